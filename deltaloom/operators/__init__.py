"""Relational operators over ordered text, code facts, graphs, terms and state."""
