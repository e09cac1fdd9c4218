"""Structured Streaming: fingerprint state per batch, event windows, sessions, duplicates within a watermark."""
