"""Readers that tolerate the usual variety of ledgers, change lists, dictionaries, source trees and requirements."""
