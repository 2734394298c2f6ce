"""Lazy operators over version logs and resolved key-value tables."""
