"""Governed and semantic plans."""
