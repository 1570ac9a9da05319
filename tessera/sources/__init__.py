"""Scans, parsers and writers."""
