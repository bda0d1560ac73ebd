"""Readers, payload parsers, table maintenance and writers."""
