"""Readers and writers: databases, sheets, JSON APIs, files."""
