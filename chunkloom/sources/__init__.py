"""Readers and parsers of documents."""
