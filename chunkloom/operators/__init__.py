"""Relational operators over documents and their blocks."""
