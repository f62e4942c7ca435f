"""Operators for large text and embedding corpora, their queries and SQL."""
