"""Corpus curation and evaluation analytics as DataFrame operations."""
