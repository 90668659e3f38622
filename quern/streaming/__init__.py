"""Structured Streaming over event tables. An extension: windows, sessions, deduplication and learning from batches."""
