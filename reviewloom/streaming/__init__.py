"""Structured Streaming over landed review files."""
