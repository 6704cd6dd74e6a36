"""Structured Streaming over quad files."""
