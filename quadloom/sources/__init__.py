"""Readers and writers of quads."""
