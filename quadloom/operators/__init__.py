"""Operators that are more than one DataFrame expression."""
