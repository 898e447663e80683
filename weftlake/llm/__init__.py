"""Operators for large collections of text."""
