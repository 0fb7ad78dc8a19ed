"""Readers and writers for logs, reports, dictionaries and verdict tables."""
