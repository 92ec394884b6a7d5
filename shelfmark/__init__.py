"""Shelfmark: a library search engine for book-length documents on PySpark."""

__version__ = "0.1.0"
