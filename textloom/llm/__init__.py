"""Operators for large text collections; nothing else of textloom imports this package."""
