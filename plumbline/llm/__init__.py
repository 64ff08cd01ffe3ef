"""Operators for large training corpora of case narratives. Nothing else in the library imports this package."""
