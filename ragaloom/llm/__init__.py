"""Operators that prepare text and catalog records as training data. Nothing else in the library imports this package."""
