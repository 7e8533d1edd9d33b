"""Operators of a training-data pipeline over whole corpora. Nothing else in the library imports this package."""
