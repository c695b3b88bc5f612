"""Operators for training-data corpora, apart from the rest of the library."""
