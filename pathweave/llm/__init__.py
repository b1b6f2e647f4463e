"""Operators that make a corpus of documents ready for training. Nothing else in the library imports them."""
