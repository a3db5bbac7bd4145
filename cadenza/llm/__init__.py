"""Operators for preparing training corpora, kept apart from the rest of the library."""
