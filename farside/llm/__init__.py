"""Operators that prepare text, vectors, pages and media for model training."""
