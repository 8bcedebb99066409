"""Operators for training corpora. Nothing outside this package imports it."""
