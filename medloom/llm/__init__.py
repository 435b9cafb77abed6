"""Operators for corpora of training texts; nothing else in the library uses them."""
