"""Readers and writers for notes, corpora, terminology and results."""
