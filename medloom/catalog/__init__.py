"""Registered queries over the given tables, each next to its SQL."""

from medloom.catalog import corpora, joins, matching, notes, scores, sequences, spans, text, vectors  # noqa: F401
from medloom.catalog.registry import ORACLES, QUERIES  # noqa: F401
