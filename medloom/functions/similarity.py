"""String similarity: gestalt ratio and word error rate."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.functions import text as tx


def _ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


@F.pandas_udf(T.DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two lower-cased strings; 0 if one is empty."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _best_of(query: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series(
        [
            max((_ratio(q, n) for n in (ns if ns is not None else ())), default=0.0)
            for q, ns in zip(query, names)
        ],
        dtype="float64",
    )


def synonyms(*cells: Column) -> Column:
    """All names in a dictionary row: cells split at `|`, without empty ones.

    Python prints a missing cell as ``nan``; such cells are left out.
    """
    usable = F.filter(
        F.array(*[c.cast("string") for c in cells]),
        lambda c: c.isNotNull() & (c != "") & (c != "nan"),
    )
    return F.flatten(F.transform(usable, lambda c: F.split(c, r"[|]")))


def best_lexical(query: Column, *cells: Column) -> Column:
    """Best gestalt ratio of ``query`` to any name in a dictionary row."""
    return _best_of(query, synonyms(*cells))


def best_overlap(query: Column, *cells: Column) -> Column:
    """Best token overlap of ``query`` with any name in a dictionary row."""
    return F.coalesce(
        F.array_max(F.transform(synonyms(*cells), lambda n: tx.token_jaccard(query, n))), F.lit(0.0)
    )


#: code points that are left for words; a pair of texts with more is an error
MOST_WORDS = 0x10FFFF - 0x10000


def _as_code_points(tokens: Column, vocabulary: Column) -> Column:
    """One code point per word, so edit distance over words is over characters."""

    def encode(w: Column) -> Column:
        code = F.lit(0x10000) + F.array_position(vocabulary, w)
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    return F.array_join(F.transform(tokens, encode), "")


def word_error_rate(gold: Column, pred: Column) -> Column:
    """Word edit distance over the number of gold words.

    An empty gold text costs 0 against an empty prediction and 1 otherwise.
    """

    def rate(g: Column) -> Column:
        def against(p: Column) -> Column:
            def encoded(v: Column) -> Column:
                edits = F.levenshtein(_as_code_points(g, v), _as_code_points(p, v))
                return (
                    F.when(F.size(g) > 0, edits / F.size(g))
                    .when(F.size(p) > 0, F.lit(1.0))
                    .otherwise(F.lit(0.0))
                )

            many = F.raise_error(F.lit("more different words than word_error_rate can number"))
            vocabulary = tx.let(
                F.array_distinct(F.concat(g, p)),
                lambda v: F.when(F.size(v) > MOST_WORDS, many.cast("array<string>")).otherwise(v),
            )
            return tx.let(vocabulary, encoded)

        return tx.let(tx.words(pred), against)

    return tx.let(tx.words(gold), rate)
