"""Vector arithmetic on array columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medloom.functions.text import let


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(v: Column) -> Column:
    """Scale to length one; a zero vector stays zero."""
    return let(
        norm(v),
        lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))),
    )


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean over positions whose mask is set (at least 1e-9 in the divisor)."""
    count = F.greatest(_total(F.transform(mask, lambda m: m.cast("double"))), F.lit(1e-9))
    weighted = F.zip_with(
        vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m)
    )
    dims = F.size(F.get(vectors, F.lit(0)))
    summed = let(
        weighted,
        lambda w: F.transform(
            F.sequence(F.lit(0), dims - 1),
            lambda d: _total(F.transform(w, lambda v: F.get(v, d))),
        ),
    )
    return let(count, lambda n: F.transform(summed, lambda s: s / n))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))
