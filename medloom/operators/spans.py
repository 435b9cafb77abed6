"""Overlapping spans, and what spans leave uncovered.

Spans are rows with key columns (a document), ``start`` and ``end``, half open.  Rows
without both or with ``end <= start`` are no spans and are left out everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.functions import text as tx
from medloom.lexicon import VIETNAMESE, Rules


def proper(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("end") > F.col("start"))


def with_islands(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``island``: spans that overlap directly or through others share a number.

    Islands of a key are numbered from 0 in reading order.  Spans that only touch do
    not overlap.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("start") >= reached)).cast("long")
    return (
        proper(spans).withColumn("_opens", opens)
        .withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .drop("_opens")
    )


def overlap_islands(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest span of each island, with ``island`` and its ``members``.

    Ties go to the earliest, then to the least in the order of the other columns.
    """
    rest = [c for c in spans.columns if c not in (*keys, "start", "end")]
    found = with_islands(spans, keys)
    rank = F.struct((F.col("start") - F.col("end")).alias("n"), "start", *rest)
    whole = F.struct("start", "end", *rest)
    return (
        found.groupBy(*keys, "island").agg(F.min_by(whole, rank).alias("_row"), F.count("*").alias("members"))
        .select(*keys, "island", "_row.*", "members")
    )


def best_disjoint(starts: Column, ends: Column, weights: Column) -> Column:
    """Positions of the disjoint spans with the greatest total weight, in reading order.

    Spans sorted by end and start are taken in turn: the best up to a span is that
    without it, or its weight with the best up to the last span that ends before it
    starts, if that is more.  Back pointers give the choice.  Spans of no length and
    weights that are not positive are never chosen; a null array gives null.
    """

    def choose(start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> list[int]:
        valid = np.flatnonzero((end > start) & (weight > 0))
        order = valid[np.lexsort((start[valid], end[valid]))]
        before = np.searchsorted(end[order], start[order], "right").tolist()
        best, taken = [0.0], []
        for p, w in zip(before, weight[order].tolist(), strict=True):
            taken.append(best[p] + w > best[-1])
            best.append(best[p] + w if taken[-1] else best[-1])
        chosen, i = [], len(taken)
        while i:
            i -= 1
            if taken[i]:
                chosen.append(int(order[i]))
                i = before[i]
        return chosen[::-1]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pick(s: pd.Series, e: pd.Series, w: pd.Series) -> pd.Series:
        as_floats = lambda x: np.array(x, dtype="float64")
        return pd.Series(
            [None if any(x is None for x in row) else choose(*map(as_floats, row)) for row in zip(s, e, w, strict=True)],
            dtype="object",
        )

    return pick(starts, ends, weights)


def overlap_best(spans: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """The rows of the heaviest choice of disjoint spans of each key.

    Spans of a key are put in order of end, start and their other columns, so ties do
    not depend on the plan.
    """
    rest = [c for c in spans.columns if c not in (*keys, "start", "end")]
    item = F.struct("end", "start", *rest, weight.cast("double").alias("_weight"))
    lists = proper(spans).groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_all"))
    chosen = best_disjoint(F.col("_all.start").cast("array<double>"), F.col("_all.end").cast("array<double>"), F.col("_all._weight"))
    picked = lists.withColumn("_chosen", chosen).select(
        *keys, F.explode(F.transform("_chosen", lambda i: F.get("_all", i))).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in ("start", "end", *rest)])


def gaps(spans: DataFrame, extents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches ``start, end`` of each key that no span covers.

    ``extents``: the keys with their ``size``.  Spans are cut to it; a key without
    spans is one gap.
    """
    # the end of the extent is a span of no length, so the last gap needs no case of its own
    inside = proper(spans).select(*keys, "start", "end")
    bounded = inside.join(extents.select(*keys, "size"), list(keys)).where(F.col("start") < F.col("size")).select(*keys, "start", "end")
    last = extents.where(F.col("size") > 0).select(*keys, F.col("size").cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    order = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.coalesce(F.max("end").over(order), F.lit(0)), F.lit(0)).cast("long")
    return (
        bounded.withColumns({c: F.col(c).cast("long") for c in ("start", "end")}).unionByName(last)
        .withColumn("_from", reached)
        .where(F.col("start") > F.col("_from"))
        .select(*keys, F.col("_from").alias("start"), F.col("start").alias("end"))
    )


def within_gaps(targets: DataFrame, free: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``targets`` with ``gap_end``, the end of the gap that their start lies in; null if covered.

    An as-of join: both sides in one order per key, each target looks back to the
    last gap.
    """
    columns = [c for c in targets.columns if c not in keys]
    wrapped = targets.select(*keys, F.col("start").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*columns).alias("_target"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("_gap"))
    empty = F.lit(None).cast(wrapped.schema["_target"].dataType)
    opened = free.select(*keys, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), empty.alias("_target"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("_gap"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_gap", ignorenulls=True).over(order)
    found = wrapped.unionByName(opened).withColumn("_last", last).where(F.col("_kind") == 1)
    inside = F.col("_at") < F.col("_last.end")
    return found.select(*keys, "_target.*", F.when(inside, F.col("_last.end")).alias("gap_end"))


#: an item of a list, and a name with its value, by their parts
LIST_ITEM = r"^(\s*(?:[-*•+]|\d+[.)])\s+)(.*\S)\s*$"
NAMED_VALUE = r"^(\s*(?:[-*•+]\s+)?)([^:]*[^:\s])(\s*:\s*)(\S.*)$"
#: a longer item is prose
ITEM_WORDS = 8


def recovery_targets(
    lines: DataFrame, keys: Sequence[str], rules: Rules = VIETNAMESE,
    list_item: str = LIST_ITEM, named_value: str = NAMED_VALUE, item_words: int = ITEM_WORDS,
) -> DataFrame:
    """Places of structured lines where a tagger may have missed something.

    ``lines``: the keys, ``start``, ``line`` and ``bounds`` (``section_bounds`` of the
    note).  Returns ``start, end, text, kind, target``; targets are

    * ``item``: the whole item of a list between the headings of present illness and
      of hospital findings, of few words, that names a symptom;
    * ``name``: what stands before a separator in the hospital section and names a test;
    * ``value``: what follows the name, up to the end of the line.
    """
    line, at = F.col("line"), F.col("start")
    present = (at >= F.col("bounds.s2")) & (at < F.col("bounds.s3"))
    hospital = at >= F.col("bounds.s3")

    def part(pattern: str, *before: int, of: int, kind: str, target: str, keep) -> Column:
        skipped = sum((F.length(F.regexp_extract(line, pattern, i)) for i in before), F.lit(0))
        text = F.regexp_extract(line, pattern, of)
        return F.when(keep(text), F.struct(
            (at + skipped).cast("long").alias("start"), (at + skipped + F.length(text)).cast("long").alias("end"),
            text.alias("text"), F.lit(kind).alias("kind"), F.lit(target).alias("target"),
        ))

    low = lambda t: tx.normalise_term(t)
    is_test = tx.any_contains(low(F.regexp_extract(line, named_value, 2)), rules.test_phrases) | low(
        F.regexp_extract(line, named_value, 2)
    ).isin(*rules.test_names)
    few = lambda t: (F.size(tx.words(t)) <= item_words) & tx.any_contains(low(t), rules.symptoms)
    found = F.array(
        part(list_item, 1, of=2, kind="TRIỆU_CHỨNG", target="item", keep=lambda t: present & line.rlike(list_item) & few(t)),
        part(named_value, 1, of=2, kind="TÊN_XÉT_NGHIỆM", target="name", keep=lambda t: hospital & line.rlike(named_value) & is_test),
        part(named_value, 1, 2, 3, of=4, kind="KẾT_QUẢ_XÉT_NGHIỆM", target="value", keep=lambda t: hospital & line.rlike(named_value) & is_test),
    )
    return lines.select(*keys, F.explode(F.array_compact(found)).alias("_t")).select(*keys, "_t.*")


def recovered_mentions(mentions: DataFrame, extents: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Further mentions ``start, end, text, kind`` in the gaps between those that exist.

    An item or a name must lie in one gap whole; a value is cut where the next mention
    begins.  Trailing blanks go.  So none overlaps a mention, or another one.
    """
    free = within_gaps(targets, gaps(mentions, extents, keys), keys).where(F.col("gap_end").isNotNull())
    cut = F.when(F.col("target") == "value", F.least("end", "gap_end")).otherwise(F.col("end"))
    text = tx.rstrip(F.substring("text", F.lit(1), (cut - F.col("start")).cast("int")))
    return (
        free.where(cut <= F.col("gap_end")).withColumn("text", text).where(F.col("text") != "")
        .select(*keys, "start", (F.col("start") + F.length("text")).alias("end"), "text", "kind")
    )
