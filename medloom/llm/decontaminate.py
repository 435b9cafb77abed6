"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark items: ten consecutive words, or all
words of a shorter item.  For each pattern length there is a shift table keyed by
blocks of two words: it tells how far the search may move on because no pattern has
the block nearer to its end.  Where the shift is 0 the block is a pattern's suffix;
its bucket lists patterns by their leading block, and comparing words confirms.

The tables are made from at most ``max_words`` words of items and broadcast; a
larger benchmark is searched in blocks of that size, one pass over the documents
each.  A document is searched whole, in the task that reads it; with one block
nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import WORD, fold, saved, shipped

WINDOW = 10
#: words of benchmark items in one block of patterns; tables take about 1 KB a word
MAX_WORDS = 200_000
#: the word pattern of ``common.WORD`` on UTF-8 bytes, after lower-casing A-Z
BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
HITS = "n_words long, items array<string>, starts array<int>, ends array<int>"


def words_of(text: str | None) -> list[bytes]:
    return BYTES.findall(text.encode().lower()) if text else []


class Table(NamedTuple):
    """Patterns of one length; ``buckets``: suffix block -> leading block -> patterns."""

    length: int
    block: int
    shifts: dict[bytes, int]
    buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], list[str]]]]]


def compile_tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[Table]:
    """Tables for ``(item_id, text)`` pairs, one for each pattern length."""
    owners: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            owners.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(item)
    tables = []
    for length, patterns in sorted(owners.items()):
        block = min(2, length)
        shifts: dict[bytes, int] = {}
        buckets: dict[bytes, dict[bytes, list]] = {}
        for pattern, ids in patterns.items():
            for end in range(block, length + 1):
                key = b" ".join(pattern[end - block : end])
                shifts[key] = min(length - end, shifts.get(key, length))
            head, tail = b" ".join(pattern[:block]), b" ".join(pattern[-block:])
            buckets.setdefault(tail, {}).setdefault(head, []).append((list(pattern), sorted(ids)))
        tables.append(Table(length, block, shifts, buckets))
    return tables


def occurrences(words: list[bytes], table: Table) -> Iterator[tuple[int, list[str]]]:
    """First word and items of every occurrence of the table's patterns."""
    length, pair = table.length, table.block == 2
    step_of, far = table.shifts.get, length - table.block + 1
    i = length - 1
    while i < len(words):
        key = words[i - 1] + b" " + words[i] if pair else words[i]
        step = step_of(key, far)
        if step:
            i += step
            continue
        start = i - length + 1
        head = words[start] + b" " + words[start + 1] if pair else words[start]
        for pattern, ids in table.buckets[key].get(head, ()):
            if words[start : i + 1] == pattern:
                yield start, ids
        i += 1


def search(text: str | None, tables: list[Table]) -> tuple[int, list[str], list[int], list[int]]:
    """Word count, sorted items found, and disjoint word spans ``[start, end)`` hit."""
    words = words_of(text)
    items: set[str] = set()
    found: list[tuple[int, int]] = []
    for table in tables:
        for start, ids in occurrences(words, table):
            items.update(ids)
            found.append((start, start + table.length))
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(found):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return len(words), sorted(items), starts, ends


def _searcher(df: DataFrame, items: DataFrame, window: int):
    """A column function that searches a text for the items, which are collected."""
    rows = [(str(r.item_id), r.text) for r in items.collect()]
    load = shipped(df.sparkSession, compile_tables(rows, window))

    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = load()
        for texts in batches:
            yield pd.DataFrame([search(t, tables) for t in texts], columns=["n_words", "items", "starts", "ends"])

    return F.pandas_udf(hits, HITS)


def _covered(starts: Column, ends: Column) -> Column:
    """Words in the union of spans sorted by start."""
    spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(state: Column, span: Column) -> Column:
        start = F.greatest(span["s"], state["upto"])
        upto = F.greatest(span["e"], state["upto"])
        return F.struct((state["n"] + F.greatest(upto - start, F.lit(0))).alias("n"), upto.alias("upto"))

    return F.aggregate(spans, zero, add, lambda state: state["n"].cast("long"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``n_words, n_hit, items, starts, ends, contaminated``.

    ``items`` lists the ids (as sorted strings) of the items with a window in the
    text, ``starts``/``ends`` the word spans inside occurrences.  Null and wordless
    texts have no words and no hits; items without words have no window; an item
    that is repeated counts once.  Columns of ``docs`` named like the added ones are
    replaced.
    """
    made = ["n_words", "n_hit", "items", "starts", "ends", "contaminated"]
    columns = [c for c in docs.columns if c not in made]
    docs = docs.select(*columns)
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.regexp_count(fold(F.col("text")), F.lit(WORD)))).first()[0] or 0
    blocks = max(1, -(-total // max_words))
    if blocks == 1:
        found = docs.withColumn("__hits", _searcher(docs, items, window)("text"))
    else:
        found = _in_blocks(docs, items, window, blocks)
    n_hit = _covered(F.col("__hits.starts"), F.col("__hits.ends"))
    return found.select(
        *columns,
        F.col("__hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        *[F.col(f"__hits.{c}").alias(c) for c in ("items", "starts", "ends")],
        (F.size("__hits.starts") > 0).alias("contaminated"),
    )


def _in_blocks(docs: DataFrame, items: DataFrame, window: int, blocks: int) -> DataFrame:
    """One pass for each block of items; hits meet on id and text hash.

    An item stays within one block unless it repeats.  Only documents with hits
    are shuffled, without their texts.
    """
    keyed = docs.withColumn("__key", F.md5(F.concat_ws("~", F.col("doc_id").cast("string"), "text")))
    passes = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        hits = keyed.select("__key", _searcher(docs, part, window)("text").alias("h")).where(F.size("h.items") > 0)
        hits = saved(hits, "hits")
        passes = hits if passes is None else passes.unionByName(hits)
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("h.starts", "h.ends")))))
    merged = passes.groupBy("__key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("__items"), spans.alias("__spans")
    )
    none = F.array().cast("array<int>")
    hits = F.struct(
        F.coalesce(F.regexp_count(fold(F.col("text")), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("__spans.starts"), none).alias("starts"),
        F.coalesce(F.col("__spans.ends"), none).alias("ends"),
    )
    return keyed.join(merged, "__key", "left").withColumn("__hits", hits)
