"""Documents whose sets of word n-grams are nearly equal, by signature trees.

A text's set is reduced to its distinct shingles, hashed to 64 bits.  Texts with equal sets are
one node; nodes are joined as ``signature_tree`` says and the links to components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm import signature_tree as st
from medloom.llm.common import saved
from medloom.llm.words import FOLDED, bounds, hashes, shingles, texts, together

SHINGLE = 3
PERCENT = 90


def shingle_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, whole: bool = False) -> DataFrame:
    """``doc_id, node, short, n`` and ``keys`` of each text or, with ``whole``, ``tokens`` of each set.

    ``tokens`` are its distinct shingles, ``keys`` name the shards by which links are
    found.  ``node`` names the set; its first half is ``short``.  A text without words has
    no node.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = "tokens" if whole else "keys"

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            data, at = texts(batch.column("text"))
            for i, j in together(at):
                start, end, n = bounds(data, at[i : j + 1])
                text, value = shingles(hashes(data, start, end, FOLDED), np.cumsum(n), size)
                values, _, sizes = st.distinct_tokens(text, value, j - i)
                listed, counts = (values, sizes) if whole else st.segment_keys(values, sizes, percent)
                out = st.set_batch(batch.column("doc_id").slice(i, j - i), values, sizes, listed, counts, kept)
                yield st.fresh(out, seen) if whole else out

    return docs.select("doc_id", "text").mapInArrow(draw, st.set_schema(kind, kept))


def ngram_join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, small: int = st.SMALL, block: int = st.BLOCK) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Words are what ASCII white space separates, after lower-casing A-Z.  Two documents
    link when ``100 * intersection >= percent * union`` of their sets of ``size``-word
    shingles; a text of fewer words is one shingle.  ``component_id`` is the least
    ``doc_id`` that links lead to.  A text that is null or has no words links with nothing.  Rows
    with a null ``doc_id`` link like others, but name no component: theirs is null if
    nothing else is in it.  Rows that repeat a ``doc_id`` are answered each.  Other
    columns are ignored.
    """
    drawn = saved(shingle_sets(docs, size, percent), "segments")
    whole = lambda d: shingle_sets(d, size, percent, whole=True)
    placed = st.document_classes(docs, drawn, whole, percent, small, block).withColumnRenamed("n", "n_shingles")
    classes = saved(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "classes")
    alone = drawn.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.join(classes, "root").select("doc_id", "n_shingles", "component_id").unionByName(alone)
