"""Near duplicates with ProbMinHash signatures, banding and verification.

1. A text is its weighted set of five-word shingles, a shingle that occurs c times having
   weight 1 + ln(c).  Each shingle is a Poisson process with its weight as rate; arrivals fall
   on registers at random and the earliest arrival on a register wins it.  Two texts win a
   register with the same shingle with the probability Jaccard similarity of their
   weights.  A process ends once its next arrival is later than all registers' winners.
2. Links are decided on sets, and texts that repeat shingles may have much lower weighted
   similarity.  So the same processes are also run at rate 1, whose winners agree with
   the probability of the set similarity; without repeats both are the same.
3. Texts with equal sets are one node.  Nodes that agree on all registers of a band, of
   either kind, meet in a bucket.
4. Buckets are the shards of ``signature_tree``: members are compared with the most central
   one; small buckets compare what is left in pairs, members of large ones are dealt
   anew by their rarest shingles.  So a pair that shares a bucket is compared or in one class
   already, and texts that share only what all of a bucket have never meet.
5. Pairs are verified on their sets of shingles: Jaccard similarity 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm import signature_tree as st
from medloom.llm.common import WORD, fold, saved
from medloom.llm.words import FOLDED, MARKS, MIX1, bounds, hashes, mix, shingles, texts, together
from medloom.llm.words import STEP_BY as STEP

SHINGLE = 5
PERCENT = 80
SIMILARITY = PERCENT / 100
#: 32 bands of 6 registers miss a pair of similarity 0.8 once in 16,000, of 0.85
#: once in three million
BANDS = 32
ROWS = 6
#: texts that are sketched at once; each has all its registers
TEXTS = 2048


def prob_min_hash(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Winning shingles, a row of registers per text.

    ``text`` is sorted.  All processes move to their next arrival together; those
    whose arrival is later than the last register of their text end.
    """
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    limit = np.full(texts, np.inf)
    time, turn = np.zeros(len(text)), 0
    while len(text):
        turn += 1
        drawn = mix(value + np.uint64(turn * int(STEP) % 2**64))
        # the upper 53 bits give the waiting time, a second draw the register
        time = time - np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        alive = time < limit[text]
        text, value, weight, time, drawn = (x[alive] for x in (text, value, weight, time, drawn))
        at = text * registers + (mix(drawn + STEP) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        winner[at[won]] = value[won]
        if turn < 16 or turn % 8 == 0:
            open_texts = text[np.flatnonzero(np.diff(text, prepend=-1))]
            limit[open_texts] = earliest.reshape(texts, registers)[open_texts].max(axis=1)
    return winner.reshape(texts, registers)


def band_keys(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for the winners of each band; bands never share keys."""
    folded = np.arange(1, bands + 1, dtype=np.uint64) * MIX1
    for i in range(rows):
        folded = mix(folded * STEP + winner.reshape(len(winner), bands, rows)[:, :, i])
    return folded.view(np.int64)


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of texts that lie end to end, and how many each text has.

    Those at rate 1, then those of the weighted processes that differ.
    """
    plain = band_keys(prob_min_hash(text, value, np.ones(len(text)), texts, bands * rows), bands, rows)
    repeats = np.unique(text[weight > 1])
    if not len(repeats):
        return plain.reshape(-1), np.full(texts, bands)
    place = np.full(texts, -1)
    place[repeats] = np.arange(len(repeats))
    mine = place[text] >= 0
    drawn = prob_min_hash(place[text[mine]], value[mine], weight[mine], len(repeats), bands * rows)
    weighted = band_keys(drawn, bands, rows)
    shown = np.concatenate((np.ones(plain.shape, bool), np.zeros(plain.shape, bool)), axis=1)
    keys = np.concatenate((plain, plain), axis=1)
    keys[repeats, bands:] = weighted
    shown[repeats, bands:] = weighted != plain[repeats]
    return keys[shown], shown.sum(axis=1)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, whole: bool = False) -> DataFrame:
    """``doc_id, node, short, n`` and band ``keys`` or, with ``whole``, a row with the ``tokens`` of each set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            data, at = texts(batch.column("text"))
            for i, j in together(at, many=TEXTS):
                start, end, words = bounds(data, at[i : j + 1], MARKS)
                text, value = shingles(hashes(data, start, end, FOLDED), np.cumsum(words), SHINGLE)
                values, weights, sizes = st.distinct_tokens(text, value, j - i)
                if whole:
                    listed, counts = values.view(np.int64), sizes
                else:
                    listed, counts = signatures(np.repeat(np.arange(j - i), sizes), values, 1 + np.log(weights), j - i, bands, rows)
                    counts = np.where(sizes > 0, counts, 0)
                    listed = listed[np.repeat(sizes > 0, np.where(sizes > 0, counts, bands))]
                out = st.set_batch(batch.column("doc_id").slice(i, j - i), values, sizes, listed, counts, "tokens" if whole else "keys")
                yield st.fresh(out, seen) if whole else out

    return docs.select("doc_id", "text").mapInArrow(draw, st.set_schema(kind, "tokens" if whole else "keys"))


def near_dedup(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, small: int = st.SMALL) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``.

    ``class_id`` is the least ``doc_id`` of the class, the document that is kept;
    ``class_size`` counts rows.  Texts are compared by their words after lower-casing
    A-Z.  Documents without words (null, empty, punctuation) are each a class of
    their own, as is a row with a null ``doc_id``, whose class is null.  Rows that
    repeat a kept ``doc_id`` within a class are one document and all kept.  Other
    columns are ignored.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    drawn = saved(sketch(known, bands, rows), "sketches")
    placed = st.document_classes(known, drawn, lambda d: sketch(d, whole=True), percent, small=small)
    classes = saved(
        placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes"
    )
    found = placed.join(classes, "root").select("doc_id", "class_id", "class_size")
    wordless = ~F.coalesce(fold(F.col("text")).rlike(WORD), F.lit(False)) | F.col("doc_id").isNull()
    alone = docs.where(wordless).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
