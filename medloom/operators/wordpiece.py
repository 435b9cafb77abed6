"""Sub-word pieces of words over a vocabulary, the longest first.

A vocabulary as large as a chunk's is held by each worker.  Any other is entered by rows:
every stretch of a word that may be a piece meets it in an equi join, so neither side has to
fit anywhere.  Distinct words are cut once.  From each place of a word only the longest
piece counts, and the chain of places from the start is followed within the word's row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import text as tx
from medloom.functions.text import portions
from medloom.session import durable

UNKNOWN = "[UNK]"
#: mark of a piece that goes on with a word
INSIDE = "##"
#: a longer word is unknown
MOST_CHARS = 100


def _stretches(word: Column, longest: int) -> Column:
    """``struct<at,length,piece>`` of all stretches of up to ``longest`` characters."""
    size = F.length(word)

    def at(i: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.least(F.lit(longest), size - i))
        mark = F.when(i > 0, INSIDE).otherwise("")
        return F.transform(
            lengths,
            lambda n: F.struct(i.alias("at"), n.alias("length"), F.concat(mark, F.substring(word, i + 1, n)).alias("piece")),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), size - 1), at))


def _chain(found: Column, size: Column) -> Column:
    """Pieces of the chain from place 0; null if it does not reach the end.

    ``found``: the longest piece of each place that has one, in order.
    """
    empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("pieces"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct((x["at"] + x["length"]).alias("next"), F.concat(acc["pieces"], F.array(x["piece"])).alias("pieces"))
        return F.when(x["at"] == acc["next"], taken).otherwise(acc)

    return F.aggregate(found, empty, step, lambda acc: F.when(acc["next"] == size, acc["pieces"]))


def wordpieces(words: DataFrame, vocabulary: DataFrame, longest: int = MOST_CHARS, most_chars: int = MOST_CHARS) -> DataFrame:
    """``word, pieces`` of the distinct words of ``words(word)``.

    ``vocabulary(piece)``: pieces at a word's start as they are, others behind ``##``, of up to
    ``longest`` characters.  A word that cannot be cut, or of more than ``most_chars``
    characters, is one unknown piece.  Null words are left out, the empty word has no piece.
    """
    distinct = words.select("word").where(F.col("word").isNotNull()).distinct()
    usual = distinct.where((F.length("word") > 0) & (F.length("word") <= most_chars))
    known = vocabulary.select("piece").where(F.col("piece").isNotNull()).distinct()
    met = tx.staged(usual, _stretches(F.col("word"), longest).alias("all")).select("word", F.explode("all").alias("s"))
    found = met.select("word", "s.at", "s.length", F.col("s.piece").alias("piece")).join(known, "piece")
    best = found.groupBy("word", "at").agg(F.max(F.struct("length", "piece")).alias("b"))
    chains = best.groupBy("word").agg(
        F.sort_array(F.collect_list(F.struct("at", F.col("b.length").alias("length"), F.col("b.piece").alias("piece")))).alias("found")
    ).select("word", _chain(F.col("found"), F.length("word")).alias("pieces"))
    unknown = F.when(F.length("word") > 0, F.array(F.lit(UNKNOWN))).otherwise(F.array().cast("array<string>"))
    return distinct.join(chains, "word", "left").select("word", F.coalesce("pieces", unknown).alias("pieces"))


#: words that share a lookup, a chunk ends with the sentence that reaches it; pieces held by a worker at most
CHUNK_WORDS = 200_000


def _asked(words: pa.Array, longest: int, most_chars: int) -> list[str]:
    """Distinct stretches of ``words`` that may be pieces."""
    size = pc.utf8_length(words)
    usual = pc.less_equal(size, most_chars)
    words, size = words.filter(usual), size.filter(usual)
    # the longest stretch from each place, then what it starts with
    at, first, later = 0, pa.array([], pa.string()), [pa.array([], pa.string())]
    while len(words):
        found = pc.utf8_slice_codeunits(words, at, at + longest).unique()
        if at:
            later.append(found)
        else:
            first = found
        at += 1
        goes_on = pc.greater(size, at)
        words, size = words.filter(goes_on), size.filter(goes_on)

    def begins(stretches: pa.Array) -> set[str]:
        lengths = range(1, min(longest, pc.max(pc.utf8_length(stretches)).as_py() or 0) + 1)
        return set().union(*(pc.utf8_slice_codeunits(stretches, 0, n).unique().to_pylist() for n in lengths))

    return sorted((begins(first) | {INSIDE + s for s in begins(pa.concat_arrays(later).unique())}) - {""})


def _cut(word: str, known: set[str], inside: set[str], longest: int, most_chars: int) -> list[str]:
    """Pieces of a word, the longest first at each place; ``inside`` are those behind a mark."""
    size = len(word)
    if size > most_chars:
        return [UNKNOWN]
    pieces, at = [], 0
    while at < size:
        end = min(at + longest, size)
        some = inside if at else known
        while (piece := word[at:end]) not in some:
            end -= 1
            if end == at:
                return [UNKNOWN]
        pieces.append(INSIDE + piece if at else piece)
        at = end
    return pieces


def _types(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema)


def _chunked(sentences: DataFrame, keys: list[str], longest: int, most_chars: int) -> DataFrame:
    """Rows in order of ``keys`` with the ``_chunk`` they belong to; one chunk has all rows of equal keys.

    ``_asked``, in some rows of each chunk, lists what its words need of the vocabulary.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, seen, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            tokens = batch.column(batch.schema.get_field_index("tokens"))
            sizes = tokens.value_lengths().fill_null(0).to_pylist()
            firsts, names = [], []
            for row, (key, size) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in keys)), sizes, strict=True)):
                if seen >= CHUNK_WORDS and key != last:
                    n, seen = n + 1, 0
                seen, last = seen + size, key
                name = f"{part}-{n}"
                if not names or names[-1] != name:
                    firsts.append(row)
                names.append(name)
            asked: list = [None] * batch.num_rows
            for begin, end in zip(firsts, [*firsts[1:], batch.num_rows], strict=True):
                words = pc.struct_field(tokens.slice(begin, end - begin).flatten(), "word").unique()
                asked[begin] = _asked(words.drop_null(), longest, most_chars)
            more = [pa.array(names, pa.string()), pa.array(asked, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_chunk", "_asked"])

    ordered = sentences.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(number, f"{_types(sentences)}, `_chunk`: string, `_asked`: array<string>")


def _gathered(keys: list[tuple], rows: list[list]) -> list[list]:
    """Rows of equal keys get the pieces of all of them by place; a key with a null has none."""
    all_of: dict[tuple, list] = {}
    for key, row in zip(keys, rows, strict=True):
        all_of.setdefault(key, []).extend((i, pieces) for i, pieces in enumerate(row))
    lists = {key: [] if None in key else [p for _, p in sorted(found)] for key, found in all_of.items()}
    return [lists[key] for key in keys]


def _cutter(sentences: DataFrame, vocabulary: list[str], longest: int, most_chars: int) -> Callable[[Column], Column]:
    """Pieces of each word of a sentence; the vocabulary goes to each worker once."""
    held = sentences.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<array<string>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = set(held.value)
        inside = {p.removeprefix(INSIDE) for p in known if p.startswith(INSIDE)}
        for batch in batches:
            for (words,) in portions(batch):
                yield _cut_all(words, words.flatten(), known, inside, longest, most_chars)

    return cut


def _cut_all(lists: pa.Array, words: pa.Array, known: set[str], inside: set[str], longest: int, most_chars: int) -> pa.Array:
    """Lists of pieces for the ``words`` of ``lists``, each distinct one cut once; none for a null."""
    coded = words.dictionary_encode()
    # one more entry for tokens without a word
    pieces = [*(_cut(w, known, inside, longest, most_chars) for w in coded.dictionary.to_pylist()), []]
    cuts = pa.array(pieces, pa.list_(pa.string())).take(coded.indices.fill_null(len(pieces) - 1))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), cuts)


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys get the pieces of all of them by place."""

    def gather(found: pa.Table) -> pa.Table:
        each = list(zip(*(found.column(k).to_pylist() for k in keys), strict=True))
        at = found.schema.get_field_index("pieces")
        pieces = pa.array(_gathered(each, found.column(at).to_pylist()), found.schema.field(at).type)
        return found.set_column(at, "pieces", pieces)

    return rows.groupBy(*keys).applyInArrow(gather, _types(rows))


def with_pieces(
    sentences: DataFrame, vocabulary: DataFrame, keys: list[str], longest: int = MOST_CHARS, most_chars: int = MOST_CHARS
) -> DataFrame:
    """Add ``pieces``, an array of pieces for each of ``tokens``, to rows that ``keys`` tell apart.

    A vocabulary of at most ``CHUNK_WORDS`` pieces is held by each worker, so sentences are cut
    where they are made and only their keys are shuffled, to find those that come twice.  A
    larger one is met by ``_met``.
    """
    known = vocabulary.select("piece").where(F.col("piece").isNotNull()).distinct()
    held = [r.piece for r in known.limit(CHUNK_WORDS + 1).collect()]
    if len(held) > CHUNK_WORDS:
        return _met(sentences, known, keys, longest, most_chars)
    cut = _cutter(sentences, held, longest, most_chars)
    named = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    none = F.array().cast("array<array<string>>")

    def pieces(rows: DataFrame) -> DataFrame:
        made = rows.select(*sentences.columns, cut(F.col("tokens.word")).alias("pieces"))
        return made.withColumn("pieces", F.when(named, F.col("pieces")).otherwise(none))

    again = durable(sentences.where(named).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*keys))
    count = again.count()
    if not count:
        return pieces(sentences)
    again = F.broadcast(again) if count <= CHUNK_WORDS else again
    alone, several = (sentences.join(again, keys, how) for how in ("left_anti", "left_semi"))
    return pieces(alone).unionByName(_shared(pieces(several), keys))


def _met(sentences: DataFrame, known: DataFrame, keys: list[str], longest: int, most_chars: int) -> DataFrame:
    """``with_pieces`` for a vocabulary ``known`` of any size.

    Sentences form chunks of a bounded number of words.  A chunk asks for the distinct
    stretches of its words, which meet the vocabulary in a join; with those that are pieces
    its words are cut.  So the words are made once and shuffled in their sentences.  The
    chunks are written to the checkpoint folder, as two branches read them.
    """
    chunks = durable(_chunked(sentences, keys, longest, most_chars))
    asked = chunks.select(F.col("_chunk").alias("_of"), F.explode("_asked").alias("piece"))
    found = asked.join(known, "piece").select("_of", "piece")
    names = sentences.columns

    def cut(rows: pa.Table, met: pa.Table) -> pa.Table:
        known = set(met.column("piece").to_pylist())
        inside = {p.removeprefix(INSIDE) for p in known if p.startswith(INSIDE)}
        rows = rows.combine_chunks()
        tokens = rows.column("tokens").chunk(0)
        pieces = _cut_all(tokens, pc.struct_field(tokens.flatten(), "word"), known, inside, longest, most_chars)
        each = list(zip(*(rows.column(k).to_pylist() for k in keys), strict=True))
        if len(set(each)) < len(each) or any(None in key for key in each):
            pieces = pa.array(_gathered(each, pieces.to_pylist()), pieces.type)
        return rows.select(names).append_column("pieces", pieces)

    return chunks.drop("_asked").groupBy("_chunk").cogroup(found.groupBy("_of")).applyInArrow(
        cut, f"{_types(sentences)}, `pieces`: array<array<string>>"
    )
