"""Token counts of flat token files found by scanning for the separator.

``write_tokens`` stores tokenised documents as bare arrays of 16-bit ids, each
document ended by the end-of-document id; nothing says where a document starts.
``scan`` cuts such files into blocks of equal size that any task can read, finds the
separators of a block at once with NumPy, and stitches documents that cross blocks:
a prefix sum over the blocks' separator counts numbers the documents of a file, and
the parts of a document add up under its number.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from medloom.llm.common import dealt, new_folder, saved

#: a rank file of byte-level BPE; fewer than 65,536 ids
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: how such files split a text before merging
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: the end-of-document id, which no token has
SEPARATOR = 50256
TOKEN_BYTES = 2
BLOCK_BYTES = 1 << 20
#: neighbouring blocks that a task reads
BLOCKS_OF_A_TASK = 16
FILE_TOKENS = 32 << 20


def load(ranks: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file; special tokens' strings are ordinary text."""
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, ranks: str = RANKS, separator: int = SEPARATOR, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Token files of the texts, and where they went: ``doc_id, path, ordinal``.

    ``ordinal`` counts the documents of a file from 0.  A null text is written as
    an empty document.  Files are named at random and listed in a table that Spark
    commits; a task that runs again writes new ones.
    """
    placed = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("path", pa.string()), ("ordinal", pa.int64())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(ranks)
        where, path = files.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        out, size, ordinal, name = None, 0, 0, ""
        end = np.array([separator], "<u2").tobytes()
        for batch in batches:
            ids, names, ordinals = batch.column("doc_id"), [], []
            for text in batch.column("text"):
                if out is None:
                    name = uuid.uuid4().hex
                    out, size, ordinal = where.open_output_stream(f"{path}/{name}.tokens"), 0, 0
                tokens = encoding.encode_ordinary(text.as_py() or "")
                out.write(np.array(tokens, "<u2").tobytes() + end)
                names.append(f"{folder}/{name}.tokens")
                ordinals.append(ordinal)
                ordinal, size = ordinal + 1, size + len(tokens) + 1
                if size >= file_tokens:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([ids.cast(placed.field("doc_id").type), pa.array(names, pa.string()), pa.array(ordinals, pa.int64())], schema=placed)
        if out is not None:
            out.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return saved(docs.select("doc_id", "text").mapInArrow(write, f"doc_id {kind}, path string, ordinal long"), "placed")


def blocks_of(paths: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, block, start, length`` of the distinct files in ``paths(path)``."""

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            found = []
            for name in names:
                where, at = files.FileSystem.from_uri(name)
                found.append(where.get_file_info(at).size)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.int64())], ["path", "size"])

    count = F.expr(f"sequence(0L, (size - 1) div {block_bytes}L)")
    named = saved(paths.select("path").distinct(), "paths")
    return (
        dealt(named, named.count(), "path", most=1000)
        .mapInArrow(sizes, "path string, size long")
        .where(F.col("size") > 0)
        .select("path", "size", F.explode(count).alias("block"))
        .select(
            "path", "block", (F.col("block") * block_bytes).alias("start"),
            F.least(F.lit(block_bytes), F.col("size") - F.col("block") * block_bytes).alias("length"),
        )
    )


def pieces(ids: np.ndarray, separator: int) -> np.ndarray:
    """Tokens before, between and after the separators of a block."""
    at = np.flatnonzero(ids == separator)
    return np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1


def scan(paths: DataFrame, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, ordinal, n_tokens`` of every document in the files of ``paths(path)``.

    Tokens behind the last separator of a file are a document too, unless there are
    none.  A document without tokens counts 0; an empty file has no documents.
    Files need a whole number of tokens; ``block_bytes`` is a multiple of a token.
    """

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, at = files.FileSystem.from_uri(row["path"])
                with where.open_input_file(at) as source:
                    source.seek(row["start"])
                    ids = np.frombuffer(source.read(row["length"]), "<u2")
                counts = pieces(ids, separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["block"]]), pa.array([len(counts) - 1]), pa.array([counts.tolist()], pa.list_(pa.int64()))],
                    ["path", "block", "ends", "counts"],
                )

    cuts = saved(blocks_of(paths, block_bytes), "cuts")
    found = saved(
        dealt(cuts, -(-cuts.count() // BLOCKS_OF_A_TASK), "path", "block")
        .mapInArrow(look, "path string, block long, ends long, counts array<long>"),
        "blocks",
    )
    before = F.coalesce(
        F.sum("ends").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    # numbers only: the counts of a large file never meet in one task
    first = found.select("path", "block", before.alias("first"))
    return (
        found.join(first, ["path", "block"])
        .select("path", "first", "ends", F.posexplode("counts").alias("i", "n"))
        .groupBy("path", (F.col("first") + F.col("i")).alias("ordinal"))
        # a part that ends at a separator makes the document exist
        .agg(F.sum("n").alias("n_tokens"), F.max(F.col("i") < F.col("ends")).alias("ended"))
        .where(F.col("ended") | (F.col("n_tokens") > 0))
        .select("path", "ordinal", "n_tokens")
    )


def count_tokens(docs: DataFrame, ranks: str = RANKS, folder: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens``, one row per document, by writing and scanning files.

    The files stay in ``folder`` (default: a new shared one).  Null and empty texts
    have 0 tokens; rows that repeat a ``doc_id`` are counted apart.
    """
    placed = write_tokens(docs, folder or new_folder(docs.sparkSession, "tokens"), ranks)
    counted = scan(placed, SEPARATOR, block_bytes)
    return placed.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
