"""Text columns, the shared folder and intermediate tables of the corpus operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word: digits, letters and everything beyond ASCII, after ``fold``
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: a run of characters that are not ASCII white space
TOKEN = r"[^\x20\x09-\x0D]+"


def fold(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII text takes the faster built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    kept = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(kept)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and
    whatever was non-deterministic in the plan is settled.  A join with it shuffles
    both sides anew, so Spark can split a hot key of the other side, which it cannot
    do against an aggregate that is already dealt out by that key.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 20_000) -> DataFrame:
    """Deal rows that stand for files or blocks out to a task each, in key order.

    Spark would merge such small rows into one task.  Beyond ``most`` tasks each
    takes several.
    """
    return df.repartitionByRange(max(1, min(rows, most)), *keys)


def shipped(spark: SparkSession, value):
    """Broadcast a value of this package's classes; a function that loads it in a task.

    It travels with its classes, so workers need not be able to import them.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load():
        return cloudpickle.loads(data.value)

    return load


def bits_for(rows: int, per_cell: int, most: int) -> int:
    """The least number of bits that give at least ``rows / per_cell`` cells."""
    return min(most, max(0, (max(rows, 1) // per_cell).bit_length()))
