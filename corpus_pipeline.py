"""A corpus pipeline: each stage applies one operator to what the one before kept.

Stages take ``(spark, docs, sf_dir)``.  All but the last return the columns of the
documents; the last returns the mix.  ``run`` writes what a stage keeps to the
shared folder and reads it back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm.common import saved
from medloom.llm.decontaminate import find_hits
from medloom.llm.line_dedup import dedup_lines
from medloom.llm.mixing import mix
from medloom.llm.near_dedup import near_dedup
from medloom.llm.toxicity import score, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, does not call toxic."""
    model = train(docs, _table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur from the second document on go; a document without any left too."""
    cleaned = dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.col("n_dropped") == F.col("n_lines"))
    return cleaned.where(~emptied).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays.

    A ``doc_id`` that several rows share stays if any of them does.
    """
    gone = near_dedup(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept"))
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = find_hits(docs, _table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the words it takes of each."""
    return mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: a fitted model and signatures have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
