"""Writers.  All but the per-note files are Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.sources.formats import register

ENTITY_FIELDS = ("text", "type", "assertions", "position", "candidates")


def entity_struct() -> Column:
    """The output record; a null candidate list leaves the key out of the JSON."""
    return F.struct(
        F.col("text"),
        F.col("type"),
        F.col("assertions"),
        F.array("start", "end").alias("position"),
        F.col("candidates"),
    )


def note_records(notes: DataFrame, entities: DataFrame, order: str = "entity_idx") -> DataFrame:
    """``[doc_id, entities]``; notes without entities keep an empty list."""
    per_note = entities.groupBy("doc_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), entity_struct().alias("e")))),
            lambda x: x["e"],
        ).alias("entities")
    )
    return (
        notes.select("doc_id")
        .join(per_note, "doc_id", "left")
        .withColumn("entities", F.coalesce("entities", F.array()))
    )


def note_json(notes: DataFrame, entities: DataFrame, order: str = "entity_idx") -> DataFrame:
    """``[doc_id, json]`` with one JSON array per note."""
    return note_records(notes, entities, order).select(
        "doc_id", F.to_json("entities").alias("json")
    )


def write_note_files(df: DataFrame, folder: str) -> None:
    """One indented ``<doc_id>.json`` per note, on any file system that Arrow reaches.

    Files appear when all are written; a job that fails leaves none.
    """
    register(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("string").alias("doc_id"), "json")
    rows.write.format("note_files").mode("append").save(folder)


def write_note_folders(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder ``doc_id=<id>`` per note with its JSON, for ids that are no file names."""
    df.select("doc_id", F.col("json").alias("value")).write.mode(mode).partitionBy("doc_id").text(path)


def write_note_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The same records as JSON lines, the layout for large note sets."""
    df.write.mode(mode).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Materialise unless the target is already there."""
    df.write.mode("ignore").parquet(path)


def conll_block(tokens: Column) -> Column:
    """``word<TAB>tag`` lines; with the writer's line end a blank line follows."""
    lines = F.transform(tokens, lambda t: F.concat(t["word"], F.lit("\t"), t["tag"]))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def write_conll(df: DataFrame, path: str, tokens: str = "tokens", mode: str = "overwrite") -> None:
    df.select(conll_block(F.col(tokens)).alias("value")).write.mode(mode).text(path)
