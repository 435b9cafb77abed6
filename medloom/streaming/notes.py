"""Process note files as they arrive.

The note rules need one note at a time, so there is no state and no watermark:
each micro-batch runs the batch job and writes its own folder.  A batch that is
run again after a failure overwrites the same folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medloom.sources.readers import newlines
from medloom.sources.writers import note_json


def stream_notes(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of ``[doc_id, text]`` from new text files in a folder."""
    return (
        spark.readStream.option("pathGlobFilter", "*.txt")
        .option("maxFilesPerTrigger", max_files)
        .text(path, wholetext=True)
        .select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("doc_id"),
            newlines(F.col("value")).alias("text"),
        )
    )


def run_stream(
    notes: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    """Write the JSON records of all available notes and stop.

    ``process`` maps a batch of notes to entities, as ``process_notes`` does.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        records = note_json(df, process(df))
        records.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        notes.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
