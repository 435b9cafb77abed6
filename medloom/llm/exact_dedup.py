"""Exact duplicates through an extendible-hash index kept in shared files.

1. The different 64-bit keys of the texts are counted by their leading bits.  A directory
   over these bits doubles where a bucket holds more than ``capacity`` keys.
2. Each task combines the rows it has of one text, so a text that a third of all rows
   repeat is one entry for each task.
3. Entries go to the owner of their bucket and key range.  There those of one key are
   compared by their bytes: equal ones are one text, whose largest id stays; others
   are chained.  The index, without the texts, is written to the shared folder.
4. Every row looks its slot, bucket and chain up; in a chain it finds its text by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import bits_for, fold, saved

#: the directory has 2 ** 16 slots at most (about 1 MB), so it may be broadcast; buckets
#: of that depth may hold more than the capacity
MAX_DEPTH = 16
#: keys in a bucket
CAPACITY = 256


def _slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, depth: int, capacity: int) -> DataFrame:
    """``slot -> bucket`` after doubling: one row for each of 2 ** depth slots.

    A bucket of local depth d is the node of a binary tree, numbered
    ``2 ** d + leading bits``.  A node is split while it holds more than
    ``capacity`` entries, so a slot's local depth is the number of overfull nodes
    above it.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(depth - 1, 0)))).alias("d")
    node = F.expr(f"shiftleft(1L, d) + shiftright(slot, {depth} - d)")
    cells = entries.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n"))
    overfull = (
        cells.select("slot", "n", levels)
        .groupBy(node.alias("node"))
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > capacity)
        .select("node")
    )
    slots = entries.sparkSession.range(1 << depth).withColumnRenamed("id", "slot")
    split = (
        slots.select("slot", levels)
        .select("slot", node.alias("node"))
        .join(overfull, "node", "left_semi")
        .groupBy("slot")
        .agg(F.count("*").cast("int").alias("local"))
    )
    local = F.least(F.coalesce("local", F.lit(0)), F.lit(depth))
    return slots.join(split, "slot", "left").select(
        "slot", local.alias("local_depth")
    ).select(
        "slot", F.expr(f"shiftleft(1L, local_depth) + shiftright(slot, {depth} - local_depth)").alias("bucket")
    )


def build_index(rows: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, int]:
    """Index of ``rows(id, t, key)``: the written index, its directory, its depth.

    The index has ``bucket, key, chain``; ``chain`` lists the entries of a key, one
    for each different text: ``digest, keep_id, group_size``.
    """
    keys = saved(rows.select("key").distinct(), "keys")
    count = keys.count()
    # three levels more than evenly filled buckets would need
    depth = bits_for(count, capacity, MAX_DEPTH - 3)
    depth = depth + 3 if depth else 0
    slots = saved(directory(keys, depth, capacity).coalesce(1), "directory")
    combined = (
        rows.withColumn("task", F.spark_partition_id()).groupBy("key", "t", "task")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .withColumn("slot", _slot(F.col("key"), depth))
        .join(F.broadcast(slots), "slot")
        .select("bucket", "key", "t", "keep_id", "group_size")
    )
    # all that follows stays with the owner of the range
    chained = (
        combined.repartitionByRange("bucket", "key").groupBy("bucket", "key", "t")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select("bucket", "key", F.struct(F.sha2(F.col("t").cast("binary"), 256).alias("digest"), "keep_id", "group_size").alias("entry"))
        .groupBy("bucket", "key").agg(F.sort_array(F.collect_list("entry")).alias("chain"))
    )
    return saved(chained.sortWithinPartitions("bucket", "key"), "index"), slots, depth


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null is the empty text.
    The row with the largest ``doc_id`` stays.  Rows that repeat that ``doc_id``
    within a group are one document and all stay; a group whose ids are all null
    has no id to point at and stays too.  Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").alias("id"), fold(F.coalesce(F.col("text"), F.lit(""))).alias("t")
    ).withColumn("key", F.xxhash64("t"))
    index, slots, depth = build_index(rows, capacity)
    asked = rows.select(
        "id", "key", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), _slot(F.col("key"), depth).alias("slot")
    ).join(F.broadcast(slots), "slot")
    entry = F.filter("chain", lambda e: e["digest"] == F.col("digest"))[0]
    return asked.join(index, ["bucket", "key"]).withColumn("entry", entry).select(
        F.col("id").alias("doc_id"),
        F.col("entry.keep_id").alias("keep_id"),
        F.col("entry.group_size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("entry.keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
