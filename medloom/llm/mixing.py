"""Mix sources to target weights by hash-random keys and exact word budgets.

Documents get a hash-random key.  The key range is cut into cells of equal width
that hold a few thousand rows each; cell sums give every cell its offset within
its source, and a window inside the cell gives every document the number of words
before it.  A source of any size is thus sorted in many small tasks, and the
budget is cut at an exact word without a source ever meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import TOKEN, bits_for

#: weights of the sources in code-point order, repeating
WEIGHTS = (5, 2, 1)
#: a source gives this many times its size at most
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` -> also ``target, budget``; one row per source.

    All targets add up to all sizes.  A target over ``max_epochs`` sizes stops
    there and the excess goes to the others by weight until none is above: every
    target is ``min(cap, level * weight)``.  With sources ordered by cap/weight,
    the level is the greatest of what is left per weight after the first k caps.
    Windows without partitions run over one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", pick.cast("long").alias("weight"))
    by_cap = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    cap = F.col("source_size") * max_epochs
    before = F.coalesce(F.sum(cap).over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left_weight = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    every = W.partitionBy()
    return (
        weighed.withColumn("level", (F.sum("source_size").over(every) - before) / left_weight)
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "target", F.round("target").cast("long").alias("budget"))
    )


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, per_cell: int = 4096) -> DataFrame:
    """The rows of ``docs`` with ``size, source_size, target, taken``.

    ``taken`` counts the words the mix takes of a document: all of it for every
    whole epoch of its source, and in the last epoch what is left of the budget
    when the document's turn comes, so the document at the cut gives its first
    words only.  Null texts and texts of white space have size 0.  A null source
    is a source, ordered last.  Rows that repeat a ``doc_id`` share a key; they are
    taken one after the other.  Columns of ``docs`` with the four names above are
    replaced.
    """
    made = ["size", "source_size", "target", "taken"]
    columns = [c for c in docs.columns if c not in made]
    bits = bits_for(docs.count(), per_cell, 24)
    key = F.md5(F.concat(F.lit(f"{seed}~"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    cell = F.shiftright(F.conv(F.substring("__key", 1, 6), 16, 10).cast("int"), 24 - bits)
    keyed = (
        docs.select(
            *columns,
            word_count(F.col("text")).alias("size"),
            # null and other sources never meet: names get a first letter
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("__source"),
            key.alias("__key"),
        )
        .withColumn("__cell", cell)
    )
    cells = keyed.groupBy("__source", "__cell").agg(F.sum("size").alias("cell_size"))
    named = F.when(F.col("__source") != "", F.expr("substring(__source, 2)"))
    sizes = cells.groupBy("__source").agg(F.sum("cell_size").alias("source_size"))
    plan = budgets(sizes.withColumn("source", named), weights, max_epochs).withColumn(
        "__source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    ).drop("source")
    earlier = W.partitionBy("__source").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cells.withColumn("__before", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
        .join(plan, "__source")
        .drop("cell_size")
    )
    inside = (
        W.partitionBy("__source", "__cell")
        .orderBy("__key", "doc_id", "size")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - F.col("__epochs") * F.col("source_size")
    return (
        keyed.join(offsets, ["__source", "__cell"])
        .withColumn("__before", F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("__epochs", epochs)
        .withColumn(
            "taken",
            F.col("size") * F.col("__epochs") + F.greatest(F.lit(0), F.least("size", rest - F.col("__before"))),
        )
        .select(*columns, *made)
    )


def materialise(mixed: DataFrame) -> DataFrame:
    """One row per copy of a document in the mix; ``text`` is cut to its words.

    Adds ``copy`` (from 0).  The last copy may hold the first words only.
    """
    words = F.col("taken") - F.col("copy") * F.col("size")
    copies = F.expr("explode(sequence(0L, (taken - 1) div size))")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, F.col("__words").cast("int")), "")
    return (
        mixed.where(F.col("taken") > 0)
        .withColumn("copy", copies)
        .withColumn("__words", words)
        .withColumn("text", F.when(F.col("__words") < F.col("size"), cut).otherwise(F.col("text")))
        .drop("__words")
    )
