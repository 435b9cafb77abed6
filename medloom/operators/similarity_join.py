"""Exact join of texts whose sets of character n-grams are similar.

Both sides are sets of n-grams.  The rarest grams of a set come first, by counts over both
sides; sets with a Jaccard similarity of at least t share one of their first
``n - ceil(t n) + 1``.  Candidates also pass a filter of sizes and of places (what lies behind
the first common gram must suffice), and are then compared.  Only ids, sizes and
short prefixes meet in the join, so it grows with rare grams in common, not with
texts times texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions import text as tx
from medloom.session import durable


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a text between two marks; an empty text has none."""

    def cut(padded: Column) -> Column:
        last = F.greatest(F.length(padded) - n + 1, F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(n))))

    marked = tx.let(F.concat(F.lit("^"), text, F.lit("$")), cut)
    return F.when(F.length(text) > 0, marked).otherwise(F.array().cast("array<string>"))


def gram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of the n-grams of two texts."""
    return tx.let(char_grams(a, n), lambda x: tx.let(char_grams(b, n), lambda y: tx.set_jaccard(x, y)))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, n: int = 3) -> DataFrame:
    """``left_text, right_text, similarity`` of all similar pairs of distinct texts.

    Both frames have a column ``text``; null and empty texts are similar to nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and not above 1")

    def sets(df: DataFrame, side: int) -> DataFrame:
        texts = df.select("text").where(F.col("text") != "").distinct()
        return tx.staged(texts, char_grams(F.col("text"), n).alias("grams")).withColumn("side", F.lit(side))

    both = durable(sets(left, 0).unionByName(sets(right, 1)))
    gram = both.select("side", "text", F.explode("grams").alias("gram"))
    counts = gram.groupBy("gram").agg(F.count("*").alias("c"), F.count_distinct("side").alias("sides"))
    # a gram of one side only leads nowhere, but keeps its place in the order
    ranked = gram.join(counts, "gram").groupBy("side", "text").agg(
        F.sort_array(F.collect_list(F.struct("c", "gram", "sides"))).alias("grams")
    )
    size = F.size("grams")
    first = (size - F.ceil(F.lit(threshold) * size - 1e-9) + 1).cast("int")
    prefixes = durable(
        ranked.select("side", "text", size.alias("size"), F.posexplode(F.slice("grams", F.lit(1), first)).alias("at", "g"))
        .where(F.col("g.sides") == 2)
        .select("side", "text", "size", "at", F.col("g.gram").alias("gram"))
    )

    def half(side: int, name: str) -> DataFrame:
        return prefixes.where(F.col("side") == side).select(
            "gram", F.col("text").alias(f"{name}_text"), F.col("size").alias(f"{name}_size"), F.col("at").alias(f"{name}_at")
        )

    reach = F.least(F.col("left_size") - F.col("left_at"), F.col("right_size") - F.col("right_at"))
    least = F.lit(threshold / (1 + threshold)) * (F.col("left_size") + F.col("right_size"))
    # places tell about the first common gram, so a pair needs to pass at one of its grams
    pairs = half(0, "left").join(half(1, "right"), "gram").where(reach >= least - 1e-9).select("left_text", "right_text").distinct()
    return tx.staged(pairs, gram_similarity(F.col("left_text"), F.col("right_text"), n).alias("similarity")).where(
        F.col("similarity") >= threshold
    )
