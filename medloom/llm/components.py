"""Connected components of links between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import saved


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """``u, v``: the given pairs of columns of each row, in one pass."""
    each = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return df.select(F.inline(each))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of the connected components of ``links(a, b)``.

    Alternating large and small stars: each node sends its larger (then its
    smaller) neighbours to the least node it knows, until nothing moves.  Nodes
    without links do not appear.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    mark = None
    while True:
        both = _pairs(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # repeats do no harm here and go below
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _pairs(large.join(least, "u"), ("v", "m"), ("u", "m")).where("u != v").distinct()
        edges = saved(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_roots(links: DataFrame, rounds: int = 2) -> DataFrame:
    """``node, root``: the least node within a few links.

    Nodes of one root are connected; connected nodes may have several.
    """
    both = saved(_pairs(links, ("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")).distinct(), "both-ways")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    for _ in range(rounds - 1):
        labels = saved(labels, "labels")
        labels = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("root"))
    return labels
