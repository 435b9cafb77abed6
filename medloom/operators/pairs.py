"""Parent/child training pairs from a code hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from medloom import lexicon as lx
from medloom.functions import text as tx
from medloom.operators.lookup import first_by, last_by
from medloom.operators.sampling import seeded_sample, shuffle_key
from medloom.session import durable

PARENT_LENGTH = 3


def _key(c: Column) -> Column:
    return F.lower(tx.strip(c))


def _hierarchy(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents (one per id, the last name wins) and children."""
    keyed = codes.select("row_idx", "id", "name").withColumn(
        "parent_id", F.substring("id", 1, PARENT_LENGTH)
    )
    parents = keyed.where(F.col("id") == F.col("parent_id"))
    children = keyed.where(F.col("id") != F.col("parent_id"))
    named = last_by(parents.select("parent_id", "row_idx", "name"), ["parent_id"], "row_idx")
    seen = parents.groupBy("parent_id").agg(F.min("row_idx").alias("first_idx"))
    return named.drop("row_idx").join(seen, "parent_id"), children


def parent_child_pairs(codes: DataFrame) -> DataFrame:
    """Every parent name with every child name of it, but for equal names.

    ``codes``: ``row_idx, id, name``.  Adds the child's ``row_idx``.
    """
    parents, children = _hierarchy(codes)
    return (
        children.withColumnRenamed("name", "matching_term")
        .join(parents.select("parent_id", F.col("name").alias("query_term")), "parent_id")
        .where(_key(F.col("query_term")) != _key(F.col("matching_term")))
        .select("row_idx", "query_term", "matching_term", F.lit(1).alias("label"))
    )


def _draw(ident: Column, seed: int, size: Column) -> Column:
    return F.pmod(F.conv(F.substring(shuffle_key(ident, seed), 1, 12), 16, 10).cast("long"), size)


def _index_children(children: DataFrame, seed: int) -> DataFrame:
    """``idx, parent_id, k, drawn``: children numbered 0.. by parent, name, key.

    Children of a parent are contiguous, and within it those of a name.  Numbers
    add up from counts by parent (a bounded set of prefixes), by a prefix of the
    name's hash, and by name and a prefix of the key, so neither a parent nor a
    name with most of the children is ranked in one task.
    """
    keyed = (
        children.select("row_idx", "parent_id", "name", _key(F.col("name")).alias("k"))
        .where(F.col("k").isNotNull())
        .withColumn("by_name", F.md5("k"))
        .withColumn("cell", F.substring("by_name", 1, 3))
        .withColumn("key", shuffle_key(F.col("row_idx"), seed))
        .withColumn("part", F.substring("key", 1, 2))
    )

    def below(*order: str, within: tuple[str, ...] = ()) -> Column:
        return F.sum("n").over(W.partitionBy(*within).orderBy(*order)) - F.col("n")

    parts = keyed.groupBy("parent_id", "cell", "by_name", "part").agg(F.count("*").alias("n"))
    cells = parts.groupBy("parent_id", "cell").agg(F.sum("n").alias("n"))
    parents = cells.groupBy("parent_id").agg(F.sum("n").alias("n"))
    offsets = (
        parts.withColumn("c", below("by_name", "part", within=("parent_id", "cell")))
        .join(cells.withColumn("b", below("cell", within=("parent_id",))).drop("n"), ["parent_id", "cell"])
        .join(parents.withColumn("a", below("parent_id")).drop("n"), "parent_id")
        .select("parent_id", "cell", "by_name", "part", (F.col("a") + F.col("b") + F.col("c")).alias("before"))
    )
    place = ["parent_id", "cell", "by_name", "part"]
    inside = F.row_number().over(W.partitionBy(*place).orderBy("key"))
    return (
        keyed.withColumn("inside", inside)
        .join(offsets, place)
        .select((F.col("before") + F.col("inside") - 1).alias("idx"), "parent_id", "k", F.col("name").alias("drawn"))
    )


def _excluded(wanted: DataFrame, indexed: DataFrame) -> DataFrame:
    """Add ``ranges`` of children that are no negative for ``parent_id, k``, in order.

    These are the parent's own children and, in other parents, those named ``k``;
    there are at most as many ranges as parents.
    """
    span = F.struct(F.min("idx").alias("low"), F.count("*").alias("n"))
    own = indexed.groupBy("parent_id").agg(span.alias("own"))
    named = (
        indexed.groupBy("parent_id", "k").agg(span.alias("span"))
        .groupBy("k").agg(F.collect_list(F.struct("parent_id", "span")).alias("named"))
    )
    elsewhere = F.transform(
        F.filter("named", lambda r: r["parent_id"] != F.col("parent_id")), lambda r: r["span"]
    )
    none = F.expr("cast(array() as array<struct<low:bigint,n:bigint>>)")
    ranges = F.concat(F.coalesce(elsewhere, none), F.array_compact(F.array("own")))
    return wanted.join(own, "parent_id", "left").join(named, "k", "left").select(
        "parent_id", "k", F.sort_array(ranges).alias("ranges")
    )


def negative_pairs(codes: DataFrame, positives: DataFrame, seed: int = lx.SEED) -> DataFrame:
    """One child of another parent per positive pair, with a different name.

    The draw is exact: a number below the count of eligible children is moved past
    the ranges of those that are not.  Only a pair for which no eligible child
    exists is left out.
    """
    parents, children = _hierarchy(codes)
    indexed = durable(_index_children(children, seed))
    # a name stands for the first parent that carries it
    own = first_by(
        parents.select(F.col("name").alias("query_term"), "parent_id", "first_idx"),
        ["query_term"], "first_idx",
    ).drop("first_idx")
    asked = (
        positives.select("row_idx", "query_term")
        .join(own, "query_term")
        .withColumn("k", _key(F.col("query_term")))
    )
    ranges = _excluded(asked.select("parent_id", "k").distinct(), indexed)
    closed = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["n"])
    eligible = F.lit(indexed.count()) - closed
    idx = F.aggregate(
        "ranges",
        _draw(F.col("row_idx"), seed, F.col("eligible")),
        lambda acc, r: F.when(acc >= r["low"], acc + r["n"]).otherwise(acc),
    )
    return (
        asked.join(ranges, ["parent_id", "k"])
        .withColumn("eligible", eligible)
        .where(F.col("eligible") > 0)
        .select("row_idx", "query_term", idx.alias("idx"))
        .join(indexed.select("idx", "drawn"), "idx")
        .select("row_idx", "query_term", F.col("drawn").alias("matching_term"), F.lit(0).alias("label"))
    )


def code_pairs(codes: DataFrame, n: int = lx.POSITIVE_PAIRS, seed: int = lx.SEED) -> DataFrame:
    """``n`` shuffled positive pairs and as many negatives, shuffled together."""
    positives = seeded_sample(parent_child_pairs(codes), F.col("row_idx"), n, seed)
    both = positives.unionByName(negative_pairs(codes, positives, seed))
    order = shuffle_key(F.concat_ws(":", F.col("label"), F.col("row_idx")), seed)
    return both.orderBy(order).select("query_term", "matching_term", "label")
