"""Seeded order and exact splits without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from medloom import lexicon as lx

_PREFIX = 4  # hex digits: at most 65,536 counting buckets


def shuffle_key(ident: Column, seed: int = lx.SEED) -> Column:
    """Position of a row in a seeded shuffle; ``ident`` must be unique."""
    return F.md5(F.concat_ws("~", F.lit(str(seed)), ident.cast("string")))


def seeded_sample(df: DataFrame, ident: Column, n: int, seed: int = lx.SEED) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle."""
    return df.orderBy(shuffle_key(ident, seed)).limit(n)


def split(
    df: DataFrame,
    ident: Column,
    fractions: Sequence[float] = lx.SPLIT_FRACTIONS,
    seed: int = lx.SEED,
) -> DataFrame:
    """Add ``split``: train, dev, test with floored sizes, the rest in test.

    The two boundary keys are found by counting key prefixes and ranking only
    the rows of the two prefixes that hold a boundary, so rows are labelled
    where they lie and nothing but counts is shuffled.
    """
    key = shuffle_key(ident, seed)
    keys = df.select(key.alias("key")).withColumn("prefix", F.substring("key", 1, _PREFIX))
    total = F.col("total").cast("double")
    train = F.floor(total * fractions[0])
    dev = train + F.floor(total * fractions[1])
    # the windows below run over prefix counts, at most 16**4 rows
    counts = (
        keys.groupBy("prefix")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(W.orderBy("prefix")))
        .withColumn("total", F.sum("n").over(W.partitionBy()))
    )
    cuts = counts.select(
        "prefix",
        (F.col("upto") - F.col("n")).alias("below"),
        "upto",
        F.posexplode(F.array(train, dev)).alias("cut", "rank"),
    ).where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
    rank = F.row_number().over(W.partitionBy("cut").orderBy("key"))
    bounds = (
        keys.join(F.broadcast(cuts), "prefix")  # two rows
        .withColumn("at", F.col("below") + rank)
        .where(F.col("at") == F.col("rank"))
        .agg(
            F.struct(
                F.max(F.when(F.col("cut") == 0, F.col("key"))).alias("train"),
                F.max(F.when(F.col("cut") == 1, F.col("key"))).alias("dev"),
            ).alias("bounds")
        )
        .scalar()
    )
    return df.withColumn(
        "split",
        F.when(key <= bounds["train"], "train").when(key <= bounds["dev"], "dev").otherwise("test"),
    )
