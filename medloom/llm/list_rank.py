"""Ranks in a linked list that lies spread over a table.

A sparse set of rulers is chosen by hash.  All others follow the pointers of those they
point to, which doubles the distance with each round, until they reach a ruler; so
rounds grow with the logarithm of the largest gap and rows that have arrived rest.
The rulers are a list of a fraction of the length, which is ranked the same way; one
of at most ``LOCAL`` elements is walked in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import saved

#: one element in so many is a ruler
SPARSE = 32
#: a list of up to so many elements is walked by one task
LOCAL = 1 << 14


def _walk(links: DataFrame) -> DataFrame:
    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[bytes | None, tuple[bytes, int]] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("arc", "next", "step"))
            before.update({n: (a, s) for a, n, s in zip(*columns, strict=True)})
        arcs, ranks, at, rank = [], [], None, 0
        while at in before:
            at, step = before[at]
            rank += step
            arcs.append(at)
            ranks.append(rank)
        yield pa.RecordBatch.from_arrays([pa.array(arcs, pa.binary()), pa.array(ranks, pa.int64())], ["arc", "rank"])

    return links.select("arc", "next", "step").coalesce(1).mapInArrow(walk, "arc binary, rank long")


def list_rank(links: DataFrame, sparse: int = SPARSE, local: int = LOCAL, level: int = 0) -> DataFrame:
    """``arc, rank``: the sum of steps from each element to the end of the list.

    ``links(arc binary, next binary, step long)``, a written table, is one list: the
    last element has a null ``next`` and its own step.
    """
    if links.count() <= local:
        return _walk(links)

    def ruler(arc: str) -> Column:
        # the last element points nowhere and need not be one
        return F.pmod(F.xxhash64(arc, F.lit(level)), F.lit(sparse)) == 0

    # those before the end may meet no ruler; they close at the end itself
    closed = ruler("to") | F.col("to").isNull()
    now = links.where(~ruler("arc")).select("arc", F.col("next").alias("to"), "step")
    done: list[DataFrame] = []
    while True:
        done.append(now.where(closed))
        going = now.where(~closed)
        if going.isEmpty():
            break
        known = reduce(DataFrame.unionByName, [*done, going])
        onward = known.select(F.col("arc").alias("to"), F.col("to").alias("then"), F.col("step").alias("more"))
        now = saved(going.join(onward, "to").select("arc", F.col("then").alias("to"), (F.col("step") + F.col("more")).alias("step")), "jumps")
    arrived = reduce(DataFrame.unionByName, done)
    onward = arrived.select(F.col("arc").alias("next"), "to", F.col("step").alias("more"))
    # a ruler's next ruler, which is its next element or where that has arrived
    rulers = (
        links.where(ruler("arc")).join(onward, "next", "left")
        .select(
            "arc",
            F.when(F.col("more").isNull(), F.col("next")).otherwise(F.col("to")).alias("next"),
            (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"),
        )
    )
    ranks = saved(list_rank(saved(rulers, "rulers"), sparse, local, level + 1), "ranks")
    onward = ranks.select(F.col("arc").alias("to"), "rank")
    others = arrived.join(onward, "to", "left").select("arc", (F.col("step") + F.coalesce("rank", F.lit(0))).alias("rank"))
    return ranks.unionByName(others)
