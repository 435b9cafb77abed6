"""A trie of conversations by their first turns, with subtree sums from an Euler tour.

1. Turns are numbered over ranges of (conversation, order), so that one conversation may
   hold any share of the rows.  A turn adds 128 bits of hash of its place, role and text;
   the running sum up to a turn names the sequence so far.  Equal names are one node.
2. Every node has an arc that enters it and one that leaves it.  An arc that enters goes
   on to the first child, or to the arc that leaves; one that leaves goes on to the next
   sibling, or leaves the parent.  Siblings are linked in cells of bounded size.
3. The tour is ranked as a linked list (``list_rank``), and prefix sums of leaves and of
   saved tokens run along the ranks in cells.  A subtree's sum is the difference of the
   sums at its two arcs.
4. The ids of conversations that end at a node are joined in blocks by range of id,
   and a node's blocks are hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.llm.common import saved
from medloom.llm.list_rank import list_rank

#: turns, siblings and arcs in a cell
CELL = 1 << 12
ARCS = 1 << 16
#: ids that are joined to a block
BLOCK = 1 << 16
ENTER, LEAVE = b"\0", b"\1"
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text``: turns by number, null first; ties by role, then text.

    Null roles and texts become empty; rows without a ``conv_id`` belong to none.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    plain = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ranged = saved(plain.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations that lie in several ranges
    before = counts.withColumn("before", F.sum("n").over(earlier)).where("before > 0").drop("n")
    here = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1
    return (
        ranged.withColumn("here", here)
        .join(before, ["conv_id", "part"], "left")
        .select("conv_id", (F.col("here") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text")
    )


def regrown(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's: ``conv_id``; ``conv_id, pos, role, text``.

    Conversation c takes the first h turns of conversation ``c - c % every``, h being
    its checksum modulo ``most + 1``, and goes on with its own turns from the h-th on.
    """
    own = saved(numbered(turns), "numbered")
    lengths = saved(own.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = lengths.select("conv_id", h.alias("h"), base.alias("base"))
    heads = own.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    borrowed = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "role", "text")
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("size"))
    # how far own turns move up where the other has fewer than h
    moved = convs.join(bases, "base", "left").select(
        "conv_id", (F.least("h", F.coalesce("size", F.lit(0))) - F.col("h")).alias("shift")
    ).where("shift < 0")
    kept = own.where(F.col("pos") >= h).join(saved(moved, "moved"), "conv_id", "left").select(
        "conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "role", "text"
    )
    return lengths.select("conv_id"), borrowed.unionByName(kept)


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


def _root() -> Column:
    return _name(F.lit(0), [F.lit(0)] * 4)


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, chars``: the node that each turn leads to.

    ``turns``: ``conv_id, pos, role, text`` with places from 0 on without gaps.
    """
    halves = []
    for salt in (0, 1):
        drawn = F.xxhash64(F.lit(salt), "pos", "role", "text")
        halves += [F.shiftrightunsigned(drawn, 32), drawn.bitwiseAND(F.lit(0xFFFFFFFF))]
    names = [f"h{i}" for i in range(4)]
    cell = F.floor(F.col("pos") / CELL).alias("cell")
    drawn = saved(
        turns.select("conv_id", "pos", cell, F.char_length("text").cast("long").alias("chars"), *[x.alias(n) for x, n in zip(halves, names, strict=True)]),
        "turn-hashes",
    )
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = drawn.groupBy("conv_id", "cell").agg(*[F.sum(n).alias(n) for n in names])
    before = totals.select("conv_id", "cell", *[F.sum(n).over(earlier).alias(f"b{n}") for n in names]).where("cell > 0")
    running = Window.partitionBy("conv_id", "cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = drawn.select(
        "conv_id", "pos", "cell", "chars", *names, *[F.sum(n).over(running).alias(f"s{n}") for n in names]
    ).join(before, ["conv_id", "cell"], "left")
    up_to = [F.col(f"s{n}") + F.coalesce(f"b{n}", F.lit(0)) for n in names]
    return summed.select(
        "conv_id",
        (F.col("pos") + 1).cast("long").alias("depth"),
        _name(F.col("pos") + 1, up_to).alias("node"),
        _name(F.col("pos"), [s - F.col(n) for s, n in zip(up_to, names, strict=True)]).alias("parent"),
        "chars",
    )


def tour(nodes: DataFrame) -> DataFrame:
    """Links ``arc, next, step`` of the Euler tour of ``nodes(node, parent)``."""
    kids = nodes.where(F.col("parent").isNotNull()).select("node", "parent")
    many = saved(kids.groupBy("parent").agg(F.count("*").alias("n")), "families")
    # hot families lie in several cells
    kids = saved(
        kids.join(many, "parent").select(
            "node", "parent", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CELL)).alias("cell")
        ),
        "siblings",
    )
    firsts = kids.groupBy("parent", "cell").agg(F.min("node").alias("first"))
    following = F.lead("first").over(Window.partitionBy("parent").orderBy("cell"))
    next_cell = firsts.select("parent", "cell", following.alias("beyond")).where(F.col("beyond").isNotNull())
    sibling = (
        kids.withColumn("sibling", F.lead("node").over(Window.partitionBy("parent", "cell").orderBy("node")))
        .join(next_cell, ["parent", "cell"], "left")
        .select("node", F.coalesce("sibling", "beyond").alias("sibling"))
    )
    eldest = firsts.groupBy("parent").agg(F.min_by("first", "cell").alias("child")).withColumnRenamed("parent", "node")
    enter = lambda c: F.concat(F.col(c), F.lit(ENTER))
    leave = lambda c: F.concat(F.col(c), F.lit(LEAVE))
    into = nodes.select("node").join(eldest, "node", "left").select(
        enter("node").alias("arc"), F.coalesce(enter("child"), leave("node")).alias("next")
    )
    out = nodes.select("node", "parent").join(sibling, "node", "left").select(
        leave("node").alias("arc"), F.coalesce(enter("sibling"), leave("parent")).alias("next")
    )
    return into.unionByName(out).withColumn("step", F.lit(1).cast("long"))


def subtree_sums(nodes: DataFrame, weights: list[str], ranks: DataFrame) -> DataFrame:
    """``node`` and the sums of ``weights`` over its subtree, itself included."""
    arcs = saved(
        ranks.select(F.substring("arc", 1, 16).alias("node"), (F.substring("arc", 17, 1) == F.lit(ENTER)).alias("enters"), "rank")
        .join(nodes.select("node", *weights), "node")
        .select(
            "node", "enters", "rank", F.floor(F.col("rank") / ARCS).alias("cell"),
            *[F.when(F.col("enters"), F.col(w)).otherwise(F.lit(0)).cast("long").alias(w) for w in weights],
        ),
        "tour",
    )
    totals = arcs.groupBy("cell").agg(*[F.sum(w).alias(w) for w in weights])
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each cell of arcs
    before = totals.select("cell", *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"b_{w}") for w in weights])
    running = Window.partitionBy("cell").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    # ranks count from the tour's end: entering comes after leaving
    sign = F.when(F.col("enters"), 1).otherwise(-1)
    summed = arcs.select("node", "enters", "cell", *[F.sum(w).over(running).alias(w) for w in weights]).join(before, "cell")
    return summed.groupBy("node").agg(*[F.sum(sign * (F.col(w) + F.col(f"b_{w}"))).alias(w) for w in weights])


def joined_hashes(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """``node, sha``: SHA-256 of the ids ``conv_id`` at each node, ascending, comma-joined.

    Ids are joined by ranges of (node, id); a node's hash then takes its blocks one
    after another, so no task holds more than a block.
    """
    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out():
            columns = [pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])]
            return pa.RecordBatch.from_arrays(columns, ["node", "first", "ids"])

        for batch in batches:
            for at, i in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (at != node or len(ids) == block):
                    yield out()
                    ids = []
                node = at
                ids.append(i)
        if ids:
            yield out()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, shas = [], []
            for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at != node:
                    if state:
                        nodes.append(node)
                        shas.append(state.hexdigest())
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], ["node", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "sha"])

    blocks = (
        ends.select("node", F.col("conv_id").cast("long")).repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
        .mapInArrow(join, "node binary, first long, ids string")
    )
    return (
        saved(blocks, "id-blocks").repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, sha string")
    )


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations.

    ``convs`` has a row for every ``conv_id``, ``turns`` the turns ``conv_id, pos,
    role, text`` with places from 0 on; a conversation without turns ends at the root.
    Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (code points that
    need not be repeated, over the subtree), ``ends_sha256``.  Without conversations
    there is no row.
    """
    steps = saved(paths(turns), "paths")
    least = lambda: F.min("conv_id").alias("conv_id")
    inner = steps.groupBy("node").agg(
        least(), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("chars").alias("chars"), F.count("*").alias("n_convs")
    )
    top = convs.agg(least(), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        _root().alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("chars"), "n_convs",
    )
    nodes = saved(inner.unionByName(top), "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0)).cast("long")
    nodes = saved(
        nodes.join(children, "node", "left").select(
            "node", "conv_id", "depth", "parent", "n_convs", n_children.alias("n_children"),
            (n_children == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
        ),
        "trie",
    )
    ranks = saved(list_rank(saved(tour(nodes), "arcs")), "ranks")
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"], ranks)
    last = steps.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("node", _root()).alias("node"))
    hashes = joined_hashes(ends)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.drop("n_leaves", "saved_tokens").join(above, "parent", "left").join(sums, "node").join(hashes, "node", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
        )
    )
