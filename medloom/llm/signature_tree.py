"""Exact similarity join of sets with a forest of signature trees.

Two sets link when their Jaccard similarity reaches a threshold.  Among sets that have
nothing in common no tree can prune, so sets are first dealt to shards:

1. A set's tokens fall by hash into K segments.  K exceeds the number of tokens that two
   sets of that size may differ by and still link, so they agree on whole segments; a
   set belongs to the shard of each of its segments.  Sizes are classed, as K depends on
   them; a set that may link with one of the next class has that class's segments too.
   Shards of one set, nearly all, go at once.
2. Members of a shard are compared with its most central one.  A shard whose members are
   then one class is done.
3. A small shard compares its pairs of different classes.  Members of larger ones are
   dealt anew, by rare tokens: of sets of n tokens that link, the ``n - ceil(t n) + 1``
   rarest tokens of one and the other have one in common.  So texts that share only
   what all of them have never meet.
4. Such a shard that is still large, with several classes, is cut into blocks of bounded
   size, and each pair of blocks that are not one class meets in a task.  There a
   signature tree stands over each block: a node holds the OR of the bitmaps of the tokens
   below, the range of sizes and the class, if there is but one.  Both trees are walked
   down together.  A pair of nodes is left out if sizes cannot link, if both are one
   class, or if the bits they share, with as many tokens as may share bits with others,
   are fewer than the least overlap that links.
5. Pairs of sets that are left are compared exactly, the most similar first, until what
   they would join is joined.

So all links that matter for the classes are found; those within a class are not listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.llm.common import saved
from medloom.llm.components import components, near_roots
from medloom.llm.words import mix

#: sets whose names a task remembers, to give each once
REMEMBERED = 500_000
#: sizes of a class of sets differ by less than this factor
CLASS = 1.5
#: segments beyond those that may differ; so many and one more agree
SPARE = 2
#: a shard of up to so many sets compares its pairs at once
SMALL = 32
#: sets, and tokens, in a block of a larger one, about
BLOCK = 512
BLOCK_TOKENS = 1 << 20
#: 64-bit words of a bitmap, and children of a tree node
WIDTH = 64
FANOUT = 8
#: pairs of nodes, and tokens of pairs, that are compared at once
PAIRS = 1 << 14
TOKENS = 1 << 20


def distinct_tokens(text: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct tokens of texts that lie end to end, how often each occurs, and each text's number.

    ``text`` is sorted.
    """
    cut = np.searchsorted(text, np.arange(texts + 1)).tolist()
    ordered, new = np.empty_like(value), np.ones(len(value), bool)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        one = np.sort(value[a:b])
        ordered[a:b] = one
        new[a + 1 : b] = one[1:] != one[:-1]
    at = np.flatnonzero(new)
    return ordered[at], np.diff(at, append=len(value)), np.bincount(text[at], minlength=texts)


def set_schema(kind: str, listed: str) -> str:
    return f"doc_id {kind}, node binary, short long, n long, {listed} array<long>"


def set_batch(ids: pa.Array, values: np.ndarray, sizes: np.ndarray, listed: np.ndarray, counts: np.ndarray, name: str) -> pa.RecordBatch:
    """Rows ``doc_id, node, short, n`` and a list: 128 bits that name a set, and their first half."""
    end = np.cumsum(sizes)
    nodes = [
        hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None
        for a, b in zip((end - sizes).tolist(), end.tolist(), strict=True)
    ]
    short = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in nodes]
    at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    lists = pa.ListArray.from_arrays(at, pa.array(listed.view(np.int64)))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(nodes, pa.binary()), pa.array(short, pa.int64()), pa.array(sizes.astype(np.int64)), lists],
        ["doc_id", "node", "short", "n", name],
    )


def fresh(batch: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
    """The rows of sets that a task has not given yet; rows without a set go.

    Rows that repeat a document would else meet each other's copies in every join.
    """
    keep = []
    for i, node in enumerate(batch.column("node").to_pylist()):
        if node is not None and node not in seen:
            seen.add(node)
            keep.append(i)
    if len(seen) > REMEMBERED:
        seen.clear()
    return batch.take(pa.array(keep, pa.int64()))


def class_bounds(percent: int) -> list[int]:
    """Least sizes of the classes, from the first size at which different sets link."""
    low = next(n for n in range(1, 1 << 20) if most_apart(n, n + 1, percent))
    bounds = [low]
    while bounds[-1] < 1 << 40:
        # the next but one class is out of reach
        bounds.append(max(int(bounds[-1] * CLASS), 100 * bounds[-1] // percent + 1))
    return bounds


def most_apart(n: int, m: int, percent: int) -> int:
    """By how many tokens sets of n and m that link differ at most."""
    return (n + m) * (100 - percent) // (100 + percent)


def segment_keys(tokens: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments of sets that lie end to end, and how many each set has.

    Segments without tokens have a key only in sets with more than ``SPARE`` of them:
    two sets that agree on no other share one.
    """
    bounds = np.array(class_bounds(percent))
    own = np.searchsorted(bounds, sizes, "right") - 1
    reach = np.searchsorted(bounds, sizes * 100 // percent, "right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    owners, keys = [], []
    for step in (0, 1):
        # sets below the first class are equal or apart
        here = (own + step >= 0) & (reach >= own + step) if step else own >= 0
        at = np.flatnonzero(here)
        if not len(at):
            continue
        kind = own[at] + step
        top = bounds[kind + 1] - 1
        segments = 2 * top * (100 - percent) // (100 + percent) + 1 + SPARE
        first = np.cumsum(segments) - segments
        rank = np.full(len(sizes), -1)
        rank[at] = np.arange(len(at))
        mine = rank[owner]
        token, mine = tokens[mine >= 0], mine[mine >= 0]
        place = first[mine] + (mix(token + np.uint64(1)) % segments[mine].astype(np.uint64)).astype(np.int64)
        total, count = np.zeros(segments.sum(), np.uint64), np.zeros(segments.sum(), np.int64)
        np.add.at(total, place, mix(token))
        np.add.at(count, place, 1)
        of = np.repeat(np.arange(len(at)), segments)
        number = np.arange(len(of)) - first[of]
        key = mix(total + mix((kind[of] * (1 << 40) + number).astype(np.uint64)))
        empty = np.bincount(of, weights=count == 0, minlength=len(at))
        shown = (count > 0) | (empty[of] > SPARE)
        owners.append(at[of[shown]])
        keys.append(key[shown])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    owners, keys = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.bincount(owners, minlength=len(sizes))


def _may_link(percent: int, n: Column, m: Column, p: Column, q: Column) -> Column:
    """Sets of n and m tokens that have no common token before places p and q."""
    reach = F.least(n - p, m - q)
    return reach * (100 + percent) >= percent * (n + m)


def _shards(member: DataFrame) -> DataFrame:
    """Members of shards ``token`` with several, and how many they are."""
    counts = saved(member.groupBy("token").agg(F.count("*").alias("members")).where("members > 1"), "shards")
    # they grow with the texts: merged at every size, never broadcast
    return saved(member.join(counts.hint("merge"), "token"), "shard-members")


def shards(nodes: DataFrame) -> DataFrame:
    """``token, short, n, at, members`` of ``nodes(short, n, keys)``."""
    return _shards(nodes.select("short", "n", F.lit(0).alias("at"), F.explode("keys").alias("token")))


def rare_token_shards(sets: DataFrame, percent: int) -> DataFrame:
    """``token, short, n, at, members`` by the rarest tokens of ``sets(short, tokens)``.

    Tokens are counted over these sets; those of one set only lead nowhere.
    """
    token = saved(sets.select("short", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token")), "set-tokens")
    counts = token.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    common = saved(token.join(saved(counts, "token-counts").hint("merge"), "token"), "common-tokens")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # a set's other tokens are its own and come first
    own = F.col("n") - F.size("common")
    found = (
        common.groupBy("short").agg(F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "token"))).alias("common"))
        .where(own < length)
        .select("short", "n", own.cast("long").alias("own"), F.posexplode(F.slice("common", F.lit(1), (length - own).cast("int"))).alias("i", "x"))
        .select("short", "n", (F.col("own") + F.col("i")).alias("at"), "x.token")
    )
    return _shards(saved(found, "rare-tokens"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` of nodes out of ``pairs(a, b)`` of short keys."""
    side = lambda x: sets.select(F.col("short").alias(x), F.col("node").alias(f"node_{x}"), F.col("tokens").alias(f"of_{x}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .withColumn("both", both)
        .where(F.col("both") * (100 + percent) >= percent * (F.size("of_a") + F.size("of_b")))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )


def star_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of each member of a shard with the one that is in most shards."""
    central = met.groupBy("short").agg(F.count("*").alias("central"))
    met = saved(met.join(central, "short"), "central-members")
    leader = met.groupBy("token").agg(F.max(F.struct("central", "short", "n", "at")).alias("leader"))
    return (
        met.join(saved(leader, "leaders"), "token")
        .where(F.col("short") != F.col("leader.short"))
        .where(_may_link(percent, F.col("n"), F.col("leader.n"), F.col("at"), F.col("leader.at")))
        .select(F.least("short", "leader.short").alias("a"), F.greatest("short", "leader.short").alias("b"))
        .distinct()
    )


class Tree:
    """Levels of a signature tree over sets, the sets themselves first."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray):
        size = np.array([len(x) for x in sets], np.int64)
        bit = np.concatenate(sets).astype(np.uint64) % np.uint64(64 * WIDTH)
        bits = np.zeros((len(sets), WIDTH), np.uint64)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), size), (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        slack = size - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, size, size, slack, label)]
        while len(self.levels[-1][0]) > FANOUT:
            bits, low, high, slack, label = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            first, last = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            self.levels.append((
                np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.maximum.reduceat(slack, at), np.where(first == last, first, -1),
            ))


def _open_pairs(x: tuple, y: tuple, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of nodes that may hold a link, and their greatest possible overlap."""
    out = []
    for i in range(0, len(a), PAIRS):
        p, q = a[i : i + PAIRS], b[i : i + PAIRS]
        keep = (100 * x[2][p] >= percent * y[1][q]) & (100 * y[2][q] >= percent * x[1][p])
        keep &= (x[4][p] != y[4][q]) | (x[4][p] < 0)
        p, q = p[keep], q[keep]
        most = np.bitwise_count(x[0][p] & y[0][q]).sum(axis=1).astype(np.int64) + np.minimum(x[3][p], y[3][q])
        keep = (100 + percent) * most >= percent * (x[1][p] + y[1][q])
        out.append((p[keep], q[keep], most[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (a, b, a)


def dual_walk(left: Tree, right: Tree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets that the signatures cannot tell apart, with the bound of their overlap.

    With ``left is right`` each pair comes once.
    """
    depth = max(len(left.levels), len(right.levels))
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    k = depth - 1
    a, b = (g.reshape(-1) for g in np.meshgrid(np.arange(len(level(left, k)[0])), np.arange(len(level(right, k)[0])), indexing="ij"))
    while True:
        if left is right:
            a, b = a[a <= b], b[a <= b]
            if k == 0:
                a, b = a[a < b], b[a < b]
        a, b, most = _open_pairs(level(left, k), level(right, k), a, b, percent)
        if k == 0:
            return a, b, most
        for side, tree in enumerate((left, right)):
            # a lower tree waits until the walk has come down to it
            if k < len(tree.levels):
                x = (a, b)[side]
                low, high = x * FANOUT, np.minimum(x * FANOUT + FANOUT, len(tree.levels[k - 1][0]))
                n = high - low
                child = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a, b = (child, np.repeat(b, n)) if side == 0 else (np.repeat(a, n), child)
        k -= 1


def joining_links(sets: list[np.ndarray], label: np.ndarray, sides: tuple[np.ndarray, np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between positions of the two sides that join all classes they join.

    ``label``: the class of each set so far.  Sides that are equal are one.
    """
    label = label.copy()
    size = np.array([len(x) for x in sets], np.int64)
    order = [s[np.lexsort((size[s], label[s]))] for s in sides]
    left = Tree([sets[i] for i in order[0]], label[order[0]])
    same = np.array_equal(order[0], order[1])
    right = left if same else Tree([sets[i] for i in order[1]], label[order[1]])
    a, b, most = dual_walk(left, right, percent)
    a, b = order[0][a], order[1][b]
    best = np.argsort(-most / (size[a] + size[b]), kind="stable")
    a, b = a[best], b[best]
    at = np.cumsum(size) - size
    number = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    many = int(number.max()) + 1 if len(number) else 1
    while len(a):
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        n = max(1, int(np.searchsorted(np.cumsum(size[a] + size[b]), TOKENS)))
        p, q = a[:n], b[:n]
        a, b = a[n:], b[n:]
        keys = []
        for x in (p, q):
            m = size[x]
            row = np.repeat(np.arange(len(x)), m)
            keys.append(row * many + number[np.repeat(at[x] - (np.cumsum(m) - m), m) + np.arange(m.sum())])
        key = np.sort(np.concatenate(keys))
        both = np.bincount(key[1:][key[1:] == key[:-1]] // many, minlength=len(p))
        for i in np.flatnonzero((100 + percent) * both >= percent * (size[p] + size[q])).tolist():
            x, y = int(p[i]), int(q[i])
            if label[x] != label[y]:
                label[label == label[x]] = label[y]
                yield x, y


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    block = table.column("block").to_numpy()
    nodes = table.column("node").to_pylist()
    lists = table.column("tokens").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    sets = [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
    label = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1].reshape(-1)
    sides = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found = list(joining_links(sets, label, sides, percent)) if len(sides[0]) and len(sides[1]) else []
    return pa.table({"a": pa.array([nodes[x] for x, _ in found], pa.binary()), "b": pa.array([nodes[y] for _, y in found], pa.binary())})


def open_links(
    met: DataFrame, placed: DataFrame, sets: DataFrame, percent: int, small: int = SMALL, block: int = BLOCK, anew: bool = True
) -> DataFrame:
    """Links ``a, b`` between classes that meet in shards with more than one class.

    ``met`` as of ``shards``, ``placed``: ``short, node, root`` with the classes so far,
    ``sets``: ``node, short, tokens``.  With ``anew`` members of large shards are dealt
    out again by rare tokens first.
    """
    member = saved(met.drop("members").join(placed, "short"), "rooted-members")
    by_root = saved(member.groupBy("token", "root").agg(F.count("*").alias("c"), F.sum("n").alias("size")), "shard-roots")
    opened = by_root.groupBy("token").agg(F.sum("c").alias("members"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    opened = saved(opened, "open-shards")
    shared = saved(member.join(opened, "token"), "open-members")
    item = F.struct("short", "root", "n", "at")
    few = (
        shared.where(F.col("members") <= small).groupBy("token").agg(F.sort_array(F.collect_list(item)).alias("all"))
        .select(F.explode(F.expr("flatten(transform(all, (x, i) -> transform(slice(all, 1, i), y -> struct(y as a, x as b))))")).alias("pair"))
        .where(F.col("pair.a.root") != F.col("pair.b.root"))
        .where(_may_link(percent, *[F.col(f"pair.{x}") for x in ("a.n", "b.n", "a.at", "b.at")]))
        .select(F.col("pair.a.short").alias("a"), F.col("pair.b.short").alias("b"))
        .distinct()
    )
    few = verified(saved(few, "open-pairs"), sets, percent)
    if anew:
        again = saved(shared.where(F.col("members") > small).select("short").distinct(), "dealt-anew")
        if again.isEmpty():
            return few
        rare = rare_token_shards(sets.join(again, "short", "left_semi"), percent)
        return few.unionByName(open_links(rare, placed, sets, percent, small, block, anew=False))
    # a large class has blocks of its own, small ones share blocks
    own = F.when(F.col("c") * 2 >= block, F.col("root"))
    groups = (
        by_root.join(opened.where(F.col("members") > small), "token").withColumn("own", own)
        .groupBy("token", "own").agg(F.ceil(F.greatest(F.sum("c") / block, F.sum("size") / BLOCK_TOKENS)).alias("blocks"))
    )
    shard = Window.partitionBy("token")
    # a row for each half block of members at least
    groups = groups.withColumn("first", F.sum("blocks").over(shard.orderBy("own").rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks"))
    groups = saved(groups.withColumn("all", F.sum("blocks").over(shard)), "block-groups")
    classes = saved(by_root.select("token", "root", own.alias("own")), "class-blocks")
    placed = (
        shared.where(F.col("members") > small).join(classes, ["token", "root"])
        .join(groups, (shared["token"] == groups["token"]) & classes["own"].eqNullSafe(groups["own"]))
        .select(
            shared["token"], "node", "root", classes["own"], "first", "blocks", "all",
            (F.col("first") + F.pmod(F.when(classes["own"].isNull(), F.xxhash64("root")).otherwise(F.xxhash64("node")), F.col("blocks"))).alias("block"),
        )
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("x")
    within = F.col("own").isNotNull() & F.col("x").between(F.col("first"), F.col("first") + F.col("blocks") - 1)
    pairs = (
        placed.select("token", "node", "root", "own", "first", "blocks", "block", other).where(~within)
        .select("token", "node", "root", "block", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"))
    )
    rows = saved(pairs, "block-pairs").join(sets.select("node", "tokens"), "node")
    many = rows.groupBy("token", "i", "j").applyInArrow(lambda t: _block_links(t, percent), "a binary, b binary")
    return few.unionByName(many)


def joined(met: DataFrame, sets: DataFrame, percent: int, known: DataFrame | None = None, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` of nodes that join all classes of sets that link.

    ``known`` are links found before; they are among the result.
    """
    links = verified(saved(star_pairs(met, percent), "star"), sets, percent)
    links = saved(links if known is None else links.unionByName(known), "star-links")
    placed = sets.select("short", "node").join(near_roots(links), "node", "left")
    placed = saved(placed.select("short", "node", F.coalesce("root", "node").alias("root")), "rooted")
    more = saved(open_links(met, placed, sets, percent, small, block), "open-links")
    return links.unionByName(more)


def document_classes(
    docs: DataFrame, drawn: DataFrame, whole: Callable[[DataFrame], DataFrame], percent: int, small: int = SMALL, block: int = BLOCK
) -> DataFrame:
    """``doc_id, n, root`` of the documents with a set: ``root`` names their class.

    ``drawn``, a written table: ``doc_id, node, short, n, keys``; ``whole`` gives the rows
    ``node, short, tokens`` of documents ``doc_id, text``.
    """
    nodes = drawn.where("n > 0").groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("short", "n", "keys")])
    met = shards(nodes)
    asked = saved(met.select("short").distinct(), "asked")
    # one document for each node in a shard; repeated ids may bring other nodes along
    examples = drawn.join(asked, "short", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct()
    chosen = docs.select("doc_id", "text").join(saved(examples, "examples"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = saved(whole(chosen).select("node", "short", "tokens"), "sets")
    roots = components(joined(met, sets, percent, small=small, block=block))
    placed = drawn.where("n > 0").select("doc_id", "node", "n").join(roots, "node", "left")
    return saved(placed.select("doc_id", "n", F.coalesce("root", "node").alias("root")), "placed")
