"""Nearest-concept retrieval, re-ranking and class decisions.

Retrieval is exact.  The dictionary and the queries of a class are cut into
blocks of bounded size; every query block meets every dictionary block of its
class in one Arrow task that multiplies two matrices and returns only the best
few rows per query.  A class that holds most of the rows just has more blocks,
nothing is broadcast or collected, and memory per task is set by the block
sizes, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from medloom import lexicon as lx
from medloom.functions import text as tx
from medloom.operators.lookup import best_by
from medloom.session import durable

DICTIONARY_BLOCK = 50_000
QUERY_BLOCK = 20_000
#: queries a block has at least before more blocks are made for idle cores
LEAST_QUERIES = 256
#: a table of class sizes is broadcast up to so many rows
MOST_CLASSES = 10_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of unit rows in double precision."""
    rows = len(column)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    m = flat.astype(np.float64).reshape(rows, -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


#: decimals of a similarity; equal ones stay equal however a product is summed
DECIMALS = 12


#: similarities a task holds at once, and dictionary rows that meet queries at once
SIMILARITIES = 1 << 20
ROWS_AT_ONCE = 1 << 13


def _similarities(queries: pa.Table, rows: pa.Table):
    """Yield (offset, similarity block); a dense block holds up to `SIMILARITIES`."""
    q, d = _matrix(queries.column("vector")), _matrix(rows.column("vector")).T
    step = max(1, SIMILARITIES // max(1, d.shape[1]))
    for at in range(0, len(q), step):
        yield at, np.round(q[at : at + step] @ d, DECIMALS)


class Nearest:
    """The ``k`` most similar rows of each query so far; on ties the row of lower rank.

    ``least`` are similarities below which a query takes no row.  A block of
    similarities counts only where it reaches the k-th one found so far.
    """

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.least = np.full(queries, -np.inf) if least is None else least
        self.sim = np.full((queries, k), -np.inf)
        self.rank = np.full((queries, k), np.iinfo(np.int64).max)

    def meet(self, q: np.ndarray, at: np.ndarray, d: np.ndarray, ranks: np.ndarray) -> None:
        """Compare queries ``at`` of the matrix ``q`` with rows ``d``, in order of ``ranks``."""
        for first in range(0, len(d), ROWS_AT_ONCE):
            rows, named = d[first : first + ROWS_AT_ONCE].T, ranks[first : first + ROWS_AT_ONCE]
            step = max(1, SIMILARITIES // rows.shape[1])
            for lead in range(0, len(at), step):
                some = at[lead : lead + step]
                self._take(some, q[some] @ rows, named)

    def _take(self, at: np.ndarray, block: np.ndarray, ranks: np.ndarray) -> None:
        worst = np.maximum(self.sim[at, -1], self.least[at])
        # products differ in their last digits, which rounding takes away
        i, j = np.nonzero(~(block < (worst - 10.0**-DECIMALS)[:, None]))
        if len(i) > 4 * self.k * len(at):
            j = _top_columns(np.round(block, DECIMALS), self.k)
            i = np.repeat(np.arange(len(at)), j.shape[1])
            j = j.ravel()
        sims, named = np.round(block[i, j], DECIMALS), ranks[j]
        better = ~((sims < worst[i]) | ((sims == self.sim[at, -1][i]) & (named >= self.rank[at, -1][i])))
        i, sims, named = i[better], sims[better], named[better]
        if not len(i):
            return
        new = np.unique(i)
        i = np.concatenate([i, np.repeat(new, self.k)])
        sims = np.concatenate([sims, self.sim[at[new]].ravel()])
        named = np.concatenate([named, self.rank[at[new]].ravel()])
        order = np.lexsort((named, -sims, i))
        i, sims, named = i[order], sims[order], named[order]
        opens = np.searchsorted(i, new)
        best = (opens[:, None] + np.arange(self.k)).ravel()
        self.sim[at[new]] = sims[best].reshape(-1, self.k)
        self.rank[at[new]] = named[best].reshape(-1, self.k)

    def hits(self, floor: float | None, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ranks of rows and similarities of what was found, from ``floor`` on."""
        keep = self.rank < np.iinfo(np.int64).max
        if floor is not None:
            keep &= self.sim > floor if strict else self.sim >= floor
        i, j = np.nonzero(keep)
        return i, self.rank[i, j], self.sim[i, j]


def _in_blocks(
    queries: DataFrame,
    dictionary: DataFrame,
    class_column: str | None,
    query_id: str,
    row_id: str,
    dictionary_block: int,
    query_block: int,
):
    """Co-grouped query and dictionary blocks.

    Memory sets the most rows of a block.  Where that gives fewer pairs of blocks
    than shuffle partitions, queries are cut finer, as long as blocks keep a useful
    size; a dictionary of many blocks is so never copied for the sake of cores.
    """
    wanted = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cls = F.lit("") if class_column is None else F.col(class_column)
    q = queries.withColumn("_cls", cls)
    d = dictionary.withColumn("_cls", cls)
    blocks_d = F.ceil(F.count("*") / dictionary_block).cast("int").alias("_nd")
    rows_q = F.count("*").alias("_rq")

    def blocks_q(rows: Column, nd: Column) -> Column:
        by_cores = F.least(F.ceil(F.lit(wanted) / nd), F.ceil(rows / LEAST_QUERIES))
        return F.greatest(F.ceil(rows / query_block), by_cores, F.lit(1)).cast("int")

    if class_column is None:
        nd = F.greatest(d.agg(blocks_d).scalar(), F.lit(1))
        nq = blocks_q(q.agg(rows_q).scalar(), nd)

        def sized(df: DataFrame) -> DataFrame:
            return df.withColumn("_nd", nd).withColumn("_nq", nq)
    else:
        # one row per class label, a vocabulary of a few entries as a rule
        sizes = durable(
            d.groupBy("_cls").agg(blocks_d)
            .join(q.groupBy("_cls").agg(rows_q), "_cls")
            .select("_cls", "_nd", blocks_q(F.col("_rq"), F.col("_nd")).alias("_nq"))
        )
        if sizes.count() <= MOST_CLASSES:
            sizes = F.broadcast(sizes)

        def sized(df: DataFrame) -> DataFrame:
            return df.join(sizes, "_cls")

    def part(c: str, n: str) -> Column:
        return F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    d = (
        sized(d)
        .withColumn("_d", part(row_id, "_nd"))
        .withColumn("_q", every("_nq"))
        .drop("_nd", "_nq")
    )
    q = (
        sized(q)
        .withColumn("_q", part(query_id, "_nq"))
        .withColumn("_d", every("_nd"))
        .drop("_nd", "_nq")
    )
    keys = ["_cls", "_d", "_q"]
    return q.groupBy(*keys).cogroup(d.groupBy(*keys))


def knn(
    queries: DataFrame,
    dictionary: DataFrame,
    k: int = lx.RETRIEVED,
    *,
    floor: float | None = None,
    strict: bool = False,
    class_column: str | None = None,
    query_id: str = "query_id",
    row_id: str = "row_idx",
    dictionary_block: int = DICTIONARY_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` rows most similar to each query: ``[query_id, row_idx, sim, rk]``.

    Both sides need a ``vector`` column.  Ties go to the lower row id.  ``floor`` drops hits below it (or equal to it with ``strict``);
    with ``class_column`` only rows of the query's class compete.
    """

    def top(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q_at, r_at, sims = [], [], []
        if queries.num_rows and rows.num_rows:
            # rows in row-id order, so the lower id has the lower rank
            rows = rows.sort_by(row_id)
            q, d = _matrix(queries.column("vector")), _matrix(rows.column("vector"))
            near = Nearest(len(q), k)
            near.meet(q, np.arange(len(q)), d, np.arange(len(d)))
            q_at, r_at, sims = ([x] for x in near.hits(floor, strict))
        return _hits(queries, rows, query_id, row_id, q_at, r_at, {"sim": sims})

    extra = [class_column] if class_column else []
    q = queries.select(query_id, "vector", *extra)
    d = dictionary.select(row_id, "vector", *extra)
    found = _in_blocks(
        q, d, class_column, query_id, row_id, dictionary_block, query_block
    ).applyInArrow(top, f"{_types(q, d, query_id, row_id)}, sim double")
    # at most k rows per dictionary block are left of each query
    w = W.partitionBy(query_id).orderBy(F.desc("sim"), F.asc(row_id))
    return found.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def _types(q: DataFrame, d: DataFrame, query_id: str, row_id: str) -> str:
    return (
        f"{query_id} {q.schema[query_id].dataType.simpleString()}, "
        f"{row_id} {d.schema[row_id].dataType.simpleString()}"
    )


def _hits(queries, rows, query_id, row_id, q_at, r_at, scores) -> pa.Table:
    """A table of hits from row positions on both sides and their scores."""

    def joined(parts, kind):
        return np.concatenate(parts).astype(kind) if parts else np.array([], kind)

    return pa.table(
        {
            query_id: queries.column(query_id).take(pa.array(joined(q_at, "int64"))),
            row_id: rows.column(row_id).take(pa.array(joined(r_at, "int64"))),
            **{name: pa.array(joined(parts, "float64")) for name, parts in scores.items()},
        }
    )


def _top_columns(block: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the k largest values per row, lower index first on ties."""
    n = block.shape[1]
    if n <= k:
        return np.argsort(-block, axis=1, kind="stable")
    # the k-th value bounds the winners; ties at the bound need the full sort
    bound = np.partition(block, n - k, axis=1)[:, n - k : n - k + 1]
    crowded = (block >= bound).sum(axis=1) > k
    best = np.argpartition(-block, k - 1, axis=1)[:, :k]
    best.sort(axis=1)
    order = np.argsort(-np.take_along_axis(block, best, axis=1), axis=1, kind="stable")
    best = np.take_along_axis(best, order, axis=1)
    for r in np.nonzero(crowded)[0]:
        best[r] = np.argsort(-block[r], kind="stable")[:k]
    return best


class _Overlaps:
    """Token overlap of a term with every wording of a block at once.

    Wordings are listed by token, so the common tokens of a term are counted from
    the lists of its own tokens.
    """

    def __init__(self, wordings: list):
        sets = [_tokens(w) for w in wordings]
        self.sizes = np.array([len(s) for s in sets])
        listed: dict[str, list[int]] = {}
        for i, tokens in enumerate(sets):
            for token in tokens:
                listed.setdefault(token, []).append(i)
        self.listed = {token: np.array(at) for token, at in listed.items()}

    def of(self, term) -> np.ndarray:
        own = _tokens(term)
        hits = [self.listed[t] for t in own if t in self.listed]
        both = np.bincount(np.concatenate(hits), minlength=len(self.sizes)) if hits else np.zeros(len(self.sizes))
        either = len(own) + self.sizes - both
        # two texts without tokens agree fully
        return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def _tokens(value) -> frozenset:
    return frozenset(str(value).lower().split())


def link_by_class(
    mentions: DataFrame,
    concepts: DataFrame,
    *,
    floor: float = lx.LINK_FLOOR,
    class_column: str = "macro_type",
    query_id: str = "query_id",
    row_id: str = "row_idx",
    dictionary_block: int = DICTIONARY_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Link each mention to the concept of its class with the closest wording.

    Among all concepts more similar than ``floor`` the one with the highest
    token overlap with the mention wins, the earliest on a tie.  ``mentions``:
    id, ``term``, ``vector``, class; ``concepts``: id, ``entity``,
    ``mapped_cui``, ``vector``, class.  Adds ``cui``, ``similarity`` and
    ``canonical_name``; unlinked mentions get null, 1.0 and their own term.
    """

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q_at, r_at, found, scores = [], [], [], []
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by(row_id)
            # copies of one wording share an overlap, so each is scored once
            wording = rows.column("entity").combine_chunks().dictionary_encode()
            codes = wording.indices.to_numpy()
            overlaps = _Overlaps(wording.dictionary.to_pylist())
            terms = queries.column("term").to_pylist()
            for at, block in _similarities(queries, rows):
                for i, sims in enumerate(block):
                    near = np.nonzero(sims > floor)[0]
                    if not near.size:
                        continue
                    kinds, first = np.unique(codes[near], return_index=True)
                    score = overlaps.of(terms[at + i])[kinds]
                    # the highest overlap, then the lowest row
                    place = near[first[score == score.max()]].min()
                    q_at.append([at + i])
                    r_at.append([place])
                    found.append([sims[place]])
                    scores.append([score.max()])
        return _hits(
            queries, rows, query_id, row_id, q_at, r_at, {"sim": found, "overlap": scores}
        )

    q = mentions.select(query_id, "term", "vector", class_column)
    d = concepts.select(row_id, "entity", "vector", class_column)
    hits = _in_blocks(
        q, d, class_column, query_id, row_id, dictionary_block, query_block
    ).applyInArrow(best, f"{_types(q, d, query_id, row_id)}, sim double, overlap double")
    winner = best_by(hits, [query_id], "overlap", row_id).drop("overlap")
    named = concepts.select(
        row_id, "entity",
        F.nullif(F.col("mapped_cui").cast("string"), F.lit("")).alias("cui"),
    )
    linked = winner.join(named, row_id).drop(row_id)
    return (
        mentions.join(linked, query_id, "left")
        .withColumn("similarity", F.coalesce("sim", F.lit(1.0)))
        .withColumn("canonical_name", F.coalesce("entity", "term"))
        .drop("sim", "entity")
    )


def link_nearest(
    mentions: DataFrame,
    concepts: DataFrame,
    *,
    floor: float = lx.SCORING_LINK_FLOOR,
    class_column: str = "macro_type",
    query_id: str = "query_id",
    row_id: str = "row_idx",
    **blocks: int,
) -> DataFrame:
    """Single nearest concept of the class above ``floor``: ``[query_id, cui, sim]``.

    Concepts without an id compete for the nearest place but link nothing only
    when their id is empty; rows with a null id are left out beforehand.
    """
    usable = concepts.where(F.col("mapped_cui").isNotNull())
    best = knn(
        mentions, usable, 1, floor=floor, strict=True, class_column=class_column,
        query_id=query_id, row_id=row_id, **blocks,
    )
    ids = usable.select(row_id, F.col("mapped_cui").cast("string").alias("cui"))
    return best.join(ids, row_id).where(F.col("cui") != "").select(query_id, "cui", "sim")


def rerank(
    hits: DataFrame,
    lexical: Column,
    *,
    weight: float = lx.LEXICAL_WEIGHT,
    floor: float = lx.CANDIDATE_FLOOR,
    query_id: str = "query_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Best hit by ``sim + weight * lexical``; the closer vector wins a tie.

    The reported ``sim`` is the vector similarity of the winner.
    """
    scored = hits.where(F.col("sim") >= floor).withColumn("hybrid", F.col("sim") + weight * lexical)
    return best_by(
        scored.select(query_id, "sim", "hybrid", "rk", *keep), [query_id], "hybrid", "rk"
    ).drop("rk")


def dual_decision(diagnosis: Column, diagnosis_id: Column, symptom: Column) -> Column:
    """Diagnosis or symptom, from the best similarity in either dictionary."""
    d, s = F.coalesce(diagnosis, F.lit(-1.0)), F.coalesce(symptom, F.lit(-1.0))
    wins = (d >= s) & diagnosis_id.isNotNull() & (d >= lx.DIAGNOSIS_FLOOR)
    return F.when(wins, F.lit(lx.DIAGNOSIS)).otherwise(F.lit(lx.SYMPTOM))


def dual_link(
    queries: DataFrame,
    diagnosis: DataFrame,
    symptom: DataFrame,
    *,
    query_id: str = "query_id",
) -> DataFrame:
    """Decide the type of disease mentions from retrieval in two dictionaries.

    ``diagnosis``: ``[query_id, sim, id]``; ``symptom``: ``[query_id, sim]``.
    Adds ``type`` and ``candidates``.
    """
    d = diagnosis.select(query_id, F.col("sim").alias("_d"), F.col("id").cast("string").alias("_id"))
    s = symptom.select(query_id, F.col("sim").alias("_s"))
    joined = queries.join(d, query_id, "left").join(s, query_id, "left")
    kind = dual_decision(F.col("_d"), F.col("_id"), F.col("_s"))
    return (
        joined.withColumn("type", kind)
        .withColumn(
            "candidates",
            F.when(F.col("type") == lx.DIAGNOSIS, F.array("_id")).otherwise(
                F.expr("cast(array() as array<string>)")
            ),
        )
        .drop("_d", "_s", "_id")
    )


def as_candidates(ident: Column, *, split_ids: bool = False) -> Column:
    """A concept id as a candidate list; ``split_ids`` takes `a|b` apart."""
    text = ident.cast("string")
    listed = F.split(text, r"[|]") if split_ids else F.array(text)
    return F.when(tx.is_filled(text), listed).otherwise(F.expr("cast(array() as array<string>)"))


