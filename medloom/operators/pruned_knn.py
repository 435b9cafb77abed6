"""Exact nearest rows with cells around pivots.

Rows of a dictionary fall to the nearest of some pivots, rows themselves, drawn evenly and in
bounded number.  A cell knows the least and greatest angle between its pivot and its rows.
Angles between unit vectors obey the triangle inequality, so what a query's angle to a pivot
says about the rows of the cell bounds their similarity from above.  A query visits its
most promising cells first, enough to hold k rows, and then only cells whose bound reaches
its k-th similarity.  The result is that of ``knn`` whatever the pivots are; they
decide how much of the dictionary is looked at.

Cells lie together in shards of bounded size.  A query goes once to each shard with a cell
that it visits, with the list of these cells, so its vector is not copied for each cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.operators.linking import DICTIONARY_BLOCK, LEAST_QUERIES, QUERY_BLOCK, Nearest, _hits, _matrix, _types, knn
from medloom.session import durable

#: rows of a cell, about, and the most pivots there are
CELL_ROWS = 2_048
MOST_PIVOTS = 1_024
#: cells of all classes that tasks hold; more classes leave one cell each
MOST_CELLS = 1 << 16
#: queries whose angles to all pivots a task holds at once
QUERIES_AT_ONCE = 512
#: arc cosines near 1 are exact to about this angle
SLACK = 1e-6


def _units(column: pa.Array) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _pivots(dictionary: DataFrame, row_id: str, cells: int) -> np.ndarray:
    """Up to ``cells`` rows that are not zero, in the order of a hash of their id."""
    usable = dictionary.where(F.exists("vector", lambda x: x != 0)).select("vector", F.xxhash64(row_id).alias("h"))
    found = usable.orderBy("h").limit(cells).select("vector").toArrow()
    if not found.num_rows:
        return np.zeros((0, 0))
    return np.unique(_units(found.column("vector").combine_chunks()), axis=0)


def _greatest(angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Greatest similarity to rows whose angle to the pivot lies in a range."""
    gap = np.maximum(np.maximum(angle - high, low - angle) - SLACK, 0)
    return np.cos(np.minimum(gap, np.pi))


def pruned_knn(
    queries: DataFrame,
    dictionary: DataFrame,
    k: int = lx.RETRIEVED,
    *,
    floor: float | None = None,
    strict: bool = False,
    class_column: str | None = None,
    query_id: str = "query_id",
    row_id: str = "row_idx",
    cell_rows: int = CELL_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """What ``knn`` returns, and the visits behind it: ``query_id, rows`` for each cell.

    Both sides need a ``vector`` column; rows that are zero are 0 similar to all and form a
    cell of their own.
    """
    spark = queries.sparkSession
    cls = F.lit("") if class_column is None else F.coalesce(F.col(class_column).cast("string"), F.lit(""))
    usable = dictionary if class_column is None else dictionary.where(F.col(class_column).isNotNull())
    d = usable.select(row_id, "vector", cls.alias("_class"))
    q = (queries if class_column is None else queries.where(F.col(class_column).isNotNull())).select(query_id, "vector", cls.alias("_class"))
    size, classes = d.agg(F.count("*"), F.approx_count_distinct("_class")).first()
    cells = max(1, min(MOST_PIVOTS, -(-size // cell_rows), MOST_CELLS // max(1, 2 * classes)))
    shipped = spark.sparkContext.broadcast(cloudpickle.dumps(_pivots(d, row_id, cells)))

    def assign(batches):
        pivots = cloudpickle.loads(shipped.value)
        for batch in batches:
            units = _units(batch.column("vector"))
            cell, angle = np.full(len(units), -1), np.zeros(len(units))
            some = np.flatnonzero(units.any(axis=1)) if len(pivots) else np.zeros(0, int)
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                sims = units[part] @ pivots.T
                cell[part] = sims.argmax(axis=1)
                angle[part] = np.arccos(np.clip(sims[np.arange(len(part)), cell[part]], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "_pivot", "_angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)
    placed = durable(d.mapInArrow(assign, f"{kinds}, _pivot long, _angle double"))
    bounds = placed.groupBy("_class", "_pivot").agg(F.min("_angle").alias("low"), F.max("_angle").alias("high"), F.count("*").alias("rows"))
    # a row for each cell of each class, MOST_CELLS at most unless classes are more
    if bounds.count() > MOST_CELLS:
        hits = knn(queries, dictionary, k, floor=floor, strict=strict, class_column=class_column, query_id=query_id, row_id=row_id)
        sizes = d.groupBy("_class").agg(F.count("*").alias("rows"))
        return hits, q.join(sizes, "_class").select(query_id, "rows")
    cells_of, where, shards = {}, [], 0
    full = DICTIONARY_BLOCK
    for n, r in enumerate(bounds.orderBy("_class", "_pivot").collect()):
        # a cell that fits goes on with the last shard, others have shards of their own
        pieces = -(-r["rows"] // DICTIONARY_BLOCK)
        if full + r["rows"] > DICTIONARY_BLOCK:
            shards, full = shards + pieces, 0
        full += r["rows"]
        where.append((r["_class"], r["_pivot"], n, shards - pieces, pieces))
        cells_of.setdefault(r["_class"], []).append((n, r["_pivot"], r["low"], r["high"], r["rows"], shards - pieces, pieces))
    known = spark.sparkContext.broadcast({c: tuple(map(np.array, zip(*v, strict=True))) for c, v in cells_of.items()})
    # as many rows as cells, MOST_CELLS at most
    numbered = F.broadcast(spark.createDataFrame(where, "_class string, _pivot long, _cell int, _from int, _pieces int"))
    shard = (F.col("_from") + F.pmod(F.xxhash64(row_id), F.col("_pieces"))).cast("int")
    rows = placed.join(numbered, ["_class", "_pivot"]).select(row_id, "vector", "_cell", shard.alias("_shard"))
    asked = q.count()
    by_cores = min(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, shards)), -(-asked // LEAST_QUERIES))
    parts = max(1, -(-asked // QUERY_BLOCK), by_cores)

    def visits(first: bool):
        """Shards a query visits with their cells: at first enough for k rows, then those that may beat ``bound``."""

        def choose(batches):
            pivots = cloudpickle.loads(shipped.value)
            for whole in batches:
                for lead in range(0, whole.num_rows, QUERIES_AT_ONCE):
                    batch = whole.slice(lead, QUERIES_AT_ONCE)
                    units = _units(batch.column("vector"))
                    # angles to pivots; a zero query is 0 similar to all, as zero rows are to all queries
                    zero = ~units.any(axis=1)
                    angles = np.arccos(np.clip(units @ pivots.T, -1, 1)) if len(pivots) else np.zeros((len(units), 0))
                    names = batch.column("_class").to_pylist()
                    bound = batch.column("bound").to_numpy()
                    at, shards, cells, rows = [], [], [], []
                    for i, c in enumerate(names):
                        if c not in known.value:
                            continue
                        cell, pivot, low, high, n, begin, pieces = known.value[c]
                        most = np.zeros(len(pivot))
                        if not zero[i]:
                            real = pivot >= 0
                            most[real] = _greatest(angles[i, pivot[real]], low[real], high[real])
                        order = np.argsort(-most, kind="stable")
                        enough = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
                        rest = order[enough:]
                        picked = np.sort(order[:enough] if first else rest[most[rest] >= bound[i] - 1e-9])
                        # cells are numbered along the shards
                        for s in np.unique(begin[picked]):
                            here = picked[begin[picked] == s]
                            for piece in range(pieces[here].max()):
                                at.append(i)
                                shards.append(s + piece)
                                cells.append(cell[here])
                                rows.append(0 if piece else n[here].sum())
                    taken = batch.select([query_id, "vector", "bound"]).take(pa.array(at, pa.int64()))
                    offsets = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
                    flat = np.concatenate(cells) if cells else np.zeros(0)
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(shards, pa.int32()), lists, pa.array(rows, pa.int64())],
                        [query_id, "vector", "bound", "_shard", "_cells", "rows"],
                    )

        return choose

    def near(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q_at, r_at, sims = [], [], []
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by(row_id)
            q_all, d_all = _matrix(queries.column("vector")), _matrix(rows.column("vector"))
            found = Nearest(len(q_all), k, queries.column("bound").to_numpy())
            lists = queries.column("_cells").combine_chunks()
            wanted = lists.flatten().to_numpy()
            asking = np.repeat(np.arange(len(q_all)), lists.value_lengths().to_numpy())
            order = np.argsort(wanted, kind="stable")
            wanted, asking = wanted[order], asking[order]
            cell = rows.column("_cell").to_numpy()
            ranks = np.argsort(cell, kind="stable")
            cell, d_all = cell[ranks], d_all[ranks]
            for c in np.unique(wanted):
                who, rows_of = (slice(*np.searchsorted(a, [c, c + 1])) for a in (wanted, cell))
                found.meet(q_all, asking[who], d_all[rows_of], ranks[rows_of])
            q_at, r_at, sims = ([x] for x in found.hits(floor, strict))
        return _hits(queries, rows, query_id, row_id, q_at, r_at, {"sim": sims})

    visit_kinds = ", ".join(f"{c} {q.schema[c].dataType.simpleString()}" for c in (query_id, "vector")) + ", bound double, _shard int, _cells array<int>, rows long"
    keys = ["_shard", "_part"]
    dealt = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy(*keys)

    def hits_of(visiting: DataFrame) -> DataFrame:
        sent = visiting.drop("rows").withColumn("_part", F.pmod(F.xxhash64(query_id), F.lit(parts)).cast("int"))
        return sent.groupBy(*keys).cogroup(dealt).applyInArrow(near, f"{_types(q, d, query_id, row_id)}, sim double")

    least = -2.0 if floor is None else floor
    first_visits = q.withColumn("bound", F.lit(least)).mapInArrow(visits(True), visit_kinds)
    first_hits = durable(hits_of(first_visits))
    kth = first_hits.groupBy(query_id).agg(F.when(F.count("*") >= k, F.min("sim")).alias("kth"))
    bounded = q.join(kth, query_id, "left").withColumn("bound", F.greatest(F.coalesce("kth", F.lit(least)), F.lit(least))).drop("kth")
    more_visits = bounded.mapInArrow(visits(False), visit_kinds)
    found = first_hits.unionByName(hits_of(more_visits))
    w = Window.partitionBy(query_id).orderBy(F.desc("sim"), F.asc(row_id))
    hits = found.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    return hits, first_visits.unionByName(more_visits).select(query_id, "rows")


def visited_share(visits: DataFrame, queries: int, rows: int) -> float:
    """Pairs that were compared, of all."""
    return (visits.agg(F.sum("rows")).first()[0] or 0) / max(1, queries * rows)
