"""Retrieval and linking against brute force."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.operators import linking as ln


def vectors(rng, n, dims=8):
    v = rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, name, **extra):
    rows = [
        (i, [float(x) for x in row], *[c[i] for c in extra.values()]) for i, row in enumerate(v)
    ]
    kinds = "".join(f", {k} string" for k in extra)
    return spark.createDataFrame(rows, f"{name} long, vector array<double>{kinds}")


def test_knn_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    q, d = vectors(rng, 37), vectors(rng, 90)
    d[50:60] = d[5]  # copies: the lowest row id wins
    got = ln.knn(
        frame(spark, q, "query_id"), frame(spark, d, "row_idx"), 3,
        dictionary_block=11, query_block=7,
    ).collect()
    sims = q @ d.T
    want = {
        (i, int(j), rk + 1)
        for i in range(len(q))
        for rk, j in enumerate(sorted(range(len(d)), key=lambda j: (-round(sims[i, j], 12), j))[:3])
    }
    assert {(r.query_id, r.row_idx, r.rk) for r in got} == want


def test_knn_floor_and_small_dictionary(spark):
    q = frame(spark, np.eye(3), "query_id")
    d = frame(spark, np.array([[1.0, 0, 0], [0, 0.6, 0.8]]), "row_idx")
    got = ln.knn(q, d, 3, floor=0.6)
    assert {(r.query_id, r.row_idx) for r in got.collect()} == {(0, 0), (1, 1), (2, 1)}
    got = ln.knn(q, d, 3, floor=0.8 - 1e-12, strict=True)
    assert {(r.query_id, r.row_idx) for r in got.collect()} == {(0, 0), (2, 1)}
    assert ln.knn(q, d.limit(0), 3).collect() == []


def test_knn_within_classes_with_one_hot_class(spark):
    rng = np.random.default_rng(2)
    q, d = vectors(rng, 60), vectors(rng, 80)
    qc = ["hot" if i % 3 else "cold" for i in range(60)]
    dc = ["hot" if i % 4 else ("cold" if i % 8 else "other") for i in range(80)]
    got = ln.knn(
        frame(spark, q, "query_id", cls=qc), frame(spark, d, "row_idx", cls=dc), 1,
        class_column="cls", dictionary_block=9, query_block=8,
    ).collect()
    sims = q @ d.T
    for i in range(60):
        mine = [j for j in range(80) if dc[j] == qc[i]]
        best = max(mine, key=lambda j: sims[i, j])
        assert [r.row_idx for r in got if r.query_id == i] == [best]


def test_link_by_class_prefers_wording(spark):
    rng = np.random.default_rng(4)
    d = vectors(rng, 40)
    q = d[:12] + 0.3 * vectors(rng, 12)
    words = ["đau đầu", "đau ngực", "sốt cao", "ho khan"]
    entities = [words[i % 4] for i in range(40)]
    terms = [words[(i + 1) % 4] for i in range(12)]
    cls = ["D"] * 40
    concepts = frame(
        spark, d, "row_idx", entity=entities, mapped_cui=[f"C{i}" if i % 5 else "" for i in range(40)],
        macro_type=cls,
    )
    mentions = frame(spark, q, "query_id", term=terms, macro_type=["D"] * 11 + ["none"])
    got = {
        r.query_id: r
        for r in ln.link_by_class(
            mentions, concepts, floor=0.3, dictionary_block=7, query_block=5
        ).collect()
    }
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    for i in range(12):
        sims = d @ qn[i]
        near = [j for j in range(40) if sims[j] > 0.3] if i < 11 else []
        if not near:
            assert (got[i].cui, got[i].similarity, got[i].canonical_name) == (None, 1.0, terms[i])
            continue

        def overlap(j):
            a, b = set(terms[i].split()), set(entities[j].split())
            return len(a & b) / len(a | b)

        best = max(near, key=lambda j: (overlap(j), -j))
        assert got[i].canonical_name == entities[best]
        assert got[i].cui == (f"C{best}" if best % 5 else None)
        assert abs(got[i].similarity - sims[best]) < 1e-9


def test_rerank_keeps_the_closer_hit_on_a_tie(spark):
    rows = [(1, 10, 0.8, 1, 0.0), (1, 11, 0.7, 2, 0.2), (2, 12, 0.6, 1, 0.0), (2, 13, 0.55, 2, 0.9), (3, 14, 0.4, 1, 1.0)]
    df = spark.createDataFrame(rows, "query_id int, row_idx int, sim double, rk int, lex double")
    got = ln.rerank(df, F.col("lex"), keep=("row_idx",)).collect()
    assert {(r.query_id, r.row_idx, r.sim) for r in got} == {(1, 10, 0.8), (2, 13, 0.55)}


def test_dual_decision(spark):
    q = spark.createDataFrame([(i,) for i in range(5)], "query_id int")
    d = spark.createDataFrame([(0, 0.9, "A"), (1, 0.7, "B"), (2, 0.6, "C"), (3, 0.45, "D")], "query_id int, sim double, id string")
    s = spark.createDataFrame([(1, 0.8), (2, 0.6)], "query_id int, sim double")
    got = {r.query_id: (r.type, r.candidates) for r in ln.dual_link(q, d, s).collect()}
    assert got == {
        0: (lx.DIAGNOSIS, ["A"]), 1: (lx.SYMPTOM, []), 2: (lx.DIAGNOSIS, ["C"]),
        3: (lx.SYMPTOM, []), 4: (lx.SYMPTOM, []),
    }


def test_a_block_of_similarities_is_bounded():
    n = 20_000
    vectors = pa.array([[float(i), 1.0] for i in range(n)])
    blocks = list(ln._similarities(pa.table({"vector": vectors[:300]}), pa.table({"vector": vectors})))
    assert sum(len(b) for _, b in blocks) == 300
    assert max(b.size for _, b in blocks) <= 1 << 20


def test_nearest_rows_found_in_parts(monkeypatch):
    monkeypatch.setattr(ln, "ROWS_AT_ONCE", 7)
    draw = np.random.default_rng(3)
    q, d = draw.integers(-2, 3, (9, 3)).astype(float), draw.integers(-2, 3, (60, 3)).astype(float)
    near = ln.Nearest(9, 4)
    near.meet(q, np.arange(9), d[30:], np.arange(30, 60))
    near.meet(q, np.arange(9), d[:30], np.arange(30))
    i, rank, sim = near.hits(1.0, strict=True)
    want = [(a, b, (q[a] @ d.T)[b]) for a in range(9) for b in np.argsort(-(q[a] @ d.T), kind="stable")[:4] if (q[a] @ d.T)[b] > 1]
    assert list(zip(i, rank, sim, strict=True)) == want
