"""Nearest rows through pivot cells equal those of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.operators import pruned_knn as pruned
from medloom.operators.linking import knn
from medloom.operators.pruned_knn import pruned_knn, visited_share


def frames(spark, dims=6):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(12, dims))
    rows = [centres[draw.integers(12)] + draw.normal(size=dims) * 0.05 for _ in range(600)]
    rows += [rows[3]] * 80 + [np.zeros(dims)] * 5
    queries = [centres[draw.integers(12)] + draw.normal(size=dims) * 0.05 for _ in range(60)] + [np.zeros(dims), rows[3], -rows[9]]
    kind = lambda i: ["a", "b", None][i % 3] if i % 7 else "c"
    d = spark.createDataFrame([(i, [float(x) for x in v], kind(i)) for i, v in enumerate(rows)], "row_idx long, vector array<float>, cls string")
    q = spark.createDataFrame([(f"q{i}", [float(x) for x in v], kind(i)) for i, v in enumerate(queries)], "query_id string, vector array<float>, cls string")
    return q, d


@pytest.mark.parametrize(
    ("k", "options"), [(3, {}), (1, {"class_column": "cls"}), (100, {"floor": 0.6}), (2, {"floor": 0.97, "strict": True, "class_column": "cls"})]
)
def test_equal_to_all_pairs_whatever_the_pivots(spark, k, options):
    q, d = frames(spark)
    want = sorted(((r.query_id, r.rk, r.row_idx, r.sim) for r in knn(q, d, k, **options).collect()))
    for cell_rows in (10, 50, 10_000):
        hits, visits = pruned_knn(q, d, k, cell_rows=cell_rows, **options)
        got = sorted(((r.query_id, r.rk, r.row_idx, r.sim) for r in hits.collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want])
        if cell_rows == 10 and k == 3:
            assert visited_share(visits, q.count(), d.count()) < 0.6


def test_empty_sides(spark):
    q, d = frames(spark)
    assert pruned_knn(q, d.limit(0), 3)[0].count() == 0
    assert pruned_knn(q.limit(0), d, 3)[0].count() == 0
    only_zero = d.where(~F.exists("vector", lambda x: x != 0))
    assert pruned_knn(q, only_zero, 2)[0].where(F.col("sim") == 0).count() == 2 * q.count()


def test_a_query_is_sent_once_to_a_shard_and_copies_split_a_cell(spark, monkeypatch):
    q, d = frames(spark)
    want = sorted((r.query_id, r.rk, r.row_idx) for r in knn(q, d, 3).collect())
    hits, visits = pruned_knn(q, d, 3, cell_rows=10)
    assert visits.count() <= 2 * q.count()
    monkeypatch.setattr(pruned, "DICTIONARY_BLOCK", 30)
    hits, visits = pruned_knn(q, d, 3, cell_rows=10)
    assert sorted((r.query_id, r.rk, r.row_idx) for r in hits.collect()) == want
    assert visited_share(visits, q.count(), d.count()) < 0.6
