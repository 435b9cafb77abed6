"""Matrices and note files through Spark's data sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.sources import formats as ff


@pytest.fixture(scope="module")
def session(spark):
    ff.register(spark)
    return spark


def test_matrices_are_read_in_row_ranges(session, tmp_path):
    draw = np.random.default_rng(1)
    parts = [draw.normal(size=(7, 5)).astype(np.float32), draw.normal(size=(10, 5)), draw.integers(0, 9, (1, 5))]
    for i, m in enumerate(parts):
        np.save(tmp_path / f"m{i}.npy", m)
    (tmp_path / "other.txt").write_text("no matrix")
    for rows in (1, 3, 1000):
        df = session.read.format("npy").option("rowsPerPartition", rows).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == sum(-(-len(m) // rows) for m in parts)
        found = {r.row: r.vector for r in df.collect()}
        assert sorted(found) == list(range(18))
        assert np.allclose([found[i] for i in range(18)], np.concatenate(parts).astype(np.float32))
    one = session.read.format("npy").load(f"file://{tmp_path}/m1.npy")
    assert [r.row for r in one.orderBy("row").collect()] == list(range(10))


def test_round_trip_keeps_rows_in_place(session, tmp_path):
    df = session.range(1000).select(F.col("id").alias("row"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vector"))
    out = str(tmp_path / "v")
    for _ in range(2):
        df.repartitionByRange(4, "row").sortWithinPartitions("row").write.format("npy").option("rowsPerFile", 64).mode("overwrite").save(out)
    back = session.read.format("npy").option("rowsPerPartition", 50).load(out)
    assert back.where(F.col("row") != F.col("vector")[0].cast("long")).isEmpty() and back.count() == 1000
    loaded = [np.load(p) for p in sorted((tmp_path / "v").glob("*.npy"))]
    assert sum(map(len, loaded)) == 1000 and max(map(len, loaded)) == 64
    assert not list((tmp_path / "v").glob("_staging*"))


def test_refused_matrices_and_empty_folders(session, tmp_path):
    assert session.read.format("npy").load(str(tmp_path)).count() == 0
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(Exception, match="no matrix"):
        session.read.format("npy").load(str(tmp_path)).count()
    bad = session.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "row long, vector array<float>")
    with pytest.raises(Exception, match="different lengths"):
        bad.coalesce(1).write.format("npy").mode("append").save(str(tmp_path / "x"))
    assert not list(tmp_path.glob("x/*"))


def test_note_files_are_committed_or_absent(session, tmp_path):
    rows = [(f"n{i}", json.dumps([{"text": "đau", "i": i}])) for i in range(40)]
    df = session.createDataFrame(rows, "doc_id string, json string").repartition(5)
    out = tmp_path / "notes"
    df.write.format("note_files").mode("append").save(f"file://{out}")
    assert {p.stem for p in out.iterdir()} == {f"n{i}" for i in range(40)}
    text = (out / "n3.json").read_text()
    assert json.loads(text) == [{"text": "đau", "i": 3}] and "đau" in text and "\n    " in text
    # one task fails: nothing is left of the others
    broken = df.withColumn("json", F.when(F.col("doc_id") == "n7", "{").otherwise(F.col("json")))
    with pytest.raises(Exception, match="Expecting|JSON"):
        broken.write.format("note_files").mode("append").save(str(tmp_path / "failed"))
    assert not list(tmp_path.glob("failed/*"))
    with pytest.raises(Exception, match="same file name"):
        df.unionByName(df).write.format("note_files").mode("append").save(str(tmp_path / "twice"))
    assert not list(tmp_path.glob("twice/*"))
    # overwriting replaces the notes of before
    df.limit(1).write.format("note_files").mode("overwrite").save(str(out))
    assert len(list(out.iterdir())) == 1
