"""Samples, splits, pairs, similarities and metrics."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.functions import similarity as sim
from medloom.functions import text as tx
from medloom.operators import corpus as cp
from medloom.operators import metrics as mt
from medloom.operators import pairs as pr
from medloom.operators import sampling as sm


@pytest.mark.parametrize("n", [0, 1, 9, 10, 103])
def test_split_sizes_are_exact(spark, n):
    df = sm.split(spark.range(n), F.col("id"))
    sizes = dict(df.groupBy("split").count().collect())
    train, dev = int(n * 0.8), int(n * 0.1)
    assert sizes == {k: v for k, v in (("train", train), ("dev", dev), ("test", n - train - dev)) if v}
    again = sm.split(spark.range(n).repartition(3), F.col("id"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, again.collect()))


def _codes(spark, children):
    rows = [(-3, "A00", "tả"), (-2, "B00", "sốt"), (-1, "B00", "Sốt cao"), (-4, "C00", "tả")]
    rows += [(i, f"{p}.{i}", name) for i, (p, name) in enumerate(children)]
    return spark.createDataFrame(rows, "row_idx long, id string, name string")


def test_negative_pairs_with_a_hot_name(spark):
    # nearly all children carry the parents' names, so most draws fail
    rng = random.Random(5)
    children = [(rng.choice(["A00", "B00", "C00"]), rng.choice([" TẢ ", "sốt cao"])) for _ in range(200)]
    children.append(("C00", "hiếm"))
    codes = _codes(spark, children)
    positives = pr.parent_child_pairs(codes)
    got = pr.negative_pairs(codes, positives).collect()
    parents = {i: p for i, (p, _) in enumerate(children)}
    names = {"A00": "tả", "B00": "Sốt cao", "C00": "tả"}
    want = {i for i, (p, n) in enumerate(children) if n.strip().lower() != names[p].lower()}
    assert {r.row_idx for r in positives.collect()} == want
    assert {r.row_idx for r in got} == want
    # "tả" stands for the first parent of that name, C00 by row order
    own = {"tả": "C00", "Sốt cao": "B00"}
    pool = {}
    for p, n in children:
        pool.setdefault(n, set()).add(p)
    for r in got:
        assert r.matching_term.strip().lower() != r.query_term.lower()
        assert pool[r.matching_term] - {own[r.query_term]}, "some other parent has this child"
        assert parents[r.row_idx]


def test_no_eligible_child_gives_no_pair(spark):
    codes = _codes(spark, [("A00", "x"), ("A00", "y")])
    codes = codes.where(F.col("row_idx") != -4)
    assert pr.negative_pairs(codes, pr.parent_child_pairs(codes)).collect() == []


def test_gestalt_and_best_name(spark):
    rows = [("Aspirin", "aspirin 81"), ("", "x"), ("đau", "ĐAU"), ("a" * 250 + "b", "b" + "a" * 250)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.r for r in df.select(sim.gestalt("a", "b").alias("r")).collect()]
    want = [
        difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0
        for a, b in rows
    ]
    assert got == want
    df = spark.createDataFrame([("ho", None, "nan", "xx|ho khan|ho", 7)], "q string, a string, b string, c string, d int")
    best = df.select(sim.best_lexical(F.col("q"), *[F.col(c) for c in "abcd"]).alias("r")).first()["r"]
    assert best == 1.0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_error_rate(spark):
    rng = random.Random(1)
    rows = [("aspirin 81 mg po daily", "aspirin 81 mg daily"), ("", ""), ("", "x"), ("a b", "")]
    rows += [
        (" ".join(rng.choices("abcde", k=rng.randint(1, 9))), " ".join(rng.choices("abcde", k=rng.randint(0, 9))))
        for _ in range(100)
    ]
    rows.append((" ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1, 3000))))
    df = spark.createDataFrame(rows, "g string, p string")
    got = [r.r for r in df.select(sim.word_error_rate(F.col("g"), F.col("p")).alias("r")).collect()]
    for (g, p), r in zip(rows[:-1], got):
        a, b = g.split(), p.split()
        assert r == pytest.approx(edits(a, b) / len(a) if a else float(bool(b)))
    assert got[0] == pytest.approx(0.2)
    assert got[-1] == pytest.approx(1 / 3000)


@pytest.mark.parametrize(
    "a, b, want", [([], [], 1.0), ([], ["a"], 0.0), (["a", "b"], ["a"], 0.5), (["a"], ["b"], 0.0)]
)
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(tx.set_jaccard(F.col("a"), F.col("b")).alias("j")).first()["j"] == want


@pytest.mark.parametrize(
    "wer, assertion, candidate, total",
    [
        (85.948, 8.7434, 3.7516, 8.33930),
        (80.785, 20.8896, 12.3597, 16.97530),
        (78.0532, 22.1193, 13.0171, 18.42670),
        (77.9624, 22.8200, 13.2756, 18.76750),
        (76.2642, 25.0139, 13.8149, 20.15090),
    ],
)
def test_published_totals(spark, wer, assertion, candidate, total):
    got = spark.range(1).select(
        mt.weighted_total(F.lit(100 - wer), F.lit(assertion), F.lit(candidate)).alias("t")
    )
    assert got.first()["t"] == pytest.approx(total, abs=1e-4)


def test_wrong_type_counts_twice(spark):
    schema = "doc_id int, type string, start int, text string, assertions array<string>, candidates array<string>"
    gold = spark.createDataFrame([(1, "S", 0, "mất ngủ", [], None), (1, "D", 9, "hen", [], ["J45"])], schema)
    pred = spark.createDataFrame([(1, "D", 0, "mất ngủ", [], ["F51"]), (1, "D", 9, "hen", [], ["J45"])], schema)
    got = mt.task_score(gold, pred).first()
    assert got.n == 3
    assert got.text_score == pytest.approx(1 / 3)
    assert got.candidates_score == pytest.approx(2 / 4)


def test_cleaning(spark):
    rows = [(" á  b\t(c)! ", "ab"), ("x_y  z.", "")]
    df = spark.createDataFrame(rows, "s string, t string")
    got = df.select(tx.clean_gold(F.col("s")).alias("g"), tx.clean_training(F.col("s")).alias("t")).collect()
    # the combining mark is deleted before composition
    assert [r.g for r in got] == ["a b c", "x_y z."]
    assert [r.t for r in got] == ["á b\t(c"[:4] + " (c", "x y z"]


def test_language(spark):
    df = spark.createDataFrame([("KHÔNG",), ("no",), ("á",)], "s string")
    assert [r.l for r in df.select(tx.detect_language(F.col("s")).alias("l")).collect()] == ["vi", "en", "en"]


def test_relabel(spark):
    answer = (
        '[{"entity":"khó thở","type":"Disease/Symptom","start_token":3,"end_token":4},'
        '{"entity":"u","type":"Disease/Symptom","start_token":0,"end_token":0},'
        '{"entity":"5 mg","type":"Drug","start_token":0,"end_token":1},'
        '{"entity":"viêm phổi","type":"Disease/Symptom","start_token":9,"end_token":9},'
        '{"entity":"truyền","type":"Procedure/Treatment","start_token":0,"end_token":0}]'
    )
    chat = spark.createDataFrame(
        [
            ([("system", "s"), ("user", "Bệnh nhân không khó thở. truyền 5 mg"), ("assistant", answer)],),
            ([("user", "x"), ("assistant", "not json")],),
        ],
        "messages array<struct<role:string,content:string>>",
    )
    first, second = cp.relabel(chat).collect()
    schema = "array<struct<entity:string,type:string,assertions:array<string>>>"
    new = spark.createDataFrame([(first.messages[2].content,)], "c string").select(
        F.from_json("c", schema).alias("e")
    ).first()["e"]
    assert [(e.entity, e.type, e.assertions) for e in new] == [
        ("khó thở", lx.SYMPTOM, ["isNegated"]), ("u", lx.DIAGNOSIS, []),
        ("viêm phổi", lx.DIAGNOSIS, []), ("truyền", lx.DRUG, []),
    ]
    assert first.messages[0].content == lx.RELABEL_PROMPT
    assert (first.total, first.modified, first.dropped) == (5, 4, 1)
    assert second.messages[1].content == "not json" and second.total == 0


def test_lexicon_sizes():
    assert len(lx.SEMANTIC_CATEGORY) == 66
    assert len(lx.SCORING_CLASS) == 24
    assert len(lx.GOLD_CLASS) == 16
    assert len(lx.VOCABULARY_KEY) == 16 and len(set(lx.VOCABULARY_KEY.values())) == 11
