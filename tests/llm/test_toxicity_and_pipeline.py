"""The random field against enumeration, held-out accuracy, and the pipeline."""

import itertools
import os
import subprocess
import sys
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from medloom.llm import near_dedup, toxicity

DATA = "/root/testdata/sf0.01"


def by_enumeration(emission, first, moves, enter):
    """Marginals, expected moves and entries from all label sequences of each chain."""
    n = len(emission)
    p, pairs, starts = np.zeros(n), np.zeros((2, 2)), np.zeros(2)
    at = [*np.flatnonzero(first), n]
    for a, b in itertools.pairwise(at):
        total, own, moved, entered = 0.0, np.zeros(b - a), np.zeros((2, 2)), np.zeros(2)
        for labels in itertools.product((0, 1), repeat=b - a):
            s = enter[labels[0]] + sum(e for e, y in zip(emission[a:b], labels) if y) + sum(moves[i, j] for i, j in itertools.pairwise(labels))
            w = np.exp(s)
            total += w
            own += w * np.array(labels)
            entered[labels[0]] += w
            for i, j in itertools.pairwise(labels):
                moved[i, j] += w
        p[a:b] = own / total
        pairs += moved / total
        starts += entered / total
    return p, pairs, starts


@pytest.mark.parametrize("lengths", [[1], [5], [3, 1, 1, 6, 2], [9, 9], [1] * 7])
def test_marginals_equal_enumeration(lengths):
    draw = np.random.default_rng(sum(lengths))
    n = sum(lengths)
    first = np.zeros(n, bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    args = draw.normal(0, 2, n), first, draw.normal(0, 1, (2, 2)), draw.normal(0, 1, 2)
    for got, true in zip(toxicity.marginals(*args, pairs=True), by_enumeration(*args)):
        assert np.allclose(got, true)


def made_up(n, seed):
    """Toxic texts have two or more words that begin with 'zorg' or are 'vile'."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 7)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(draw.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(draw.randint(2, 5)):
                words[draw.randrange(len(words))] = draw.choice(["Vile", "zorg" + word(), "ZORG" + word()])
        texts.append(" ".join(words))
        labels.append(i % 4 == 0)
    return texts, labels


def test_unseen_words_spans_and_held_out_accuracy():
    model = toxicity.fit(*made_up(800, 1))
    texts, labels = made_up(400, 2)
    scored = toxicity.score_texts(texts, model)
    right = sum((s >= 0.5) == y for (s, _, _), y in zip(scored, labels))
    assert right >= 390
    score, starts, ends = toxicity.score_texts(["Ein, zorgnew, ZORGxy word. vile"], model)[0]
    assert score > 0.9
    assert ["Ein, zorgnew, ZORGxy word. vile"[a:b] for a, b in zip(starts, ends)] == ["zorgnew, ZORGxy", "vile"]


def test_copies_of_one_text_teach_once():
    texts, labels = made_up(400, 3)
    copied = "completely harmless words that were copied very often " * 3
    model = toxicity.fit(texts + [copied + str(i) for i in range(300)], labels + [True] * 300)
    assert toxicity.score_texts([copied], model)[0][0] < 0.5


def test_one_label_or_none():
    for texts, labels in (([], []), (["a b", "c"], [False, False]), (["a"], [True]), (["", ""], [True, False])):
        scores = [s for s, _, _ in toxicity.score_texts(["a b", "", None], toxicity.fit(texts, labels))]
        assert all(0 <= s < 0.6 for s in scores)


def test_rows_scored_whole_and_apart_from_ids(spark):
    texts, labels = made_up(300, 4)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, texts[0], 7), (5, None, 7), (6, "", 7)], "doc_id long, text string, score int")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(0, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted", "starts", "ends"]
    found = got.collect()
    assert len(found) == 303 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_text = {}
    for r in found:
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    # a long text is scored to its end
    late = toxicity.score(spark.createDataFrame([(1, "ab " * 300_000 + "vile zorgaa vile")], "doc_id long, text string"), model).first()
    assert len(late.starts) == 1 and late.starts[0] == 900_000
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.train(docs, marks.limit(0)).weights == {}


def test_held_out_rows_are_never_sampled(spark):
    labels = spark.range(1000).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    sample = toxicity.sample_labels(labels, 50, 100)
    assert sample.where(toxicity.held_out()).isEmpty()
    assert {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()} == {True: 50, False: 100}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.saved(stage(spark, out[-1], DATA), name.replace(" ", "-")))
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
class TestPipeline:
    def test_columns_and_ids(self, stages):
        assert [name for name, _ in corpus_pipeline.STAGES] == [
            "toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources",
        ]
        for before, after in itertools.pairwise(stages):
            assert after.columns[: len(before.columns)] == before.columns
            assert after.join(before, "doc_id", "left_anti").isEmpty()
        assert stages[-1].columns[len(stages[0].columns) :] == ["size", "source_size", "target", "taken"]

    def test_stages_do_their_work(self, spark, stages):
        _, calm, lines, apart, clean, mixed = stages
        # toxicity and lines: a document lost its lines to earlier documents
        before = {r.doc_id: r.text for r in calm.collect()}
        after = {r.doc_id: r.text for r in lines.collect()}
        assert all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in after.items())
        truth = near_dedup.near_dedup(lines).collect()
        assert {r.doc_id for r in apart.collect()} == {r.doc_id for r in truth if r.kept}
        assert {r.class_id for r in truth} == {r.doc_id for r in apart.collect()}
        gone = apart.join(clean, "doc_id", "left_anti")
        assert gone.count() > 0 and clean.count() > 0.9 * apart.count()
        assert mixed.where("taken <= 0 or taken > 3 * size").isEmpty()

    def test_run(self, spark, stages):
        same = lambda df: sorted((r.doc_id, r.taken) for r in df.select("doc_id", "taken").collect())
        assert same(corpus_pipeline.run(spark, DATA)) == same(stages[-1])


@pytest.mark.parametrize("column", ["doc_id", "text", "source"])
def test_stages_take_nulls_and_no_rows(spark, tmp_path, column):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "some text here", "en", "a", 1), (2, "x", "en", "a", 1), (2, "x", "en", "a", 1)], columns)
    docs = docs.withColumn(column, F.when(F.col("doc_id") == 2, F.col(column)))
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such item words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, str(tmp_path)).columns == rows.columns
            assert stage(spark, rows, str(tmp_path)).count() == rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() <= rows.count()


def test_a_passage_of_two_documents_is_kept_once(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = [(1, f"own start\n{passage}"), (2, f"{passage}\nanother end"), (3, "third text")]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert {r.doc_id: r.text for r in got} == {1: f"own start\n{passage}", 2: "another end", 3: "third text"}
    # two lines of one leaf are too few to generalise a place
    docs = [(1, "posted by user ann on the public list"), (2, "posted by user bob on the public list")]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == docs


def test_rows_of_different_numbers_are_different_lines(spark):
    docs = [(i, f"{i} {i + 1} {i + 2}\nTotal: 1,{i}34") for i in range(5)] + [(9, "0 1 2")]
    docs += [(20 + i, f"own {chr(97 + i)}\nsee all of the notes on page {i}") for i in range(2)]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    # the equal row goes, and the line with one field in eight tokens
    assert {r.doc_id: r.text for r in got} == dict(docs[:5]) | {20: docs[6][1], 21: "own b"}


def test_the_texts_learnt_from_do_not_depend_on_the_process():
    code = (
        "import random; from medloom.llm.toxicity import unlike; d = random.Random(1); base = [f'w{i}' for i in range(60)]\n"
        "print(unlike([' '.join(w if d.random() < 0.6 else f'x{d.random()}' for w in base) for _ in range(200)]))"
    )
    run = lambda seed: subprocess.run(
        [sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": os.pathsep.join(sys.path)},
        capture_output=True, text=True, check=True,
    ).stdout
    assert run("1") == run("2")


def test_fitting_takes_a_bounded_number_of_characters(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('word ', 20) AS text").unionByName(
        spark.range(200, 203).selectExpr("id AS doc_id", "repeat('x', 100000) AS text")
    ).selectExpr("*", "1 AS n")
    marks = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    toxicity.train(docs, marks)
    monkeypatch.setattr(toxicity, "MAX_CHARS", 5_000)
    toxicity.train(docs, marks)
    toxicity.train(docs, marks)
    assert sum(map(len, seen[0][0])) > 200_000 and 4_900 <= sum(map(len, seen[1][0])) <= 5_000
    assert seen[1] == seen[2] and set(seen[1][1]) == {True, False}
