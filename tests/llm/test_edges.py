"""Long texts, ties and clashing names of the corpus operators."""

import pytest
from pyspark.sql import functions as F

from medloom.llm import decontaminate, mixing, preferences, prefix_trie, toxicity, url_rules

LONG = 100_000


def test_decontamination_of_a_long_text_and_item(spark):
    words = " ".join(f"w{i}" for i in range(LONG))
    docs = spark.createDataFrame([(1, f"x {words} y"), (2, "x y")], "doc_id long, text string").selectExpr("*", "1 AS n_hit", "'a' AS item_id")
    items = spark.createDataFrame([(1, words), (2, "x Y"), (3, None)], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find_hits(docs.select("doc_id", "text"), items).collect()}
    assert got == {1: (LONG + 2, LONG, ["1"]), 2: (2, 2, ["2"])}


def test_mixing_of_a_long_text_and_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "w " * LONG, "a"), (2, "w w", "b")], "doc_id long, text string, source string").selectExpr("*", "'s' AS size", "7 AS taken")
    got = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(docs).collect()}
    assert got[1][0] == LONG and got[2] == (2, 6) and got[1][1] == LONG + 2 - 6


def test_a_long_conversation_and_clashing_names(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'p' AS part", "1 AS n", "0 AS masked")
    got = preferences.preference_turns(*preferences.echo_pairs(frame))
    parts = {r.part: r["count"] for r in got.groupBy("part").count().collect()}
    assert parts == {"prompt": 2999, "chosen": 1, "rejected": 1}


def test_a_long_host_and_clashing_names(spark):
    host = "a." * 5_000 + "example.org"
    urls = [f"http://{host}/es/x", "http://" + "b" * 20_000 + ".org/" + "p" * 20_000, None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS rule", "2 AS key")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("org/", "allow"), 2: (None, "allow")}


def test_equal_texts_have_equal_scores(spark):
    model = toxicity.fit(["bad word here", "good word here"] * 6, [True, False] * 6)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["bad bad", "bad bad", "", None, "bad bad"])], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS starts")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[0] == got[1] == got[4] and got[2] == got[3] and len(got) == 5


def test_long_turns_and_a_conversation_of_many(spark):
    turns = [(7, i, "user", "x" * (300_000 if i == 5 else 1)) for i in range(9000)]
    got = prefix_trie.prefix_trie(*prefix_trie.regrown(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    # its first turns are those of conversation 0, which is not there
    deepest = got.orderBy(F.desc("depth")).first()
    assert got.count() == deepest.depth + 1 > 8990 and deepest.n_leaves == 1 and got.agg(F.sum("n_leaves")).first()[0] == got.count()


@pytest.mark.parametrize("name", ["size", "taken", "n_lines", "class_id"])
def test_the_pipeline_takes_clashing_names(spark, tmp_path, name):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "one line of words here", "a"), (2, "another text of words", "b")], "doc_id long, text string, source string")
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "source", "10L AS n_chars", f"5 AS {name}")
    for stage in ("line dedup", "MinHash near-dedup", "mixing sources"):
        out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
        assert {r.doc_id for r in out.collect()} == {1, 2} and len(set(out.columns)) == len(out.columns)
