"""Dictionary matches: exact by first words, and approximate ones."""

import random

import pytest
from pyspark.sql import functions as F

from medloom.operators.similarity_join import similarity_join
from medloom.plans.extraction import Extractor
from medloom.plans.models import ApproximateMatcher, LexiconAnnotator, LexiconMatcher

CONCEPTS = "term string, cui string, type string, row_idx long"


def grams(s, n=3):
    s = f"^{s}$"
    return {s[i : i + n] for i in range(max(1, len(s) - n + 1))}


@pytest.mark.parametrize("threshold", [0.3, 0.7, 1.0])
def test_join_equals_all_pairs(spark, threshold):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcé ") for _ in range(draw.randint(1, 14)))
    base = [word() for _ in range(60)]
    left = base + [w[:3] + draw.choice("xyz") + w[4:] for w in base] + ["", None, "a", "aa", "𝄞𝄞"]
    right = base[::2] + [w + "s" for w in base] + ["", None, "a", "aaa", "𝄞𝄞"]
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "text string").selectExpr("*", "1 AS size")
    found = {(r.left_text, r.right_text): r.similarity for r in similarity_join(frame(left), frame(right), threshold).collect()}
    want = {}
    for a in set(left) - {"", None}:
        for b in set(right) - {"", None}:
            s = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            if s >= threshold:
                want[a, b] = pytest.approx(s)
    assert found == want and len(want) > 20


def test_join_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert similarity_join(none, none, 0.7).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        similarity_join(none, none, 0)


def test_misspelt_phrases_are_found(spark):
    concepts = spark.createDataFrame(
        [("hypertension", "C1", "Finding", 1), ("diabetes mellitus", "C2", "Finding", 2), ("pneumonia", "C3", "Finding", 3), ("diabetes mellitus", "C9", "Finding", 9)], CONCEPTS
    )
    notes = spark.createDataFrame([(1, "Known hypertensoin, and diabetis mellitus. No pneumonias here."), (2, None), (3, "nothing of that kind")], "doc_id long, text string")
    got = Extractor("quickumls", matcher=ApproximateMatcher(concepts, threshold=0.5)).extract(notes).collect()
    found = {(r.doc_id, r.term.lower(), r.cui) for r in got}
    assert found == {(1, "hypertensoin", "C1"), (1, "diabetis mellitus", "C2"), (1, "pneumonias", "C3")}
    assert all(0.5 <= r.similarity < 1 for r in got)
    exact = Extractor("quickumls", matcher=LexiconMatcher(concepts)).extract(notes)
    assert exact.count() == 0


def test_terms_of_many_words(spark):
    long = " ".join(f"w{i}" for i in range(200))
    terms = spark.createDataFrame([("heart failure", "A", 1), ("acute heart failure", "B", 2), ("failure", "C", 3), (long, "D", 4), ("a, b", "E", 5)], "term string, label string, row_idx long")
    text = f"Acute  heart failure; - Heart failure, failure\n\n{long}.\na, b a b (acute heart"
    notes = spark.createDataFrame([(1, text), (2, long + " w200"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: [(e.line_no, e.word, e.label) for e in r.raw] for r in LexiconAnnotator(terms).annotate(notes).collect()}
    assert got == {
        1: [(0, "Acute  heart failure", "B"), (0, "Heart failure", "A"), (0, "failure", "C"), (2, long, "D"), (3, "a, b", "E")],
        2: [(0, long, "D")], 3: [], 4: [],
    }


def test_a_long_term_adds_no_rows(spark):
    notes = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("one two three four five six seven").alias("text"))
    short = spark.createDataFrame([("two", "A", 1)], "term string, label string, row_idx long")
    long = short.unionByName(spark.createDataFrame([(" ".join(["zero"] * 200), "B", 2)], short.schema))

    def rows(terms):
        """Rows written to the shuffles of the plan that ran."""
        frame = LexiconAnnotator(terms).annotate(notes).where(F.size("raw") == 1)
        assert len(frame.collect()) == 50
        total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
            elif node.nodeName().endswith("QueryStage"):
                todo.append(node.plan())
            else:
                metric = node.metrics().get("shuffleRecordsWritten")
                total += metric.get().value() if metric.isDefined() else 0
                todo += [node.children().apply(i) for i in range(node.children().size())]
        return total

    # one row more at most, that of the term
    assert rows(short) >= 50 and 0 <= rows(long) - rows(short) <= 2
