"""Which model, draw, window, sentence or block is chosen, and that nothing is lost by it."""

import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.functions import context as cx
from medloom.functions import similarity as sim
from medloom.functions import text as tx
from medloom.operators import linking as ln
from medloom.operators import metrics as mt
from medloom.operators import pairs as pr
from medloom.operators import sequence as sq
from medloom.plans.extraction import Extractor
from medloom.plans.models import LexiconAnnotator, ModelMatcher, ModelScorer
from medloom.plans.notes import only_asserted, typed_mentions

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _tagger(spark, label):
    terms = spark.createDataFrame([("fever", label, 1)], "term string, label string, row_idx int")
    return LexiconAnnotator(terms)


class TestLanguages:
    def notes(self, spark):
        return spark.createDataFrame([("a", "fever"), ("b", "fever đau")], "doc_id string, text string")

    def labels(self, spark, models, lang=""):
        out = Extractor("ner only", annotator=models).extract(self.notes(spark), lang)
        return sorted((r.doc_id, r.label) for r in out.collect())

    def test_all_but_english_share_a_model(self, spark):
        models = {"en": _tagger(spark, "E"), "vi": _tagger(spark, "V")}
        assert self.labels(spark, models) == [("a", "E"), ("b", "V")]
        assert self.labels(spark, models, "fr") == [("a", "V"), ("b", "V")]
        assert self.labels(spark, models, "en") == [("a", "E"), ("b", "E")]

    def test_a_missing_model_is_an_error(self, spark):
        only = {"vi": _tagger(spark, "V")}
        assert self.labels(spark, only, "fr") == [("a", "V"), ("b", "V")]
        for lang in ("", "en"):
            with pytest.raises(ValueError, match="no model for en"):
                self.labels(spark, only, lang)

    def test_a_null_language_is_not_english(self, spark):
        notes = self.notes(spark).withColumn("lang", F.lit(None).cast("string"))
        models = {"en": "E", "vi": "V"}
        run = lambda df, model, key: df.withColumn("model", F.lit(model))
        got = Extractor("ner only")._per_language(notes, models, run).collect()
        assert [r.model for r in got] == ["V", "V"]


def test_sentences(spark):
    cases = {
        "take 5.5 mg now! then stop.": ["take 5.5 mg now!", "then stop."],
        "What?! No...  Yes": ["What?!", "No...", "Yes"],
        " ": [],
        "a. b.c. ": ["a.", "b.c."],
        "no end": ["no end"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", tx.sentences(F.col("t")).alias("s")).collect()} == cases
    plain = df.limit(1).select(tx.sentences(F.col("t"), at_points=True).alias("s")).first()["s"]
    assert plain == ["take 5", "5 mg now! then stop"]


@pytest.mark.parametrize("n", [0, 1, 6, 7, 30])
def test_windows_lose_no_piece(spark, n):
    tokens = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.cast("string").alias("word"), F.lit("B-Drug").alias("tag")))
    tokens = F.filter(tokens, lambda t: F.lit(n > 0))
    pieces = F.transform(tokens, lambda t: F.array(t["word"], F.lit("x")))
    got = spark.range(1).select(sq.subword_windows(tokens, pieces, max_length=8, overlap=2).alias("w")).first()["w"]
    every = [p for i in range(1, n + 1) for p in (str(i), "x")]
    body = [[p.piece for p in w if p.piece not in ("[CLS]", "[SEP]", "[PAD]")] for w in got]
    assert all(len(w) == 8 and w[0].piece == "[CLS]" for w in got)
    assert body[0] + [p for b in body[1:] for p in b[2:]] == every
    assert all(a[-2:] == b[:2] for a, b in zip(body, body[1:]))
    with pytest.raises(ValueError):
        sq.subword_windows(tokens, pieces, max_length=8, overlap=6)


def test_negatives_are_drawn_evenly_from_all_eligible_children(spark):
    rows = [(-1, "A00", "a"), (-2, "B00", "b")]
    # children of A: 400 that ask, of B: three, one of them named like A
    rows += [(i, f"A00.{i}", f"c{i}") for i in range(400)]
    rows += [(500, "B00.1", "x"), (501, "B00.2", "y"), (502, "B00.3", "A "), (503, "C00.1", "z"), (504, "C00.2", None)]
    codes = spark.createDataFrame(rows, "row_idx long, id string, name string")
    got = pr.negative_pairs(codes, pr.parent_child_pairs(codes)).where("query_term = 'a'").collect()
    drawn = Counter(r.matching_term for r in got)
    assert set(drawn) == {"x", "y", "z"} and len(got) == 400
    assert min(drawn.values()) > 90


@pytest.mark.parametrize("blocks", [{}, {"dictionary_block": 7, "query_block": 5}])
def test_retrieval_does_not_depend_on_blocks(spark, blocks, monkeypatch):
    rows = [(i, [float((i * k) % 5) for k in (1, 2, 3)], f"w{i % 7} x{i % 3}", f"C{i}", "A" if i % 2 else "B") for i in range(1, 60)]
    both = spark.createDataFrame(rows, "row_idx int, vector array<float>, entity string, mapped_cui string, macro_type string")
    queries = spark.createDataFrame(rows, "query_id int, vector array<float>, term string, c string, macro_type string").drop("c")
    tidy = lambda df: sorted(map(tuple, df.collect()))

    def found(**blocks):
        return (
            tidy(ln.knn(queries, both, 3, **blocks)),
            tidy(ln.link_by_class(queries, both, floor=0.1, **blocks).select("query_id", "cui", "similarity")),
        )

    plain = found(dictionary_block=10**6, query_block=10**6)
    monkeypatch.setattr(ln, "LEAST_QUERIES", 4)
    assert found(**blocks) == plain


def test_overlaps_of_a_block(spark):
    wordings = ["a b", "B c d", "", None, "a"]
    overlaps = ln._Overlaps(wordings)

    def direct(x, y):
        x, y = (set(str(v).lower().split()) for v in (x, y))
        return len(x & y) / len(x | y) if x | y else 1.0

    for term in ("A b", "", "none", "zz", "d b c"):
        assert overlaps.of(term).tolist() == [direct(term, w) for w in wordings]


def test_macro_row_is_the_mean_of_classes(spark):
    gold = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "i int, cls string, v string")
    pred = spark.createDataFrame([(1, "a", "x"), (3, "b", "n")], "i int, cls string, v string")
    got = {r.cls: r for r in mt.set_prf(gold, pred, ["i", "cls", "v"], "cls", macro=True).collect()}
    macro = got[mt.MACRO]
    assert (macro.precision, macro.recall, macro.tp) == (0.5, 0.25, None)
    assert macro.f1 == pytest.approx((got["a"].f1 + got["b"].f1) / 2)
    assert mt.set_prf(gold.limit(0), pred.limit(0), ["i", "cls", "v"], "cls", macro=True).where(F.col("cls") == mt.MACRO).isEmpty()


def test_scorer_and_matcher_models(spark):
    notes = spark.createDataFrame([("a", "xx"), ("b", None)], "doc_id string, text string")
    scorer = ModelScorer(lambda: lambda texts: [[len(t), -1.0] for t in texts], batch=1)
    assert sorted(map(tuple, scorer.score(notes).collect())) == [("a", 0, 2.0), ("a", 1, -1.0), ("b", 0, 0.0), ("b", 1, -1.0)]
    matcher = ModelMatcher(lambda: lambda sentences: [[(w, w.upper(), "C", 0.5, "Finding") for w in s.split()] for s in sentences])
    sentences = spark.createDataFrame([("a", 0, "u v"), ("a", 1, "")], "doc_id string, sent_no int, sentence string")
    got = sorted((r.sent_no, r.match_no, r.ngram, r.term) for r in matcher.match(sentences).collect())
    assert got == [(0, 0, "u", "U"), (0, 1, "v", "V")]
    found = Extractor("quickumls", matcher=matcher).extract(notes).collect()
    assert [(r.doc_id, r.term, r.start, r.category) for r in found] == [("a", "xx", 0, "Phenotype")]


def test_only_some_types_are_asserted(spark):
    rows = [(lx.SYMPTOM, [lx.NEGATED]), (lx.DRUG, [lx.NEGATED])]
    got = only_asserted(spark.createDataFrame(rows, "type string, assertions array<string>"), [lx.SYMPTOM])
    assert {r.type: r.assertions for r in got.collect()} == {lx.SYMPTOM: [lx.NEGATED], lx.DRUG: []}


def test_best_overlap_of_a_row(spark):
    df = spark.createDataFrame([("a b", "b c|a B", None), ("q", None, None)], "q string, x string, y string")
    got = df.select(sim.best_overlap(F.col("q"), F.col("x"), F.col("y")).alias("o")).collect()
    assert [r.o for r in got] == [1.0, 0.0]


def test_too_many_words_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(sim, "MOST_WORDS", 3)
    df = spark.createDataFrame([("a b", "a c")], "g string, p string")
    assert df.select(sim.word_error_rate(F.col("g"), F.col("p")).alias("w")).first()["w"] == 0.5
    many = df.withColumn("p", F.lit("d e f"))
    with pytest.raises(Exception, match="more different words"):
        many.select(sim.word_error_rate(F.col("g"), F.col("p")).alias("w")).collect()


def _note(seed):
    import random

    draw = random.Random(seed)
    words = ["không", "sốt", "aspirin", "81 mg po", ".", ";", "\n", ":", "-", "đau", "(", "MRI", "😀"]
    return "".join(draw.choice(words) + draw.choice(["", " ", " "]) for _ in range(120))


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_mentions_read_the_same_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(cx, "BLOCK", block)
    for seed in range(4):
        text = _note(seed)
        spans = [(i, min(len(text), i + 1 + i % 6)) for i in range(0, len(text), 7)]
        df = spark.createDataFrame([(text, spans)], "t string, m array<struct<a:int,b:int>>")
        t, cut = F.col("t"), F.col("cut")
        both = F.transform(
            "m",
            lambda m: F.struct(
                cx.surroundings(t, m["a"], m["b"]).alias("x"),
                cx.surroundings_nearby(t, cut, m["a"], m["b"]).alias("y"),
                cx.repair_boundaries(t, m["a"], m["b"]).alias("p"),
                cx.repair_nearby(t, cut, m["a"], m["b"]).alias("q"),
            ),
        )
        for r in df.withColumn("cut", cx.blocks(t)).select(F.explode(both).alias("r")).select("r.*").collect():
            assert r.x == r.y and r.p == r.q


def test_surroundings_hold_what_the_rules_read(spark):
    text = _note(9) + "\n" + "dài " * 40 + "không sốt aspirin\n\n 81 mg po\nx"
    spans = [(i, i + 3) for i in range(0, len(text) - 3, 5)]
    df = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a int, b int")
    t, a, b = F.col("t"), F.col("a"), F.col("b")
    at = cx.surroundings(t, a, b)
    whole = cx.before(t, a), tx.slice_text(t, a, b), cx.after(t, b)
    cut = F.col("at.prefix"), F.col("at.term"), F.col("at.suffix")

    def read(prefix, term, suffix):
        return F.struct(
            cx.is_negated(prefix, term, suffix), cx.drug_context(prefix, suffix), cx.dose_length(suffix), cx.result_in(suffix, b)
        )

    for r in df.withColumn("at", at).select(read(*whole).alias("w"), read(*cut).alias("c")).collect():
        assert tuple(r.w) == tuple(r.c)


def test_a_very_long_note(spark):
    line = "bệnh nhân không sốt nhưng có khó thở, dùng aspirin 81 mg po daily và ho nhiều\n"
    n, at = 300_000 // len(line), line.index("aspirin")
    notes = spark.createDataFrame([(1, line * n)], "doc_id int, text string").select(
        "doc_id", "text", cx.section_bounds(F.col("text")).alias("bounds"),
        F.expr(f"transform(sequence(0, {n - 1}), i -> struct(i * {len(line)} + {at} as start, i * {len(line)} + {at + 7} as end, 'Drug' as label))").alias("mentions"),
    )
    got = typed_mentions(notes).agg(F.count("*"), F.min("display"), F.max("display"), F.max("end")).first()
    assert tuple(got)[:3] == (n, "aspirin 81 mg po daily v", "aspirin 81 mg po daily v")
    assert got[3] == (n - 1) * len(line) + at + len("aspirin 81 mg po daily v")
