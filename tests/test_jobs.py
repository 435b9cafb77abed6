"""Composite jobs on Vietnamese notes, with toy models behind the plug points."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.plans.extraction import Extractor
from medloom.plans.models import (
    LexiconAnnotator, LexiconMatcher, ModelAnnotator, ModelEncoder, NgramEncoder, dictionary_vectors,
)
from medloom.plans.notes import Dictionaries, process_notes
from medloom.plans.scoring import evaluate, generated_entities, tagged_entities
from medloom.sources.writers import note_json
from medloom.streaming.notes import run_stream, stream_notes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOTE = """1. Tiền sử bệnh
- Không viêm phổi
2. Bệnh sử hiện tại
Bệnh nhân không sốt nhưng có khó thở, dùng aspirin 81 mg po daily.
Có đái tháo đường.
3. Đánh giá tại bệnh viện
MRI: bình thường
truyền 5 mg"""

LABELS = {
    "viêm phổi": "Disease/Symptom", "sốt": "Disease/Symptom", "khó th": "Disease/Symptom",
    "aspirin": "Drug", "đái tháo đường": "Disease/Symptom", "MRI": "Procedure/Treatment",
    "truyền": "Procedure/Treatment", "Bệnh nhân": "Person",
}


def tagger():
    def tag(lines):
        out = []
        for line in lines:
            hits = sorted((line.index(w), w) for w in LABELS if w in line)
            out.append([(w, LABELS[w]) for _, w in hits])
        return out

    return tag


def encoder():
    axes = {"viêm phổi": 0, "viêm phổi nặng": 0, "đái tháo đường": 1, "aspirin 81 mg po daily": 2, "aspirin": 2, "zzz": 1}

    def encode(texts):
        return [[1.0 if axes.get(t, 3) == i else 0.0 for i in range(4)] for t in texts]

    return encode


@pytest.fixture
def notes(spark):
    return spark.createDataFrame([("n1", NOTE), ("n2", "không có gì")], "doc_id string, text string")


@pytest.fixture
def dictionaries(spark):
    enc = ModelEncoder(encoder)
    diagnosis = spark.createDataFrame(
        [(0, "J18", "viêm phổi"), (1, "J18.9", "viêm phổi nặng"), (2, "E11", "đái tháo đường")],
        "row_idx int, id string, name_vi string",
    )
    drug = spark.createDataFrame(
        [(0, "1191|1192", "aspirin", None), (1, "5", "zzz", "x|y")], "row_idx int, rxcui string, term string, atc string"
    )
    symptom = spark.createDataFrame([(0, "sốt")], "row_idx int, name_vi string")
    return Dictionaries(
        dictionary_vectors(diagnosis, "name_vi", enc), dictionary_vectors(drug, "term", enc),
        dictionary_vectors(symptom, "name_vi", enc),
    )


WANT = [
    ("viêm phổi", lx.DIAGNOSIS, ["isHistorical", "isNegated"], ["J18"]),
    ("sốt", lx.SYMPTOM, ["isNegated"], None),
    ("khó thở", lx.SYMPTOM, [], None),
    ("aspirin 81 mg po daily", lx.DRUG, [], ["1191|1192"]),
    ("đái tháo đường", lx.DIAGNOSIS, [], ["E11"]),
    ("MRI", lx.TEST_NAME, [], None),
    ("bình thường", lx.TEST_RESULT, [], []),
    ("truyền 5 mg", lx.DRUG, [], []),
]


def test_notes_end_to_end(spark, notes, dictionaries):
    got = process_notes(notes, ModelAnnotator(tagger), dictionaries, ModelEncoder(encoder))
    rows = got.orderBy("doc_id", "entity_idx").collect()
    assert [(r.text, r.type, r.assertions, r.candidates) for r in rows] == WANT
    assert all(NOTE[r.start : r.end] == r.text for r in rows)
    split = process_notes(
        notes, ModelAnnotator(tagger), dictionaries, ModelEncoder(encoder), split_ids=True
    )
    assert split.where(F.col("text").startswith("aspirin")).first().candidates == ["1191", "1192"]


def test_notes_without_dictionaries(spark, notes):
    got = process_notes(notes, ModelAnnotator(tagger), Dictionaries(), ModelEncoder(encoder))
    kinds = {r.text: (r.type, r.candidates) for r in got.collect()}
    assert kinds["viêm phổi"] == (lx.SYMPTOM, None)
    assert kinds["aspirin 81 mg po daily"] == (lx.DRUG, [])


def test_stream(spark, notes, dictionaries, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "n1.txt").write_text(NOTE, encoding="utf-8")

    def run():
        query = run_stream(
            stream_notes(spark, str(source)),
            lambda df: process_notes(df, ModelAnnotator(tagger), dictionaries, ModelEncoder(encoder)),
            str(out), str(tmp_path / "ck"),
        )
        query.awaitTermination(120)

    run()
    (source / "n2.txt").write_text("không có gì", encoding="utf-8")
    run()
    got = {r.doc_id: r.json for r in spark.read.parquet(str(out)).collect()}
    want = note_json(
        notes, process_notes(notes, ModelAnnotator(tagger), dictionaries, ModelEncoder(encoder))
    )
    assert got == {r.doc_id: r.json for r in want.collect()}
    assert got["n2"] == "[]"


def test_lexicon_annotator_takes_the_longest(spark):
    terms = spark.createDataFrame(
        [("Đau", "A", 0), ("đau  ngực", "B", 1), ("ngực trái", "C", 2), ("đau", "Z", 3)],
        "term string, label string, row_idx int",
    )
    notes = spark.createDataFrame(
        [("1", "Đau ngực trái, đau.\n(ngực trái)"), ("2", "x")], "doc_id string, text string"
    )
    got = {r.doc_id: [tuple(e) for e in r.raw] for r in LexiconAnnotator(terms).annotate(notes).collect()}
    assert got == {"1": [(0, "Đau ngực", "B"), (0, "đau", "A"), (1, "ngực trái", "C")], "2": []}


def test_extractor_modes(spark, notes):
    with pytest.raises(ValueError):
        Extractor("nothing")
    ner = Extractor("NER only", annotator={"vi": ModelAnnotator(tagger), "en": ModelAnnotator(tagger)})
    got = ner.extract(notes).orderBy("idx").collect()
    # section 1 and 2 labels outside the final types stay at this level
    assert ("Bệnh nhân", "Person") in [(r.term, r.label) for r in got]
    assert all(NOTE[r.start : r.end] == r.term for r in got)

    concepts = spark.createDataFrame(
        [("viêm phổi", "C0032285", "Disease/Symptom", 0), ("aspirin", "C_1", "Drug", 1), ("viêm phổi nặng", "C9", "Disease/Symptom", 2)],
        "entity string, mapped_cui string, macro_type string, row_idx int",
    )
    enc = NgramEncoder()
    concepts = concepts.withColumn("vector", enc.vector(F.col("entity")))
    codes = spark.createDataFrame([("C0032285", {"icd10": "J18"}), ("C_1", {"icd10": "no"})], "cui string, codes map<string,string>")
    linked = Extractor("ner + retrieval", annotator=ModelAnnotator(tagger), encoder=enc, concepts=concepts, codes=codes)
    rows = {r.term: r for r in linked.extract(notes).collect()}
    assert (rows["viêm phổi"].cui, rows["viêm phổi"].codes) == ("C0032285", {"icd10": "J18"})
    assert (rows["aspirin"].cui, rows["aspirin"].codes) == ("C_1", {})
    assert (rows["sốt"].cui, rows["sốt"].similarity, rows["sốt"].canonical_name) == (None, 1.0, "sốt")


def test_matching_mode(spark):
    concepts = spark.createDataFrame(
        [("sốt", "C1", "Finding", 0), ("ho khan", "C2", "Weird", 1)], "term string, cui string, type string, row_idx int"
    )
    notes = spark.createDataFrame([("1", "Ho khan. Sốt. ho khan, Ho khan")], "doc_id string, text string")
    got = Extractor("quickumls", matcher=LexiconMatcher(concepts)).extract(notes).orderBy("idx").collect()
    assert [(r.term, r.start, r.category, r.cui) for r in got] == [
        ("Ho khan", 0, "Weird", "C2"), ("ho khan", 14, "Weird", "C2"), ("Sốt", None, "Phenotype", "C1"),
    ]


def test_doc_class_mode(spark, notes):
    class Scorer:
        def score(self, df):
            return df.select("doc_id", F.posexplode(F.array(F.lit(2.0), F.lit(0.0), F.lit(-1.0))).alias("class_idx", "logit"))

    classes = spark.createDataFrame([(0, "C1"), (1, "C2"), (2, "C3")], "class_idx int, cui string")
    kg = spark.createDataFrame(
        [("C1", "Pneumonia", "VIÊM PHỔI", None, "", 0), ("C1", "later", "x", None, None, 1)],
        "uml_id string, name string, medgemma_trans string, qwen_trans string, map_trans string, row_idx int",
    )
    concepts = spark.createDataFrame([("C2", "sốt", 0)], "mapped_cui string, entity string, row_idx int")
    job = Extractor("doc_class", scorer=Scorer(), classes=classes, kg=kg, concepts=concepts)
    rows = {(r.doc_id, r.cui): r for r in job.extract(notes).collect()}
    assert set(rows) == {("n1", "C1"), ("n1", "C2"), ("n2", "C1"), ("n2", "C2")}
    hit = rows["n1", "C1"]
    assert (hit.term, hit.canonical_name, hit.label) == ("viêm phổi", "VIÊM PHỔI", "Diagnosis")
    assert NOTE[hit.start : hit.end] == "viêm phổi"
    assert (rows["n2", "C1"].term, rows["n2", "C1"].start) == ("VIÊM PHỔI", None)
    english = {r.cui: r for r in job.extract(notes, dl_model="long").where("doc_id = 'n1'").collect()}
    assert (english["C1"].canonical_name, english["C1"].term) == ("Pneumonia", "viêm phổi")
    assert [r.cui for r in job.extract(notes, threshold=0.6).where("doc_id = 'n2'").collect()] == ["C1"]


def test_evaluation(spark):
    enc = NgramEncoder()
    concepts = spark.createDataFrame(
        [("ho khan", "C1", "Finding", 0), ("aspirin", "C2", "Clinical Drug", 1), ("sốt", None, "Finding", 2), ("x", "C3", "Unknown", 3)],
        "entity string, mapped_cui string, mapped_type string, row_idx int",
    ).withColumn("vector", enc.vector(F.col("entity")))
    gold = spark.createDataFrame(
        [(1, {"Disease/Symptom": ["C1", "C7"], "Drug": []}), (2, {"Drug": ["C2"]})],
        "doc_id int, gold_entities map<string,array<string>>",
    )
    answers = spark.createDataFrame(
        [
            (1, 'ok ```JSON [{"entity":"ho khan","type":" symptom"},{"entity":"ho khan","type":"DISEASE"},{"entity":"aspirin","type":"Drug"}] ``` bye'),
            (2, "not json"),
        ],
        "doc_id int, answer string",
    )
    got = {r.cls: r for r in evaluate(gold, generated_entities(answers, F.col("answer")), concepts, enc).collect()}
    assert (got["Disease/Symptom"].tp, got["Disease/Symptom"].fp, got["Disease/Symptom"].fn) == (1, 0, 1)
    assert (got["Drug"].tp, got["Drug"].fp, got["Drug"].fn) == (0, 1, 1)
    assert got["ALL (micro)"].precision == 0.5
    mentions = spark.createDataFrame([(2, "aspirin", "Drug")], "doc_id int, term string, label string")
    got = {r.cls: r for r in evaluate(gold, tagged_entities(mentions), concepts, enc).collect()}
    assert (got["Drug"].tp, got["Drug"].f1) == (1, 1.0)
