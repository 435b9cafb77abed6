"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom import schemas
from medloom.operators import corpus as cp
from medloom.operators.lookup import build_drug_dictionary
from medloom.sources import readers as rd
from medloom.sources import writers as wr


def test_notes(spark, tmp_path):
    for name, text in (("b.x.txt", "một\r\nhai\rba"), ("a.txt", "😀"), ("c.csv", "no")):
        (tmp_path / name).write_bytes(text.encode())
    got = {r.doc_id: r.text for r in rd.read_notes(spark, str(tmp_path)).collect()}
    assert got == {"b.x": "một\nhai\nba", "a": "😀"}
    assert [r.doc_id for r in rd.read_notes(spark, str(tmp_path), limit=1).collect()] == ["a"]


def test_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text('id,name_vi\nA00,"bệnh ""tả"", nặng"\n0123,"hai\ndòng"\n', encoding="utf-8")
    got = rd.read_csv(spark, str(tmp_path / "d.csv"), schemas.DIAGNOSIS_DICTIONARY).orderBy("row_idx").collect()
    assert [(r.id, r.name_vi) for r in got] == [("A00", 'bệnh "tả", nặng'), ("0123", "hai\ndòng")]
    missing = rd.read_csv(spark, str(tmp_path / "none.csv"), schemas.DIAGNOSIS_DICTIONARY)
    assert missing.count() == 0 and missing.columns == ["id", "name_vi", "row_idx"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rd.read_csv(spark, str(tmp_path / "none.csv"), schemas.DIAGNOSIS_DICTIONARY, missing_ok=False)


def test_printed_vectors(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        'entity,mapped_cui,mapped_type,original_type,embedding\nho,C1,Finding,,"[ 0.5 -1.25e-2\n 3 1e-05]"\n'
    )
    got = rd.read_mapped_entities(spark, str(tmp_path / "m.csv")).first()
    # numbers without a decimal point are skipped
    assert [round(x, 6) for x in got.vector] == [0.5, -0.0125]


def test_parquet_sources(spark, tmp_path):
    path = str(tmp_path / "kg")
    rows = [("Disease", "flu", "C1"), ("Drug", "aspirin", "C2"), ("Phenotype", "cough", "C3")]
    spark.createDataFrame(rows, "labels string, name string, uml_id string").coalesce(1).write.parquet(path)
    kg = rd.read_kg(spark, path)
    assert [r.name for r in kg.orderBy("row_idx").collect()] == ["flu", "cough"]
    assert "PushedFilters: [In(labels" in kg._jdf.queryExecution().toString()
    assert rd.read_kg(spark, str(tmp_path / "none")).count() == 0
    voc = str(tmp_path / "voc")
    spark.createDataFrame([("C1", "MSH", "1"), ("C1", "ZZZ", "2")], "CUI string, SAB string, CODE string").write.parquet(voc)
    assert [r.CODE for r in rd.read_vocabulary(spark, voc).collect()] == ["1"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"text":"a","labels":["x"]}\n\n{bad\n{"text":"b"}\n')
    path = str(tmp_path / "t.jsonl")
    got = rd.read_jsonl(spark, path, schemas.LABELLED_TEXT, malformed="skip").collect()
    assert [r.text for r in got] == ["a", "b"]
    with pytest.raises(Exception):
        rd.read_jsonl(spark, path, schemas.LABELLED_TEXT).collect()


def test_conll_round_trip(spark, tmp_path):
    text = "a\tB-drug\nb\tI-drug\n\n \t\nc O\nd x I-ten_benh\n\n" * 40 + "last\tB-zzz\n"
    (tmp_path / "t.conll").write_text(text)
    df = rd.read_conll(spark, str(tmp_path / "t.conll"))
    got = [[tuple(t) for t in r.tokens] for r in df.orderBy("sent_id").collect()]
    assert got == [[("a", "B-drug"), ("b", "I-drug")], [("c", "O"), ("d", "I-ten_benh")]] * 40 + [[("last", "B-zzz")]]
    corpora = cp.build_corpora([df, rd.read_conll(spark, str(tmp_path / "none"))])
    assert dict(corpora.groupBy("split").count().collect()) == {"train": 64, "dev": 8, "test": 9}
    out = str(tmp_path / "out")
    wr.write_conll(corpora.orderBy("uid").coalesce(1), out)
    back = rd.read_conll(spark, out).orderBy("sent_id").collect()
    assert len(back) == 81
    assert [tuple(t) for t in back[0].tokens] == [("a", "B-Drug"), ("b", "I-Drug")]


def test_large_conll_is_read_in_parts(spark, tmp_path):
    sentence = "từ\tO\n" * 30 + "\n"
    (tmp_path / "big.conll").write_text(sentence * 4000, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = rd.read_conll(spark, str(tmp_path / "big.conll"))
        assert df.rdd.getNumPartitions() > 4
        assert df.count() == 4000
        assert df.select("sent_id").distinct().count() == 4000
        assert df.where(F.size("tokens") != 30).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_span_json(spark, tmp_path):
    data = [
        {"sentence": "thuốc  ho tốt", "seq_label": [[0, 1, "drug"], [2, 7, "zzz"]]},
        {"sentence": "đau", "seq_label": []},
    ]
    (tmp_path / "s.json").write_text(json.dumps(data, ensure_ascii=False, indent=1), encoding="utf-8")
    got = rd.read_span_json(spark, str(tmp_path / "s.json")).orderBy(F.size("words").desc()).collect()
    assert got[0].words == ["thuốc", "ho", "tốt"]
    assert [tuple(s) for s in got[0].spans] == [(0, 1, "Drug"), (2, 7, None)]
    assert got[1].spans == []


def test_terminology_files(spark, tmp_path):
    def concept(rxcui, lat, sab, tty, code, term):
        return "|".join([rxcui, lat, *[""] * 9, sab, tty, code, term, "", ""])

    def relation(a, b, rela):
        return "|".join([a, "", "", "", b, "", "", rela, "", "", "", ""])

    (tmp_path / "conso").write_text(
        "\n".join(
            [
                concept("1", "ENG", "RXNORM", "BN", "1", 'Tylenol "X" '), concept("2", "ENG", "RXNORM", "IN", "2", "acetaminophen"),
                concept("3", "ENG", "RXNORM", "PIN", "3", "ACETAMINOPHEN"), concept("2", "ENG", "ATC", "IN", "N02", "x"),
                concept("3", "ENG", "SNOMEDCT_US", "PT", "77", "x"), concept("2", "SPA", "DRUGBANK", "IN", "DB", "x"),
                "1|ENG|short",
            ]
        )
    )
    (tmp_path / "rel").write_text(
        "\n".join([relation("1", "2", "tradename_of"), relation("1", "3", "isa"), relation("1", "9", "has_ingredient")])
    )
    concepts = rd.read_rrf(spark, str(tmp_path / "conso"), lx.CONCEPT_FIELDS, lx.CONCEPT_MIN_FIELDS)
    relations = rd.read_rrf(spark, str(tmp_path / "rel"), lx.RELATION_FIELDS, lx.RELATION_MIN_FIELDS)
    got = {r.term: tuple(r)[1:] for r in build_drug_dictionary(concepts, relations).collect()}
    assert got == {
        'tylenol "x"': ("1", "BN", "acetaminophen", "", "", ""),
        "acetaminophen": ("2|3", "IN|PIN", "", "77", "N02", ""),
    }


def test_class_list_and_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('["C1",\n "C2"]')
    assert [tuple(r) for r in rd.read_class_list(spark, str(tmp_path / "c.json")).collect()] == [(0, "C1"), (1, "C2")]
    with pytest.raises(ValueError):
        rd.required_setting(spark, "medloom.terminology.path")


def test_note_files(spark, tmp_path):
    notes = spark.createDataFrame([("1", "đau ngực"), ("2", "x")], "doc_id string, text string")
    entities = spark.createDataFrame(
        [("1", 2, "ngực", lx.SYMPTOM, [], 4, 8, None), ("1", 0, "đau", lx.DRUG, ["isNegated"], 0, 3, ["7"])],
        "doc_id string, entity_idx int, text string, type string, assertions array<string>, start int, end int, candidates array<string>",
    )
    folder = tmp_path / "out"
    records = wr.note_json(notes, entities)
    wr.write_note_files(records, str(folder))
    first = json.loads((folder / "1.json").read_text(encoding="utf-8"))
    assert first == [
        {"text": "đau", "type": lx.DRUG, "assertions": ["isNegated"], "position": [0, 3], "candidates": ["7"]},
        {"text": "ngực", "type": lx.SYMPTOM, "assertions": [], "position": [4, 8]},
    ]
    assert json.loads((folder / "2.json").read_text()) == []
    assert '    {\n        "text": "đau"' in (folder / "1.json").read_text(encoding="utf-8")
    assert sorted(p.name for p in folder.iterdir()) == ["1.json", "2.json"]


def test_note_folders(spark, tmp_path):
    records = spark.createDataFrame([("1", "[]"), ("a/b", '[{"x": "đ"}]')], "doc_id string, json string")
    wr.write_note_folders(records, str(tmp_path / "n"))
    back = spark.read.text(str(tmp_path / "n"))
    assert sorted(map(tuple, back.select("doc_id", "value").collect())) == [("1", "[]"), ("a/b", '[{"x": "đ"}]')]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "name string, vector array<float>")
    wr.write_once(df, str(tmp_path / "once"))
    wr.write_once(df.withColumn("name", F.lit("b")), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).first().name == "a"
    wr.write_vectors(df, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first().vector == [1.0, 2.0]
    wr.write_csv(df.select("name", F.lit('x "y", z').alias("t")), str(tmp_path / "c"))
    assert spark.read.options(header=True, escape='"').csv(str(tmp_path / "c")).first().t == 'x "y", z'
    wr.write_jsonl(df.select("name"), str(tmp_path / "j"))
    wr.write_note_table(df.select("name"), str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "j")).first().name == "a"
