"""Steps that must not sort, copy or repeat more than the input asks for."""

import re
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.catalog.spans import _runs
from medloom.functions import context as cx
from medloom.functions import text as tx
from medloom.operators import corpus as cp
from medloom.operators import sequence as sq


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_examples_sort_nothing(spark):
    tokens = "array<struct<word:string,tag:string>>"
    df = spark.createDataFrame(
        [(2, [("x", "B-A"), ("y", "I-A"), ("z", "O")]), (1, [("o", "O"), ("p", "B-B"), ("q", "B-A")])], f"at long, tokens {tokens}"
    )
    found = cp.tag_examples(df, "tokens", "at")
    assert "SortAggregate" not in plan(found)
    assert {(r.tag, r.entity, r.example) for r in found.collect()} == {("A", "q", "o p q"), ("B", "p", "o p")}
    spans = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame(
        [(2, ["x"], "x", [(0, 0, "A")]), (1, ["a", "b"], "a b", [(1, 1, "A"), (0, 1, "A"), (0, 0, None)])],
        f"at long, words array<string>, sentence string, spans {spans}",
    )
    found = cp.span_examples(df, "at")
    assert "SortAggregate" not in plan(found)
    assert {(r.tag, r.entity, r.example) for r in found.collect()} == {("A", "b", "a b"), (None, "a", "a b")}


def test_labels_meet_the_dictionary_in_one_pass(spark):
    df = spark.createDataFrame([(1, "t", ["Flu", "x", None]), (2, "u", []), (2, "v", ["flu"]), (None, "w", ["flu"])], "id long, text string, labels array<string>")
    truth = spark.createDataFrame([("flu", "C1", 0)], "entity string, mapped_cui string, row_idx long")
    found = cp.map_labels(df, truth, ident="id")
    assert plan(found).count("posexplode") == 1 and "Join" in plan(found)
    assert plan(found).count("Scan ExistingRDD") <= 2
    got = {(r.id, r.text, tuple(r.cuis), r.mapped, r.unmapped) for r in found.collect()}
    assert got == {(1, "t", ("C1",), 1, 2), (2, "u", ("C1",), 1, 0), (2, "v", ("C1",), 1, 0), (None, "w", (), 0, 0)}


def test_tags_are_read_in_batches(spark):
    tokens = "array<struct<word:string,tag:string>>"
    rows = [(0, None), (1, []), (2, [("a", "I-x"), (None, "I-x"), ("c", None), ("d", "B-y"), ("e", "I-y"), ("f", "Q")]), (3, [("g", "I-y")])]
    df = spark.createDataFrame(rows, f"id int, tokens {tokens}")
    repaired = df.select("id", sq.repair_bio(F.col("tokens")).alias("tokens"))
    assert "ArrowEvalPython" in plan(repaired)
    got = {r.id: r.tokens for r in repaired.collect()}
    assert got[0] is None and got[1] == [] and [t.tag for t in got[2]] == ["B-x", "I-x", "O", "B-y", "I-y", "O"] and got[3][0].tag == "B-y"
    got = {r.id: r.s for r in repaired.select("id", sq.bio_to_spans(F.col("tokens")).alias("s")).collect()}
    assert got[0] is None and got[1] == []
    assert [tuple(x) for x in got[2]] == [("a", "x", 0, 1), ("d e", "y", 3, 4)] and tuple(got[3][0]) == ("g", "y", 0, 0)


def test_matches_are_chosen_and_located_in_batches(spark):
    rows = [(0, None), (1, []), (2, [(0, 0, 2, "a"), (0, 0, 1, "b"), (0, 1, 2, "c"), (1, 0, 1, "d"), (1, 1, 1, "e")]), (3, [(0, 3, 4, "f")])]
    df = spark.createDataFrame(rows, "id int, c array<struct<line_no:int,start:int,end:int,name:string>>")
    chosen = df.select("id", sq.longest_matches(F.col("c")).alias("m"))
    assert "ArrowEvalPython" in plan(chosen)
    got = {r.id: r.m and [x.name for x in r.m] for r in chosen.collect()}
    assert got == {0: None, 1: [], 2: ["a", "d", "e"], 3: ["f"]}

    found = "array<struct<term:string,start:int,end:int,n:int>>"
    rows = [
        (0, None, [("a", None, None, 1), None]), (1, "x", None), (2, "B a b", [("b", None, None, 1), ("q", 7, 8, 2), ("A", None, None, 3), (None, 1, 2, 4), ("B", None, None, 5)]),
        (3, "İx x", [("x", None, None, 1)]), (4, "ab", [("b", None, None, 1), ("", None, None, 2)]),
    ]
    df = spark.createDataFrame(rows, f"id int, text string, f {found}")
    placed = df.select("id", sq.locate_in_text(F.col("text"), F.col("f")).alias("m"))
    assert "ArrowEvalPython" in plan(placed)
    got = {r.id: r.m and [x and tuple(x) for x in r.m] for r in placed.collect()}
    assert got == {
        0: [("a", None, None, 1), None], 1: None,
        2: [("B", 0, 1, 1), ("b", 4, 5, 5), ("A", None, None, 3), ("q", None, None, 2), (None, None, None, 4)],
        # places are those of the text in lower case, where a letter may have become two
        3: [(" ", 2, 3, 1)],
        4: [("", 0, 0, 2), ("b", 1, 2, 1)],
    }

    raw = "array<struct<line_no:bigint,word:string,label:string>>"
    rows = [(0, None, [(0, "a", "X")]), (1, "a", None), (2, "a b\n\na", [(0, "b", "X"), (0, "a", "X"), (2, "##a ", "Y"), (9, "a", "Y"), (0, "a", "Z"), (0, "b", None), (0, None, "X"), None, (0, "b", "Z")])]
    df = spark.createDataFrame(rows, f"id int, text string, raw {raw}")
    got = {r.id: r.m and [tuple(x) for x in r.m] for r in df.select("id", sq.locate_in_lines(F.col("text"), F.col("raw")).alias("m")).collect()}
    assert got == {
        0: [("a", None, None, "X")], 1: None,
        2: [("b", 2, 3, "X"), ("a", None, None, "X"), ("a", 5, 6, "Y"), ("a", None, None, "Y"), ("a", 0, 1, "Z"), (None, None, None, "X"), ("b", 2, 3, "Z")],
    }


def test_letters_are_tested_without_folding_a_text(spark):
    pattern = tx._either_case("äöüßéèêçñóí".replace("ß", ""))
    assert pattern.startswith("[") and "(?" not in pattern and tx._either_case("ak") == "(?iu)[ak]"
    every = [(chr(i),) for i in range(1, 0x3000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame(every, "c string")
    for letters in ("äöüéèêçñóí", "åÿŵ", "ơạỹ"):
        differ = F.col("c").rlike(tx._either_case(letters)) != F.col("c").rlike(f"(?iu)[{letters}]")
        assert df.where(differ).count() == 0


def test_phrases_are_cut_in_batches(spark):
    rows = [(1, "Ab cd\nEFG h"), (None, "toolong x"), (2, None), (3, ""), (4, "İabcde  abcdef")]
    found = _runs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    assert "MapInArrow" in plan(found)
    got = {tuple(r) for r in found.collect()}
    assert got == {
        (1, 0, "ab cd efg"), (1, 3, "cd efg"), (1, 3, "cd efg h"), (None, 0, "toolong"), (None, 0, "toolong x"),
        (4, 0, "i\u0307abcde"), (4, 0, "i\u0307abcde "), (4, 0, "i\u0307abcde  abcdef"), (4, 7, " abcdef"), (4, 8, "abcdef"),
    }


def test_mentions_are_cut_out_in_batches(spark):
    texts = [
        "ab-cd ef\rgh, x.y;z\nand de-mi 500 mg\nlast", "word" * 200 + " x " + "y" * 700, "a\n" + "and " * 300 + "the end",
        "😀é x😀 b\r\rc", "pain" + " " * 600 + "500 mg", "x-\ry", "", None,
    ]
    rows = [(i, t, [(s, s + n) for s in range(0, len(t or "x"), 1 if len(t or "") < 60 else 97) for n in (1, 3) if s + n <= len(t or "x")]) for i, t in enumerate(texts)]
    rows += [(len(rows), "a b", None), (len(rows) + 1, "a b", [(0, None), None, (2, 3)])]
    df = spark.createDataFrame(rows, "id int, text string, m array<struct<s:int,e:int>>")
    rules = replace(lx.VIETNAMESE, dose_tail=r"^[\s\-,]*((?:and|\d+ ?mg)[a-zA-Z0-9\s/]*)")
    cut = df.select("id", cx.mention_windows(F.col("text"), F.col("m.s"), F.col("m.e"), rules).alias("w"))
    assert "ArrowEvalPython" in plan(cut)
    got = {r.id: r.w and [tuple(x) for x in r.w] for r in cut.collect()}
    spans = df.select("id", "text", F.posexplode("m").alias("at", "m"))
    grown = tx.staged(spans, cx.repair_boundaries(F.col("text"), F.col("m.s"), F.col("m.e")).alias("g"))
    read = grown.select("id", "at", "g.*", cx.surroundings(F.col("text"), F.col("g.start"), F.col("g.end"), rules).alias("r")).select("id", "at", "start", "end", "r.*")
    asked = {(r.id, r.at): tuple(r)[2:] for r in read.collect() if r.end is not None}
    assert len(asked) > 100 and got[len(texts)] is None
    assert {(i, k): x for i, w in got.items() for k, x in enumerate(w or []) if x[1] is not None} == asked


def test_a_portion_of_a_batch_is_cut_at_once(spark, monkeypatch):
    made, arrow_udf = [], F.arrow_udf
    monkeypatch.setattr(tx, "PORTION", 1 << 16, raising=False)
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: made.append(f) or arrow_udf(kind)(f))
    cx.mention_windows(F.col("t"), F.col("s"), F.col("e"))
    sq.pieces(F.col("t"), "[ \n]")
    find, cut = made
    line = "dùng đau 😀\n"
    text = line * 1000
    starts = list(range(0, len(text), len(line)))
    texts = pa.array([text] * 20 + [None, ""])
    batch = texts, pa.array([starts] * 20 + [[0], None]), pa.array([[s + 4 for s in starts]] * 20 + [[1], None])
    found = list(find(iter([batch, tuple(x.slice(0, 0) for x in batch)])))
    # places only, where the surroundings are many times as much as the texts
    assert len(found) > 4 and sum(p.nbytes for p in found) < 4 * texts.nbytes
    rows = [r for p in found for r in p.to_pylist()]
    assert len(rows) == len(texts) and rows[21] is None and set(rows[20][0].values()) == {None}
    coded = text.encode()
    assert [m["start"] for m in rows[7]] == starts and {coded[m["at"]:m["to"]].decode() for m in rows[7]} == {"dùng"}
    for m in rows[3][::50]:
        assert coded[m["begin"]:m["at"]].decode() == text[max(m["start"] - lx.CONTEXT_CHARS, 0):m["start"]]
        assert coded[m["to"]:m["reach"]].decode() == text[m["end"]:m["end"] + cx.DOSE_CHARS]
        assert m["whole"] == (m["end"] + cx.DOSE_CHARS >= len(text)) and m["line"] == len(line) - 5
    parts = list(cut(iter([texts, texts.slice(0, 0)])))
    assert len(parts) > 4 and max(p.nbytes for p in parts) < sum(p.nbytes for p in parts) / 4
    pieces = [[x["piece"] for x in r or []] for p in parts for r in p.to_pylist()]
    assert pieces == [re.split("[ \n]", text)] * 20 + [[], [""]]
    # a module cannot be sent to workers once it holds a pandas function in use
    notes = spark.sql("select 'a b' as t, array(2) as s, array(3) as e").select("*", tx.compose("t").alias("c"))
    cut_out = cx.mention_windows(F.col("t"), F.col("s"), F.col("e"))["term"]
    assert notes.select("c", cut_out).collect() == [("a b", ["b"])]
    assert notes.select(sq.pieces(F.col("t"), " ")["piece"]).collect() == [(["a", "b"],)]
