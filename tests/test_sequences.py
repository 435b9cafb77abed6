"""Sequence operators against plain state machines."""

import random

import pytest
from pyspark.sql import functions as F

from medloom.functions.text import let
from medloom.operators import sequence as sq
from medloom.sources.readers import conll_sentences

TOKENS = "tokens array<struct<word:string,tag:string>>"


def repaired(tags, mapping):
    out, current = [], None
    for tag in tags:
        head, kind = tag[:2], mapping.get(tag[2:])
        if head not in ("B-", "I-") or kind is None:
            out.append("O")
            current = None
        else:
            out.append(("I-" if head == "I-" and current == kind else "B-") + kind)
            current = kind
    return out


def spans(tokens):
    out, words, kind, start = [], [], None, -1
    for i, (word, tag) in enumerate([*tokens, ("", "O")]):
        new = tag[2:] if tag[:2] in ("B-", "I-") else None
        if words and (tag[:2] != "I-" or new != kind):
            out.append((" ".join(words), kind, start, i - 1))
            words = []
        if new is not None:
            if not words:
                start = i
            words, kind = [*words, word], new
    return out


def test_repair_and_spans_match_a_state_machine(spark):
    rng = random.Random(7)
    tags = ["O", "B-a", "I-a", "B-b", "I-b", "I-c", "B-x", "I-x", "bad", "B-"]
    mapping = {"a": "A", "b": "B", "c": "A"}
    rows = []
    for n in range(400):
        seq = [rng.choice(tags) for _ in range(rng.randint(1, 14))]
        rows.append((n, [(f"w{i}", t) for i, t in enumerate(seq)]))
    df = spark.createDataFrame(rows, f"id int, {TOKENS}").select(
        "id", sq.repair_bio(F.col("tokens"), mapping).alias("fixed"),
        sq.bio_to_spans(F.col("tokens")).alias("spans"),
    )
    for row in df.collect():
        tokens = rows[row.id][1]
        assert [t.tag for t in row.fixed] == repaired([t for _, t in tokens], mapping)
        assert [tuple(s) for s in row.spans] == spans(tokens)


def test_repair_example(spark):
    df = spark.createDataFrame([([("a", "I-A"), ("b", "I-A"), ("c", "O"), ("d", "I-A")],)], TOKENS)
    got = df.select(sq.repair_bio(F.col("tokens")).alias("t")).first()["t"]
    assert [t.tag for t in got] == ["B-A", "I-A", "O", "B-A"]


def merged(text, mentions, gap=1):
    out = []
    for term, start, end, label in mentions:
        if out and out[-1][3] == label and out[-1][2] is not None and start is not None \
                and start - out[-1][2] <= gap:
            first = out[-1][1]
            out[-1] = (text[first:end], first, end, label)
        else:
            out.append((term, start, end, label))
    return out


def test_merge_matches_a_state_machine(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abc đ\n") for _ in range(120))
    rows = []
    for n in range(300):
        at, ms = 0, []
        for _ in range(rng.randint(1, 10)):
            if rng.random() < 0.15:
                ms.append(("?", None, None, rng.choice("XY")))
                continue
            start = max(0, at + rng.randint(-3, 4))
            end = start + rng.randint(1, 6)
            ms.append((text[start:end], start, end, rng.choice("XY")))
            at = end
        rows.append((n, text, ms))
    schema = "id int, text string, m array<struct<term:string,start:int,end:int,label:string>>"
    df = spark.createDataFrame(rows, schema)
    got = df.select("id", sq.merge_adjacent(F.col("text"), F.col("m")).alias("out"))
    for row in got.collect():
        assert [tuple(m) for m in row.out] == merged(text, rows[row.id][2])


def test_merge_crosses_a_line_break(spark):
    rows = [("đau\nngực", [("đau", 0, 3, "D"), ("ngực", 4, 8, "D"), ("x", 10, 11, "D")])]
    df = spark.createDataFrame(
        rows, "text string, m array<struct<term:string,start:int,end:int,label:string>>"
    )
    got = df.select(sq.merge_adjacent(F.col("text"), F.col("m")).alias("o")).first()["o"]
    assert [tuple(m) for m in got] == [("đau\nngực", 0, 8, "D"), ("x", 10, 11, "D")]


def test_line_starts(spark):
    got = spark.range(1).select(sq.lines(F.lit("ab\n\ncde\nf")).alias("l")).first()["l"]
    assert [(x.no, x.start, x.piece) for x in got] == [
        (0, 0, "ab"), (1, 3, ""), (2, 4, "cde"), (3, 8, "f"),
    ]


def test_starts_across_blocks(spark):
    rows = [(n, list(range(n))) for n in (0, 1, 63, 64, 65, 128, 200)]
    df = spark.createDataFrame(rows, "n int, sizes array<int>")
    for row in df.select("n", sq.starts(F.col("sizes")).alias("s")).collect():
        assert row.s == [sum(range(i)) for i in range(row.n)]


def test_locate_in_lines(spark):
    text = "ho ho, sốt\n\n😀 ho"
    raw = [(0, "ho", "D"), (0, "ho", "D"), (0, "ho", "D"), (0, " s@@ốt", "D"), (0, "x", "O"), (2, "ho", "D")]
    df = spark.createDataFrame(
        [(text, raw)], "text string, raw array<struct<line_no:int,word:string,label:string>>"
    )
    got = df.select(sq.locate_in_lines(F.col("text"), F.col("raw")).alias("o")).first()["o"]
    assert [(m.term, m.start, m.end) for m in got] == [
        ("ho", 0, 2), ("ho", 3, 5), ("ho", None, None), ("sốt", 7, 10), ("ho", 14, 16),
    ]


def test_locate_in_text(spark):
    text = "Sốt rồi ho. HO nữa, sốt"
    found = [("ho", None, None, 1), ("zz", None, None, 2), ("sốt", None, None, 3), ("HO", None, None, 4)]
    df = spark.createDataFrame(
        [(text, found)], "text string, f array<struct<term:string,start:int,end:int,n:int>>"
    )
    got = df.select(sq.locate_in_text(F.col("text"), F.col("f")).alias("o")).first()["o"]
    assert [tuple(m) for m in got] == [
        ("Sốt", 0, 3, 3), ("ho", 8, 10, 1), ("HO", 12, 14, 4), ("zz", None, None, 2),
    ]


def test_clean_terms(spark):
    rows = [([("(sốt)", 0, 5, "D"), ("ho.", 6, 9, "D"), ("đau", None, None, "D")],)]
    df = spark.createDataFrame(rows, "m array<struct<term:string,start:int,end:int,label:string>>")
    got = df.select(sq.clean_terms(F.col("m")).alias("o")).first()["o"]
    assert [tuple(m) for m in got] == [("sốt", 0, 5, "D"), ("đau", None, None, "D")]


def test_span_layers_overwrite(spark):
    rows = [(["a", "b", "c", "d"], [(0, 2, "X"), (1, 9, "Y"), (3, 3, None)])]
    df = spark.createDataFrame(
        rows, "words array<string>, spans array<struct<start:int,end:int,label:string>>"
    )
    got = df.select(sq.spans_to_bio(F.col("words"), F.col("spans")).alias("o")).first()["o"]
    assert [t.tag for t in got] == ["B-X", "B-Y", "I-Y", "I-Y"]


def test_subword_labels(spark):
    df = spark.createDataFrame(
        [([("đau", "B-Drug"), ("đầu", "I-Drug"), ("x", "??"), ("", "B-Drug")],
          [["đ", "au"], ["đầu"], ["x"], []])],
        f"{TOKENS}, pieces array<array<string>>",
    )
    got = df.select(
        sq.align_subwords(F.col("tokens"), F.col("pieces"), max_length=8).alias("o"),
        sq.align_subwords(F.col("tokens"), F.col("pieces"), max_length=4).alias("cut"),
    ).first()
    assert [x.label for x in got.o] == [-100, 5, -100, 6, 0, -100, -100, -100]
    assert [x.piece for x in got.cut] == ["[CLS]", "đ", "au", "đầu"]


def test_underscores(spark):
    df = spark.createDataFrame([([("viêm_phổi_", "B-D"), ("nặng_hơn", "O"), ("ho", "I-D")],)], TOKENS)
    got = df.select(sq.split_underscores(F.col("tokens")).alias("o")).first()["o"]
    assert [tuple(t) for t in got] == [
        ("viêm", "B-D"), ("phổi", "I-D"), ("nặng", "O"), ("hơn", "O"), ("ho", "I-D"),
    ]


def test_conll_blocks(spark):
    text = "a\tx\tO\r\n b B-D \n \t \nc I-D\nlonely\n\n\n\nd  O\n"
    got = spark.range(1).select(conll_sentences(F.lit(text)).alias("o")).first()["o"]
    assert [[tuple(t) for t in s] for s in got] == [
        [("a", "O"), ("b", "B-D")], [("c", "I-D")], [("d", "O")],
    ]


def test_let_binds_once(spark):
    got = spark.range(1).select(let(F.lit(3), lambda x: x * x).alias("o")).first()["o"]
    assert got == 9


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 400])
def test_passes_over_many_items(spark, n):
    """More items than a block: offsets go on where the block before stopped."""
    text = " ".join(["ab"] * n)
    raw = [(0, "ab", "X")] * n
    df = spark.createDataFrame([(text, raw)], "t string, raw array<struct<line_no:int,word:string,label:string>>")
    got = df.select(sq.locate_in_lines(F.col("t"), F.col("raw")).alias("m")).first()["m"]
    assert [(m.start, m.end) for m in got] == [(3 * i, 3 * i + 2) for i in range(n)]
    items = [(0, i, i + 2) for i in range(n)]
    df = spark.createDataFrame([(items,)], "c array<struct<line_no:int,start:int,end:int>>")
    got = df.select(sq.longest_matches(F.col("c")).alias("m")).first()["m"]
    assert [m.start for m in got] == list(range(0, n, 2))


def test_pieces_can_be_merged(spark):
    text = F.col("text")
    each = F.transform(sq.pieces(text, "[ \n]"), lambda p: F.struct(
        p["piece"].alias("term"), p["start"].alias("start"), (p["start"] + F.length(p["piece"])).alias("end"), F.lit("x").alias("label"),
    ))
    df = spark.createDataFrame([("😀b é\n\nc",), ("",), (None,)], "text string")
    got = df.select(sq.pieces(text, "[ \n]").alias("p"), sq.merge_adjacent(text, each).alias("m")).collect()
    assert [(x.no, x.start, x.piece) for x in got[0].p] == [(0, 0, "😀b"), (1, 3, "é"), (2, 5, ""), (3, 6, "c")]
    assert [(x.start, x.end, x.term) for x in got[0].m] == [(0, 7, "😀b é\n\nc")]
    assert [(x.no, x.start, x.piece) for x in got[1].p] == [(0, 0, "")] and got[2].p is None
