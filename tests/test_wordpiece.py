"""Sub-word pieces against the greedy rule."""

import random

from medloom.operators.wordpiece import UNKNOWN, with_pieces, wordpieces


def greedy(word, vocabulary, most=100):
    if len(word) > most:
        return [UNKNOWN]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return [UNKNOWN]
    return out


def test_pieces_equal_the_greedy_rule(spark):
    draw = random.Random(6)
    word = lambda n: "".join(draw.choice("abđ😀") for _ in range(draw.randint(1, n)))
    vocabulary = {word(3) for _ in range(20)} | {"##" + word(4) for _ in range(40)} | {"a", "##a", "##b"}
    words = {word(12) for _ in range(300)} | {"", "a" * 100, "a" * 101, "z"}
    df = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "word string")
    found = {r.word: r.pieces for r in wordpieces(df, spark.createDataFrame([(p,) for p in vocabulary] + [(None,)], "piece string")).collect()}
    assert found == {w: greedy(w, vocabulary) for w in words}
    assert sum(p == [UNKNOWN] for p in found.values()) >= 2 and sum(len(p) > 2 for p in found.values()) > 50


def test_rows_keep_their_tokens(spark):
    df = spark.sql("select 1 as id, array(named_struct('word', 'ab', 'tag', 'O'), named_struct('word', null, 'tag', 'O'), named_struct('word', 'ab', 'tag', 'O')) as tokens union all select 2, array()")
    got = {r.id: r.pieces for r in with_pieces(df, spark.createDataFrame([("a",), ("##b",)], "piece string"), ["id"]).collect()}
    assert got == {1: [["a", "##b"], [], ["a", "##b"]], 2: []}


def test_chunks_cut_like_single_words(spark, monkeypatch):
    from pyspark.sql import functions as F

    from medloom.operators import wordpiece

    monkeypatch.setattr(wordpiece, "CHUNK_WORDS", 7)
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abđ😀#") for _ in range(draw.randint(1, n)))
    vocabulary = {word(3) for _ in range(30)} | {"##" + word(4) for _ in range(60)} | {"a", "##a", "##b"}
    rows = {i: [word(9) for _ in range(draw.randint(0, 12))] + ["a" * 101, None][: i % 3] for i in range(60)}
    df = spark.createDataFrame([(i, [(w, "O") for w in ws]) for i, ws in rows.items()], "id int, tokens array<struct<word:string,tag:string>>")
    cut = with_pieces(df, spark.createDataFrame([(p,) for p in vocabulary], "piece string"), ["id"], longest=5)
    got = {r.id: r.pieces for r in cut.collect()}
    assert got == {i: [[] if w is None else greedy(w, vocabulary) for w in ws] for i, ws in rows.items()}
    # the vocabulary is met by chunks and the words travel in their sentences, so none is a row of a shuffle
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "FlatMapCoGroupsInArrow" in plan
    # rows of equal keys keep sharing their pieces, those without a key have none
    twice = df.where("id < 6").unionAll(df.where("id = 5")).withColumn("id", F.when(F.col("id") != 4, F.col("id")))
    some = with_pieces(twice, spark.createDataFrame([("a",)], "piece string"), ["id"]).collect()
    assert {len(r.pieces) for r in some if r.id == 5} == {2 * len(rows[5])} and [r.pieces for r in some if r.id is None] == [[]]


def test_a_small_vocabulary_comes_to_the_sentences(spark, monkeypatch):
    from pyspark.sql import functions as F

    from medloom.operators import wordpiece

    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abđ😀#") for _ in range(draw.randint(1, n)))
    vocabulary = {"a", "b", "##a", "##bđ", "##😀", "đ", "##"}
    known = spark.createDataFrame([(p,) for p in vocabulary] * 2 + [(None,)], "piece string")
    rows = {(i % 7, i // 7): [word(6) for _ in range(draw.randint(0, 9))] + [None] * (i % 3) for i in range(90)}
    schema = "doc int, line int, tokens array<struct<word:string,tag:string>>, more string"
    df = spark.createDataFrame([(*k, [(w, "O") for w in ws], "x") for k, ws in rows.items()] + [(9, 9, None, None)], schema)
    cut = with_pieces(df, known, ["doc", "line"])
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CoGroups" not in plan and cut.columns == [*df.columns, "pieces"]
    got = {(r.doc, r.line): r.pieces for r in cut.collect()}
    assert got == {k: [[] if w is None else greedy(w, vocabulary) for w in ws] for k, ws in rows.items()} | {(9, 9): []}
    # rows that come twice and keys without a value are as in chunks, however many there are
    odd = df.where("doc < 5").unionAll(df.where("doc in (2, 3, 9)")).withColumn("line", F.when(F.col("doc") != 4, F.col("line")))
    odd = odd.unionAll(df.where("doc = 3").withColumn("tokens", F.reverse("tokens")))
    listed = lambda x: sorted(map(repr, x.collect()))
    chunked = listed(wordpiece._met(odd, known.dropna().distinct(), ["doc", "line"], 100, 100))
    assert listed(with_pieces(odd, known, ["doc", "line"])) == chunked
    monkeypatch.setattr(wordpiece, "CHUNK_WORDS", len(vocabulary))
    many = with_pieces(odd, known, ["doc", "line"])
    assert listed(many) == chunked and "CoGroups" not in many._jdf.queryExecution().executedPlan().toString()
