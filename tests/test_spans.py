"""Overlap removal and recovery against their definitions."""

import itertools
import random

from pyspark.sql import functions as F

from medloom.functions import context as cx
from medloom.operators import sequence as sq
from medloom.operators import spans as sp

SPANS = "doc long, start int, end int, weight double"


def random_spans(draw, n):
    out = []
    for _ in range(n):
        s = draw.randrange(30)
        out.append((s, s + draw.randint(-1, 12), float(draw.randint(-1, 9))))
    return out


def test_best_choice_equals_all_subsets(spark):
    draw = random.Random(2)
    notes = {d: random_spans(draw, draw.randint(0, 11)) for d in range(40)}
    rows = [(d, *s) for d, spans in notes.items() for s in spans] + [(99, None, 3, 1.0), (99, 1, None, 1.0)]
    frame = spark.createDataFrame(rows, SPANS)
    found = {}
    for r in sp.overlap_best(frame, ["doc"], F.col("weight")).collect():
        found.setdefault(r.doc, []).append((r.start, r.end, r.weight))
    for d, spans in notes.items():
        proper = [s for s in spans if s[1] > s[0]]
        best = 0.0
        for k in range(len(proper) + 1):
            for chosen in itertools.combinations(proper, k):
                ordered = sorted(chosen)
                if all(a[1] <= b[0] for a, b in itertools.pairwise(ordered)):
                    best = max(best, sum(s[2] for s in chosen))
        mine = sorted(found.get(d, []))
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(mine)) and all(s in proper for s in mine)
        assert sum(s[2] for s in mine) == best
    assert 99 not in found
    again = {tuple(r) for r in sp.overlap_best(frame.repartition(7), ["doc"], F.col("weight")).collect()}
    assert again == {(d, *s) for d, spans in found.items() for s in spans}


def test_best_choice_of_many_spans_is_not_quadratic(spark):
    frame = spark.range(200_000).selectExpr("1L AS doc", "cast(id * 3 AS int) AS start", "cast(id * 3 + 5 AS int) AS end", "1D AS weight")
    assert sp.overlap_best(frame, ["doc"], F.col("weight")).count() == 100_000


def test_islands_and_their_longest(spark):
    rows = [(1, 0, 4, 1.0), (1, 2, 6, 2.0), (1, 6, 8, 3.0), (1, 7, 9, 4.0), (1, 20, 30, 5.0), (1, 22, 24, 6.0), (1, 23, 25, 7.0), (2, 3, 3, 1.0), (2, None, 1, 1.0)]
    got = sp.overlap_islands(spark.createDataFrame(rows, SPANS), ["doc"]).collect()
    assert sorted((r.doc, r.island, r.start, r.end, r.members) for r in got) == [(1, 0, 0, 4, 2), (1, 1, 6, 8, 2), (1, 2, 20, 30, 3)]
    assert sp.overlap_islands(spark.createDataFrame([], SPANS), ["doc"]).count() == 0


def test_gaps_are_the_complement(spark):
    draw = random.Random(3)
    notes = {d: (draw.randint(0, 40), random_spans(draw, draw.randint(0, 8))) for d in range(30)}
    frame = spark.createDataFrame([(d, *s) for d, (_, spans) in notes.items() for s in spans], SPANS)
    extents = spark.createDataFrame([(d, n) for d, (n, _) in notes.items()], "doc long, size int")
    free = {d: set() for d in notes}
    rows = sp.gaps(frame, extents, ["doc"]).collect()
    for r in rows:
        assert r.end > r.start
        free[r.doc] |= set(range(r.start, r.end))
    for d, (n, spans) in notes.items():
        assert free[d] == set(range(n)) - {i for s, e, _ in spans for i in range(s, max(s, e))}
        # gaps are as long as can be
        mine = sorted((r.start, r.end) for r in rows if r.doc == d)
        assert all(a[1] < b[0] for a, b in itertools.pairwise(mine))


NOTE = """1. Tiền sử bệnh
- ho kéo dài
2. Bệnh sử hiện tại
- đau ngực
- ho khan, khó thở
- ho rồi đau bụng dữ dội
- một dòng rất dài không phải triệu chứng ho nào cả vì có nhiều từ
3. Đánh giá tại bệnh viện
- X-quang: bình thường 
Xét nghiệm máu : gan to
Ghi chú: không"""


def test_missed_mentions_come_back_in_gaps_only(spark):
    at = NOTE.index("đau bụng dữ dội")
    inside = NOTE.index("gan to") + 4
    mentions = spark.createDataFrame([(1, at, at + 8, 0.0), (1, inside, inside + 2, 0.0)], SPANS)
    notes = spark.createDataFrame([(1, NOTE), (2, None), (3, "")], "doc long, text string")
    sections = notes.select("doc", cx.section_bounds(F.col("text")).alias("bounds"), F.length("text").alias("size"))
    lines = notes.select("doc", F.explode(sq.lines(F.col("text"))).alias("l")).join(sections, "doc").select(
        "doc", F.col("l.start").alias("start"), F.col("l.piece").alias("line"), "bounds"
    )
    targets = sp.recovery_targets(lines, ["doc"])
    got = sorted(tuple(r) for r in sp.recovered_mentions(mentions, sections.select("doc", "size"), targets, ["doc"]).collect())
    for _, start, end, text, _ in got:
        assert NOTE[start:end] == text and not (start < at + 8 and end > at) and not (start < inside + 2 and end > inside)
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(got))
    assert {text: kind for *_, text, kind in got} == {
        "đau ngực": "TRIỆU_CHỨNG", "ho khan, khó thở": "TRIỆU_CHỨNG",
        "X-quang": "TÊN_XÉT_NGHIỆM", "bình thường": "KẾT_QUẢ_XÉT_NGHIỆM",
        "Xét nghiệm máu": "TÊN_XÉT_NGHIỆM", "gan": "KẾT_QUẢ_XÉT_NGHIỆM",
    }
