"""The trie of conversations and list ranking against direct computation."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from medloom.llm import list_rank as lr
from medloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn int, role string, text string"
LINKS = "arc binary, next binary, step long"


def brute(rows, regrow=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if regrow else 0
        s = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda a: sum(1 for n in members if n and n[:-1] == a)
        out.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids(node), sum(kids(n) == 0 for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells", [(1 << 12, 1 << 16, 1 << 16), (2, 3, 2)])
def test_trie_equals_its_definition(spark, monkeypatch, cells):
    for name, value in zip(("CELL", "ARCS"), cells, strict=False):
        monkeypatch.setattr(pt, name, value)
    draw = random.Random(5)
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, "user", "é"), (7, 3, "user", "a"), (7, 3, "user", "a")]
    for c in [*range(0, 8), *range(95, 106), 200, 201, 250, 333, 399]:
        for t in range(draw.randint(1, 9)):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "é" * 5, "", None])))
    rows += [(5000, t, "user", f"t{t % 3}") for t in range(60)]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS pos", "3 AS part")
    got = pt.prefix_trie(*pt.regrown(turns))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table_and_blocks_of_ids(spark):
    assert pt.prefix_trie(*pt.regrown(spark.createDataFrame([], SCHEMA))).count() == 0
    ends = spark.range(1000).select(F.lit(b"n").alias("node"), F.col("id").alias("conv_id")).repartition(7)
    (row,) = pt.joined_hashes(ends, block=64).collect()
    assert row.sha == hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 700])
def test_list_rank(spark, n):
    order = list(range(n))
    random.Random(n).shuffle(order)
    name = lambda i: order[i].to_bytes(3, "big")
    steps = [random.Random(i).randint(0, 5) for i in range(n)]
    rows = [(name(i), name(i + 1) if i + 1 < n else None, steps[i]) for i in range(n)]
    got = lr.list_rank(spark.createDataFrame(rows, LINKS), sparse=4, local=10).collect()
    assert {bytes(r.arc): r.rank for r in got} == {name(i): sum(steps[i:]) for i in range(n)} and len(got) == n
