"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medloom.llm import periodic_runs as pr


def brute_runs(w):
    """All runs: for each period, stretches that neither end extends and no smaller period has."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute(doc_id, text, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if rewrite and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def words_of(w):
    ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
    return np.array([ids[x] for x in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)


def found_runs(parts, **kw):
    arrays = [words_of(w) for w in parts]
    text, s, e, q = pr.find_runs(np.concatenate(arrays), np.cumsum([len(a) for a in arrays]), **kw)
    out = [[] for _ in parts]
    for t, a, b, c in zip(text.tolist(), s.tolist(), e.tolist(), q.tolist(), strict=True):
        out[t].append((a, b - a, c))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([2, 3, 64]))
def test_runs_equal_their_definition(seed, direct):
    draw = random.Random(seed)
    parts = []
    for _ in range(3):
        w = []
        while len(w) < draw.choice([0, 5, 80, 300]):
            piece = [draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.choice([1, 2, 7, 20, 40]))]
            w += (piece * draw.choice([1, 1, 2, 3, 9]))[: draw.randint(1, 200)]
        parts.append(w)
    assert found_runs(parts, direct=direct) == [brute_runs(w) for w in parts]


@pytest.mark.parametrize("direct", [2, 8, 64])
def test_long_periods_inside_short_ones(direct):
    a, b = ["a"] * 300, ["a", "b"] * 150
    parts = [a + ["x"] + a + ["x"] + a, b + ["b"] + b, (a + ["x"]) * 3, list(range(150)) * 2 + [0], b + a + b + a]
    assert found_runs(parts, direct=direct) == [brute_runs(w) for w in parts]


def test_words_whose_prefix_hashes_agree():
    morse = ["ab"[bin(i).count("1") % 2] for i in range(4096)]
    other = ["ba"[bin(i).count("1") % 2] for i in range(4096)]
    for w in (morse + ["c"] * 100 + other, morse + ["c"] * 100 + morse + ["c"] * 100 + other):
        s, e, q = pr.find_runs(words_of(w), np.array([len(w)]))[1:]
        for a, b, p in zip(s.tolist(), e.tolist(), q.tolist(), strict=True):
            assert w[a : b - p] == w[a + p : b] and w[a - 1] != w[a + p - 1] and (b == len(w) or w[b] != w[b - p])
    assert (0, 4196 + 4196, 4196) in zip(s.tolist(), e.tolist(), q.tolist(), strict=True)


def test_query_rows(spark):
    draw = random.Random(3)
    docs = [(None, "a b " * 30), (1, None), (2, ""), (3, " \t\n"), (3, "é " * 13 + "x"), (4, " ".join("w%d" % i for i in range(9)))]
    for i in range(5, 90):
        docs.append((i, draw.choice([" ", "  ", "\n"]).join(draw.choice("ab") * draw.choice([1, 1, 200]) for _ in range(draw.randint(1, 150)))))
    found = pr.periodic_runs(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS start", "1 AS crc"), rewrite=True)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((brute(*d) for d in docs), key=repr)


def test_empty_table_and_long_text(spark):
    assert pr.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    period = " ".join(f"w{i}" for i in range(70_000))
    text = "start " + " ".join([period] * 3) + " " + "x" * 3_000_000 + " end" + " same" * 50_000
    (row,) = pr.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 1, 210_000, 70_000, 3000)
    assert row.collapsed_sha256 == hashlib.sha256(f"start {period} {'x' * 3_000_000} end same".encode()).hexdigest()
