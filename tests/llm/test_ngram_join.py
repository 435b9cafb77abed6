"""Signature trees and the n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from medloom.llm import ngram_join as nj
from medloom.llm import signature_tree as st

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(docs, percent=90):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))], key=repr)


def text(draw, n):
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def edited(draw, words, n):
    words = list(words)
    for i in draw.sample(range(len(words)), n):
        words[i] = f"e{draw.randrange(10**6)}"
    return words


def corpus():
    draw = random.Random(4)
    docs = [text(draw, draw.randint(1, 200)) for _ in range(40)]
    # near copies around a base, many of them too far from each other
    base = text(draw, 150)
    docs += [edited(draw, base, draw.randint(0, 6)) for _ in range(90)] + [base] * 4
    # chains, sets at the very threshold, short texts
    chain = text(draw, 120)
    for _ in range(10):
        docs.append(chain)
        chain = edited(draw, chain, 1)
    for n in (2, 3, 4, 11, 12, 21, 22, 40):
        t = text(draw, n)
        docs += [t, t[:-1], t + ["x"], [*t, "y", "z"]]
    # a passage and a line in most documents
    passage, line = text(draw, 60), text(draw, 9)
    docs += [text(draw, 15) + passage for _ in range(40)] + [line * draw.randint(1, 3) + text(draw, 4) for _ in range(30)]
    rows = [" ".join(d) for d in docs] + ["Same  TEXT\there", "same text here", "É é", "é é", "", " \n", None, "a b", "A B", "a"]
    draw.shuffle(rows)
    return [(3 * i if i % 17 else None, t) for i, t in enumerate(rows)] + [(3, rows[1]), (3, "other text of the same id")]


@pytest.mark.parametrize("limits", [{}, {"small": 3, "block": 8}])
def test_components_equal_all_pairs(spark, limits):
    docs = corpus()
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "0 AS node", "'x' AS n", "1 AS component_id").repartition(5)
    found = nj.ngram_join(frame, **limits)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs)


def test_empty_table_and_long_texts(spark):
    assert nj.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"x{i}" for i in range(300_000))
    docs = [(5, long), (6, long + " y"), (7, "x" * 3_000_000), (8, "x" * 3_000_000)]
    got = sorted(map(tuple, nj.ngram_join(spark.createDataFrame(docs, SCHEMA)).collect()))
    assert got == [(5, 299_998, 5), (6, 299_999, 5), (7, 1, 7), (8, 1, 7)]


def test_many_repeated_rows_do_not_multiply(spark):
    draw = random.Random(9)
    base = text(draw, 100)
    texts_ = [" ".join(base), " ".join(edited(draw, base, 1)), " ".join(edited(draw, base, 2))]
    docs = [(None, t) for t in texts_ for _ in range(1500)] + [(7, texts_[0])] * 500 + [(3, texts_[2])]
    got = nj.ngram_join(spark.createDataFrame(docs, SCHEMA)).groupBy("doc_id", "component_id").count().collect()
    assert {(r.doc_id, r.component_id, r["count"]) for r in got} == {(None, 7, 3000), (7, 7, 500), (None, 3, 1500), (3, 3, 1)}
    sets = nj.shingle_sets(spark.createDataFrame(docs, SCHEMA).coalesce(1), whole=True)
    assert sets.count() == 3


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_walk_and_links_equal_all_pairs(percent):
    draw = np.random.default_rng(percent)
    sets = []
    for _ in range(12):
        base = draw.integers(0, 2**63 - 1, draw.integers(1, 300)).astype(np.uint64)
        for _ in range(draw.integers(1, 30)):
            kept = base[draw.random(len(base)) < draw.choice([0.7, 0.9, 0.98])]
            sets.append(np.unique(np.concatenate((kept, draw.integers(0, 2**63 - 1, draw.integers(1, 9)).astype(np.uint64)))))
    n = len(sets)
    likeness = {(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
    for sides in ((np.arange(n), np.arange(n)), (np.arange(0, n, 2), np.arange(1, n, 2))):
        trees = [st.Tree([sets[i] for i in s], s) for s in sides]
        trees[1] = trees[0] if len(sides[0]) == n else trees[1]
        a, b, most = st.dual_walk(*trees, percent)
        walked = {(max(x, y), min(x, y)) for x, y in zip(sides[0][a].tolist(), sides[1][b].tolist(), strict=True)}
        across = {(i, j) for i, j in likeness if len(sides[0]) == n or i % 2 != j % 2}
        assert across <= walked and len(walked) == len(a) < len(sides[0]) * len(sides[1]) // 2
        label = np.arange(n)
        for x, y in st.joining_links(sets, np.arange(n), sides, percent):
            assert (max(x, y), min(x, y)) in across and label[x] != label[y]
            label[label == label[x]] = label[y]
        assert all(label[i] == label[j] for i, j in across)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_sets_that_link_share_a_segment(percent):
    draw = np.random.default_rng(percent)
    for _ in range(300):
        n = int(draw.integers(1, 12) ** draw.integers(1, 4))
        tokens = np.unique(draw.integers(0, 2**63 - 1, 2 * n + 2).astype(np.uint64))
        # the least overlap of sets of n and m
        m = int(draw.integers(n, 100 * n // percent + 1))
        both = -(-percent * (n + m) // (100 + percent))
        if both > n:
            continue
        a, b = tokens[:n], np.concatenate((tokens[:both], tokens[n : n + m - both]))
        if n == m == both:
            continue
        keys, counts = st.segment_keys(np.concatenate((a, b)), np.array([len(a), len(b)]), percent)
        assert len(np.intersect1d(keys[: counts[0]], keys[counts[0] :]))
