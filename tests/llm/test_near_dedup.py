"""Signatures, candidates and classes of near duplicates."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.llm import near_dedup as nd
from medloom.llm.components import components

SCHEMA = "doc_id long, text string"


def brute(docs):
    """Class of each document by comparing all pairs of shingle sets."""
    words = {i: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()) for i, t in docs}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    root = {i: i for i, _ in docs}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in root}


def text(draw, n):
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def edited(draw, words, n):
    words = list(words)
    for i in draw.sample(range(len(words)), n):
        words[i] = f"e{draw.randrange(10**6)}"
    return words


def corpus():
    draw = random.Random(11)
    docs = [text(draw, draw.randint(1, 200)) for _ in range(40)]
    base = text(draw, 150)
    # a group of near copies, some too far from each other, larger than a small bucket
    docs += [edited(draw, base, draw.randint(0, 5)) for _ in range(60)] + [base] * 5
    chain = text(draw, 120)
    for _ in range(8):
        docs.append(chain)
        chain = edited(draw, chain, 1)
    passage = text(draw, 60)
    docs += [text(draw, 80) + passage for _ in range(20)]
    texts = [" ".join(d) for d in docs] + ["Same, text: here.", "same TEXT here", "", "", None, "...", "a b", "a b c"]
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_classes_equal_brute_force(spark):
    docs = corpus()
    found = nd.near_dedup(spark.createDataFrame(docs, SCHEMA).withColumn("class_id", F.lit(0))).collect()
    truth = brute(docs)
    assert {r.doc_id: r.class_id for r in found} == truth
    sizes = [list(truth.values()).count(r.class_id) for r in found]
    assert [r.class_size for r in found] == sizes and max(sizes) > 20
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)


def test_nulls_repeats_and_long_text(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    docs = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f!"), (5, long), (6, long + " y"), (None, None), (7, None)]
    got = sorted((tuple(r) for r in nd.near_dedup(spark.createDataFrame(docs, SCHEMA)).collect()), key=repr)
    assert got == sorted(
        [(3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False), (5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True), (None, None, 1, True), (None, None, 1, True)],
        key=repr,
    )


def test_empty_table(spark):
    assert nd.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def far_from_the_centre(families=250, members=3):
    """A large group of families: members are similar, families hardly ever."""
    draw = random.Random(5)
    base, docs = text(draw, 600), []
    for _ in range(families):
        own = edited(draw, base, 4)
        docs += [edited(draw, own, 6) for _ in range(members)]
    draw.shuffle(docs)
    return list(enumerate(" ".join(d) for d in docs))


def test_a_large_group_far_from_its_centre(spark):
    docs = far_from_the_centre()
    truth = brute(docs)
    found = nd.near_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in found} == truth
    assert len(set(truth.values())) > 100


def test_texts_that_share_boilerplate_in_one_bucket(spark):
    # one bucket of all, with one pair that links; the others have 0.6 in common
    draw = random.Random(8)
    shared = text(draw, 66)
    docs = [shared + text(draw, 18) for _ in range(4000)]
    docs.append(edited(draw, docs[7], 1))
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], SCHEMA)
    found = {r.doc_id: r.class_id for r in nd.near_dedup(frame, bands=16, rows=1).collect()}
    assert found == {i: i for i in range(4000)} | {4000: 7}


def repeating():
    """Pairs of similar sets, one text of each repeating its shingles many times."""
    draw, docs = random.Random(3), []
    for i in range(60):
        base = text(draw, 60)
        if i % 2:
            # the same set of shingles; a fifth of them a hundred times
            docs += [base + base[:16], base + base[:16] * 100]
        else:
            # a line of its own, repeated
            line = text(draw, 6)
            docs += [base, base + line * 100]
    return list(enumerate(" ".join(d) for d in docs))


def test_repeated_passages_do_not_hide_a_link(spark):
    docs = repeating()
    found = nd.near_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    truth = brute(docs)
    assert {r.doc_id: r.class_id for r in found} == truth
    assert sum(i != c for i, c in truth.items()) >= 30


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (202, 202)]
    links = spark.createDataFrame(pairs, "a long, b long").select(*[F.encode(F.format_string("%05d", c), "UTF-8").alias(c) for c in "ab"])
    got = {int(r.node): int(r.root) for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200} | {i: i for i in (0, 100, 200) if i in got}


def test_both_signatures_are_banded():
    draw = np.random.default_rng(3)
    value = np.sort(draw.integers(0, 2**63, 40, np.uint64))
    text_of, weight = np.repeat([0, 1], 20), np.where(np.arange(40) % 40 >= 35, 5.0, 1.0)
    keys, counts = nd.signatures(text_of, value, weight, 2, 8, 2)
    plain = nd.band_keys(nd.prob_min_hash(text_of, value, np.ones(40), 2, 16), 8, 2)
    weighted = nd.band_keys(nd.prob_min_hash(text_of, value, weight, 2, 16), 8, 2)
    assert counts[0] == 8 and set(keys[:8]) == set(plain[0]) == set(weighted[0])
    assert set(keys[8:]) == set(plain[1]) | set(weighted[1]) and 8 < counts[1] <= 16


class TestSignatures:
    def shingled(self, texts):
        hashed = [np.array([hash(w) for w in t], np.int64).view(np.uint64) for t in texts]
        ends = np.cumsum([len(h) for h in hashed])
        return nd.shingles(np.concatenate(hashed), ends, nd.SHINGLE)

    def test_shingles(self):
        text_of, value = self.shingled([list("abcdef"), list("ab"), list("bcdef"), [], list("ab")])
        assert text_of.tolist() == [0, 0, 1, 2, 4]
        assert value[1] == value[3] and value[2] == value[4] and len(set(value.tolist())) == 3

    @pytest.mark.parametrize("registers", [16, 400])
    def test_registers_agree_like_probability_jaccard(self, registers):
        draw = np.random.default_rng(4)
        common, own = draw.integers(0, 2**63, 60, np.uint64), draw.integers(0, 2**63, 40, np.uint64)
        x = {int(v): float(w) for v, w in zip(common, draw.choice([1, 2, 5], 60))} | {int(v): 1.0 for v in own[:20]}
        y = {int(v): float(w) for v, w in zip(common, draw.choice([1, 2, 5], 60))} | {int(v): 2.0 for v in own[20:]}
        alike = sum(1 / sum(max(x.get(o, 0) / x[d], y.get(o, 0) / y[d]) for o in {*x, *y}) for d in {*x} & {*y})
        rates = []
        for shift in range(4000 // registers):
            salt = np.uint64(shift * 7919)
            value = np.array([*sorted(x), *sorted(y)], np.uint64)
            weight = np.array([x[k] for k in sorted(x)] + [y[k] for k in sorted(y)])
            text_of = np.repeat([0, 1], [len(x), len(y)])
            a, b = nd.prob_min_hash(text_of, nd.mix(value ^ salt), weight, 2, registers)
            rates.append((a == b).mean())
        assert abs(np.mean(rates) - alike) < 0.03

    def test_a_signature_does_not_depend_on_its_batch(self):
        draw = np.random.default_rng(1)
        values = [np.sort(draw.integers(0, 2**63, n, np.uint64)) for n in (1, 7, 300, 2)]
        every = nd.prob_min_hash(np.repeat(range(4), [len(v) for v in values]), np.concatenate(values), np.ones(310), 4, 24)
        for i, v in enumerate(values):
            alone = nd.prob_min_hash(np.zeros(len(v), int), v, np.ones(len(v)), 1, 24)
            assert (alone[0] == every[i]).all()

    def test_every_register_is_the_first_arrival(self):
        # without early ends: many arrivals of each process, the least by register
        value, registers = np.array([5, 6, 7], np.uint64), 8
        best = {}
        for v in value:
            time = 0.0
            for turn in range(1, 400):
                drawn = nd.mix(np.array([v], np.uint64) + np.uint64(turn * int(nd.STEP) % 2**64))
                time -= np.log((float(drawn[0] >> np.uint64(11)) + 0.5) * 2.0**-53) / 2.0
                at = int(nd.mix(drawn + nd.STEP)[0] % np.uint64(registers))
                best[at] = min(best.get(at, (np.inf, 0)), (time, int(v)))
        got = nd.prob_min_hash(np.zeros(3, int), value, np.full(3, 2.0), 1, registers)[0]
        assert got.tolist() == [best[i][1] for i in range(registers)]
