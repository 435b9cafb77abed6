"""Toxic spans and document scores from a linear-chain conditional random field.

Labels mark documents, so token labels are derived first: a token of a toxic
document is labelled toxic if one of its features (the word or a prefix of it) is
tied to toxic documents by a likelihood-ratio test.  A two-state chain (clean,
toxic) is fitted to those labelled tokens.  Its forward-backward marginals give the
offending spans of a text and, by way of a logistic link fitted on the document
labels, a score.

Fitting uses a bounded sample of labelled rows on the driver; scoring is a map over
whole texts, without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import shipped

#: labelled documents that are fitted on, at most, by label; chosen by a hash of the id
MAX_TOXIC = 1_000
MAX_CLEAN = 3_000
#: characters of their texts, at most; texts that would pass it are left out whole
MAX_CHARS = 40_000_000
#: of these, documents whose tokens the chain is fitted to, at most by label
MAX_CHAINS = 500
HELD_OUT_OF = 5
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
#: share of a marking feature's documents that are toxic, at least
PURITY = 0.85
#: words in original case; folded one by one
TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: tokens that are scored at once
CHUNK = 1 << 18
#: words whose emission is remembered in a task
REMEMBERED = 250_000
SCORED = "score double, starts array<int>, ends array<int>"


def features(word: str) -> list[str]:
    """The word itself and its longer prefixes, in lower case."""
    word = word.lower()
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def held_out(doc_id: str = "doc_id"):
    """Rows that are never fitted on: one in five by crc32 of the id's text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray, enter: np.ndarray, pairs: bool = False):
    """P(toxic) of each token of many chains laid end to end.

    ``emission``: log odds of toxic at a token; ``first``: true where a chain
    begins; ``moves[i, j]`` and ``enter[j]``: log potentials.  At a chain's first
    token all rows of the step matrix are alike, which cuts it off from the chain
    before.  The line is folded into columns; products over columns are taken step
    by step for all columns at once, then joined.  With ``pairs``, also the
    expected number of each move and of each entry.
    """
    n = len(emission)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    steps = max(1, int(math.sqrt(n)))
    columns = -(-n // steps)
    pad = steps * columns - n
    odds = np.exp(np.clip(np.concatenate((emission, np.zeros(pad))), -30, 30)).reshape(columns, steps).T.copy()
    begin = np.concatenate((first, np.ones(pad, bool))).reshape(columns, steps).T.copy()
    begin[0, 0] = True
    a, s = np.exp(moves), np.exp(enter)
    # step[i][j]: from state i before a token to state j at it
    step = [[np.where(begin, s[j], a[i, j]) * (odds if j else 1.0) for j in (0, 1)] for i in (0, 1)]

    product = [[step[i][j][0].copy() for j in (0, 1)] for i in (0, 1)]
    for t in range(1, steps):
        new = [[product[i][0] * step[0][j][t] + product[i][1] * step[1][j][t] for j in (0, 1)] for i in (0, 1)]
        scale = 1.0 / (new[0][0] + new[0][1] + new[1][0] + new[1][1])
        product = [[x * scale for x in row] for row in new]
    into, outof = np.empty((2, columns)), np.empty((2, columns))
    f0, f1 = 0.5, 0.5
    p = [[product[i][j].tolist() for j in (0, 1)] for i in (0, 1)]
    for c in range(columns):
        into[:, c] = f0, f1
        g0, g1 = f0 * p[0][0][c] + f1 * p[1][0][c], f0 * p[0][1][c] + f1 * p[1][1][c]
        f0, f1 = g0 / (g0 + g1), g1 / (g0 + g1)
    b0, b1 = 0.5, 0.5
    for c in range(columns - 1, -1, -1):
        outof[:, c] = b0, b1
        g0, g1 = p[0][0][c] * b0 + p[0][1][c] * b1, p[1][0][c] * b0 + p[1][1][c] * b1
        b0, b1 = g0 / (g0 + g1), g1 / (g0 + g1)

    forward = np.empty((2, steps, columns))
    f0, f1 = into
    for t in range(steps):
        g0 = f0 * step[0][0][t] + f1 * step[1][0][t]
        g1 = f0 * step[0][1][t] + f1 * step[1][1][t]
        total = g0 + g1
        f0, f1 = g0 / total, g1 / total
        forward[0, t], forward[1, t] = f0, f1
    backward = np.empty((2, steps, columns))
    b0, b1 = outof
    for t in range(steps - 1, -1, -1):
        backward[0, t], backward[1, t] = b0, b1
        g0 = step[0][0][t] * b0 + step[0][1][t] * b1
        g1 = step[1][0][t] * b0 + step[1][1][t] * b1
        total = g0 + g1
        b0, b1 = g0 / total, g1 / total
    toxic, clean = forward[1] * backward[1], forward[0] * backward[0]
    line = (toxic / (toxic + clean)).T.reshape(-1)[:n]
    if not pairs:
        return line
    before = np.concatenate((into[:, None, :], forward[:, :-1, :]), axis=1)
    moved = np.array([[before[i] * step[i][j] * backward[j] for j in (0, 1)] for i in (0, 1)])
    moved /= moved.sum(axis=(0, 1))
    real = (np.arange(steps * columns) < n).reshape(columns, steps).T
    return line, (moved * (real & ~begin)).sum(axis=(2, 3)), (moved * (real & begin)).sum(axis=(0, 2, 3))


@dataclass
class Model:
    """Fitted potentials; ``link`` has the weights of bias and document features."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    enter: np.ndarray = field(default_factory=lambda: np.zeros(2))
    link: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0, 0.0]))


class Emissions(dict):
    """Log odds by word, computed when first asked for."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights, model.bias

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return found


def summary(p: np.ndarray) -> list[float]:
    """Document features of the token marginals; all 0 for no tokens."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0]
    expected = float(p.sum())
    return [1.0, math.log1p(expected), float(p.max()), math.log1p(100 * expected / len(p))]


def score_texts(texts: list[str | None], model: Model, emissions: Emissions | None = None) -> list[tuple]:
    """``(score, starts, ends)``; spans are character offsets of runs of toxic tokens."""
    emissions = Emissions(model) if emissions is None else emissions
    out: list[tuple] = []
    held: list[tuple[str, list[str]]] = []
    size = 0

    def flush() -> None:
        lengths = np.array([len(words) for _, words in held], dtype=np.int64)
        first = np.zeros(int(lengths.sum()), bool)
        starts = np.cumsum(lengths) - lengths
        first[starts[lengths > 0]] = True
        line = np.fromiter((emissions[w] for _, words in held for w in words), float, len(first))
        p = marginals(line, first, model.moves, model.enter)
        for (text, _), at, length in zip(held, starts, lengths, strict=True):
            own = p[at : at + length]
            z = float(np.dot(model.link, summary(own)))
            out.append((1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), *offsets(text, own)))
        held.clear()

    for text in texts:
        words = TOKENS.findall(text or "")
        held.append((text or "", words))
        size += len(words)
        if size >= CHUNK:
            flush()
            size = 0
    flush()
    return out


def offsets(text: str, p: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of tokens that are toxic rather than not."""
    starts: list[int] = []
    ends: list[int] = []
    if len(p) and p.max() >= 0.5:
        last = -2
        for i, match in enumerate(TOKENS.finditer(text)):
            if p[i] >= 0.5:
                if last != i - 1:
                    starts.append(match.start())
                    ends.append(0)
                ends[-1], last = match.end(), i
    return starts, ends


def unlike(texts: list[str]) -> list[int]:
    """Texts to learn from: of near copies, the first.

    A text is left out if it shares one of three minima of hashed word pairs with
    an earlier one; else a passage that was copied often would look like a cause.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    # not hash(), which differs between processes
    number = cache(lambda w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
    for i, text in enumerate(texts):
        words = np.array([number(w) for w in TOKENS.findall(text)], dtype=np.uint64)
        with np.errstate(over="ignore"):
            pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] if len(words) > 1 else words
            minima = {(k, int((pairs * np.uint64(m)).min())) for k, m in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))} if len(pairs) else {(-1, 0)}
        if not minima & seen:
            kept.append(i)
        seen |= minima
    return kept


def telling(documents: list[list[str]], toxic: list[bool]) -> set[str]:
    """Features that mark toxic documents.

    Twice the log likelihood ratio must pass 2 ln(number of features), so that about
    one feature in all is taken by chance, and nearly all documents with the feature
    must be toxic.
    """
    with_it, toxic_with_it = Counter(), Counter()
    for words, label in zip(documents, toxic, strict=True):
        own = {f for w in set(words) for f in features(w)}
        with_it.update(own)
        if label:
            toxic_with_it.update(own)
    share = sum(toxic) / len(toxic)
    least = 2 * math.log(max(2, len(with_it)))
    found = set()
    for f, k in toxic_with_it.items():
        n = with_it[f]
        rate = k / n
        if rate >= PURITY and rate > share:
            ratio = 2 * (k * math.log(rate / share) + ((n - k) * math.log((1 - rate) / (1 - share)) if k < n else 0))
            if ratio >= least:
                found.add(f)
    return found


def fit(texts: list[str], toxic: list[bool], rounds: int = 80, decay: float = 1e-3) -> Model:
    """Fit chain and link to labelled texts.  Without both labels: scores near 0."""
    kept = unlike(texts)
    texts, toxic = [texts[i] for i in kept], [bool(toxic[i]) for i in kept]
    model = Model()
    if not any(toxic) or all(toxic):
        return model
    documents = [TOKENS.findall(t) for t in texts]
    marks = telling(documents, toxic)
    chosen = [i for label in (True, False) for i in [j for j, y in enumerate(toxic) if y is label][:MAX_CHAINS]]
    _fit_chain(model, [documents[i] for i in chosen], [toxic[i] for i in chosen], marks, rounds, decay)
    _fit_link(model, texts, toxic)
    return model


def _fit_chain(model: Model, documents: list[list[str]], toxic: list[bool], marks: set[str], rounds: int, decay: float) -> None:
    """Ascend the conditional likelihood of the labelled tokens, with Adagrad."""
    words = [w for words in documents for w in words]
    if not words:
        return
    kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
    seen = Counter(f for w in kinds for f in features(w))
    names = {f: i for i, f in enumerate(f for f, n in seen.items() if n > 1 or f in marks)}
    # a row of feature numbers per kind of word; the last number is no feature
    width = 1 + len(PREFIXES)
    table = np.full((len(kinds), width), len(names), dtype=np.int64)
    marked = np.zeros(len(kinds), bool)
    for w, i in kinds.items():
        own = features(w)
        table[i, : len(own)] = [names.get(f, len(names)) for f in own]
        marked[i] = not marks.isdisjoint(own)
    kind = np.fromiter((kinds[w] for w in words), np.int64, len(words))
    lengths = np.array([len(d) for d in documents])
    first = np.zeros(len(words), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    label = marked[kind] & np.repeat(toxic, lengths)
    inner = ~first
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (label[:-1][inner[1:]].astype(int), label[1:][inner[1:]].astype(int)), 1)
    seen_enter = np.bincount(label[first].astype(int), minlength=2)

    weights, sums = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-8)
    rest = np.concatenate(([math.log((label.sum() + 0.5) / len(label))], np.zeros(6)))
    rest_sums = np.full(7, 1e-8)
    for _ in range(rounds):
        emission = weights[table].sum(axis=1)[kind] + rest[0]
        p, moves, enter = marginals(emission, first, rest[1:5].reshape(2, 2), rest[5:], pairs=True)
        miss = label - p
        by_kind = np.bincount(kind, miss, len(kinds))
        slope = np.bincount(table.reshape(-1), np.repeat(by_kind, width), len(names) + 1) - decay * len(words) ** 0.5 * weights
        slope[-1] = 0
        sums += slope**2
        weights += slope / np.sqrt(sums)
        rest_slope = np.concatenate(([miss.sum()], (seen_moves - moves).reshape(-1), seen_enter - enter)) - decay * rest
        rest_sums += rest_slope**2
        rest += rest_slope / np.sqrt(rest_sums) * 0.5
    model.weights = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 0.02}
    model.bias, model.moves, model.enter = float(rest[0]), rest[1:5].reshape(2, 2), rest[5:]


def _fit_link(model: Model, texts: list[str], toxic: list[bool]) -> None:
    """Logistic regression of document labels on summaries, by Newton's method.

    Evidence never lowers a score, and a text without any is never called toxic.
    """
    emissions = Emissions(model)
    x = np.array([summary(marginals(np.array([emissions[w] for w in words]), np.arange(len(words)) == 0, model.moves, model.enter)) for words in map(TOKENS.findall, texts)])
    y = np.array(toxic, float)
    link = np.zeros(x.shape[1])
    # shrinks towards 0 so that a perfect split stays finite; not the bias
    shrink = np.diag([1e-6, 0.05, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ link, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + shrink, x.T @ (y - p) - shrink @ link)
        link += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.link = np.concatenate(([min(link[0], -1.0)], np.maximum(link[1:], 0.0)))


def sample_labels(labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """``doc_id, toxic`` of the labelled rows to fit on, by a hash of the id.

    At most ``max_toxic + max_clean`` rows.  A document with several labels is toxic
    if one says so; null ids and labels are ignored.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    order = F.xxhash64("doc_id"), "doc_id"
    return (
        known.where("toxic").orderBy(*order).limit(max_toxic)
        .unionByName(known.where("not toxic").orderBy(*order).limit(max_clean))
    )


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on the sampled labels' texts, which are collected: number and size are bounded."""
    chosen = sample_labels(labels, max_toxic, max_clean)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    # repeated rows of an id do not pass the bound
    order = F.xxhash64("doc_id"), "doc_id", "n"
    sizes = rows.select("doc_id", F.char_length("text").alias("n")).orderBy(*order).limit(max_toxic + max_clean).collect()
    kept, total = [], 0
    for r in sizes:
        if total + r.n <= MAX_CHARS:
            total += r.n
            kept.append((r.doc_id, r.n))
    wanted = docs.sparkSession.createDataFrame(kept, rows.select("doc_id", F.lit(0).alias("n")).schema).distinct()
    rows = rows.withColumn("n", F.char_length("text")).join(F.broadcast(wanted), ["doc_id", "n"])
    rows = rows.orderBy(*order, F.xxhash64("text")).limit(len(kept)).collect()
    return fit([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``score, predicted, starts, ends``.

    ``starts``/``ends`` are character offsets of toxic spans.  The score depends on
    the text alone; null and empty texts get that of a text without toxic tokens.
    Columns of ``docs`` with these names are replaced.
    """
    made = ["score", "predicted", "starts", "ends"]
    columns = [c for c in docs.columns if c not in made]
    load = shipped(docs.sparkSession, model)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = load()
        emissions = Emissions(fitted)
        for texts in batches:
            yield pd.DataFrame(score_texts(texts.tolist(), fitted, emissions), columns=["score", "starts", "ends"])

    rated = F.pandas_udf(rate, SCORED)
    return docs.select(*columns, rated("text").alias("__rated")).select(
        *columns,
        F.col("__rated.score").alias("score"),
        (F.col("__rated.score") >= 0.5).cast("int").alias("predicted"),
        F.col("__rated.starts").alias("starts"),
        F.col("__rated.ends").alias("ends"),
    )
