"""Periodic runs in texts: multi-scale minimizers as seeds, direct scans of short lags.

A run is a stretch of words with smallest period q, at least ``MIN_LENGTH`` words and two
periods long, that no neighbouring word extends.  All runs of all texts are found:

1. Periods up to ``DIRECT`` words are scanned lag by lag: a word equals the one q places
   before it throughout a run.
2. Longer periods are found scale by scale.  At scale Q, for periods in (Q, 2Q], every
   window of Q/2 positions selects the position whose gram of Q/4 words has the least
   hash, the leftmost of equals.  Such a window and its gram span less than a period, so
   the first window of a run and its copy one period on both lie in the run, hold the
   same words and select the same place: two equal minimizers at the distance of the
   period.  All pairs of equal minimizers at distances in (Q, 2Q] are seeds.
3. A seed is extended to both sides by binary search over prefix hashes of the words; the
   stretch is then compared word by word.
4. Of equal stretches the least period counts.

Where a short period repeats a gram densely, equal minimizers follow each other closely;
of two chains of them only the pairs that begin one are seeds, since the pairs further
along lie in the same stretch.  So pairs grow with the minimizers, not with their square.

Texts are laid end to end with a word of its own between two, so short texts cost no
more than their words, and everything happens within a row: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.words import BASE, SPACE, bounds, hashes, mix, powers, texts, together

MIN_LENGTH = 12
#: periods up to so many words are scanned directly
DIRECT = 64
FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of stretches of True that are at least ``least`` long."""
    at = np.flatnonzero(equal)
    if len(at) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    length = np.diff(first, append=len(at))
    long = length >= least
    return at[first[long]], length[long]


def minimizers(gram: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the leftmost least gram of a window of ``window`` positions."""
    n = len(gram)
    if n < window:
        return np.zeros(0, np.int64)
    bits = max(1, (n - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    key = (gram & ~low) | np.arange(n, dtype=np.uint64)
    # least key of each window, from running minima of blocks in both directions
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    square = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[: n - window + 1], ahead[window - 1 : n])
    return np.unique(least & low).astype(np.int64)


def _ranges(low: np.ndarray, high: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``of[i]`` with every number from ``low[i]`` to below ``high[i]``."""
    n = np.maximum(high - low, 0)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(of, n), np.repeat(low, n) + turn


def seeds(gram: np.ndarray, at: np.ndarray, scale: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal minimizers ``at`` at distances in (scale, 2 scale], first and second."""
    order = np.lexsort((at, gram[at]))
    pos, value = at[order], gram[at][order]
    new = np.diff(value, prepend=value[:1]) != 0
    new[:1] = True
    # a place on a line where groups of equal grams lie far apart
    group = np.cumsum(new) - 1
    line = group * (3 * scale + (int(pos.max()) if len(pos) else 0) + 1) + pos
    close = np.zeros(len(pos), bool)
    close[1:] = ~new[1:] & (np.diff(pos) <= size // 2)
    head = np.flatnonzero(~close)
    # a chain's head as the first, and as the second of a pair
    a, b = _ranges(np.searchsorted(line, line[head] + scale, "right"), np.searchsorted(line, line[head] + 2 * scale, "right"), head)
    d, c = _ranges(np.searchsorted(line, line[head] - 2 * scale, "left"), np.searchsorted(line, line[head] - scale, "left"), head)
    return np.concatenate((pos[a], pos[c])), np.concatenate((pos[b], pos[d]))


def _common(sums: np.ndarray, power: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words from ``a`` and ``b`` on (or before them) are the same."""
    low, high, shift = np.zeros(len(a), np.int64), most.copy(), power[b - a]
    while (low < high).any():
        mid = (low + high + 1) // 2
        x, y = (a, b) if ahead else (a - mid, b - mid)
        same = (sums[x + mid] - sums[x]) * shift == sums[y + mid] - sums[y]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def find_runs(words: np.ndarray, ends: np.ndarray, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and period of all runs of hashed words, in this order.

    ``ends``: where each text ends in ``words``.  Starts and ends count from the text's
    first word.
    """
    lengths = np.diff(ends, prepend=0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first_of = np.cumsum(lengths) - lengths
    scale, taken = 0, lengths >= MIN_LENGTH
    while taken.any():
        own = np.flatnonzero(taken)
        # the texts that are long enough, each followed by a word that occurs nowhere else
        size = lengths[own] + 1
        begin = np.cumsum(size) - size
        text = np.repeat(np.arange(len(own)), size)
        place = np.arange(len(text)) - begin[text]
        border = place == lengths[own][text]
        source = np.where(border, 0, first_of[own][text] + place)
        line = np.where(border, mix(text.astype(np.uint64) + np.uint64(BASE)), words[source])
        back = first_of[own] - begin  # from this line to the place in ``words``
        if scale == 0:
            for q in range(1, min(direct, int(lengths[own].max()) // 2) + 1):
                start, same = _stretches(line[q:] == line[:-q], max(q, MIN_LENGTH - q))
                found.append((start + back[text[start]], start + same + q + back[text[start]], np.full(len(start), q)))
            scale = direct
        else:
            gram_size, window = max(1, scale // 4), max(1, scale // 2)
            power = powers(BASE, len(line) + 1)
            sums = np.zeros(len(line) + 1, np.uint64)
            np.cumsum(line * power[:-1], out=sums[1:])
            down = powers(pow(BASE, -1, 1 << 64), len(line) + 1)
            gram = mix((sums[gram_size:] - sums[:-gram_size]) * down[: len(line) - gram_size + 1])
            a, b = seeds(gram, minimizers(gram, window), scale, gram_size)
            within = text[a] == text[b]
            a, b = a[within], b[within]
            if len(a):
                q = b - a
                ahead = _common(sums, power, a, b, len(line) - b, True)
                behind = _common(sums, power, a, b, a, False)
                stretch = np.unique(np.stack((a - behind, ahead + behind, q))[:, ahead + behind >= np.maximum(q, MIN_LENGTH - q)], axis=1)
                right = [np.array_equal(line[i : i + n], line[i + lag : i + n + lag]) for i, n, lag in stretch.T.tolist()]
                # where prefix hashes of different words agree, as those of Thue-Morse words do
                for lag in np.unique(stretch[2][~np.array(right, bool)]):
                    i, n = _stretches(line[lag:] == line[:-lag], max(lag, MIN_LENGTH - lag))
                    found.append((i + back[text[i]], i + n + lag + back[text[i]], np.full(len(i), lag)))
                start, same, q = stretch[:, np.array(right, bool)]
                found.append((start + back[text[start]], start + same + q + back[text[start]], q))
            scale *= 2
        taken = lengths > 2 * scale
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # the same stretch with multiples of its smallest period
    least = np.ones(len(start), bool)
    least[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, period = start[least], end[least], period[least]
    text = np.searchsorted(ends, start, "right")
    order = np.lexsort((period, start, text))
    text, start, end, period = text[order], start[order], end[order], period[order]
    return text, start - first_of[text], end - first_of[text], period


def rewritten(n: int, crc: int) -> np.ndarray | None:
    """Which original word each of ``n`` words becomes, None if all stay.

    One text in ten, by its id's checksum, repeats a stretch from some word on.
    """
    if crc % 10 or not n:
        return None
    g = crc // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def _collapsed(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, kept: np.ndarray, n_words: np.ndarray) -> list[str]:
    """SHA-256 of the kept words of each text, joined by one blank."""
    a, b = int(at[0]), int(at[-1])
    part = data[a:b]
    mask = ~SPACE[part]
    gone = ~kept
    if gone.any():
        step = np.zeros(len(part) + 1, np.int8)
        step[start[gone] - a] += 1
        # a word may begin where the one before ends: texts lie end to end
        np.add.at(step, end[gone] - a, -1)
        mask &= np.cumsum(step[:-1], dtype=np.int8) == 0
    # the blank before each kept word but a text's first
    leading = np.zeros(len(start), bool)
    leading[(np.cumsum(n_words) - n_words)[n_words > 0]] = True
    blank = start[kept & ~leading] - a - 1
    mask[blank] = True
    out = np.where(SPACE[part], np.uint8(0x20), part)[mask]
    stop = np.concatenate(([0], np.cumsum(mask)))[at - a]
    return [hashlib.sha256(out[x:y]).hexdigest() for x, y in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]


def describe(data: np.ndarray, at: np.ndarray, crcs: list[int | None]) -> list[tuple]:
    """The fields of the result for texts that lie end to end; ``crcs`` choose rewritten ones."""
    start, end, n_words = bounds(data, at)
    words, ends = hashes(data, start, end), np.cumsum(n_words)
    moved: dict[int, np.ndarray] = {}
    for i, crc in enumerate(crcs):
        if crc is not None and (new := rewritten(int(n_words[i]), crc)) is not None:
            moved[i] = new + (ends[i] - n_words[i])
            words[ends[i] - n_words[i] : ends[i]] = words[moved[i]]
    text, first, last, period = find_runs(words, ends)
    # words beyond the first period of a run
    offset = (ends - n_words)[text]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, offset + first + period, 1)
    np.add.at(step, offset + last, -1)
    kept = np.cumsum(step[:-1]) == 0
    collapsed = _collapsed(data, at, start, end, kept, n_words)
    for i, new in moved.items():
        mine = new[kept[ends[i] - n_words[i] : ends[i]]]
        whole = data[at[i] : at[i + 1]].tobytes()
        a, b = (start[mine] - at[i]).tolist(), (end[mine] - at[i]).tolist()
        collapsed[i] = hashlib.sha256(b" ".join([whole[x:y] for x, y in zip(a, b, strict=True)])).hexdigest()
    rows, none = [], hashlib.sha256(b"").hexdigest()
    cut = np.searchsorted(text, np.arange(len(crcs) + 1))
    for i in range(len(crcs)):
        x, y = cut[i], cut[i + 1]
        if x == y:
            rows.append((0, None, None, None, None, none, collapsed[i]))
            continue
        s, n, q = first[x:y], (last - first)[x:y], period[x:y]
        best = int(np.lexsort((q, s, -n))[0])
        listed = "".join(f"{u},{v},{w}\n" for u, v, w in zip(s.tolist(), n.tolist(), q.tolist(), strict=True))
        longest = (int(s[best]), int(n[best]), int(q[best]), 1000 * int(n[best]) // int(q[best]))
        rows.append((int(y - x), *longest, hashlib.sha256(listed.encode()).hexdigest(), collapsed[i]))
    return rows


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """One row per document: ``doc_id`` and the fields of ``FIELDS``.

    ``start, length, period, exponent_milli`` belong to the longest run (ties: least
    start, then period) and are null without a run; ``runs_sha256`` covers all runs,
    ``collapsed_sha256`` the text without what repeats a run's first period.  With
    ``rewrite`` one text in ten is first made to repeat (see ``rewritten``).

    A null or blank text has no words and no run.  Rows that repeat a ``doc_id`` are
    answered each; a null ``doc_id`` is never rewritten.  Other columns are ignored.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.string() if "string" in f else pa.int64() for f in FIELDS.split(", ")]

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts(batch.column("text"))
            crcs = batch.column("crc").to_pylist()
            for i, j in together(at):
                rows = describe(data, at[i : j + 1], crcs[i:j])
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *columns], ["doc_id", *names])

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) if rewrite else F.lit(None).cast("long")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", crc.alias("crc")).mapInArrow(draw, f"doc_id {kind}, {FIELDS}")
