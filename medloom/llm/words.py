"""Words of whole texts in Arrow batches, as byte positions and 64-bit hashes.

A word is a run of bytes without separators, which are ASCII; such bytes never occur
inside a UTF-8 character, so bytes can be cut without decoding.  Work arrays are bounded by
``STEP`` bytes at a time, whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes that are hashed at once
STEP = 1 << 20
#: texts are taken together up to about so many bytes
TOGETHER = 1 << 22
MIX1, MIX2, STEP_BY = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII that is neither digit nor letter
MARKS = np.zeros(256, bool)
MARKS[[c for c in range(128) if not chr(c).isalnum()]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


#: a random number for each byte, and for each lower-cased byte
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
FOLDED = BYTES.copy()
FOLDED[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i below n."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each text starts, with the end at last; null is empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def together(at: np.ndarray, most: int = TOGETHER, many: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Stretches of up to ``many`` texts with at most ``most`` bytes, or one text."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, min(first + many, int(np.searchsorted(at, at[first] + most, "right")) - 1))
        yield first, last
        first = last


def bounds(data: np.ndarray, at: np.ndarray, table: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of texts that lie end to end, and how many words each has.

    ``at``: start of each text in ``data`` and the end of the last; ``table``: the bytes
    that separate words.
    """
    starts, ends = [], []
    for a in range(int(at[0]), int(at[-1]), STEP):
        b = min(a + STEP, int(at[-1]))
        space = table[data[a:b]]
        # a text's end separates words as white space does
        cut = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a
        before = np.empty(b - a, bool)
        before[1:] = space[:-1]
        before[0] = a == at[0] or table[data[a - 1]]
        before[cut] = True
        starts.append(np.flatnonzero(before & ~space) + a)
        after = np.empty(b - a, bool)
        after[:-1] = space[1:]
        after[-1] = b == at[-1] or table[data[b]] or bool(np.isin(b, at))
        after[cut[cut > 0] - 1] = True
        ends.append(np.flatnonzero(after & ~space) + a + 1)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return start, end, np.diff(np.searchsorted(start, at))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over its bytes."""
    out = np.empty(len(start), np.uint64)
    up, down = powers(BASE, STEP), powers(INVERSE, STEP)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STEP, "right")))
        a, b = int(start[i]), int(end[j - 1])
        if b - a > STEP:  # one word longer than a step
            up, down = powers(BASE, b - a), powers(INVERSE, b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(words: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle of texts laid end to end.

    ``words``: hashed words; ``ends``: where each text ends.  A shorter text that has
    words is one shingle.
    """
    lengths = np.diff(np.concatenate(([0], ends)))
    text = np.repeat(np.arange(len(ends)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(words))
    whole = (np.arange(len(words)) == np.repeat(ends - lengths, lengths)) | (left >= size)
    value = np.zeros(len(words), np.uint64)
    for i in range(size):
        # beyond the end of a short text: nothing is added
        inside = left > i
        value = np.where(inside, value * STEP_BY + np.roll(words, -i), value)
    return text[whole], mix(value[whole])
