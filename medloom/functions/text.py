"""Scalar text rules as native Column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom import lexicon as lx

# Whitespace as Python's str methods see it: Unicode spaces plus the four
# ASCII separator controls.
SPACE = r"[\s\x1c-\x1f]"
# The same set spelled out, which a split tests faster than the Unicode class.
_SPACES = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same set as characters, for trimming without a regular expression.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda an outer expression would be evaluated per element; a
    one-element array binds it instead.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def staged(df: DataFrame, *cols: Column) -> DataFrame:
    """Add columns that later steps use many times, each evaluated once.

    The optimizer copies expensive expressions into filters and struct
    extractions; it does not copy them through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*cols))))


#: bytes of a batch that an Arrow function takes up at once
PORTION = 1 << 20


def portions(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Equally long arrays in slices of few rows.

    The first has texts or lists, of which a slice holds ``PORTION`` bytes and its last row
    at most; an item of a list counts as eight.  So the objects made of a batch stay few
    however long its rows are.
    """
    first = columns[0]
    lists = pa.types.is_list(first.type) or pa.types.is_large_list(first.type)
    sizes = (first.value_lengths() if lists else pc.binary_length(first)).fill_null(0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1] * (8 if lists else 1)
    cuts = np.flatnonzero(np.diff(before // PORTION)) + 1
    ends = [0, *cuts.tolist(), len(first)]
    for begin, end in zip(ends, ends[1:]):
        yield tuple(c.slice(begin, end - begin) for c in columns)


def any_contains(c: Column, needles: Iterable[str]) -> Column:
    tests = [c.contains(n) for n in needles]
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def words(c: Column) -> Column:
    """Whitespace-separated tokens; an empty string has none."""
    return F.array_remove(F.split(c, f"{_SPACES}+"), "")


def normalise_term(c: Column, chars: str = lx.VIETNAMESE.term_strip) -> Column:
    return collapse(F.btrim(F.lower(c), F.lit(chars)))


def label_key(c: Column) -> Column:
    return strip(F.translate(F.lower(c), "_", " "))


def detect_language(
    c: Column, letters: str = lx.VIETNAMESE_LETTERS, hit: str = "vi", miss: str = "en"
) -> Column:
    return F.when(c.rlike(_either_case(letters)), hit).otherwise(miss)


@functools.cache
def _either_case(letters: str) -> str:
    """A pattern for one of these letters in upper or lower case.

    A class of a few ranges costs a text less than one that folds each character and
    tries the letters in turn.  Only for letters whose cases are pairs of single ones.
    """
    # Latin with marks; the letters left out have a third form or cases of other lengths
    if not all("\u00c0" <= x <= "\u017e" and x not in "\u00d7\u00df\u00f7\u0130\u0131\u0149" or x in "ƠơƯư" or "\u1ea0" <= x <= "\u1ef9" for x in letters):
        return f"(?iu)[{letters}]"
    # the sign of the unit is one more capital of a letter
    forms = {form for x in letters for form in (x.lower(), x.upper(), *("\u212b" if x in "Åå" else ""))}
    points = sorted(map(ord, forms))
    opens = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
    closes = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(opens, closes, strict=True)) + "]"


def token_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays taken as sets; two empty sets agree fully."""
    union = F.size(F.array_union(a, b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def token_jaccard(a: Column, b: Column) -> Column:
    return let(token_set(a), lambda x: let(token_set(b), lambda y: set_jaccard(x, y)))


@F.pandas_udf(T.StringType())
def compose(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return s.str.normalize("NFC")


def keep_word_characters(c: Column) -> Column:
    """Collapse whitespace, then drop all but letters, digits, `_`, space, `-`, `.`."""
    return F.regexp_replace(
        F.regexp_replace(strip(c), f"(?U){SPACE}+", " "), r"[^\p{L}\p{N}_ \-.]", ""
    )


def clean_gold(c: Column) -> Column:
    """Cleaning used for benchmark sets: combining marks go before composition."""
    return compose(keep_word_characters(c))


def clean_training(c: Column) -> Column:
    text = F.translate(F.coalesce(c, F.lit("")), "_", " ")
    return F.regexp_replace(
        F.btrim(text, F.lit(" .,;!?\"'()[]{}")), f"(?U){SPACE}+", " "
    )


def sentences(c: Column, *, at_points: bool = False) -> Column:
    """Sentences: cut after a run of ``.``, ``!`` or ``?`` that whitespace follows.

    ``at_points`` is the plain fallback: cut at every ``.``, which is dropped.
    """
    cut = "[.]" if at_points else f"(?U)(?<=[.!?]){SPACE}+"
    return F.filter(F.transform(F.split(c, cut), strip), lambda s: s != "")


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def is_filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def find(c: Column, term: Column) -> Column:
    """Zero-based code-point position of ``term``, -1 if absent."""
    return F.call_function("locate", term, c) - 1


def find_ignoring_case(c: Column, term: Column) -> Column:
    return find(F.lower(c), F.lower(term))


def slice_text(c: Column, start: Column, end: Column) -> Column:
    """Half-open, zero-based slice."""
    return F.substring(c, start + 1, end - start)


def fenced_json(c: Column) -> Column:
    """The part between json code fences, or the whole answer without fences."""
    fence = r"(?is)```json\s*(.*?)\s*```"
    return strip(F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c))


def drop_subword_marks(c: Column) -> Column:
    return F.replace(F.replace(strip(c), F.lit("@@"), F.lit("")), F.lit("##"), F.lit(""))


def strip_punctuation(c: Column) -> Column:
    return F.btrim(c, F.lit(lx.PUNCTUATION + " \t\n\r"))


def parse_vector(c: Column) -> Column:
    """Numbers with a decimal point out of printed text, as floats."""
    found = F.regexp_extract_all(c, F.lit(r"(-?\d+\.\d+(?:e-?\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("float"))


def chat_messages(system: Column, user: Column, assistant: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", system), message("user", user), message("assistant", assistant)
    )


def role_content(messages: Column, role: str, *, last: bool = False) -> Column:
    """Content of the first (or last) message of a role."""
    mine = F.filter(messages, lambda m: m["role"] == role)
    return F.try_element_at(mine, F.lit(-1 if last else 1))["content"]


def token_slice(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens ``start`` to ``end`` inclusive, joined by a space."""
    return F.array_join(F.slice(tokens, start + 1, F.greatest(end - start + 1, F.lit(0))), " ")


def remap(c: Column, table: dict[str, str], miss: str | None = "identity") -> Column:
    """Look a value up in a small fixed table.

    ``miss``: ``identity`` keeps the key, ``None`` gives null, any other text is
    the default.  Dropping unmatched rows is ``where(remap(c, t, None).isNotNull())``.
    """
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, c)
    if miss is None:
        return found
    return F.coalesce(found, c if miss == "identity" else F.lit(miss))


