"""Rules that look at the text around a mention.

They take the note text and half-open code-point offsets, or the surroundings of a
mention that ``surroundings`` cuts out of it once: its line, a few characters more,
and a dose that follows.  Used inside a transform over the mentions of a note, rows
of mentions never carry the note.  The clause and line are cut with
``substring_index``, which scans from the mention outwards.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.functions import text as tx
from medloom.functions.text import portions
from medloom.lexicon import VIETNAMESE, Rules


def first_match_start(c: Column, pattern: str) -> Column:
    """Code-point start of the first match, null without one.

    ``regexp_instr`` counts UTF-16 units, so the text before the match is
    measured instead.
    """
    return F.when(c.rlike(pattern), F.length(F.split(c, pattern, 2)[0]))


def section_bounds(c: Column, rules: Rules = VIETNAMESE) -> Column:
    """Starts of the three sections; a missing first is -1, others the text length."""
    return F.struct(
        F.coalesce(first_match_start(c, rules.history_header), F.lit(-1)).alias("s1"),
        F.coalesce(first_match_start(c, rules.present_header), F.length(c)).alias("s2"),
        F.coalesce(first_match_start(c, rules.hospital_header), F.length(c)).alias("s3"),
    )


def is_historical(start: Column, bounds: Column) -> Column:
    return (bounds["s1"] != -1) & (bounds["s1"] <= start) & (start < bounds["s2"])


def before(c: Column, start: Column) -> Column:
    return F.substring(c, F.lit(1), start)


def after(c: Column, end: Column) -> Column:
    return F.substring(c, end + 1, F.lit(2**31 - 1))


def surroundings(
    c: Column, start: Column, end: Column, rules: Rules = VIETNAMESE, window: int = lx.CONTEXT_CHARS
) -> Column:
    """``struct<prefix,term,suffix>``: as much text as the rules read around a mention.

    The prefix reaches back to the start of its line and clause, the suffix to the
    end of the line and one character past a dose, both ``window`` at least.
    """

    def back(prefix: Column) -> Column:
        line = F.length(F.substring_index(prefix, "\n", -1))
        clause = F.length(clause_before(prefix, rules.clause_breaks))
        return F.right(prefix, F.greatest(line, clause, F.lit(window)))

    def ahead(suffix: Column) -> Column:
        line = F.length(F.substring_index(suffix, "\n", 1))
        dose = F.length(F.regexp_extract(suffix, f"(?iU){rules.dose_tail}", 0)) + 1
        return F.left(suffix, F.greatest(line, dose, F.lit(window)))

    return F.struct(
        tx.let(before(c, start), back).alias("prefix"),
        tx.slice_text(c, start, end).alias("term"),
        tx.let(after(c, end), ahead).alias("suffix"),
    )


#: characters of a block of text
BLOCK = 256
#: blocks read on both sides of a mention, first few and then more
AROUND = (1, 4, 32)


def blocks(c: Column) -> Column:
    """A text in blocks, so that a place in it is reached without reading up to it."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def nearby(
    c: Column, cut: Column, start: Column, end: Column, read: Callable[[Column, Column, Column], Column],
    reach: Callable[[Column, Column, Column], tuple[Column, Column]], around: tuple[int, ...] = AROUND,
) -> Column:
    """``read(text, start, end)`` on the blocks around a mention instead of the text.

    ``cut`` are the blocks of ``c``.  ``reach(found, start, end)`` tells how far the
    result reaches into the text it was read from.  If that is to an edge of the
    blocks which is no edge of the text, more blocks are read, and at last the text itself.
    """
    if not around:
        return F.struct(read(c, start, end).alias("found"), F.lit(0).alias("offset"))
    first = F.greatest(F.floor(start / BLOCK).cast("int") - around[0], F.lit(0))
    last = F.floor(end / BLOCK).cast("int") + around[0]

    def on(window: Column) -> Column:
        offset = window["offset"]
        here = start - offset, end - offset

        def judge(found: Column) -> Column:
            left, right = reach(found, *here)
            inside = ((offset == 0) | (left > 0)) & ((last >= F.size(cut) - 1) | (right < F.length(window["text"])))
            return F.when(inside, F.struct(found.alias("found"), offset.alias("offset"))).otherwise(
                nearby(c, cut, start, end, read, reach, around[1:])
            )

        return tx.let(read(window["text"], *here), judge)

    window = F.struct(
        F.array_join(F.slice(cut, first + 1, last - first + 1), "").alias("text"),
        (first * BLOCK).alias("offset"),
    )
    return tx.let(window, on)


def clause_before(prefix: Column, breaks: tuple[str, ...]) -> Column:
    return functools.reduce(lambda c, b: F.substring_index(c, b, -1), breaks, prefix)


def line_around(prefix: Column, mention: Column, suffix: Column) -> Column:
    return F.concat(
        F.substring_index(prefix, "\n", -1), mention, F.substring_index(suffix, "\n", 1)
    )


def starts_negated_line(line: Column, rules: Rules = VIETNAMESE) -> Column:
    def opens(trimmed: Column) -> Column:
        return functools.reduce(
            lambda a, b: a | b, [trimmed.startswith(p) for p in rules.negated_line_starts]
        )

    return tx.let(F.lower(tx.strip(line)), opens)


def is_negated_in_clause(clause: Column, rules: Rules = VIETNAMESE) -> Column:
    """A negator before the mention that no later contrast marker cancels."""

    def back_to(low: Column, negator: str) -> Column:
        # distance from the mention back to the last use of the negator
        gap = F.length(F.substring_index(low, negator, -1)) + len(negator)
        return F.when(low.contains(negator), gap)

    def scope(low: Column) -> Column:
        gaps = [back_to(low, n) for n in rules.negators]
        nearest = gaps[0] if len(gaps) == 1 else F.least(*gaps)
        text = tx.let(nearest, lambda n: F.when(n.isNotNull(), F.right(low, n)))
        for phrase in rules.blanked_phrases:
            text = F.replace(text, F.lit(phrase), F.lit(""))
        return text

    def verdict(between: Column) -> Column:
        return between.isNotNull() & ~tx.any_contains(between, rules.contrast_markers)

    return tx.let(tx.let(F.lower(clause), scope), verdict)


def is_negated(
    prefix: Column,
    mention: Column,
    suffix: Column,
    rules: Rules = VIETNAMESE,
    *,
    line_rule: bool = True,
    strict_contrast: bool = False,
) -> Column:
    """Negation of a mention.

    By default a line that opens with a negator negates everything on it, even
    after a contrast marker; ``strict_contrast`` lets the marker win there too.
    Without ``line_rule`` only the clause is looked at.
    """
    breaks = rules.clause_breaks
    in_clause = is_negated_in_clause(clause_before(prefix, breaks), rules)
    if not line_rule:
        return in_clause
    on_line = starts_negated_line(line_around(prefix, mention, suffix), rules)
    if strict_contrast:
        line_prefix = F.substring_index(prefix, "\n", -1)
        on_line = on_line & ~tx.any_contains(F.lower(line_prefix), rules.contrast_markers)
    return F.coalesce(on_line, F.lit(False)) | F.coalesce(in_clause, F.lit(False))


def assertion_flags(historical: Column | None, negated: Column) -> Column:
    """Flags of a mention, history first."""
    flags = [F.when(negated, F.lit(lx.NEGATED))]
    if historical is not None:
        flags.insert(0, F.when(historical, F.lit(lx.HISTORICAL)))
    return F.array_compact(F.array(*flags))


def assertions(
    c: Column,
    start: Column,
    end: Column,
    bounds: Column | None = None,
    rules: Rules = VIETNAMESE,
    *,
    line_rule: bool = True,
    strict_contrast: bool = False,
) -> Column:
    """Assertion flags of a mention; without bounds only negation."""
    if not line_rule:
        # the clause alone: neither the line nor what follows is read
        negated = is_negated_in_clause(clause_before(before(c, start), rules.clause_breaks), rules)
        return assertion_flags(None if bounds is None else is_historical(start, bounds), negated)
    negated = tx.let(
        surroundings(c, start, end, rules),
        lambda at: is_negated(
            at["prefix"], at["term"], at["suffix"], rules,
            line_rule=line_rule, strict_contrast=strict_contrast,
        ),
    )
    return assertion_flags(None if bounds is None else is_historical(start, bounds), negated)


_SEPARATORS = r"\s!-/:-@\[-`{-~"  # ASCII whitespace and punctuation


def repair_boundaries(c: Column, start: Column, end: Column) -> Column:
    """Grow a span both ways to the next ASCII space or punctuation mark."""
    # the run of word characters lies after the last newline and space
    tail = F.substring_index(F.substring_index(before(c, start), "\n", -1), " ", -1)
    left = F.length(F.regexp_extract(tail, f"[^{_SEPARATORS}]*$", 0))
    right = F.length(F.regexp_extract(after(c, end), f"^[^{_SEPARATORS}]*", 0))
    return F.struct((start - left).alias("start"), (end + right).alias("end"))


def repair_nearby(c: Column, cut: Column, start: Column, end: Column) -> Column:
    """``repair_boundaries`` on the blocks of a text."""
    near = nearby(c, cut, start, end, repair_boundaries, lambda s, a, b: (s["start"], s["end"]))
    return tx.let(
        near,
        lambda x: F.struct(
            (x["found"]["start"] + x["offset"]).alias("start"),
            (x["found"]["end"] + x["offset"]).alias("end"),
        ),
    )


def surroundings_nearby(
    c: Column, cut: Column, start: Column, end: Column, rules: Rules = VIETNAMESE
) -> Column:
    """``surroundings`` on the blocks of a text."""
    return nearby(
        c, cut, start, end,
        lambda text, a, b: surroundings(text, a, b, rules),
        lambda at, a, b: (a - F.length(at["prefix"]), b + F.length(at["suffix"])),
    )["found"]


#: characters after a mention in which a dose is looked for first
DOSE_CHARS = 512


def mention_windows(
    c: Column, starts: Column, ends: Column, rules: Rules = VIETNAMESE, window: int = lx.CONTEXT_CHARS
) -> Column:
    """Per mention its span of whole words and what ``surroundings`` reads around that.

    ``array<struct<start,end,prefix,term,suffix>>`` of the arrays ``starts`` and ``ends``;
    a mention without both has nulls.  The spans are those of ``repair_boundaries``.  An Arrow
    function finds the places in portions of a batch and gives them in bytes; the texts are
    cut there within their row, so a batch never holds the surroundings of its mentions.  A
    dose is looked for in the next ``DOSE_CHARS`` characters, and in all that follows only
    where it reaches their end.
    """
    word = re.compile("[^ \t\n\x0b\x0c\r!-/:-@\\[-`{-~]*")
    marks = ("\n", *rules.clause_breaks)

    def spans(text: str, firsts: list, lasts: list) -> np.ndarray:
        """Start, end, begin of the prefix, end of the suffix and rest of the line of mentions."""
        # where each mark stands in the text, found once
        places = [[] for _ in marks]
        for mark, found in zip(marks, places, strict=True):
            at = text.find(mark)
            while at >= 0:
                found.append(at)
                at = text.find(mark, at + 1)
        back, out = text[::-1], []
        for start, end in zip(firsts, lasts, strict=True):
            if start is None or end is None:
                out.append((-1,) * 5)
                continue
            # a return before the span is passed over, as an end of a line is
            gap = start > 0 and text[start - 1 : start] == "\r"
            left, right = word.match(back, len(text) - start + gap), word.match(text, end)
            start -= left.end() - left.start()
            end += right.end() - right.start()

            def after(begin: int, n: int) -> int:
                """Place after the last of a mark between there and the span."""
                k = bisect.bisect_right(places[n], start - len(marks[n])) - 1
                return places[n][k] + len(marks[n]) if k >= 0 and places[n][k] >= begin else begin

            clause = 0
            for n in range(1, len(marks)):
                clause = after(clause, n)
            begin = max(0, min(after(0, 0), clause, start - window))
            k = bisect.bisect_left(places[0], end)
            line = (places[0][k] if k < len(places[0]) else len(text)) - end
            out.append((start, end, begin, end + max(line, window, DOSE_CHARS), line))
        return np.array(out, np.int64)

    @F.arrow_udf("array<struct<start:int,end:int,line:int,whole:boolean,begin:int,at:int,to:int,reach:int>>")
    def find(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts, firsts, lasts in portions(*batch):
                sizes = firsts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                firsts_, lasts_ = firsts.flatten().to_pylist(), lasts.flatten().to_pylist()
                found, bytes_ = np.full((offsets[-1], 5), -1), np.zeros((offsets[-1], 4), np.int64)
                whole = np.zeros(offsets[-1], bool)
                for text, lo, hi in zip(texts.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if lo == hi or text is None:
                        continue
                    found[lo:hi] = at = spans(text, firsts_[lo:hi], lasts_[lo:hi])
                    whole[lo:hi] = at[:, 3] >= len(text)
                    bytes_[lo:hi] = np.clip(at[:, [2, 0, 1, 3]], 0, len(text))
                    if not text.isascii():
                        coded = np.frombuffer(text.encode(), np.uint8)
                        # the first byte of each character, and the end
                        begins = np.append(np.flatnonzero((coded & 0xC0) != 0x80), len(coded))
                        bytes_[lo:hi] = begins[bytes_[lo:hi]]
                missing = found[:, 0] < 0
                columns = [found[:, 0], found[:, 1], found[:, 4], whole, *bytes_.T]
                kinds = [pa.int32()] * 3 + [pa.bool_()] + [pa.int32()] * 4
                names = ["start", "end", "line", "whole", "begin", "at", "to", "reach"]
                fields = [pa.array(x, kind, mask=missing) for x, kind in zip(columns, kinds, strict=True)]
                items = pa.StructArray.from_arrays(fields, names)
                yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=firsts.is_null())

    def finish(text: Column, m: Column) -> Column:
        part = lambda begin, end: F.substring(text, begin + 1, end - begin).cast("string")
        dose = lambda suffix: F.length(F.regexp_extract(suffix, f"(?iU){rules.dose_tail}", 0)) + 1
        ahead = lambda suffix, n: F.left(suffix, F.greatest(m["line"], n, F.lit(window)))

        def suffix(near: Column) -> Column:
            far = tx.let(part(m["to"], F.lit(2**31 - 1)), lambda rest: ahead(rest, dose(rest)))
            return tx.let(
                dose(near), lambda n: F.when(m["whole"] | (n < F.length(near)), ahead(near, n)).otherwise(far)
            )

        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), part(m["begin"], m["at"]).alias("prefix"),
            part(m["at"], m["to"]).alias("term"), tx.let(part(m["to"], m["reach"]), suffix).alias("suffix"),
        )

    return tx.let(
        F.struct(c.cast("binary").alias("text"), find(c, starts, ends).alias("found")),
        lambda x: F.transform(x["found"], lambda m: finish(x["text"], m)),
    )


def dose_length(suffix: Column, pattern: str = VIETNAMESE.dose_tail) -> Column:
    """Length of a dose directly at the start of the text after a drug."""
    return F.length(tx.rstrip(F.regexp_extract(suffix, f"(?iU){pattern}", 0)))


def expand_drug(c: Column, end: Column, pattern: str = VIETNAMESE.dose_tail) -> Column:
    """End of a drug span once a directly following dose is taken in."""
    return end + dose_length(after(c, end), pattern)


def drug_context(
    prefix: Column, suffix: Column, rules: Rules = VIETNAMESE, window: int = lx.CONTEXT_CHARS
) -> Column:
    """A dose right after, or a word for taking medicine right before."""
    left = F.lower(F.right(prefix, F.lit(window)))
    right = F.lower(F.left(suffix, F.lit(window)))
    return right.rlike(f"(?U){rules.dose_after}") | left.rlike(f"(?U){rules.drug_before}")


def has_drug_context(
    c: Column,
    start: Column,
    end: Column,
    rules: Rules = VIETNAMESE,
    window: int = lx.CONTEXT_CHARS,
) -> Column:
    """The same from the whole text and the offsets of the mention."""
    near = tx.slice_text(c, F.greatest(start - window, F.lit(0)), start)
    return drug_context(near, F.substring(c, end + 1, F.lit(window)), rules, window)


def result_in(suffix: Column, end: Column) -> Column:
    """Rest of the line after a test name, without a leading `:` or `-`.

    Null when nothing is left.
    """

    def build(raw: Column) -> Column:
        value = tx.strip(F.regexp_replace(tx.strip(raw), rf"(?U)^[:\-]+{tx.SPACE}*", ""))

        def place(found: Column) -> Column:
            start = end + tx.find(raw, found)
            return F.when(
                found != "",
                F.struct(
                    found.alias("text"),
                    start.alias("start"),
                    (start + F.length(found)).alias("end"),
                ),
            )

        return tx.let(value, place)

    return tx.let(F.substring_index(suffix, "\n", 1), build)


def result_after(c: Column, end: Column) -> Column:
    """The same from the whole text and the end of the test name."""
    return result_in(after(c, end), end)


def is_test_name(term: Column, rules: Rules = VIETNAMESE) -> Column:
    return tx.any_contains(term, rules.test_phrases) | term.isin(list(rules.test_names))


def passes_precision(term: Column, kind: Column, rules: Rules = VIETNAMESE) -> Column:
    """Keep a normalised term: not empty, too short, generic, or only a dose."""

    def judge(t: Column) -> Column:
        is_test = F.coalesce(kind == lx.TEST_NAME, F.lit(False))
        is_drug = F.coalesce(kind == lx.DRUG, F.lit(False))
        too_short = (F.length(t) < 3) & ~t.isin(list(rules.short_terms)) & ~is_test
        vague_feeling = t.startswith(rules.generic_prefix) & (F.size(tx.words(t)) <= 2)
        only_dose = is_drug & t.rlike(f"(?iU)^(?:{rules.dose_only})$")
        generic = t.isin(list(rules.generic_terms))
        return (t != "") & ~too_short & ~generic & ~vague_feeling & ~only_dose

    return tx.let(term, judge)


def correct_type(
    term: Column,
    kind: Column,
    is_disease: Column,
    drug_context: Column,
    rules: Rules = VIETNAMESE,
) -> Column:
    """Type after the three corrections, applied in order.

    A disease mention naming a common symptom becomes a symptom; a test in drug
    context becomes a drug; test keywords always make a test.  Returns
    ``struct<type, is_disease>``; ``type`` stays null while retrieval decides.
    """

    def decide(seen: Column) -> Column:
        to_symptom = F.when(seen["symptom"], F.lit(lx.SYMPTOM)).otherwise(kind)
        to_drug = F.when((kind == lx.TEST_NAME) & drug_context, F.lit(lx.DRUG)).otherwise(to_symptom)
        return F.struct(
            F.when(seen["test"], F.lit(lx.TEST_NAME)).otherwise(to_drug).alias("type"),
            (is_disease & ~seen["symptom"] & ~seen["test"]).alias("is_disease"),
        )

    def look(t: Column) -> Column:
        return F.struct(
            (is_disease & tx.any_contains(t, rules.symptoms)).alias("symptom"),
            is_test_name(t, rules).alias("test"),
        )

    return tx.let(tx.let(term, look), decide)
