"""Token and span sequences.

A sentence or note is one row and its tokens, lines or mentions are an array
in that row, so none of these operators shuffles: each is a Column over one
array, linear in its length except for the folds that must carry a position.
Tags are repaired and read for Arrow batches of sentences at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.functions import text as tx
from medloom.functions.text import let, portions

TOKENS = "array<struct<word:string,tag:string>>"


def _indices(c: Column) -> Column:
    """0 .. size-1, empty for an empty array."""
    return F.filter(F.sequence(F.lit(0), F.size(c)), lambda i: i < F.size(c))


def _positions(flags: Column) -> Column:
    """Zero-based positions of the true flags."""
    marked = F.transform(flags, lambda f, i: F.when(f, i))
    return F.filter(marked, lambda i: i.isNotNull())


def tag_type(tag: Column) -> Column:
    """Entity type of a BIO tag, null outside an entity."""
    return F.when(tag.startswith("B-") | tag.startswith("I-"), F.substring(tag, 3, 1 << 30))


# --- BIO tags -------------------------------------------------------------


class _Tags:
    """Tags of a batch of sentences, flat: types as numbers (-1 for none) and what goes on.

    ``kind_of`` gives the type of a distinct tag or None; a token goes on with an entity
    if it is ``I-`` and the token before it has its type.
    """

    def __init__(self, sentences: pa.Array, kind_of: Callable[[str], str | None]):
        self.nulls = sentences.is_null()
        lengths = sentences.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        tokens = sentences.flatten()
        self.words = pc.struct_field(tokens, "word")
        coded = pc.struct_field(tokens, "tag").dictionary_encode()
        tags = coded.dictionary.to_pylist()
        kinds = [kind_of(t) for t in tags]
        self.kinds = sorted({k for k in kinds if k is not None})
        # one more entry for tokens without a tag
        number = np.array([-1 if k is None else self.kinds.index(k) for k in kinds] + [-1])
        inside = np.array([t.startswith("I-") for t in tags] + [False])
        at = coded.indices.fill_null(len(tags)).to_numpy(zero_copy_only=False)
        self.kind = number[at]
        same = np.zeros(len(at), bool)
        same[1:] = self.kind[1:] == self.kind[:-1]
        same[self.offsets[:-1][lengths > 0]] = False
        self.goes_on = inside[at] & same & (self.kind >= 0)

    def lists(self, offsets: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=self.nulls)


def _kind(tag: str) -> str | None:
    return tag[2:] if tag.startswith(("B-", "I-")) else None


def _chosen(values: list[str], at: np.ndarray) -> pa.Array:
    return pa.array(values, pa.string()).take(pa.array(at, pa.int64()))


def repair_bio(tokens: Column, tag_map: dict[str, str] | None = None) -> Column:
    """Map tag types and make every entity start with ``B-``.

    Unmapped or malformed tags become ``O``; an ``I-`` whose previous token has
    another type becomes ``B-``.
    """

    def mapped(tag: str) -> str | None:
        return _kind(tag) if tag_map is None else tag_map.get(_kind(tag))

    @F.arrow_udf(TOKENS)
    def repair(sentences: pa.Array) -> pa.Array:
        t = _Tags(sentences, mapped)
        names = ["O", *[f"{head}-{k}" for k in t.kinds for head in "BI"]]
        tags = _chosen(names, np.where(t.kind < 0, 0, 1 + 2 * t.kind + t.goes_on))
        return t.lists(t.offsets, pa.StructArray.from_arrays([t.words, tags], ["word", "tag"]))

    return repair(tokens)


SPANS = "array<struct<entity:string,type:string,start_token:int,end_token:int>>"


def bio_to_spans(tokens: Column) -> Column:
    """Entities of a tagged sentence with inclusive token ends."""

    @F.arrow_udf(SPANS)
    def spans(sentences: pa.Array) -> pa.Array:
        t = _Tags(sentences, _kind)
        # a sentence opens with an edge, so no stretch runs over its end
        edges = np.flatnonzero(~t.goes_on)
        ends = np.append(edges, len(t.kind))[1:]
        entity = t.kind[edges] >= 0
        start, end = edges[entity], ends[entity] - 1
        words, whole = t.words, np.append(edges, len(t.kind))
        if words.null_count:
            # words that are null are left out of an entity
            known = np.concatenate([[0], np.cumsum(words.is_valid().to_numpy(zero_copy_only=False))])
            words, whole = words.drop_null(), known[whole]
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array(whole, pa.int32()), words), " ")
        first = t.offsets[np.searchsorted(t.offsets, start, side="right") - 1]
        found = pa.StructArray.from_arrays(
            [
                names.filter(pa.array(entity)), _chosen(t.kinds, t.kind[start]),
                pa.array(start - first, pa.int32()), pa.array(end - first, pa.int32()),
            ],
            ["entity", "type", "start_token", "end_token"],
        )
        return t.lists(np.searchsorted(start, t.offsets), found)

    return spans(tokens)


def spans_to_bio(words: Column, spans: Column) -> Column:
    """Tag words from ``struct<start,end,label>`` spans; later spans overwrite.

    Ends are inclusive; parts outside the sentence and spans without a label
    are ignored.
    """

    def tag(labelled: Column, i: Column) -> Column:
        covering = F.filter(labelled, lambda s: (s["start"] <= i) & (i <= s["end"]))

        def name(last: Column) -> Column:
            head = F.when(last["start"] == i, F.lit("B-")).otherwise(F.lit("I-"))
            return F.coalesce(F.concat(head, last["label"]), F.lit("O"))

        return let(F.try_element_at(covering, F.lit(-1)), name)

    return let(
        F.filter(spans, lambda s: s["label"].isNotNull()),
        lambda labelled: F.transform(
            words, lambda w, i: F.struct(w.alias("word"), tag(labelled, i).alias("tag"))
        ),
    )


def split_underscores(tokens: Column) -> Column:
    """Split word-segmented tokens at ``_``; later parts of an entity get ``I-``."""

    def parts(t: Column) -> Column:
        kind = tag_type(t["tag"])
        pieces = F.filter(F.split(t["word"], "_"), lambda w: w != "")
        return F.transform(
            pieces,
            lambda w, k: F.struct(
                w.alias("word"),
                F.when((k > 0) & kind.isNotNull(), F.concat(F.lit("I-"), kind))
                .otherwise(t["tag"])
                .alias("tag"),
            ),
        )

    return F.flatten(F.transform(tokens, parts))


def align_subwords(
    tokens: Column,
    pieces: Column,
    max_length: int = 256,
    labels: tuple[str, ...] = lx.BIO_LABELS_VI,
) -> Column:
    """Training labels per sub-word piece.

    ``pieces`` holds the piece array of every word.  Only the first piece keeps
    the label; the others, both special tokens and padding get the ignored
    label.  The result is cut or padded to ``max_length``.
    """
    framed = F.concat(
        F.array(_special("[CLS]")), _piece_labels(tokens, pieces, labels), F.array(_special("[SEP]"))
    )
    padded = F.concat(framed, F.array_repeat(_special("[PAD]"), max_length))
    return F.slice(padded, 1, max_length)


def subword_windows(
    tokens: Column,
    pieces: Column,
    max_length: int = 256,
    overlap: int = 32,
    labels: tuple[str, ...] = lx.BIO_LABELS_VI,
) -> Column:
    """The same for sentences of any length: overlapping windows that lose no piece.

    Each window is framed and padded to ``max_length``; neighbours share
    ``overlap`` pieces.
    """
    body = max_length - 2
    step = body - overlap
    if step < 1:
        raise ValueError("the overlap leaves no room for new pieces")

    def cut(content: Column) -> Column:
        last = F.greatest(F.ceil((F.size(content) - body) / step), F.lit(0)).cast("int")

        def window(i: Column) -> Column:
            framed = F.concat(
                F.array(_special("[CLS]")), F.slice(content, i * step + 1, F.lit(body)), F.array(_special("[SEP]"))
            )
            return F.slice(F.concat(framed, F.array_repeat(_special("[PAD]"), max_length)), 1, max_length)

        return F.transform(F.sequence(F.lit(0), last), window)

    return let(_piece_labels(tokens, pieces, labels), cut)


def _special(name: str) -> Column:
    return F.struct(F.lit(name).alias("piece"), F.lit(lx.IGNORED_LABEL).alias("label"))


def _piece_labels(tokens: Column, pieces: Column, labels: tuple[str, ...]) -> Column:
    """``struct<piece,label>`` of all pieces; the first of a word has its label."""
    position = F.create_map(*[F.lit(x) for i, name in enumerate(labels) for x in (name, i)])

    def of_word(t: Column, ps: Column) -> Column:
        label = F.coalesce(F.try_element_at(position, t["tag"]), F.lit(0))
        return F.transform(
            ps,
            lambda p, k: F.struct(
                p.alias("piece"), F.when(k == 0, label).otherwise(F.lit(lx.IGNORED_LABEL)).alias("label")
            ),
        )

    return F.flatten(F.zip_with(tokens, pieces, of_word))


# --- lines and offsets ------------------------------------------------------


_BLOCK = 64


def _fold_starts(sizes: Column, first: Column) -> Column:
    start = F.struct(
        first.cast("int").alias("at"), F.expr("cast(array() as array<int>)").alias("out")
    )
    return F.aggregate(
        sizes,
        start,
        lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
        ),
        lambda acc: acc["out"],
    )


def starts(sizes: Column) -> Column:
    """Running total before each element of an integer array.

    A fold copies its result at every step, so it runs over blocks: one short
    fold for the block totals and one inside each block.
    """

    def by_block(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n))
        return let(
            _fold_starts(totals, F.lit(0)),
            lambda firsts: F.flatten(
                F.transform(blocks, lambda b, i: _fold_starts(b, F.get(firsts, i)))
            ),
        )

    return let(let(sizes, _in_blocks), by_block)


def _in_blocks(items: Column) -> Column:
    """An array as an array of arrays of up to ``_BLOCK`` items; one empty for none."""
    last = F.ceil(F.size(items) / _BLOCK).cast("int") - 1
    return F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)),
    )


def pieces(c: Column, separator: str) -> Column:
    """``array<struct<no,start,piece>>`` of a text cut at one-character separators.

    ``start`` is the offset in the text; ``separator`` is a pattern.  Texts are cut for
    portions of Arrow batches.
    """

    split = re.compile(separator).split

    def all_of(texts: pa.Array) -> pa.Array:
        parts = pa.array([None if s is None else split(s) for s in texts.to_pylist()], pa.list_(pa.string()))
        sizes = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = parts.flatten()
        ends = np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begins = np.concatenate([[0], ends])[:-1]
        first = np.repeat(offsets[:-1], sizes)
        fields = [pa.array(np.arange(len(flat)) - first, pa.int32()), pa.array(begins - begins[first], pa.int32()), flat]
        found = pa.StructArray.from_arrays(fields, ["no", "start", "piece"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found, mask=parts.is_null())

    @F.arrow_udf("array<struct<no:int,start:int,piece:string>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (texts,) in portions(batch):
                yield all_of(texts)

    return cut(c)


def lines(c: Column) -> Column:
    """Lines of a note with their number and offset."""
    return pieces(c, "\n")


def _lists(of: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the lists of a batch begin and end among their items, and the items."""
    sizes = of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), of.flatten()


def _listed(offsets: np.ndarray, of: pa.Array, values: pa.Array) -> pa.Array:
    """New lists of ``values``, null where those of the batch are."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=of.is_null())


LOCATED = "array<struct<term:string,start:int,end:int,label:string>>"


def locate_in_lines(c: Column, raw: Column) -> Column:
    """Offsets of tagger output, searched forward within each line.

    ``raw`` is ``array<struct<line_no,word,label>>`` in reading order.  A word
    that is not found keeps null offsets and leaves the search position alone;
    a new line starts again at its beginning.  Texts are searched for Arrow batches.
    """
    spaces = tx.SPACES

    @F.arrow_udf(LOCATED)
    def search(texts: pa.Array, raws: pa.Array) -> pa.Array:
        offsets, items = _lists(raws)
        words, labels, numbers = (pc.struct_field(items, f).to_pylist() for f in ("word", "label", "line_no"))
        out, ends = [], [0]
        for text, first, last in zip(texts.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            lines = None if text is None or first == last else text.split("\n")
            at = no = begin = pos = 0
            line = lines[0] if lines else None
            for i in range(first, last):
                if labels[i] is None or labels[i] == "O":
                    continue
                word, number = words[i], numbers[i]
                if number != no:
                    no, pos, line = number, 0, None
                    if lines and number is not None and 0 <= number < len(lines):
                        # lines come in order, as a rule
                        if number < at:
                            at = begin = 0
                        begin += sum(map(len, lines[at:number])) + number - at
                        at, line = number, lines[number]
                if word is not None:
                    word = word.strip(spaces).replace("@@", "").replace("##", "")
                hit = -1 if word is None or line is None else line.find(word, pos) if word else 0
                if hit < 0:
                    out.append((word, None, None, labels[i]))
                else:
                    pos = hit + len(word)
                    out.append((word, begin + hit, begin + pos, labels[i]))
            ends.append(len(out))
        fields = list(zip(*out, strict=True)) or [()] * 4
        kinds = pa.string(), pa.int32(), pa.int32(), pa.string()
        found = pa.StructArray.from_arrays(list(map(pa.array, fields, kinds)), ["term", "start", "end", "label"])
        return _listed(np.array(ends), raws, found)

    return search(c, F.transform(raw, lambda e: F.struct(e["line_no"].cast("int").alias("line_no"), e["word"].alias("word"), e["label"].alias("label"))))


def locate_in_text(c: Column, found: Column) -> Column:
    """Offsets of matcher output, searched forward through the whole text.

    Rows are put in order of first occurrence, matched ignoring case, and a hit
    takes its surface form from the text.  A miss keeps its null offset.
    ``found`` needs fields ``term``, ``start``, ``end``; others are kept.  Texts are
    searched for Arrow batches.
    """

    @F.arrow_udf("array<struct<i:int,term:string,start:int,end:int>>")
    def search(texts: pa.Array, lows: pa.Array, terms: pa.Array, low_terms: pa.Array) -> pa.Array:
        offsets, names = _lists(terms)
        names, asked = names.to_pylist(), low_terms.flatten().to_pylist()
        out = []
        for text, low, first, last in zip(
            texts.to_pylist(), lows.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True
        ):

            def find(i: int, pos: int) -> int:
                if low is None or asked[i] is None:
                    return -1
                # an empty term is found at the start, wherever the search stands
                return low.find(asked[i], pos) if asked[i] else 0

            # a missing term goes last; ties keep their order
            firsts = [find(i, 0) for i in range(first, last)]
            order = sorted(range(first, last), key=lambda i: (firsts[i - first] < 0, firsts[i - first]))
            pos = 0
            for i in order:
                hit = find(i, pos)
                if hit < 0:
                    out.append((i - first, names[i], None, None))
                else:
                    pos = hit + len(names[i])
                    out.append((i - first, text[hit:pos], hit, pos))
        fields = list(zip(*out, strict=True)) or [()] * 4
        kinds = pa.int32(), pa.string(), pa.int32(), pa.int32()
        placed = pa.StructArray.from_arrays(list(map(pa.array, fields, kinds)), ["i", "term", "start", "end"])
        return _listed(offsets, terms, placed)

    def fill(x: Column) -> Column:
        def item(m: Column) -> Column:
            e = F.get(x["found"], m["i"])
            return e.withField("start", m["start"]).withField("end", m["end"]).withField("term", m["term"])

        return F.transform(x["placed"], item)

    terms = found["term"]
    placed = search(c, F.lower(c), terms, F.transform(terms, F.lower))
    # both outside the lambda, as an Arrow function has to be
    return let(F.struct(found.alias("found"), placed.alias("placed")), fill)


def merge_adjacent(c: Column, mentions: Column, gap: int = lx.MERGE_GAP) -> Column:
    """Join neighbouring mentions of one label at most ``gap`` characters apart.

    ``mentions`` is ``array<struct<term,start,end,label>>`` in reading order.  A
    merged mention runs from the first start to the last end and its term is cut
    from the text again, so a line break between the parts stays inside.
    """

    def merge(c: Column, ms: Column) -> Column:
        def opens(m: Column, i: Column) -> Column:
            prev = F.get(ms, i - 1)
            joined = (prev["label"] == m["label"]) & (m["start"] - prev["end"] <= gap)
            return ~F.coalesce(joined, F.lit(False))

        def build(starts: Column) -> Column:
            def item(s: Column, k: Column) -> Column:
                last = F.coalesce(F.get(starts, k + 1), F.size(ms)) - 1
                head, tail = F.get(ms, s), F.get(ms, last)
                term = F.when(
                    last > s, tx.slice_text(c, head["start"], tail["end"])
                ).otherwise(head["term"])
                return F.struct(
                    term.alias("term"),
                    head["start"].alias("start"),
                    tail["end"].alias("end"),
                    head["label"].alias("label"),
                )

            return F.transform(starts, item)

        return let(_positions(F.transform(ms, opens)), build)

    # both outside the lambda, so either may come from an Arrow function
    return let(F.struct(c.alias("text"), mentions.alias("mentions")), lambda x: merge(x["text"], x["mentions"]))


def clean_terms(mentions: Column, min_length: int = lx.MIN_TERM_LENGTH) -> Column:
    """Strip punctuation from terms and drop short ones; offsets stay as they are."""
    stripped = F.transform(
        mentions, lambda m: m.withField("term", tx.strip_punctuation(m["term"]))
    )
    return F.filter(stripped, lambda m: F.length(m["term"]) >= min_length)


def longest_matches(candidates: Column) -> Column:
    """Leftmost-longest choice among ``struct<line_no,start,end,...>`` candidates.

    The input is in order of line, start and falling end.  The choice is made for Arrow
    batches from lines and offsets alone.
    """

    @F.arrow_udf("array<int>")
    def choose(lines: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        offsets, line = _lists(lines)
        line, start, end = (x.to_pylist() for x in (line, starts.flatten(), ends.flatten()))
        out, sizes = [], [0]
        for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            at, reached = -1, 0
            for i in range(first, last):
                other = line[i] is not None and at is not None and line[i] != at
                if other or (start[i] is not None and reached is not None and start[i] >= reached):
                    at, reached = line[i], end[i]
                    out.append(i - first)
            sizes.append(len(out))
        return _listed(np.array(sizes), lines, pa.array(out, pa.int32()))

    chosen = choose(candidates["line_no"], candidates["start"], candidates["end"])
    return let(
        F.struct(candidates.alias("all"), chosen.alias("at")),
        lambda x: F.transform(x["at"], lambda i: F.get(x["all"], i)),
    )
