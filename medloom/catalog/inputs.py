"""Inputs the queries derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.catalog.registry import Tables
from medloom.functions import context as cx
from medloom.functions import text as tx
from medloom.functions.text import portions
from medloom.lexicon import Rules
from medloom.operators import sequence as sq

# Stand-ins for the Vietnamese phrase lists, in the languages of the tables.
RULES = Rules(
    history_header=r"(?:and|et|und|y) (?:the|of|le|la|der|die|el)",
    present_header=r"(?:that|que|von|de) (?:the|is|la|der|los)",
    hospital_header=r"(?:with|pour|mit|por) [a-z]+",
    negated_line_starts=("the ", "de ", "la ", "- "),
    negators=("of ", "not ", "pas ", "der ", "no "),
    blanked_phrases=("of the", "pas de", "der die"),
    contrast_markers=(" is ", " les ", ", and", " que ", " und "),
    short_terms=("ho", "th", "é"),
    generic_terms=("that", "this", "pour", "sich", "para"),
    generic_prefix="is ",
    dose_only=r"\d+(?:[.,]\d+)?\s*(?:mg|[a-z]?%)?",
    symptoms=("tion", "heit", "ment"),
    dose_after=r"^\s*(?:[a-z]+ )?(?:of|the|la|der|de)\b",
    drug_before=r"(?:and|le|die|el)\s*$",
    test_phrases=("then", "elle", "lich"),
    test_names=("thouon", "there"),
    dose_tail=r"^[\s\-,]*((?:and|the|of|la|de|der|que)[a-zA-Z0-9\s/]*)",
)


#: a shorter word is no dictionary term
TERM_LETTERS = 5


def dictionary_terms(t: Tables) -> DataFrame:
    """Words of the benchmark passages with at least five letters."""
    words = t.benchmark.select("item_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    return (
        words.where(F.length("word") >= TERM_LETTERS).groupBy("word").agg(F.min("item_id").alias("item_id"))
    )


def with_mentions(t: Tables) -> DataFrame:
    """Documents with ``found``: dictionary words and their offsets, in order.

    The words of a document are matched without its text, which meets the hits
    once afterwards.
    """
    pieces = t.documents.select("doc_id", F.explode(sq.pieces(F.col("text"), "[ \n]")).alias("p"))
    surface = F.regexp_extract("p.piece", r"^\p{L}+", 0)
    hits = (
        pieces.select("doc_id", F.col("p.start").alias("start"), surface.alias("surface"))
        .withColumn("word", F.lower("surface"))
        .where(F.length("word") >= TERM_LETTERS)
        .join(dictionary_terms(t), "word")
        .groupBy("doc_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "start",
                        (F.col("start") + F.length("surface")).alias("end"),
                        "surface",
                        "item_id",
                    )
                )
            ).alias("found")
        )
    )
    return t.documents.select("doc_id", "text").join(hits, "doc_id")


def mentions(t: Tables, *keep: Column, blocks: bool = False, **read: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per dictionary word: ``doc_id, start, end, surface, item_id``.

    ``keep`` are further columns computed once per document, ``read`` columns made
    from the text and a mention; rows of mentions do not carry the text.  With ``blocks``
    these can use the text in ``_blocks``.
    """
    documents = with_mentions(t).select("doc_id", "text", "found", *keep)
    if blocks:
        documents = tx.staged(documents, cx.blocks(F.col("text")).alias("_blocks"))
    rest = [c for c in documents.columns if c not in ("text", "found", "_blocks")]
    fields = ("start", "end", "surface", "item_id")

    def one(m: Column) -> Column:
        return F.struct(
            *[m[f].alias(f) for f in fields],
            *[value(F.col("text"), m).alias(name) for name, value in read.items()],
        )

    return documents.select(*rest, F.explode(F.transform("found", one)).alias("m")).select(
        *rest, *[f"m.{f}" for f in (*fields, *read)]
    )


def document_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(sq.lines(F.col("text"))).alias("l")).select(
        "doc_id", F.col("l.no").alias("line_no"), F.col("l.start").alias("line_start"),
        F.col("l.piece").alias("line"),
    )


TAG_BY_LETTER = {
    "a": "I-ten_benh", "e": "I-ten_benh", "t": "B-drug", "o": "I-drug", "i": "I-drug",
    "d": "B-medical_procedure", "l": "B-medical_procedure", "s": "I-unknown", "h": "X",
}


def raw_tag(word: Column) -> Column:
    """A corpus tag decided by the first letter of a word."""
    return tx.remap(F.lower(F.left(word, F.lit(1))), TAG_BY_LETTER, "O")


SQL_RAW_TAG = """CASE
    WHEN lower(left(word, 1)) IN ('a', 'e') THEN 'I-ten_benh'
    WHEN lower(left(word, 1)) = 't' THEN 'B-drug'
    WHEN lower(left(word, 1)) IN ('o', 'i') THEN 'I-drug'
    WHEN lower(left(word, 1)) IN ('d', 'l') THEN 'B-medical_procedure'
    WHEN lower(left(word, 1)) = 's' THEN 'I-unknown'
    WHEN lower(left(word, 1)) = 'h' THEN 'X'
    ELSE 'O' END"""


def _tagged(line: Column) -> Column:
    """Words of a line with their raw tags, for Arrow batches of lines."""
    letters = [c for low in TAG_BY_LETTER for c in (low, low.upper())]
    tags = pa.array([*[tag for tag in TAG_BY_LETTER.values() for _ in range(2)], "O"], pa.string())

    def portion(lines: pa.Array) -> pa.Array:
        # Python splits at the same characters as ``tx.words``
        words = pa.array([(line or "").split() for line in lines.to_pylist()], pa.list_(pa.string()))
        flat = words.flatten()
        at = pc.index_in(pc.utf8_slice_codeunits(flat, 0, 1), pa.array(letters, pa.string())).fill_null(len(letters))
        return pa.ListArray.from_arrays(words.offsets, pa.StructArray.from_arrays([flat, tags.take(at)], ["word", "tag"]))

    @F.arrow_udf(sq.TOKENS)
    def tokens(lines: pa.Array) -> pa.Array:
        return pa.concat_arrays([portion(x) for (x,) in portions(lines)])

    return tokens(line)


def tagged_lines(t: Tables) -> DataFrame:
    """Lines as tagged sentences: ``doc_id, line_no, tokens``."""
    # a line with a word
    numbered = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = numbered.where(F.col("line").rlike(f"(?U)[^{tx.SPACE[1:-1]}]"))
    return lines.select("doc_id", "line_no", _tagged(F.col("line")).alias("tokens"))
