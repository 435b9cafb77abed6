"""Entity extraction from notes in four modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.functions import text as tx
from medloom.functions.vector import sigmoid
from medloom.operators import sequence as sq
from medloom.operators.linking import link_by_class
from medloom.operators.lookup import (
    locate_synonym, lookup_names, no_codes, with_codes,
)
from medloom.plans.models import Annotator, Encoder, Matcher, Scorer
from medloom.session import durable

MODES = ("quickumls", "ner only", "ner + retrieval", "doc_class")


def note_mentions(notes: DataFrame, annotator: Annotator) -> DataFrame:
    """Add ``mentions``: located, merged and cleaned tagger output per note."""
    located = annotator.annotate(notes).withColumn(
        "located", sq.locate_in_lines(F.col("text"), F.col("raw"))
    )
    return located.withColumn(
        "mentions", sq.clean_terms(sq.merge_adjacent(F.col("text"), F.col("located")))
    ).drop("raw", "located")


def explode_mentions(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode("mentions").alias("idx", "m")).select(
        *keep, "idx", "m.term", "m.start", "m.end", "m.label"
    )


def matched_mentions(notes: DataFrame, matcher: Matcher, codes: DataFrame | None) -> DataFrame:
    """Best dictionary match per surface form and note, with offsets.

    ``idx`` numbers the mentions of a note by falling similarity.
    """
    sentences = notes.select(
        "doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_no", "sentence")
    )
    found = matcher.match(sentences).where(tx.is_filled(F.col("ngram")))
    order = F.struct("sent_no", "match_no")
    record = F.struct("term", "cui", "similarity", "type")
    best = found.groupBy("doc_id", "ngram").agg(
        F.min(order).alias("first"),
        F.min_by(record, F.struct((-F.col("similarity")).alias("s"), order.alias("o"))).alias("r"),
    )
    item = F.struct(
        F.col("ngram").alias("term"),
        F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end"),
        F.col("r.term").alias("canonical_name"),
        F.col("r.cui").alias("cui"),
        F.col("r.similarity").alias("similarity"),
        F.coalesce("r.type", F.lit("Unknown")).alias("label"),
    )
    listed = F.sort_array(F.collect_list(F.struct("first", item.alias("item"))))
    per_note = best.groupBy("doc_id").agg(F.transform(listed, lambda x: x["item"]).alias("found"))
    located = sq.locate_in_text(F.col("text"), F.col("found"))
    # most similar first; equal ones keep the order of the text
    ranked = F.sort_array(
        F.transform(
            located,
            lambda m, i: F.struct((-m["similarity"]).alias("s"), i.alias("i"), m.alias("m")),
        )
    )
    placed = (
        notes.join(per_note, "doc_id")
        .select("doc_id", F.posexplode(F.transform(ranked, lambda x: x["m"])).alias("idx", "m"))
        .select("doc_id", "idx", "m.*")
        .withColumn("category", tx.remap(F.col("label"), lx.SEMANTIC_CATEGORY))
    )
    return _codes(placed, codes)


def _codes(df: DataFrame, codes: DataFrame | None, *, guard: bool = False) -> DataFrame:
    if codes is None:
        return df.withColumn("codes", no_codes())
    return with_codes(df, codes, guard=guard)


def linked_mentions(
    mentions: DataFrame,
    concepts: DataFrame,
    encoder: Encoder,
    codes: DataFrame | None,
    floor: float = lx.LINK_FLOOR,
) -> DataFrame:
    """Link mentions to concepts of their class.

    A link depends only on label and term, so each distinct pair is encoded and
    retrieved once and joined back.
    """
    wanted = (
        mentions.select("label", "term")
        .distinct()
        .withColumn("query_id", F.to_json(F.struct("label", "term")))
        .withColumn("macro_type", F.col("label"))
        .withColumn("vector", encoder.vector(F.col("term")))
    )
    linked = link_by_class(durable(wanted), concepts, floor=floor)
    joined = mentions.join(
        linked.select("label", "term", "canonical_name", "cui", "similarity"),
        ["label", "term"],
    )
    return _codes(joined, codes, guard=True)


def class_mentions(
    notes: DataFrame,
    scores: DataFrame,
    classes: DataFrame,
    kg: DataFrame,
    concepts: DataFrame,
    codes: DataFrame | None,
    threshold: float = lx.LABEL_PROBABILITY,
) -> DataFrame:
    """Document classes above a probability, with a name and a place in the text."""
    hits = (
        scores.withColumn("similarity", sigmoid(F.col("logit")))
        .where(F.col("similarity") >= threshold)
        .join(classes, "class_idx")
        .select("doc_id", "class_idx", "cui", "similarity")
    )
    langs = notes.select("doc_id", "lang")
    named = lookup_names(
        hits.join(langs, "doc_id"), "cui", kg, "row_idx", concepts, "row_idx",
        english=F.col("lang") == "en",
    ).drop("lang")
    # one text per note: classes are gathered before they meet it
    gathered = named.groupBy("doc_id").agg(
        F.sort_array(
            F.collect_list(F.struct("class_idx", "cui", "similarity", "canonical_name", "names"))
        ).alias("found")
    )
    placed = notes.join(gathered, "doc_id").select(
        "doc_id",
        F.explode(
            F.transform(
                "found",
                lambda f: F.struct(
                    f.alias("f"), locate_synonym(F.col("text"), f["names"]).alias("at")
                ),
            )
        ).alias("x"),
    )
    rows = placed.select(
        "doc_id",
        F.col("x.f.class_idx").alias("idx"),
        F.coalesce("x.at.term", "x.f.canonical_name").alias("term"),
        F.col("x.f.canonical_name").alias("canonical_name"),
        F.col("x.at.start").alias("start"),
        F.col("x.at.end").alias("end"),
        F.lit("Diagnosis").alias("label"),
        F.col("x.f.cui").alias("cui"),
        F.col("x.f.similarity").alias("similarity"),
    )
    return _codes(rows, codes)


class Extractor:
    """Unified extraction: pick a mode, hand in models and tables, call ``extract``.

    ``annotator``, ``encoder`` and ``scorer`` may be one object or one per
    language (``{"vi": ..., "en": ...}``).
    """

    def __init__(
        self,
        mode: str,
        *,
        annotator: Annotator | dict[str, Annotator] | None = None,
        encoder: Encoder | dict[str, Encoder] | None = None,
        matcher: Matcher | None = None,
        scorer: Scorer | dict[str, Scorer] | None = None,
        concepts: DataFrame | None = None,
        codes: DataFrame | None = None,
        kg: DataFrame | None = None,
        classes: DataFrame | dict[str, DataFrame] | None = None,
        letters: str = lx.VIETNAMESE_LETTERS,
    ):
        self.mode = mode.lower()
        if self.mode not in MODES:
            raise ValueError(f"Unknown mode: {self.mode}")
        self.annotator, self.encoder, self.matcher, self.scorer = (
            annotator, encoder, matcher, scorer,
        )
        self.concepts, self.codes, self.kg, self.classes = concepts, codes, kg, classes
        self.letters = letters

    def with_language(self, notes: DataFrame, lang: str = "") -> DataFrame:
        found: Column = (
            F.lit(lang) if lang else tx.detect_language(F.col("text"), self.letters)
        )
        return notes.withColumn("lang", found)

    def _per_language(self, notes: DataFrame, part, run, lang: str = "") -> DataFrame:
        """Run with one model, or split by language when there are several.

        English notes go to ``en``, all others (and those without a language) to
        ``vi``.  With a given ``lang`` only its model is needed.
        """
        if not isinstance(part, dict):
            return run(notes, part, None)
        wanted = (lx.model_language(lang),) if lang else ("en", "vi")
        if missing := [key for key in wanted if key not in part]:
            raise ValueError(f"no model for {', '.join(missing)}")
        english = F.col("lang").eqNullSafe("en")
        out = None
        for key in wanted:
            one = run(notes.where(english if key == "en" else ~english), part[key], key)
            out = one if out is None else out.unionByName(one)
        return out

    def _of(self, part, lang):
        return part[lang] if isinstance(part, dict) else part

    def extract(
        self,
        notes: DataFrame,
        lang: str = "",
        *,
        threshold: float = lx.LABEL_PROBABILITY,
        dl_model: str = "auto",
    ) -> DataFrame:
        """Entities of ``[doc_id, text]`` notes, one row each.

        An empty ``lang`` is detected per note.  ``dl_model`` ``short`` or
        ``long`` forces the Vietnamese or English document classifier.
        """
        if self.mode == "doc_class":
            lang = {"short": "vi", "long": "en"}.get(dl_model, lang)
        notes = self.with_language(notes, lang)
        if self.mode == "quickumls":
            return matched_mentions(notes, self.matcher, self.codes)
        if self.mode == "doc_class":
            return self._per_language(
                notes,
                self.scorer,
                lambda part, scorer, key: class_mentions(
                    part, scorer.score(part), self._of(self.classes, key), self.kg,
                    self.concepts, self.codes, threshold,
                ),
                lang,
            )

        def mentions(part: DataFrame, annotator: Annotator, _) -> DataFrame:
            return explode_mentions(note_mentions(part, annotator), "doc_id", "lang")

        found = self._per_language(notes, self.annotator, mentions, lang)
        if self.mode == "ner only":
            return found.drop("lang")
        found = durable(found)

        def link(part: DataFrame, encoder: Encoder, _) -> DataFrame:
            return linked_mentions(part, self.concepts, encoder, self.codes)

        return self._per_language(found, self.encoder, link, lang).drop("lang")
