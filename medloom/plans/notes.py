"""Full note processing: typed, asserted and coded entities."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.functions import context as cx
from medloom.functions import text as tx
from medloom.functions.similarity import best_overlap
from medloom.lexicon import VIETNAMESE, Rules
from medloom.operators.linking import as_candidates, dual_link, knn, rerank
from medloom.plans.extraction import note_mentions
from medloom.plans.models import Annotator, Encoder
from medloom.session import durable

NO_CANDIDATES = "cast(array() as array<string>)"
#: wording similarity of a mention to the best of a dictionary row's name columns
Lexical = Callable[..., Column]


@dataclass(frozen=True)
class Dictionaries:
    """Concept dictionaries, each with ``row_idx`` and ``vector``; any may be missing.

    ``diagnosis`` needs ``id``, ``drug`` needs ``rxcui``; every other column
    counts as a name when hits are re-ranked.
    """

    diagnosis: DataFrame | None = None
    drug: DataFrame | None = None
    symptom: DataFrame | None = None


def typed_mentions(notes: DataFrame, rules: Rules = VIETNAMESE) -> DataFrame:
    """Repair, filter, re-type, expand and assert mentions.

    ``notes``: ``doc_id, text, bounds, mentions``; ``bounds`` are the section
    bounds, computed once per note, ``mentions`` an array of structs with ``start,
    end, label``.  Each mention leaves its note with its surroundings only.  The
    result has ``doc_id, idx, term, display, kind, is_disease, assertions, start,
    end, result``; ``idx`` is the place in the array, ``start``/``end`` the printed
    span; assertions come from the span before a dose is taken in.
    """
    text, start, end = (F.col(c) for c in ("text", "start", "end"))
    known = [*lx.TAGGER_TYPE, *lx.DISEASE_LABELS]
    numbered = F.transform(
        "mentions",
        lambda m, i: F.struct(i.alias("idx"), m["label"].alias("label"), m["start"].alias("start"), m["end"].alias("end")),
    )
    kept = tx.staged(
        notes, F.filter(numbered, lambda x: x["start"].isNotNull() & x["label"].isin(known)).alias("_kept")
    )
    around = cx.mention_windows(text, F.col("_kept.start"), F.col("_kept.end"), rules)
    both = F.zip_with("_kept", around, lambda x, at: F.struct(x["idx"].alias("idx"), x["label"].alias("label"), at.alias("at")))
    cut = kept.select("doc_id", "bounds", F.explode(both).alias("x")).select(
        "doc_id", "bounds", "x.idx", "x.label", "x.at.*"
    )
    named = tx.staged(
        cut,
        tx.normalise_term(F.col("term"), rules.term_strip).alias("name"),
        tx.remap(F.col("label"), lx.TAGGER_TYPE, None).alias("tagged"),
        F.col("label").isin(list(lx.DISEASE_LABELS)).alias("disease"),
    ).where(cx.passes_precision(F.col("name"), F.col("tagged"), rules))
    prefix, term, suffix = F.col("prefix"), F.col("term"), F.col("suffix")
    fixed = tx.staged(
        named,
        cx.correct_type(
            F.col("name"), F.col("tagged"), F.col("disease"),
            cx.drug_context(prefix, suffix, rules), rules,
        ).alias("fix"),
    )
    kind = F.col("fix.type")
    dose = F.when(kind == lx.DRUG, cx.dose_length(suffix, rules.dose_tail)).otherwise(F.lit(0))
    in_hospital = (kind == lx.TEST_NAME) & (start >= F.col("bounds.s3"))
    shown = tx.staged(fixed, dose.alias("dose"))
    return shown.select(
        "doc_id",
        "idx",
        "term",
        F.concat(term, F.left(suffix, F.col("dose"))).alias("display"),
        kind.alias("kind"),
        F.col("fix.is_disease").alias("is_disease"),
        cx.assertion_flags(
            cx.is_historical(start, F.col("bounds")), cx.is_negated(prefix, term, suffix, rules)
        ).alias("assertions"),
        start,
        (end + F.col("dose")).alias("end"),
        F.when(in_hospital, cx.result_in(suffix, end)).alias("result"),
    )


def _reranked(queries: DataFrame, dictionary: DataFrame, ident: str, lexical: Lexical) -> DataFrame:
    """Best of the three nearest rows by vector and wording: ``query_id, sim, id``."""
    names = [c for c in dictionary.columns if c not in ("row_idx", "vector")]
    hits = knn(queries, dictionary, lx.RETRIEVED, floor=lx.CANDIDATE_FLOOR)
    cells = dictionary.select(
        "row_idx", F.col(ident).cast("string").alias("_id"), *[F.col(c).alias(f"_n_{c}") for c in names]
    )
    wording = lexical(F.col("query_id"), *[F.col(f"_n_{c}") for c in names])
    scored = hits.join(cells, "row_idx").select(
        "query_id", "sim", "rk", F.col("_id").alias("id"), wording.alias("lexical")
    )
    return rerank(scored, F.col("lexical"), keep=("id",)).select("query_id", "sim", "id")


def _queries(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """Each distinct string is encoded once."""
    distinct = texts.distinct()
    return durable(distinct.withColumn("vector", encoder.vector(F.lower("query_id"))))


def link_diseases(
    terms: DataFrame, dictionaries: Dictionaries, encoder: Encoder, lexical: Lexical = best_overlap
) -> DataFrame:
    """``[query_id, type, candidates]`` of distinct disease terms."""
    queries = _queries(terms, encoder)
    empty = queries.select("query_id", F.lit(0.0).alias("sim"), F.lit("").alias("id")).limit(0)
    diagnosis = (
        empty
        if dictionaries.diagnosis is None
        else _reranked(queries, dictionaries.diagnosis, "id", lexical)
    )
    # below the diagnosis floor a symptom cannot change the decision
    symptom = (
        empty
        if dictionaries.symptom is None
        else knn(queries, dictionaries.symptom, 1, floor=lx.DIAGNOSIS_FLOOR)
    )
    return dual_link(queries.select("query_id"), diagnosis, symptom)


def link_drugs(
    texts: DataFrame,
    dictionary: DataFrame,
    encoder: Encoder,
    *,
    split_ids: bool = False,
    lexical: Lexical = best_overlap,
) -> DataFrame:
    """``[query_id, candidates]`` of distinct drug texts that reach the drug floor."""
    best = _reranked(_queries(texts, encoder), dictionary, "rxcui", lexical)
    return best.where(F.col("sim") >= lx.DRUG_FLOOR).select(
        "query_id", as_candidates(F.col("id"), split_ids=split_ids).alias("candidates")
    )


def coded_entities(
    mentions: DataFrame,
    dictionaries: Dictionaries,
    encoder_vi: Encoder,
    encoder_en: Encoder,
    *,
    split_ids: bool = False,
    lexical: Lexical = best_overlap,
) -> DataFrame:
    """Link typed mentions and add test results as rows after their test."""
    diseases = link_diseases(
        mentions.where("is_disease").select(F.col("term").alias("query_id")),
        dictionaries, encoder_vi, lexical,
    ).select("query_id", F.col("type").alias("_type"), F.col("candidates").alias("_dc"))
    linked = mentions.join(
        diseases, F.col("is_disease") & (F.col("term") == F.col("query_id")), "left"
    ).drop("query_id")
    is_drug = F.col("kind") == lx.DRUG
    if dictionaries.drug is None:
        linked = linked.withColumn("_rc", F.lit(None).cast("array<string>"))
    else:
        drugs = link_drugs(
            mentions.where(is_drug).select(F.col("display").alias("query_id")),
            dictionaries.drug, encoder_en, split_ids=split_ids, lexical=lexical,
        ).withColumnRenamed("candidates", "_rc")
        linked = linked.join(
            drugs, is_drug & (F.col("display") == F.col("query_id")), "left"
        ).drop("query_id")
    kind = F.when(F.col("is_disease"), F.col("_type")).otherwise(F.col("kind"))
    candidates = F.when(
        kind.isin(lx.DIAGNOSIS, lx.DRUG),
        F.coalesce(F.when(is_drug, F.col("_rc")), F.col("_dc"), F.expr(NO_CANDIDATES)),
    )
    entity = F.struct(
        (F.col("idx") * 2).alias("entity_idx"),
        F.col("display").alias("text"),
        kind.alias("type"),
        "assertions",
        "start",
        "end",
        candidates.alias("candidates"),
    )
    result = F.when(
        F.col("result").isNotNull(),
        F.struct(
            (F.col("idx") * 2 + 1).alias("entity_idx"),
            F.col("result.text").alias("text"),
            F.lit(lx.TEST_RESULT).alias("type"),
            F.expr(NO_CANDIDATES).alias("assertions"),
            F.col("result.start").alias("start"),
            F.col("result.end").alias("end"),
            F.expr(NO_CANDIDATES).alias("candidates"),
        ),
    )
    return linked.select(
        "doc_id", F.explode(F.array_compact(F.array(entity, result))).alias("e")
    ).select("doc_id", "e.*")


def only_asserted(entities: DataFrame, types: Collection[str]) -> DataFrame:
    """Entities of other types lose their assertions."""
    kept = F.when(F.col("type").isin(*types), F.col("assertions")).otherwise(F.expr(NO_CANDIDATES))
    return entities.withColumn("assertions", kept)


def process_notes(
    notes: DataFrame,
    annotator: Annotator,
    dictionaries: Dictionaries,
    encoder_vi: Encoder,
    encoder_en: Encoder | None = None,
    rules: Rules = VIETNAMESE,
    *,
    split_ids: bool = False,
    lexical: Lexical = best_overlap,
    assertable_types: Collection[str] | None = None,
) -> DataFrame:
    """Entities of notes: ``doc_id, entity_idx, text, type, assertions, start, end, candidates``.

    The note text stays with its row until every context rule has run; what
    follows shuffles only mentions.  The typed mentions are written to the
    checkpoint folder because three branches read them.  ``lexical`` is the wording
    similarity that re-ranks retrieved rows, ``assertable_types`` those that may be
    negated or historical (all by default).
    """
    tagged = note_mentions(notes, annotator).withColumn(
        "bounds", cx.section_bounds(F.col("text"), rules)
    )
    typed = durable(typed_mentions(tagged, rules))
    entities = coded_entities(
        typed, dictionaries, encoder_vi, encoder_en or encoder_vi, split_ids=split_ids, lexical=lexical
    )
    return entities if assertable_types is None else only_asserted(entities, assertable_types)
