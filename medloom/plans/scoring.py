"""Extraction and linking scored against a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom import schemas
from medloom.functions import text as tx
from medloom.operators.linking import link_nearest
from medloom.operators.metrics import set_prf
from medloom.plans.models import Encoder
from medloom.session import durable


def generated_entities(df: DataFrame, answer: Column, ident: str = "doc_id") -> DataFrame:
    """``[ident, entity, cls]`` out of a generative tagger's answers.

    An answer that does not parse has no entities; unknown types are dropped.
    """
    listed = F.from_json(tx.fenced_json(answer), schemas.ENTITY_JSON)
    rows = df.select(ident, F.explode(listed).alias("e")).select(
        ident,
        F.coalesce("e.entity", F.lit("")).alias("entity"),
        tx.remap(F.upper(tx.strip(F.col("e.type"))), lx.GENERATED_TYPE_CLASS, None).alias("cls"),
    )
    return rows.where(F.col("cls").isNotNull())


def tagged_entities(mentions: DataFrame, ident: str = "doc_id") -> DataFrame:
    """The same from tagger mentions, whose label already is the class."""
    return mentions.select(ident, F.col("term").alias("entity"), F.col("label").alias("cls"))


def scoring_concepts(concepts: DataFrame) -> DataFrame:
    """Concepts with the class used for scoring; rows without an id are left out."""
    return concepts.where(F.col("mapped_cui").isNotNull()).withColumn(
        "macro_type", tx.remap(F.col("mapped_type"), lx.SCORING_CLASS, None)
    )


def link_entities(
    entities: DataFrame,
    concepts: DataFrame,
    encoder: Encoder,
    floor: float = lx.SCORING_LINK_FLOOR,
    ident: str = "doc_id",
) -> DataFrame:
    """Distinct ``[ident, cls, cui]`` of predicted entities."""
    wanted = (
        entities.select("cls", "entity")
        .distinct()
        .select(
            F.to_json(F.struct("cls", "entity")).alias("query_id"),
            F.col("cls").alias("macro_type"),
            "cls",
            "entity",
            encoder.vector(F.col("entity")).alias("vector"),
        )
    )
    wanted = durable(wanted)
    links = link_nearest(wanted, concepts, floor=floor).join(
        wanted.select("query_id", "cls", "entity"), "query_id"
    )
    return entities.join(links, ["cls", "entity"]).select(ident, "cls", "cui").distinct()


def predictions(
    notes: DataFrame,
    entities: DataFrame,
    concepts: DataFrame,
    encoder: Encoder,
    floor: float = lx.SCORING_LINK_FLOOR,
    ident: str = "doc_id",
) -> DataFrame:
    """Per note the distinct ``predicted_entities`` and ``linked_entities``, sorted.

    Arrays of ``struct<entity,cls>`` and ``struct<cui,cls>``; empty where nothing
    was found.  Other columns of ``notes`` are kept.
    """
    linked = link_entities(entities, scoring_concepts(concepts), encoder, floor, ident)

    def listed(df: DataFrame, field: str, name: str) -> DataFrame:
        return df.groupBy(ident).agg(F.sort_array(F.collect_set(F.struct(field, "cls"))).alias(name))

    none = "cast(array() as array<struct<{}:string,cls:string>>)"
    return (
        notes.join(listed(entities, "entity", "predicted_entities"), ident, "left")
        .join(listed(linked, "cui", "linked_entities"), ident, "left")
        .withColumn("predicted_entities", F.coalesce("predicted_entities", F.expr(none.format("entity"))))
        .withColumn("linked_entities", F.coalesce("linked_entities", F.expr(none.format("cui"))))
    )


def gold_items(gold: DataFrame, ident: str = "doc_id") -> DataFrame:
    """``[ident, cls, cui]`` from ``gold_entities`` maps."""
    return (
        gold.select(ident, F.explode("gold_entities").alias("cls", "cuis"))
        .where(F.col("cls").isin(list(lx.MACRO_CLASSES)))
        .select(ident, "cls", F.explode("cuis").alias("cui"))
    )


def evaluate(
    gold: DataFrame,
    entities: DataFrame,
    concepts: DataFrame,
    encoder: Encoder,
    floor: float = lx.SCORING_LINK_FLOOR,
    ident: str = "doc_id",
) -> DataFrame:
    """Precision, recall and F1 per class and over pooled counts."""
    pred = link_entities(entities, scoring_concepts(concepts), encoder, floor, ident)
    return set_prf(gold_items(gold, ident), pred, [ident, "cls", "cui"], "cls")
