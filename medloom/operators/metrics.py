"""Set, span and task metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.functions import text as tx
from medloom.functions.similarity import word_error_rate
from medloom.operators.sequence import bio_to_spans

OVERALL = "ALL (micro)"
MACRO = "ALL (macro)"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def precision_recall_f1(df: DataFrame) -> DataFrame:
    """Add the three ratios to ``tp, fp, fn``; an empty denominator gives 0."""
    return (
        df.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn(
            "f1",
            _ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
    )


def set_counts(gold: DataFrame, pred: DataFrame, keys: Sequence[str], cls: str) -> DataFrame:
    """True and false positives and misses per class, items compared as sets."""
    sides = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        pred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p"))
    )
    items = sides.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return items.groupBy(cls).agg(
        F.sum(F.col("g") * F.col("p")).alias("tp"),
        F.sum((1 - F.col("g")) * F.col("p")).alias("fp"),
        F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"),
    )


def _scores(counts: DataFrame, cls: str, overall: str) -> DataFrame:
    grouped = counts.rollup(cls).agg(
        F.grouping(cls).alias("pooled"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
    )
    named = F.when(F.col("pooled") == 1, F.lit(overall)).otherwise(F.col(cls).cast("string"))
    return precision_recall_f1(grouped.withColumn(cls, named).drop("pooled"))


def macro_row(scores: DataFrame, cls: str, overall: str = OVERALL, name: str = MACRO) -> DataFrame:
    """Plain means of the classes' scores; such a row has no counts."""
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    none = [F.lit(None).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]
    mean = scores.where(F.col(cls) != overall).agg(*means)
    return mean.select(F.lit(name).alias(cls), *none, "precision", "recall", "f1").where(
        F.col("f1").isNotNull()
    )


def set_prf(
    gold: DataFrame,
    pred: DataFrame,
    keys: Sequence[str],
    cls: str,
    overall: str = OVERALL,
    *,
    macro: bool = False,
) -> DataFrame:
    """Per-class scores and one row over pooled counts, a micro average.

    With ``macro`` also a row of the classes' mean scores.
    """
    scores = _scores(set_counts(gold, pred, keys, cls), cls, overall)
    return scores.unionByName(macro_row(scores, cls, overall)) if macro else scores


def span_prf(df: DataFrame, gold: str, pred: str, overall: str = OVERALL) -> DataFrame:
    """Entity-level scores of tagged sentences.

    ``gold`` and ``pred`` are ``array<struct<word,tag>>`` of equal length;
    positions whose gold tag is null are ignored.  Both span sets of a sentence
    lie in its row, so they are compared there and only counts are shuffled.
    """
    kept = F.filter(
        F.zip_with(F.col(gold), F.col(pred), lambda g, p: F.struct(g.alias("g"), p.alias("p"))),
        lambda x: x["g"]["tag"].isNotNull(),
    )

    def spans(side: str) -> Column:
        return bio_to_spans(F.transform("_kept", lambda x: x[side])).alias(side)

    def as_text(found: str) -> Column:
        # as text, which is compared by hashing; the type comes last
        return F.transform(
            found, lambda s: F.concat_ws("|", s["start_token"], s["end_token"], s["type"])
        ).alias(found)

    def compare(sets: Column) -> Column:
        g, p = sets["g"], sets["p"]
        return F.concat(
            *[
                F.transform(items, lambda s: F.struct(s.alias("s"), F.lit(kind).alias("kind")))
                for items, kind in (
                    (F.array_intersect(g, p), "tp"),
                    (F.array_except(p, g), "fp"),
                    (F.array_except(g, p), "fn"),
                )
            ]
        )

    found = tx.staged(df, kept.alias("_kept")).select(spans("g"), spans("p"))
    items = found.select(F.explode(tx.let(F.struct(as_text("g"), as_text("p")), compare)).alias("x")).select(
        F.regexp_replace("x.s", r"^\d+\|\d+\|", "").alias("type"), "x.kind"
    )
    counts = items.groupBy("type").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")]
    )
    return _scores(counts, "type", overall)


def weighted_total(text: Column, assertion: Column, candidate: Column) -> Column:
    a, b, c = lx.SCORE_WEIGHTS
    return a * text + b * assertion + c * candidate


def task_score(
    gold: DataFrame,
    pred: DataFrame,
    keys: Sequence[str] = ("doc_id", "type", "start"),
) -> DataFrame:
    """The combined score of extracted entities.

    Entities are paired on ``keys``; with the type among them a wrong type is a
    miss plus a spurious entity, and both score 0 on all three parts.  Text is
    1 - WER, assertions and candidates are set Jaccard, candidates weighted by
    the number of gold ids plus one.
    """
    cols = ("text", "assertions", "candidates")
    none = F.expr("cast(array() as array<string>)")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *keys,
            F.col("text").alias(f"{tag}_text"),
            F.col("assertions").alias(f"{tag}_assertions"),
            F.coalesce("candidates", none).alias(f"{tag}_candidates"),
            F.lit(True).alias(f"{tag}_here"),
        )

    pairs = side(gold, "g").join(side(pred, "p"), list(keys), "full_outer")
    hit = F.col("g_here").isNotNull() & F.col("p_here").isNotNull()

    def jaccard(name: str) -> Column:
        return F.when(
            hit,
            tx.set_jaccard(F.array_distinct(f"g_{name}"), F.array_distinct(f"p_{name}")),
        ).otherwise(F.lit(0.0))

    parts = pairs.select(
        F.when(hit, 1 - word_error_rate(F.col("g_text"), F.col("p_text")))
        .otherwise(F.lit(0.0))
        .alias(cols[0]),
        jaccard("assertions").alias(cols[1]),
        jaccard("candidates").alias(cols[2]),
        (F.coalesce(F.size("g_candidates"), F.lit(0)) + 1).alias("weight"),
    )
    scores = parts.agg(
        F.count("*").alias("n"),
        F.avg("text").alias("text_score"),
        F.avg("assertions").alias("assertions_score"),
        (F.sum(F.col("candidates") * F.col("weight")) / F.sum("weight")).alias("candidates_score"),
    )
    total = weighted_total(
        F.col("text_score"), F.col("assertions_score"), F.col("candidates_score")
    )
    return scores.withColumn("final_score", total)


def validate_output(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts of entities that break the output contract.

    ``entities``: ``doc_id, text, type, assertions, start, end, candidates``.
    """
    cut = tx.slice_text(F.col("note"), F.col("start"), F.col("end"))
    checks = {
        "unknown_note": F.col("note").isNull(),
        "text_mismatch": F.col("note").isNotNull() & (F.coalesce(cut, F.lit("")) != F.col("text")),
        "bad_position": F.col("start").isNull()
        | F.col("end").isNull()
        | (F.col("start") < 0)
        | (F.col("end") <= F.col("start")),
        "unknown_type": ~F.col("type").isin(list(lx.FINAL_TYPES)),
        "unknown_assertion": F.size(
            F.array_except(
                F.coalesce("assertions", F.array(F.lit("?"))),
                F.array(*[F.lit(a) for a in lx.ASSERTIONS]),
            )
        )
        > 0,
        "repeated_candidate": F.size(F.array_distinct(F.coalesce("candidates", F.array())))
        < F.size(F.coalesce("candidates", F.array())),
    }
    bare = notes.select("doc_id", F.col("text").alias("note"))
    return entities.join(bare, "doc_id", "left").agg(
        F.count("*").alias("entities"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()],
    )
