"""Metrics and output checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.catalog.inputs import dictionary_terms, mentions
from medloom.catalog.notes import DIMS, SQL_NGRAMS
from medloom.catalog.registry import SQL_MENTIONS, Tables, query
from medloom.operators import metrics as mt
from medloom.plans.models import NgramEncoder
from medloom.plans.scoring import evaluate, generated_entities, predictions

SQL_PRF = """ratios AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::double ELSE 0 END AS precision,
                      CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::double ELSE 0 END AS recall FROM counts)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ratios"""


@query(
    "set_prf",
    "lang:string, tp:bigint, fp:bigint, fn:bigint, precision:double, recall:double, f1:double",
    f"""WITH gold AS (SELECT DISTINCT d.lang, d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
        pred AS (SELECT DISTINCT lang, doc_id FROM documents WHERE length(text) > 1500),
        pairs AS (SELECT coalesce(g.lang, p.lang) AS lang, g.doc_id IS NOT NULL AS g, p.doc_id IS NOT NULL AS p
                  FROM gold g FULL JOIN pred p ON g.lang = p.lang AND g.doc_id = p.doc_id),
        counts AS (SELECT coalesce(lang, 'ALL (micro)') AS lang, count(*) FILTER (g AND p) AS tp,
                          count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn
                   FROM pairs GROUP BY ROLLUP (lang)),
        scores AS ({SQL_PRF.replace("ratios AS", "WITH ratios AS", 1)})
        SELECT * FROM scores UNION ALL
        SELECT 'ALL (macro)', NULL, NULL, NULL, avg(precision), avg(recall), avg(f1) FROM scores
        WHERE lang <> 'ALL (micro)'""",
)
def set_prf(t: Tables):
    gold = t.documents.join(t.labels.where(F.col("quality") == 1), "doc_id").select("lang", "doc_id")
    pred = t.documents.where(F.length("text") > 1500).select("lang", "doc_id")
    return mt.set_prf(gold, pred, ["lang", "doc_id"], "lang", macro=True)


def _mention_entities(t: Tables):
    """Mentions as output entities; some have a wrong note, span, type, flag or candidate list."""
    end = (
        F.when(F.col("item_id") == 3, F.col("end") - 1)
        .when(F.col("item_id") == 12, F.col("start"))
        .otherwise(F.col("end"))
    )
    return mentions(t).select(
        F.when(F.col("item_id") == 11, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.col("start"),
        end.alias("end"),
        F.col("surface").alias("text"),
        F.when(F.col("item_id") == 5, "OTHER").otherwise(lx.SYMPTOM).alias("type"),
        F.when(F.col("item_id") == 7, F.array(F.lit("isWrong")))
        .otherwise(F.array(F.lit(lx.NEGATED)))
        .alias("assertions"),
        F.when(F.col("item_id") == 9, F.array(F.lit("1"), F.lit("1"))).alias("candidates"),
    )


@query(
    "output_validation",
    "entities:bigint, unknown_note:bigint, text_mismatch:bigint, bad_position:bigint, unknown_type:bigint, "
    "unknown_assertion:bigint, repeated_candidate:bigint",
    f"""WITH {SQL_MENTIONS}
        SELECT count(*) AS entities, count(*) FILTER (item_id = 11) AS unknown_note,
               count(*) FILTER (item_id IN (3, 12)) AS text_mismatch,
               count(*) FILTER (item_id = 12) AS bad_position, count(*) FILTER (item_id = 5) AS unknown_type,
               count(*) FILTER (item_id = 7) AS unknown_assertion,
               count(*) FILTER (item_id = 9) AS repeated_candidate FROM mentions""",
)
def output_validation(t: Tables):
    return mt.validate_output(t.documents.select("doc_id", "text"), _mention_entities(t))


def _scored(t: Tables):
    """Gold and predicted entities; predictions lose, add and change some."""
    found = mentions(t)
    gold = found.select(
        "doc_id", F.lit("A").alias("type"), "start", F.concat(F.lower("surface"), F.lit(" of two sides")).alias("text"),
        F.when(F.col("item_id") < 10, F.array(F.lit("isNegated"), F.lit("isHistorical")))
        .otherwise(F.array(F.lit("isNegated")))
        .alias("assertions"),
        F.when(F.col("item_id") < 20, F.array(F.lit("c1"), F.lit("c2"))).alias("candidates"),
    )
    pred = found.where(F.col("item_id") != 4).select(
        "doc_id",
        F.when(F.col("item_id") == 8, "B").otherwise("A").alias("type"),
        "start",
        # of four words one is lost, one changed, or one is too many
        F.concat(
            F.lower("surface"),
            F.when(F.col("item_id") % 5 == 1, " two sides")
            .when(F.col("item_id") % 5 == 2, " of 2 sides")
            .when(F.col("item_id") % 5 == 3, " of the two wrong sides")
            .otherwise(" of two sides"),
        ).alias("text"),
        F.array(F.lit("isNegated")).alias("assertions"),
        F.when(F.col("item_id") < 30, F.array(F.lit("c1"))).alias("candidates"),
    )
    return gold, pred


@query(
    "task_score",
    "n:bigint, text_score:double, assertions_score:double, candidates_score:double, final_score:double",
    f"""WITH {SQL_MENTIONS},
        pairs AS (
          SELECT item_id, item_id NOT IN (4, 8) AS hit, true AS gold FROM mentions
          UNION ALL SELECT item_id, false, false FROM mentions WHERE item_id = 8),
        parts AS (
          SELECT CASE WHEN NOT hit THEN 0 WHEN item_id % 5 IN (1, 2) THEN 0.75 WHEN item_id % 5 = 3 THEN 0.5 ELSE 1 END AS t,
                 CASE WHEN NOT hit THEN 0 WHEN item_id < 10 THEN 0.5 ELSE 1 END AS a,
                 CASE WHEN NOT hit THEN 0 WHEN item_id < 20 THEN 0.5 WHEN item_id < 30 THEN 0 ELSE 1 END AS c,
                 CASE WHEN gold AND item_id < 20 THEN 3 ELSE 1 END AS w FROM pairs),
        scores AS (SELECT count(*) AS n, avg(t) AS text_score, avg(a) AS assertions_score,
                          sum(c * w) / sum(w) AS candidates_score FROM parts)
        SELECT *, 0.3 * text_score + 0.3 * assertions_score + 0.4 * candidates_score AS final_score FROM scores""",
)
def task_score(t: Tables):
    return mt.task_score(*_scored(t))


# --- linking scored end to end --------------------------------------------------


def _macro(word):
    head = F.left(word, F.lit(1))
    return (
        F.when(head.isin("a", "e", "s"), lx.DISEASE_SYMPTOM)
        .when(head.isin("t", "l", "h"), lx.PROCEDURE_TREATMENT)
        .otherwise(lx.MACRO_DRUG)
    )


_SQL_MACRO = """CASE WHEN left({0}, 1) IN ('a', 'e', 's') THEN 'Disease/Symptom'
  WHEN left({0}, 1) IN ('t', 'l', 'h') THEN 'Procedure/Treatment' ELSE 'Drug' END"""

_TYPE_OF = {
    lx.DISEASE_SYMPTOM: "Finding",
    lx.PROCEDURE_TREATMENT: "Laboratory Procedure",
    lx.MACRO_DRUG: "Clinical Drug",
}


def _concepts(t: Tables):
    from medloom.functions.text import remap

    words = dictionary_terms(t)
    rows = words.select(
        F.col("word").alias("row_idx"),
        F.when(F.length("word") == 5, F.lit(None).cast("string"))
        .when(F.length("word") == 6, "")
        .otherwise(F.concat(F.lit("C"), "word"))
        .alias("mapped_cui"),
        remap(_macro(F.col("word")), _TYPE_OF).alias("mapped_type"),
    )
    return rows.withColumn("vector", NgramEncoder(DIMS).vector(F.col("row_idx")))


def _gold_sets(t: Tables):
    """Per document, the ids of its dictionary words of seven letters and more."""
    words = mentions(t).select("doc_id", F.lower("surface").alias("w")).where(F.length("w") >= 7)
    per_class = words.groupBy("doc_id", _macro(F.col("w")).alias("cls")).agg(
        F.collect_set(F.concat(F.lit("C"), "w")).alias("cuis")
    )
    return per_class.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("cls", "cuis"))).alias("gold_entities")
    )


SQL_LINK_SCORES = f"""WITH {SQL_MENTIONS},
        entities AS (SELECT DISTINCT doc_id, left(lower(surface), length(surface) - 1) AS entity,
                            {_SQL_MACRO.format('lower(surface)')} AS cls FROM mentions),
        names AS (SELECT entity AS name FROM entities UNION SELECT word FROM terms),
        {SQL_NGRAMS},
        near AS (
          SELECT q, {_SQL_MACRO.format('d')} AS cls, d, sim,
                 row_number() OVER (PARTITION BY q, {_SQL_MACRO.format('d')} ORDER BY sim DESC, d) AS rk
          FROM sims JOIN terms ON word = d WHERE length(d) <> 5),
        pred AS (SELECT DISTINCT doc_id, e.cls, 'C' || d AS cui FROM entities e
                 JOIN near n ON n.q = e.entity AND n.cls = e.cls AND n.rk = 1 AND n.sim > 0.8 WHERE length(d) > 6),
        gold AS (SELECT DISTINCT doc_id, {_SQL_MACRO.format('lower(surface)')} AS cls, 'C' || lower(surface) AS cui
                 FROM mentions WHERE length(surface) >= 7),
        pairs AS (SELECT coalesce(g.cls, p.cls) AS cls, g.cui IS NOT NULL AS g, p.cui IS NOT NULL AS p
                  FROM gold g FULL JOIN pred p ON g.doc_id = p.doc_id AND g.cls = p.cls AND g.cui = p.cui),
        counts AS (SELECT coalesce(cls, 'ALL (micro)') AS cls, count(*) FILTER (g AND p) AS tp,
                          count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn
                   FROM pairs GROUP BY ROLLUP (cls)),
        {SQL_PRF}"""

_SPEC = "cls:string, tp:bigint, fp:bigint, fn:bigint, precision:double, recall:double, f1:double"


def _cut_words(t: Tables):
    """Dictionary words cut by a letter."""
    word = F.lower("surface")
    return mentions(t).select(
        "doc_id", F.left(word, F.length(word) - 1).alias("entity"), _macro(word).alias("cls")
    )


@query("linking_scores", _SPEC, SQL_LINK_SCORES)
def linking_scores(t: Tables):
    """Words cut by a letter, linked again and scored."""
    return evaluate(_gold_sets(t), _cut_words(t), _concepts(t), NgramEncoder(DIMS))


@query("generated_linking_scores", _SPEC, SQL_LINK_SCORES)
def generated_linking_scores(t: Tables):
    """The same entities written as a generative tagger's fenced answers."""
    word = F.lower("surface")
    kind = (
        F.when(_macro(word) == lx.DISEASE_SYMPTOM, " symptom")
        .when(_macro(word) == lx.PROCEDURE_TREATMENT, "Lab ")
        .otherwise("medication")
    )
    item = F.struct(F.left(word, F.length(word) - 1).alias("entity"), kind.alias("type"))
    answers = mentions(t).groupBy("doc_id").agg(
        F.concat(
            F.lit("Here:\n```json\n"), F.to_json(F.collect_set(item)), F.lit("\n```")
        ).alias("answer")
    )
    entities = generated_entities(answers, F.col("answer"))
    return evaluate(_gold_sets(t), entities, _concepts(t), NgramEncoder(DIMS))


@query(
    "linking_predictions",
    "doc_id:bigint, predicted:string, linked:string",
    SQL_LINK_SCORES[: SQL_LINK_SCORES.index("gold AS (SELECT DISTINCT")].rstrip().rstrip(",")
    + """
        SELECT d.doc_id,
               coalesce((SELECT string_agg(entity || '=' || cls, '|' ORDER BY entity, cls) FROM entities e WHERE e.doc_id = d.doc_id), '') AS predicted,
               coalesce((SELECT string_agg(cui || '=' || cls, '|' ORDER BY cui, cls) FROM pred p WHERE p.doc_id = d.doc_id), '') AS linked
        FROM documents d""",
)
def linking_predictions(t: Tables):
    """What is found and linked in each note, for the words of `linking_scores`."""
    found = predictions(
        t.documents.select("doc_id"), _cut_words(t), _concepts(t), NgramEncoder(DIMS)
    )

    def printed(name: str, field: str):
        pairs = F.transform(name, lambda x: F.concat_ws("=", x[field], x["cls"]))
        return F.array_join(pairs, "|")

    return found.select(
        "doc_id",
        printed("predicted_entities", "entity").alias("predicted"),
        printed("linked_entities", "cui").alias("linked"),
    )
