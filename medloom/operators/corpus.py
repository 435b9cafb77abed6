"""Training corpora: unification, exports, gold sets, relabelling, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom import schemas
from medloom.functions import context as cx
from medloom.functions import text as tx
from medloom.lexicon import VIETNAMESE, Rules
from medloom.operators import sequence as sq
from medloom.operators.lookup import first_by, first_of_few, last_by, semi_join_text
from medloom.operators.sampling import split


def unify(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of corpora ``[sent_id, tokens]``; adds ``source_idx``."""
    out = None
    for i, part in enumerate(parts):
        ident = F.concat_ws(":", F.lit(str(i)), F.col("sent_id").cast("string"))
        one = part.select(
            F.lit(i).alias("source_idx"), ident.alias("uid"), F.col("tokens")
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no corpora given")
    return out


def chat_export(df: DataFrame, tokens: str = "tokens", prompt: str = lx.EXTRACTION_PROMPT) -> DataFrame:
    """Add ``text``, ``entities`` and the chat ``messages`` of tagged sentences."""
    text = F.array_join(F.transform(tokens, lambda t: t["word"]), " ")
    return (
        df.withColumn("text", text)
        .withColumn("entities", sq.bio_to_spans(F.col(tokens)))
        .withColumn(
            "messages",
            tx.chat_messages(F.lit(prompt), F.col("text"), F.to_json("entities")),
        )
    )


def labelled_text(df: DataFrame, cls: str = lx.DISEASE_SYMPTOM) -> DataFrame:
    """``[text, labels]`` of sentences with at least one entity of the class."""
    labels = F.transform(
        F.filter("entities", lambda e: e["type"] == cls), lambda e: e["entity"]
    )
    keep = [c for c in df.columns if c not in ("text", "entities", "messages", "tokens")]
    # staged: the filter would find the labels again
    return tx.staged(df.select(*keep, "text", "entities"), labels.alias("labels")).drop("entities").where(F.size("labels") > 0)


def build_corpora(parts: Sequence[DataFrame], seed: int = lx.SEED) -> DataFrame:
    """Unify, repair tags, split and export; one row per sentence with ``split``."""
    repaired = unify(parts).withColumn(
        "tokens", sq.repair_bio(F.col("tokens"), lx.CORPUS_TAG_CLASS)
    )
    return chat_export(split(repaired, F.col("uid"), seed=seed))


# --- reading chat records back ----------------------------------------------


def assistant_entities(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Add ``answer``, ``entities`` and ``malformed`` from the first assistant turn."""
    answer = tx.role_content(F.col(messages), "assistant")
    return (
        df.withColumn("answer", answer)
        .withColumn("entities", F.from_json("answer", schemas.ENTITY_JSON))
        .withColumn(
            "malformed",
            F.col(messages).isNull()
            | (tx.is_filled(F.col("answer")) & F.col("entities").isNull()),
        )
    )


def entity_frequency(df: DataFrame, entity: Column, kind: Column, order: Column) -> DataFrame:
    """Mentions per lower-cased entity and type, most frequent first.

    Equal counts keep the order in which entities were first seen.  A numeric
    ``order`` lets counting hash; over structs it sorts all mentions.
    """
    return (
        df.select(
            F.lower(tx.strip(entity)).alias("entity"),
            tx.strip(kind).alias("type"),
            order.alias("_o"),
        )
        .where((F.col("entity") != "") & (F.col("type") != ""))
        .groupBy("entity", "type")
        .agg(F.count("*").alias("count"), F.min("_o").alias("_first"))
        .orderBy(F.desc("count"), F.asc("_first"))
        .drop("_first")
    )


def tag_examples(df: DataFrame, tokens: str, order: str) -> DataFrame:
    """First entity and example text per tag type, in input order.

    The example runs to the word before the token that ended the entity, or to
    the end of the sentence for an entity at its end.
    """
    spans = F.posexplode(sq.bio_to_spans(F.col(tokens)))
    # examples are cut for the chosen entities only
    rows = df.select(order, tokens, spans).select(
        F.struct(order, F.col("pos")).alias("_o"),
        F.col("col")["type"].alias("tag"),
        F.col("col")["entity"].alias("entity"),
        F.col("col")["end_token"].alias("_end"),
        F.col(tokens).alias("_tokens"),
    )
    until = F.slice("_tokens", F.lit(1), F.col("_end") + 1)
    example = F.array_join(F.transform(until, lambda t: t["word"]), " ")
    return first_of_few(rows, ["tag"], "_o").select("tag", "_o", "entity", example.alias("example"))


def span_examples(df: DataFrame, order: str) -> DataFrame:
    """First entity and its whole sentence per label of span sentences."""
    rows = df.select(
        order, "words", "sentence", F.posexplode("spans").alias("pos", "s")
    ).select(
        F.struct(order, "pos").alias("_o"), F.col("s.label").alias("tag"), "s", "words", "sentence"
    )
    entity = tx.token_slice(F.col("words"), F.col("s.start"), F.col("s.end"))
    return first_of_few(rows, ["tag"], "_o").select(
        "tag", "_o", entity.alias("entity"), F.col("sentence").alias("example")
    )


# --- gold sets --------------------------------------------------------------


def successful(truth: DataFrame) -> DataFrame:
    """Ground-truth rows that carry a concept id."""
    return truth.where(tx.is_filled(F.col("mapped_cui")))


def gold_set(
    chat: DataFrame,
    kept: DataFrame,
    truth: DataFrame,
    *,
    class_from: str = "ontology",
    ident: str = "row_idx",
    truth_order: str = "row_idx",
) -> DataFrame:
    """Gold concept ids per macro class of the sentences in a split.

    ``class_from='ontology'`` takes the class from the concept's semantic type
    and cleans text for benchmarks; ``'annotation'`` takes the annotated type
    and cleans for training.  Sentences without a mapped entity are left out.
    """
    clean = tx.clean_gold if class_from == "ontology" else tx.clean_training
    # cleaned terms are staged: joins and filters would clean them again
    truths = tx.staged(successful(truth), F.lower(clean(F.col("entity"))).alias("_term"))
    dictionary = last_by(
        truths.select(
            "_term",
            F.col(truth_order).alias("_o"),
            F.col("mapped_cui").alias("cui"),
            tx.remap(F.col("mapped_type"), lx.GOLD_CLASS, None).alias("_onto"),
        ),
        ["_term"], "_o",
    )
    turns = chat.where(F.size("messages") >= 3).select(
        ident,
        tx.strip(F.get("messages", F.lit(1))["content"]).alias("text"),
        F.get("messages", F.lit(2))["content"].alias("_answer"),
    )
    # parse answers only of sentences in the split
    wanted = semi_join_text(turns, "text", kept, "text")
    entities = wanted.select(
        ident, "text", F.explode(F.from_json("_answer", schemas.ENTITY_JSON)).alias("e")
    )
    mentions = tx.staged(
        entities, F.lower(clean(F.coalesce("e.entity", F.lit("")))).alias("_term")
    ).select(ident, "text", "_term", F.col("e.type").alias("_type"))
    cls = F.col("_onto") if class_from == "ontology" else F.col("_type")
    mapped = (
        mentions.join(dictionary, "_term")
        .withColumn("_cls", cls)
        .where(F.col("_cls").isin(list(lx.MACRO_CLASSES)))
    )
    per_class = [
        F.sort_array(F.collect_set(F.when(F.col("_cls") == c, F.col("cui")))).alias(c)
        for c in lx.MACRO_CLASSES
    ]
    return (
        mapped.groupBy(ident)
        .agg(F.any_value("text").alias("text"), *per_class)
        .select(ident, "text", F.struct(*lx.MACRO_CLASSES).alias("gold_entities"))
    )


def map_labels(
    df: DataFrame,
    truth: DataFrame,
    *,
    ident: str,
    truth_order: str = "row_idx",
) -> DataFrame:
    """Concept ids of sentence labels in label order, without repeats.

    Adds ``cuis``, ``mapped`` and ``unmapped``.  Labels meet the dictionary as
    exploded rows, so its size does not matter.
    """
    dictionary = first_by(
        truth.select(
            tx.strip(F.lower("entity")).alias("_term"),
            F.col(truth_order).alias("_o"),
            tx.strip(F.col("mapped_cui")).alias("_cui"),
        ),
        ["_term"], "_o",
    ).drop("_o")
    # the first label of a row carries the row, so rows are neither made twice nor joined back
    first, known = F.coalesce("_pos", F.lit(0)) == 0, F.col(ident).isNotNull()
    found = (
        df.select(F.struct(*df.columns).alias("_whole"), ident, F.posexplode_outer("labels").alias("_pos", "_label"))
        .select(ident, "_pos", tx.label_key(F.col("_label")).alias("_term"), F.when(first, F.col("_whole")).alias("_row"))
        .join(dictionary, "_term", "left")
        .groupBy(ident)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.when(known & F.col("_cui").isNotNull(), F.struct("_pos", "_cui"))
                )
            ).alias("_hits"),
            F.count(F.when(known, F.col("_pos"))).alias("_labels"),
            F.collect_list("_row").alias("_rows"),
        )
    )
    return (
        found.select("_hits", "_labels", F.explode("_rows").alias("_row"))
        .select(*[F.col("_row")[c].alias(c) for c in df.columns], "_hits", "_labels")
        .withColumn("cuis", F.array_distinct(F.transform("_hits", lambda h: h["_cui"])))
        .withColumn("mapped", F.size("_hits"))
        .withColumn("unmapped", F.col("_labels") - F.col("mapped"))
        .drop("_hits", "_labels")
    )


# --- relabelling ------------------------------------------------------------


def relabel_entity(sentence: Column, entity: Column, rules: Rules = VIETNAMESE) -> Column:
    """One training entity under the note rules; null when it is dropped.

    Offsets are the first occurrence of the term; only clause negation applies.
    """
    term = entity["entity"]

    def build(known: Column) -> Column:
        name, kind, start = known["term"], known["kind"], known["start"]
        end = start + F.length(term)
        is_disease = F.coalesce(entity["type"] == lx.DISEASE_SYMPTOM, F.lit(False))
        in_context = (start >= 0) & cx.has_drug_context(sentence, start, end, rules)
        fixed = cx.correct_type(name, kind, is_disease, in_context, rules)
        flags = F.when(
            start >= 0, cx.assertions(sentence, start, end, None, rules, line_rule=False)
        ).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(
            cx.passes_precision(name, kind, rules),
            F.struct(
                entity["entity"].alias("entity"),
                fixed["type"].alias("type"),
                entity["start_token"].alias("start_token"),
                entity["end_token"].alias("end_token"),
                flags.alias("assertions"),
            ),
        )

    known = F.struct(
        tx.normalise_term(term, rules.term_strip).alias("term"),
        tx.remap(entity["type"], lx.RELABEL_TYPE).alias("kind"),
        tx.find(sentence, term).alias("start"),
    )
    return tx.let(known, build)


def relabel(
    chat: DataFrame,
    rules: Rules = VIETNAMESE,
    prompt: str = lx.RELABEL_PROMPT,
) -> DataFrame:
    """Rewrite chat records under the note rules.

    The sentence is the last user turn.  Every assistant turn that parses is
    rewritten; one that does not stays as it is.  Adds ``total``, ``modified``
    and ``dropped`` per record.
    """
    sentence = F.coalesce(tx.role_content(F.col("messages"), "user", last=True), F.lit(""))

    def turn(s: Column, m: Column) -> Column:
        before = F.from_json(m["content"], schemas.ENTITY_JSON)
        judged = tx.let(
            before,
            lambda es: F.transform(
                es,
                lambda e: F.struct(e["type"].alias("old"), relabel_entity(s, e, rules).alias("new")),
            ),
        )
        return F.when(m["role"] == "assistant", judged)

    def rewritten(m: Column, rows: Column) -> Column:
        kept = F.filter(F.transform(rows, lambda r: r["new"]), lambda e: e.isNotNull())
        content = (
            F.when(m["role"] == "system", F.lit(prompt))
            .when(rows.isNotNull(), F.to_json(kept))
            .otherwise(m["content"])
        )
        return F.struct(m["role"].alias("role"), content.alias("content"))

    judged = tx.let(
        sentence, lambda s: F.transform("messages", lambda m: turn(s, m))
    )
    changed = lambda r: (
        r["new"].isNotNull()
        & (~r["new"]["type"].eqNullSafe(r["old"]) | (F.size(r["new"]["assertions"]) > 0))
    )
    everything = F.flatten(F.filter("_judged", lambda rows: rows.isNotNull()))
    return (
        chat.withColumn("_judged", judged)
        .withColumn("messages", F.zip_with("messages", "_judged", rewritten))
        .withColumn("total", F.size(everything))
        .withColumn("modified", F.size(F.filter(everything, changed)))
        .withColumn("dropped", F.size(F.filter(everything, lambda r: r["new"].isNull())))
        .drop("_judged")
    )
