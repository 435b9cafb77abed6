"""Dictionary lookups, semi joins and per-key picks.

Duplicates in a dictionary are resolved by an aggregation (combined before the
shuffle, so a key with very many rows costs no single task) and never by a
window.  No join carries a broadcast hint: Spark broadcasts a side when its
measured size is under the session's limit and AQE splits skewed keys beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.functions import text as tx


def first_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _pick(df, keys, F.min_by, order)


def last_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` per key."""
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys: Sequence[str], agg, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(agg(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )


def first_of_few(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The same as ``first_by`` for keys of a small vocabulary, such as labels.

    Picks of whole rows alone sort all rows by key before they are combined.  A set,
    here an empty one, among the aggregates lets Spark hash the keys instead, so a
    task holds one row per key and sorts nothing.
    """
    rest = [c for c in df.columns if c not in keys]
    nothing = F.collect_set(F.lit(None).cast("boolean"))
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"), nothing.alias("_none"))
        .where(F.size("_none") == 0)
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )


def best_by(df: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """The row with the highest score per key, the earliest on a tie."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"))
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), ranked).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )


def semi_join_text(df: DataFrame, text: str, kept: DataFrame, kept_text: str) -> DataFrame:
    """Rows whose trimmed text occurs among the trimmed texts of ``kept``."""
    wanted = kept.select(tx.strip(F.col(kept_text)).alias("_t")).distinct()
    return (
        df.withColumn("_t", tx.strip(F.col(text)))
        .join(wanted, "_t", "left_semi")
        .drop("_t")
    )


# --- concepts and codes -----------------------------------------------------


def vocabulary_codes(
    df: DataFrame,
    order: str,
    key_of: dict[str, str] | None = None,
) -> DataFrame:
    """``[cui, codes]`` from rows ``[CUI, SAB, CODE]``; the last row of a key wins."""
    key_of = lx.VOCABULARY_KEY if key_of is None else key_of
    per_key = (
        df.where(F.col("SAB").isin(list(key_of)))
        .groupBy(F.col("CUI").alias("cui"), tx.remap(F.col("SAB"), key_of, None).alias("key"))
        .agg(F.max_by("CODE", order).alias("code"))
    )
    # at most one entry per vocabulary key, so the collected map stays small
    return per_key.groupBy("cui").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "code")))).alias("codes")
    )


def is_concept_id(cui: Column) -> Column:
    """Standard concept identifiers start with ``C`` but not with ``C_``."""
    return cui.startswith("C") & ~cui.startswith("C_")


def no_codes() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def with_codes(df: DataFrame, codes: DataFrame, cui: str = "cui", *, guard: bool = False) -> DataFrame:
    """Attach vocabulary codes; a concept without codes gets an empty map.

    With ``guard`` only standard concept identifiers are looked up.
    """
    probe = F.when(is_concept_id(F.col(cui)), F.col(cui)) if guard else F.col(cui)
    lookup = codes.select(F.col("cui").alias("_cui"), F.col("codes").alias("_codes"))
    return (
        df.withColumn("_probe", probe)
        .join(lookup, F.col("_probe") == F.col("_cui"), "left")
        .withColumn("codes", F.coalesce("_codes", no_codes()))
        .drop("_probe", "_cui", "_codes")
    )


def map_terms(
    df: DataFrame,
    key: Column,
    truth: DataFrame,
    truth_key: Column,
    order: str,
    *,
    keep: str = "first",
    columns: Sequence[str] = ("mapped_cui",),
) -> DataFrame:
    """Left-join concept columns on a normalised term; one duplicate wins."""
    keyed = truth.select(truth_key.alias("_term"), F.col(order).alias("_order"), *columns)
    pick = first_by if keep == "first" else last_by
    one = pick(keyed, ["_term"], "_order").drop("_order")
    return (
        df.withColumn("_key", key)
        .join(one, F.col("_key") == F.col("_term"), "left")
        .drop("_key", "_term")
    )


def lookup_names(
    df: DataFrame,
    cui: str,
    kg: DataFrame,
    kg_order: str,
    fallback: DataFrame,
    fallback_order: str,
    english: Column | None = None,
) -> DataFrame:
    """Name of a concept: first graph node, else first mapped entity, else the id.

    ``english`` marks rows that prefer the English name.  Adds
    ``canonical_name`` and ``names``, the terms worth searching in a text.
    """
    node = first_by(
        kg.select(F.col("uml_id").alias("_cui"), F.col(kg_order).alias("_o"), *lx.KG_NAMES_VI),
        ["_cui"], "_o",
    ).drop("_o")
    mapped = first_by(
        fallback.select(
            F.col("mapped_cui").alias("_cui2"), F.col(fallback_order).alias("_o"),
            F.col("entity").alias("_entity"),
        ),
        ["_cui2"], "_o",
    ).drop("_o")
    from_graph = F.when(
        F.lit(False) if english is None else english,
        tx.first_nonempty(*[F.col(n) for n in lx.KG_NAMES_EN]),
    ).otherwise(tx.first_nonempty(*[F.col(n) for n in lx.KG_NAMES_VI]))
    # an id that only names itself counts as unnamed and tries the fallback
    named = F.when(from_graph != F.col(cui), from_graph)
    listed = F.array_compact(
        F.array(*[F.nullif(F.col(n), F.lit("")) for n in lx.KG_NAMES_VI])
    )
    return (
        df.join(node, F.col(cui) == F.col("_cui"), "left")
        .join(mapped, F.col(cui) == F.col("_cui2"), "left")
        .withColumn("canonical_name", F.coalesce(named, "_entity", cui))
        .withColumn("names", F.concat(F.array("canonical_name"), listed))
        .drop("_cui", "_cui2", "_entity", *lx.KG_NAMES_VI)
    )


def locate_synonym(c: Column, names: Column) -> Column:
    """``struct<term,start,end>`` of the first name found in the text.

    Names are tried in order, ignoring case; the surface form comes from the
    text.  Null when none occurs.
    """

    def search(low: Column) -> Column:
        hits = F.filter(
            F.transform(
                names,
                lambda n: F.struct(
                    (F.call_function("locate", F.lower(n), low) - 1).alias("start"),
                    F.length(n).alias("n"),
                ),
            ),
            lambda h: h["start"] >= 0,
        )
        hit = F.get(hits, F.lit(0))
        end = hit["start"] + hit["n"]
        return F.when(
            hit.isNotNull(),
            F.struct(
                tx.slice_text(c, hit["start"], end).alias("term"),
                hit["start"].alias("start"),
                end.alias("end"),
            ),
        )

    return tx.let(F.lower(c), search)


# --- dictionaries -----------------------------------------------------------


def symptom_dictionary(kg: DataFrame, id_columns: Sequence[str] = lx.KG_ID_COLUMNS) -> DataFrame:
    """Symptom names out of the graph: known id columns plus both names."""
    present = [c for c in id_columns if c in kg.columns]
    return kg.where(F.col("labels").isin(list(lx.SYMPTOM_KG_LABELS))).select(
        *present,
        F.col("name").alias("name_en"),
        F.coalesce("medgemma_trans", "name").alias("name_vi"),
    )


def first_present(df: DataFrame, names: Sequence[str], default: str) -> Column:
    """The first of several columns the frame has, else a constant."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(default)


def build_drug_dictionary(
    concepts: DataFrame,
    relations: DataFrame,
    relation_names: Sequence[str] = lx.INGREDIENT_RELATIONS,
) -> DataFrame:
    """Drug terms with their ids, term types, ingredients and foreign codes.

    ``concepts``: ``rxcui, lat, sab, tty, code, term``; ``relations``: ``rxcui1,
    rxcui2, rela``.  Ingredient terms are gathered once per drug id and then
    handed to its terms, so term pairs are never listed.  Multi-valued cells are
    sorted and joined by ``|``.
    """
    sabs = {"SNOMEDCT_US": "snomed", "ATC": "atc", "DRUGBANK": "drugbank"}
    sab = F.col("sab")
    drug = F.struct(tx.strip(F.lower("term")).alias("term"), "tty")
    ids = (
        concepts.where((F.col("lat") == "ENG") & sab.isin("RXNORM", *sabs))
        .groupBy("rxcui")
        .agg(
            F.collect_set(F.when(sab == "RXNORM", drug)).alias("names"),
            *[F.collect_set(F.when(sab == s, F.col("code"))).alias(c) for s, c in sabs.items()],
        )
        .where(F.size("names") > 0)
    )
    edges = (
        relations.where(F.col("rela").isin(list(relation_names)))
        .select("rxcui1", "rxcui2")
        .distinct()
    )
    terms = F.array_distinct(F.transform("names", lambda n: n["term"]))
    ingredients = (
        edges.join(ids.select(F.col("rxcui").alias("rxcui2"), terms.alias("terms")), "rxcui2")
        .select(F.col("rxcui1").alias("rxcui"), F.explode("terms").alias("term"))
        .groupBy("rxcui")
        .agg(F.collect_set("term").alias("ingredients"))
    )
    multi = ("ingredients", *sabs.values())
    cells = ("rxcui", "tty", *multi)
    per_name = ids.join(ingredients, "rxcui", "left").select(
        F.array("rxcui").alias("rxcui"), F.explode("names").alias("n"), *multi
    ).withColumn("tty", F.array("n.tty"))
    # one row per value: sets are formed before the shuffle, however many share a term
    def listed(cell: str) -> Column:
        values = F.coalesce(cell, F.expr("cast(array() as array<string>)"))
        return F.transform(values, lambda v: F.struct(F.lit(cell).alias("cell"), v.cast("string").alias("value")))

    values = F.concat(*map(listed, cells))
    return (
        per_name.select("n.term", F.explode(values).alias("v"))
        .groupBy("term")
        .agg(*[F.collect_set(F.when(F.col("v.cell") == c, F.col("v.value"))).alias(c) for c in cells])
        .select("term", *[F.array_join(F.sort_array(c), "|").alias(c) for c in cells])
    )
