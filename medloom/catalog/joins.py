"""Lookups, remaps, dictionaries and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.catalog.inputs import dictionary_terms, with_mentions
from medloom.catalog.registry import SQL_MENTIONS, SQL_TERMS, Tables, query, sql_strip
from medloom.functions import text as tx
from medloom.operators import lookup as lk
from medloom.operators import pairs as pr
from medloom.operators import sampling as sm
from medloom.sources import readers

PRIORITIES = {"1-URGENT": "top", "2-HIGH": "top", "5-LOW": "rest"}
_PRIORITY_CASE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'top' WHEN '2-HIGH' THEN 'top' WHEN '5-LOW' THEN 'rest' END"
)


@query(
    "remap_identity",
    "o_orderkey:bigint, label:string",
    f"SELECT o_orderkey, coalesce({_PRIORITY_CASE}, o_orderpriority) AS label FROM orders",
)
def remap_identity(t: Tables):
    return t.orders.select(
        "o_orderkey", tx.remap(F.col("o_orderpriority"), PRIORITIES).alias("label")
    )


@query(
    "remap_null",
    "o_orderkey:bigint, label:string",
    f"SELECT o_orderkey, {_PRIORITY_CASE} AS label FROM orders",
)
def remap_null(t: Tables):
    return t.orders.select(
        "o_orderkey", tx.remap(F.col("o_orderpriority"), PRIORITIES, None).alias("label")
    )


@query(
    "remap_default",
    "o_orderkey:bigint, label:string",
    f"SELECT o_orderkey, coalesce({_PRIORITY_CASE}, 'O') AS label FROM orders",
)
def remap_default(t: Tables):
    return t.orders.select(
        "o_orderkey", tx.remap(F.col("o_orderpriority"), PRIORITIES, "O").alias("label")
    )


@query(
    "remap_drop",
    "label:string, n:bigint, total:double",
    f"""SELECT {_PRIORITY_CASE} AS label, count(*) AS n,
               sum(o_totalprice::decimal(18, 2)) AS total FROM orders
        WHERE {_PRIORITY_CASE} IS NOT NULL GROUP BY 1""",
)
def remap_drop(t: Tables):
    label = tx.remap(F.col("o_orderpriority"), PRIORITIES, None)
    return (
        t.orders.withColumn("label", label)
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    )


def _graph(t: Tables):
    """Parts as graph nodes, with gaps in the translated names."""
    return t.part.select(
        F.col("p_partkey").alias("row_idx"),
        F.when(F.col("p_type") == "PROMO", "Disease")
        .when(F.col("p_type") == "ECONOMY", "Phenotype")
        .otherwise(F.col("p_type"))
        .alias("labels"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("uml_id"),
        F.when(F.col("p_size") > 20, F.concat(F.lit("vi "), "p_name")).alias("medgemma_trans"),
        F.when(F.col("p_size") > 10, "").alias("qwen_trans"),
        F.lit(None).cast("string").alias("map_trans"),
        F.col("p_size").cast("string").alias("icd"),
    )


SQL_GRAPH = """graph AS (
  SELECT p_partkey AS row_idx, CASE p_type WHEN 'PROMO' THEN 'Disease' WHEN 'ECONOMY' THEN 'Phenotype'
         ELSE p_type END AS labels, p_name AS name, p_brand AS uml_id,
         CASE WHEN p_size > 20 THEN 'vi ' || p_name END AS medgemma_trans, p_size::varchar AS icd
  FROM part)"""


@query(
    "symptom_dictionary",
    "uml_id:string, icd:string, name_en:string, name_vi:string",
    f"""WITH {SQL_GRAPH} SELECT uml_id, icd, name AS name_en, coalesce(medgemma_trans, name) AS name_vi
        FROM graph WHERE labels IN ('Disease', 'Phenotype')""",
)
def symptom_dictionary(t: Tables):
    return lk.symptom_dictionary(_graph(t))


@query(
    "graph_label_filter",
    "labels:string, n:bigint, ids:bigint",
    f"""WITH {SQL_GRAPH} SELECT labels, count(*) AS n, count(DISTINCT uml_id) AS ids FROM graph
        WHERE labels IN ('Diagnosis', 'Disease', 'Phenotype') GROUP BY labels""",
)
def graph_label_filter(t: Tables):
    return (
        _graph(t)
        .where(F.col("labels").isin(list(lx.KG_LABELS)))
        .groupBy("labels")
        .agg(F.count("*").alias("n"), F.countDistinct("uml_id").alias("ids"))
    )


@query(
    "first_present_column",
    "p_partkey:bigint, macro_type:string, fallback:string",
    "SELECT p_partkey, p_type AS macro_type, 'Other' AS fallback FROM part",
)
def first_present_column(t: Tables):
    return t.part.select(
        "p_partkey",
        lk.first_present(t.part, ["original_type", "p_type"], "Other").alias("macro_type"),
        lk.first_present(t.part, ["original_type", "mapped_type"], "Other").alias("fallback"),
    )


def _concept(cui_col: str):
    """Part names as concept ids: plain, private (`C_`), empty or foreign."""
    name = F.col(cui_col)
    return (
        F.when(name.startswith("blue"), "")
        .when(name.startswith("red"), F.concat(F.lit("C_"), name))
        .when(name.startswith("cold"), F.lit(None).cast("string"))
        .when(name.startswith("new"), F.concat(F.lit("X"), name))
        .otherwise(F.concat(F.lit("C"), name))
    )


_SQL_CONCEPT = """CASE WHEN p_name LIKE 'blue%' THEN '' WHEN p_name LIKE 'red%' THEN 'C_' || p_name
  WHEN p_name LIKE 'cold%' THEN NULL WHEN p_name LIKE 'new%' THEN 'X' || p_name ELSE 'C' || p_name END"""


@query(
    "valid_concepts",
    "p_partkey:bigint, cui:string, standard:boolean",
    f"""SELECT * FROM (SELECT p_partkey, {_SQL_CONCEPT} AS cui,
          starts_with({_SQL_CONCEPT}, 'C') AND NOT starts_with({_SQL_CONCEPT}, 'C_') AS standard FROM part)
        WHERE cui IS NOT NULL AND cui <> ''""",
)
def valid_concepts(t: Tables):
    return (
        t.part.withColumn("cui", _concept("p_name"))
        .where(tx.is_filled(F.col("cui")))
        .select("p_partkey", "cui", lk.is_concept_id(F.col("cui")).alias("standard"))
    )


# Line items as a vocabulary concordance: the part is the concept, the ship
# month decides the vocabulary, the order the code.
_SABS = ("ICD10", "ICD10CM", "ICD9CM", "RXNORM", "LNC", "LOINC", "MSH", "OTHER", "PMID", "HPO",
         "SNOMEDCT_US", "DRUGBANK")


def _concordance(t: Tables):
    sab = F.element_at(F.array(*[F.lit(s) for s in _SABS]), F.month("l_shipdate"))
    return t.lineitem.select(
        F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("CUI"),
        sab.alias("SAB"),
        F.col("l_orderkey").cast("string").alias("CODE"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_idx"),
    )


SQL_CODES = f"""concordance AS (
  SELECT 'C' || l_partkey AS cui, CASE month(l_shipdate) WHEN 1 THEN 'icd10' WHEN 2 THEN 'icd10'
         WHEN 3 THEN 'icd9' WHEN 4 THEN 'rxnorm' WHEN 5 THEN 'loinc' WHEN 6 THEN 'loinc' WHEN 7 THEN 'mesh'
         WHEN 9 THEN 'pubmed' WHEN 10 THEN 'hpo' WHEN 11 THEN 'snomed' WHEN 12 THEN 'drugbank' END AS key,
         l_orderkey::varchar AS code, l_orderkey * 100 + l_linenumber AS row_idx FROM lineitem),
codes AS (
  SELECT cui, key, arg_max(code, row_idx) AS code FROM concordance WHERE key IS NOT NULL GROUP BY cui, key)"""


@query(
    "vocabulary_pivot",
    "cui:string, icd10:string, icd9:string, rxnorm:string, loinc:string, pubmed:string, n:bigint",
    f"""WITH {SQL_CODES}
        SELECT cui, max(code) FILTER (key = 'icd10') AS icd10, max(code) FILTER (key = 'icd9') AS icd9,
               max(code) FILTER (key = 'rxnorm') AS rxnorm, max(code) FILTER (key = 'loinc') AS loinc,
               max(code) FILTER (key = 'pubmed') AS pubmed, count(*) AS n FROM codes GROUP BY cui""",
)
def vocabulary_pivot(t: Tables):
    codes = lk.vocabulary_codes(_concordance(t), "row_idx")
    return codes.select(
        "cui",
        *[
            F.try_element_at("codes", F.lit(k)).alias(k)
            for k in ("icd10", "icd9", "rxnorm", "loinc", "pubmed")
        ],
        F.size("codes").alias("n"),
    )


@query(
    "concept_codes",
    "p_partkey:bigint, cui:string, rxnorm:string, n:bigint",
    f"""WITH {SQL_CODES},
        asked AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'C_' || p_partkey WHEN p_size < 20 THEN 'D' || p_partkey
                  ELSE 'C' || p_partkey END AS cui FROM part)
        SELECT p_partkey, a.cui, max(code) FILTER (key = 'rxnorm') AS rxnorm, count(key) AS n
        FROM asked a LEFT JOIN codes c ON a.cui = c.cui GROUP BY p_partkey, a.cui""",
)
def concept_codes(t: Tables):
    prefix = F.when(F.col("p_size") < 10, "C_").when(F.col("p_size") < 20, "D").otherwise("C")
    asked = t.part.select(
        "p_partkey", F.concat(prefix, F.col("p_partkey").cast("string")).alias("cui")
    )
    codes = lk.vocabulary_codes(_concordance(t), "row_idx")
    return lk.with_codes(asked, codes, guard=True).select(
        "p_partkey",
        "cui",
        F.try_element_at("codes", F.lit("rxnorm")).alias("rxnorm"),
        F.size("codes").alias("n"),
    )


def _truth(t: Tables):
    return t.part.select(
        F.initcap("p_name").alias("entity"),
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("mapped_cui"),
        F.col("p_partkey").alias("row_idx"),
    )


def _map_terms(t: Tables, keep: str):
    """Distinct names of parts and of nations, looked up among part names."""
    names = t.part.select(
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")
    ).unionByName(t.nation.select(F.col("n_name").alias("name")))
    return lk.map_terms(
        names.distinct(), tx.label_key(F.col("name")), _truth(t), tx.strip(F.lower("entity")),
        "row_idx", keep=keep,
    )


def _map_sql(pick: str) -> str:
    return f"""WITH names AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part
                              UNION SELECT n_name FROM nation),
        truth AS (SELECT p_name AS term, 'C' || {pick}(p_partkey) AS cui FROM part GROUP BY p_name)
        SELECT name, cui AS mapped_cui FROM names LEFT JOIN truth ON lower(replace(name, '_', ' ')) = term"""


@query("term_map_first", "name:string, mapped_cui:string", _map_sql("min"))
def term_map_first(t: Tables):
    return _map_terms(t, "first")


@query("term_map_last", "name:string, mapped_cui:string", _map_sql("max"))
def term_map_last(t: Tables):
    return _map_terms(t, "last")


@query(
    "split_semi",
    "conv_id:bigint, turn:bigint",
    f"""SELECT conv_id, turn FROM conversations WHERE {sql_strip('text')} IN
        (SELECT {sql_strip('text')} FROM conversations WHERE role = 'assistant')""",
)
def split_semi(t: Tables):
    kept = t.conversations.where(F.col("role") == "assistant")
    return lk.semi_join_text(t.conversations, "text", kept, "text").select("conv_id", "turn")


@query(
    "best_per_key",
    "p_name:string, p_partkey:bigint, p_size:bigint",
    """SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER
         (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn = 1""",
)
def best_per_key(t: Tables):
    return lk.best_by(t.part.select("p_name", "p_partkey", "p_size"), ["p_name"], "p_size", "p_partkey")


@query(
    "concept_names",
    "p_brand:string, canonical_name:string, names:string",
    """WITH graph AS (SELECT * FROM part WHERE p_size < 20),
        node AS (SELECT p_brand, arg_min(p_name, p_partkey) AS name,
                 arg_min(CASE WHEN p_size > 15 THEN 'vi ' || p_name ELSE '' END, p_partkey) AS local
          FROM graph WHERE p_type <> 'SMALL' AND p_retailprice < 950 GROUP BY p_brand),
        mapped AS (SELECT p_brand, arg_min(p_name, p_partkey) AS entity FROM part GROUP BY p_brand)
        SELECT q.p_brand, coalesce(nullif(n.local, ''), n.name, m.entity, q.p_brand) AS canonical_name,
               concat_ws('|', coalesce(nullif(n.local, ''), n.name, m.entity, q.p_brand), nullif(n.local, ''), n.name) AS names
        FROM (SELECT DISTINCT p_brand FROM part UNION SELECT n_name FROM nation) q
        LEFT JOIN node n USING (p_brand) LEFT JOIN mapped m USING (p_brand)""",
)
def concept_names(t: Tables):
    asked = t.part.select("p_brand").union(t.nation.select("n_name")).distinct()
    none = F.lit(None).cast("string")
    kg = t.part.where(
        (F.col("p_size") < 20) & (F.col("p_type") != "SMALL") & (F.col("p_retailprice") < 950)
    ).select(
        F.col("p_brand").alias("uml_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 15, F.concat(F.lit("vi "), "p_name")).otherwise("").alias("medgemma_trans"),
        none.alias("qwen_trans"),
        none.alias("map_trans"),
        F.col("p_partkey").alias("row_idx"),
    )
    mapped = t.part.select(
        F.col("p_brand").alias("mapped_cui"), F.col("p_name").alias("entity"),
        F.col("p_partkey").alias("row_idx"),
    )
    return lk.lookup_names(asked, "p_brand", kg, "row_idx", mapped, "row_idx").withColumn(
        "names", F.array_join("names", "|")
    )


@query(
    "synonym_offset",
    "doc_id:bigint, term:string, start:bigint, end:bigint",
    f"""WITH {SQL_MENTIONS},
        names AS (
          SELECT doc_id, unnest(['Ention De', 'DER DIE', 'que la', 'of the', w]) AS name,
                 unnest([1, 2, 3, 4, 5]) AS o
          FROM (SELECT doc_id, arg_min(lower(surface), start) AS w FROM mentions GROUP BY doc_id)),
        hits AS (
          SELECT n.doc_id, n.o, n.name, d.text, instr(lower(d.text), lower(n.name)) AS pos
          FROM names n JOIN documents d USING (doc_id)),
        first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS rn FROM hits WHERE pos > 0)
        SELECT doc_id, substr(text, pos, length(name)) AS term, pos - 1 AS start,
               pos - 1 + length(name) AS "end" FROM first WHERE rn = 1""",
)
def synonym_offset(t: Tables):
    names = F.array(
        *[F.lit(n) for n in ("Ention De", "DER DIE", "que la", "of the")],
        F.lower(F.get("found", F.lit(0))["surface"]),
    )
    return with_mentions(t).select(
        "doc_id", lk.locate_synonym(F.col("text"), names).alias("at")
    ).select("doc_id", "at.*")


# --- terminology ------------------------------------------------------------


def _terminology(t: Tables):
    """Orders and parts written as pipe-delimited concept and relation lines."""
    blank = F.lit("")

    def line(*cells):
        return F.concat_ws("|", *cells).alias("value")

    drugs = t.part.select(
        line(
            F.col("p_partkey").cast("string"),
            F.when(F.col("p_size") == 50, "SPA").otherwise("ENG"),
            *[blank] * 9,
            F.lit("RXNORM"), "p_type", F.col("p_size").cast("string"),
            F.concat(F.upper("p_name"), F.lit(" "), "p_brand"), blank,
        )
    )
    sab = (
        F.when(F.col("o_orderstatus") == "F", "SNOMEDCT_US")
        .when(F.col("o_orderstatus") == "O", "ATC")
        .otherwise("DRUGBANK")
    )
    foreign = t.lineitem.join(
        t.orders, F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        line(
            F.col("l_partkey").cast("string"), F.lit("ENG"), *[blank] * 9, sab, F.lit("PT"),
            F.col("l_suppkey").cast("string"), F.lit("x"), blank,
        )
    )
    short = t.nation.select(line(F.col("n_nationkey").cast("string"), F.lit("ENG"), "n_name"))
    relation = (
        F.when(F.col("l_returnflag") == "A", "has_ingredient")
        .when(F.col("l_returnflag") == "R", "tradename_of")
        .otherwise("isa")
    )
    edges = t.lineitem.select(
        line(
            F.col("l_partkey").cast("string"), *[blank] * 3, F.col("l_suppkey").cast("string"),
            blank, blank, relation, *[blank] * 4,
        )
    )
    return drugs.unionByName(foreign).unionByName(short), edges


@query(
    "drug_dictionary",
    "term:string, rxcui:string, tty:string, ingredients:string, snomed:string, atc:string, drugbank:string",
    """WITH drugs AS (SELECT p_partkey::varchar AS rxcui, p_type AS tty, lower(p_name || ' ' || p_brand) AS term
                      FROM part WHERE p_size <> 50),
        foreign_codes AS (SELECT DISTINCT l_partkey::varchar AS rxcui, l_suppkey::varchar AS code, o_orderstatus AS s
                          FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        edges AS (SELECT DISTINCT l_partkey::varchar AS rxcui, l_suppkey::varchar AS rxcui2
                  FROM lineitem WHERE l_returnflag IN ('A', 'R')),
        ing AS (SELECT a.term, string_agg(DISTINCT b.term, '|' ORDER BY b.term) AS ingredients
                FROM drugs a JOIN edges e USING (rxcui) JOIN drugs b ON b.rxcui = e.rxcui2 GROUP BY a.term),
        code AS (SELECT term, string_agg(DISTINCT code, '|' ORDER BY code) FILTER (s = 'F') AS snomed,
                   string_agg(DISTINCT code, '|' ORDER BY code) FILTER (s = 'O') AS atc,
                   string_agg(DISTINCT code, '|' ORDER BY code) FILTER (s = 'P') AS drugbank
                 FROM drugs JOIN foreign_codes USING (rxcui) GROUP BY term),
        own AS (SELECT term, string_agg(DISTINCT rxcui, '|' ORDER BY rxcui) AS rxcui,
                       string_agg(DISTINCT tty, '|' ORDER BY tty) AS tty FROM drugs GROUP BY term)
        SELECT term, rxcui, tty, coalesce(ingredients, '') AS ingredients, coalesce(snomed, '') AS snomed,
               coalesce(atc, '') AS atc, coalesce(drugbank, '') AS drugbank
        FROM own LEFT JOIN ing USING (term) LEFT JOIN code USING (term)""",
)
def drug_dictionary(t: Tables):
    concepts, edges = _terminology(t)
    return lk.build_drug_dictionary(
        readers.rrf_fields(concepts, "value", lx.CONCEPT_FIELDS, lx.CONCEPT_MIN_FIELDS),
        readers.rrf_fields(edges, "value", lx.RELATION_FIELDS, lx.RELATION_MIN_FIELDS),
    )


# --- code pairs ---------------------------------------------------------------


def _codes(t: Tables):
    """Customers as codes: the nation is the parent, the customer number the child."""
    parent = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    parents = t.nation.select(
        (F.col("n_nationkey").cast("long") - 1000).alias("row_idx"),
        parent.alias("id"),
        # two parents share a name with another parent and with some children
        F.when(F.col("n_nationkey") > 20, "NATION_7")
        .when(F.col("n_nationkey") == 3, "building ")
        .otherwise(F.col("n_name"))
        .alias("name"),
    )
    own = F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    children = t.customer.select(
        F.col("c_custkey").alias("row_idx"),
        F.concat(own, F.lit("."), F.col("c_custkey").cast("string")).alias("id"),
        F.when(F.col("c_acctbal") < 2000, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("name"),
    )
    return parents.unionByName(children)


SQL_CODE_PAIRS = """parents AS (
  SELECT 'N' || lpad(n_nationkey::varchar, 2, '0') AS parent_id, n_nationkey - 1000 AS first_idx,
         CASE WHEN n_nationkey > 20 THEN 'NATION_7' WHEN n_nationkey = 3 THEN 'building ' ELSE n_name END AS name
  FROM nation),
children AS (
  SELECT c_custkey AS row_idx, 'N' || lpad(c_nationkey::varchar, 2, '0') AS parent_id,
         CASE WHEN c_acctbal < 2000 THEN c_mktsegment ELSE c_name END AS name FROM customer),
positives AS (
  SELECT c.row_idx, p.name AS query_term, c.name AS matching_term
  FROM children c JOIN parents p USING (parent_id)
  WHERE lower(trim(c.name)) <> lower(trim(p.name)))"""

SQL_NEGATIVES = (
    SQL_CODE_PAIRS
    + """,
own AS (SELECT name AS query_term, arg_min(parent_id, first_idx) AS parent_id FROM parents GROUP BY name),
indexed AS (SELECT *, row_number() OVER (ORDER BY parent_id, md5(lower(trim(name))), md5('42~' || row_idx)) - 1 AS idx
            FROM children),
asked AS (SELECT p.row_idx, p.query_term, parent_id FROM positives p JOIN own USING (query_term)),
eligible AS (
  SELECT a.row_idx, a.query_term, i.name,
         row_number() OVER (PARTITION BY a.row_idx ORDER BY i.idx) - 1 AS at_row,
         count(*) OVER (PARTITION BY a.row_idx) AS n
  FROM asked a JOIN indexed i ON i.parent_id <> a.parent_id AND lower(trim(i.name)) <> lower(trim(a.query_term))),
negatives AS (
  SELECT row_idx, query_term, name AS matching_term FROM eligible
  WHERE at_row = ('0x' || substr(md5('42~' || row_idx), 1, 12))::bigint % n)"""
)


@query(
    "parent_child_pairs",
    "row_idx:bigint, query_term:string, matching_term:string, label:bigint",
    f"WITH {SQL_CODE_PAIRS} SELECT *, 1 AS label FROM positives",
)
def parent_child_pairs(t: Tables):
    return pr.parent_child_pairs(_codes(t))


@query(
    "negative_pairs",
    "row_idx:bigint, query_term:string, matching_term:string, label:bigint",
    f"WITH {SQL_NEGATIVES} SELECT *, 0 AS label FROM negatives",
)
def negative_pairs(t: Tables):
    codes = _codes(t)
    return pr.negative_pairs(codes, pr.parent_child_pairs(codes))


@query(
    "code_pairs",
    "query_term:string, matching_term:string, label:bigint",
    # the sample of positives is a feature: at most 2,500 pairs enter the set
    f"""WITH {SQL_NEGATIVES},
        chosen AS (SELECT * FROM positives ORDER BY md5('42~' || row_idx) LIMIT 2500)
        SELECT query_term, matching_term, 1 AS label FROM chosen
        UNION ALL
        SELECT n.query_term, n.matching_term, 0 FROM negatives n JOIN chosen c USING (row_idx)""",
)
def code_pairs(t: Tables):
    return pr.code_pairs(_codes(t))


@query(
    "pair_label_counts",
    "label:bigint, n:bigint",
    f"""WITH {SQL_NEGATIVES}, both_labels AS (SELECT 1 AS label FROM positives UNION ALL SELECT 0 FROM negatives)
        SELECT label, count(*) AS n FROM both_labels GROUP BY label""",
)
def pair_label_counts(t: Tables):
    codes = _codes(t)
    positives = pr.parent_child_pairs(codes)
    both = positives.unionByName(pr.negative_pairs(codes, positives))
    return both.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(
    "children_by_parent",
    "parent_id:string, children:bigint, first_child:string",
    f"""WITH {SQL_CODE_PAIRS} SELECT parent_id, count(*) AS children, min(name) AS first_child
        FROM children GROUP BY parent_id""",
)
def children_by_parent(t: Tables):
    _, children = pr._hierarchy(_codes(t))
    return children.groupBy("parent_id").agg(
        F.count("*").alias("children"), F.min("name").alias("first_child")
    )


# --- order, samples, splits, sets ---------------------------------------------


@query(
    "split_80_10_10",
    "doc_id:bigint, split:string",
    """WITH ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42~' || doc_id)) AS r,
                              count(*) OVER () AS n FROM documents)
       SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train'
              WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM ranked""",
)
def split_80_10_10(t: Tables):
    return sm.split(t.documents.select("doc_id"), F.col("doc_id"))


@query(
    "split_sizes",
    "split:string, rows:bigint, events:bigint",
    """WITH ranked AS (SELECT event_type, row_number() OVER (ORDER BY md5('42~' || event_id)) AS r,
                              count(*) OVER () AS n FROM events)
       SELECT CASE WHEN r <= floor(n * 0.8) THEN 'train'
              WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split,
              count(*) AS rows, count(DISTINCT event_type) AS events FROM ranked GROUP BY 1""",
)
def split_sizes(t: Tables):
    labelled = sm.split(t.events.select("event_id", "event_type"), F.col("event_id"))
    return labelled.groupBy("split").agg(
        F.count("*").alias("rows"), F.countDistinct("event_type").alias("events")
    )


@query(
    "seeded_sample",
    "o_orderkey:bigint",
    # a sampling operator: the limit is the feature
    "SELECT o_orderkey FROM orders ORDER BY md5('42~' || o_orderkey) LIMIT 2500",
)
def seeded_sample(t: Tables):
    return sm.seeded_sample(t.orders.select("o_orderkey"), F.col("o_orderkey"), lx.POSITIVE_PAIRS)


@query(
    "corpus_union",
    "source_idx:bigint, n:bigint, chars:bigint",
    """SELECT source_idx, count(*) AS n, sum(length(text)) AS chars FROM (
         SELECT 0 AS source_idx, text FROM documents UNION ALL SELECT 1, text FROM benchmark
         UNION ALL SELECT 2, text FROM conversations) GROUP BY source_idx""",
)
def corpus_union(t: Tables):
    from medloom.operators.corpus import unify

    def part(df, ident):
        tokens = F.array(F.struct(F.col("text").alias("word"), F.lit("O").alias("tag")))
        return df.select(ident.alias("sent_id"), tokens.alias("tokens"))

    merged = unify(
        [
            part(t.documents, F.col("doc_id").cast("string")),
            part(t.benchmark, F.col("item_id").cast("string")),
            part(t.conversations, F.concat_ws(".", "conv_id", "turn")),
        ]
    )
    return merged.groupBy("source_idx").agg(
        F.count("*").alias("n"), F.sum(F.length(F.get("tokens", F.lit(0))["word"])).alias("chars")
    )


@query(
    "set_algebra",
    "conv_id:bigint, turn:bigint, shared:bigint, added:bigint, lost:bigint, either:bigint",
    """WITH sets AS (SELECT conv_id, turn, list_distinct(list_filter(
               string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS s FROM conversations)
       SELECT a.conv_id, a.turn, len(list_intersect(a.s, b.s)) AS shared,
              len(list_filter(a.s, lambda w: NOT list_contains(b.s, w))) AS added,
              len(list_filter(b.s, lambda w: NOT list_contains(a.s, w))) AS lost,
              len(list_distinct(list_concat(a.s, b.s))) AS either
       FROM sets a JOIN sets b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
)
def set_algebra(t: Tables):
    sets = t.conversations.select("conv_id", "turn", tx.token_set(F.col("text")).alias("s"))
    before = sets.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("s").alias("b"))
    return sets.join(before, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.size(F.array_intersect("s", "b")).alias("shared"),
        F.size(F.array_except("s", "b")).alias("added"),
        F.size(F.array_except("b", "s")).alias("lost"),
        F.size(F.array_union("s", "b")).alias("either"),
    )


@query(
    "distinct_terms",
    "terms:bigint, items:bigint",
    f"WITH {SQL_TERMS} SELECT count(*) AS terms, count(DISTINCT item_id) AS items FROM terms",
)
def distinct_terms(t: Tables):
    return dictionary_terms(t).agg(
        F.countDistinct("word").alias("terms"), F.countDistinct("item_id").alias("items")
    )
