"""Vector arithmetic, retrieval and linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.catalog.registry import Tables, query
from medloom.functions import similarity as sim
from medloom.functions import text as tx
from medloom.functions import vector as vc
from medloom.operators import linking as ln
from medloom.operators.pruned_knn import pruned_knn, visited_share
from medloom.plans.models import NgramEncoder, dictionary_vectors

# Query vectors: a vector counted twice, pooled with the next one and scaled.
SQL_QUERIES = """next AS (
  SELECT a.vec_id, a.label, b.label AS next_label, a.embedding::double[] AS a, b.embedding::double[] AS b
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
pooled AS (
  SELECT vec_id, label, next_label,
         list_transform(range(1, len(a) + 1), lambda i: (2 * a[i] + b[i]) / 3) AS vector FROM next)"""


def queries(t: Tables):
    """``query_id, label, next_label, vector`` for every vector that has a next one."""
    here = t.embeddings.select("vec_id", "label", F.col("embedding").alias("a"))
    after = t.embeddings.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("next_label"),
        F.col("embedding").alias("b"),
    )
    pooled = vc.mean_pool(
        F.array("a", "a", "b", "b"), F.array(*[F.lit(x) for x in (1.0, 1.0, 1.0, 0.0)])
    )
    return here.join(after, "vec_id").select(
        F.col("vec_id").alias("query_id"), "label", "next_label", vc.unit(pooled).alias("vector")
    )


def concepts(t: Tables):
    """Vectors with the wording and concept id of the part of the same number."""
    name = F.col("p_name")
    cui = (
        F.when(F.col("p_size") < 5, "")
        .when(F.col("p_size") < 10, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("C"), F.col("p_partkey").cast("string")))
    )
    return t.embeddings.join(t.part, F.col("vec_id") == F.col("p_partkey")).select(
        F.col("vec_id").alias("row_idx"),
        F.col("label").alias("macro_type"),
        F.concat(name, F.lit(" "), F.lower("p_type")).alias("entity"),
        cui.alias("mapped_cui"),
        F.col("embedding").alias("vector"),
    )


SQL_CONCEPTS = """concepts AS (
  SELECT vec_id AS row_idx, label AS macro_type, p_name || ' ' || lower(p_type) AS entity,
         CASE WHEN p_size < 5 THEN '' WHEN p_size < 10 THEN NULL ELSE 'C' || p_partkey END AS mapped_cui,
         embedding::double[] AS vector
  FROM embeddings JOIN part ON vec_id = p_partkey)"""


#: small cells, as the given dictionary has few rows
CELL_ROWS = 64


@query(
    "unit_vectors",
    "vec_id:bigint, dim:bigint, value:double, norm:double",
    """WITH scaled AS (SELECT vec_id, list_transform(embedding::double[], lambda x: x * (label + 1)) AS v
                       FROM embeddings),
            normed AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM scaled)
       SELECT vec_id, unnest(list_transform(v, lambda x: x / norm)) AS value,
              generate_subscripts(v, 1) - 1 AS dim, norm FROM normed""",
)
def unit_vectors(t: Tables):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    return (
        t.embeddings.select("vec_id", scaled.alias("v"))
        .select("vec_id", vc.norm(F.col("v")).alias("norm"), F.posexplode(vc.unit(F.col("v"))).alias("dim", "value"))
    )


@query(
    "mean_pool",
    "vec_id:bigint, dim:bigint, value:double",
    f"""WITH {SQL_QUERIES} SELECT vec_id, unnest(vector) AS value, generate_subscripts(vector, 1) - 1 AS dim
        FROM pooled""",
)
def mean_pool(t: Tables):
    here = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    mask = F.array(*[F.lit(x) for x in (1.0, 1.0, 1.0, 0.0)])
    return here.join(after, "vec_id").select(
        "vec_id", F.posexplode(vc.mean_pool(F.array("a", "a", "b", "b"), mask)).alias("dim", "value")
    )


@query(
    "cosine_pairs",
    "vec_id:bigint, sim:double",
    """SELECT a.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS sim
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(t: Tables):
    here = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return here.join(after, "vec_id").select("vec_id", vc.cosine(F.col("a"), F.col("b")).alias("sim"))


_SQL_RANKED = f"""{SQL_QUERIES},
sims AS (
  SELECT q.vec_id AS query_id, d.vec_id AS row_idx, list_cosine_similarity(q.vector, d.embedding::double[]) AS sim
  FROM pooled q, embeddings d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_idx) AS rk FROM sims)"""


def _dictionary(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("row_idx"), "label", F.col("embedding").alias("vector"))


@query(
    "knn_top3",
    "query_id:bigint, row_idx:bigint, rk:bigint, sim:double",
    f"WITH {_SQL_RANKED} SELECT query_id, row_idx, rk, sim FROM ranked WHERE rk <= 3",
)
def knn_top3(t: Tables):
    return ln.knn(queries(t), _dictionary(t), lx.RETRIEVED)


@query(
    "pruned_knn_top3",
    "query_id:bigint, row_idx:bigint, rk:bigint, sim:double",
    f"WITH {_SQL_RANKED} SELECT query_id, row_idx, rk, sim FROM ranked WHERE rk <= 3",
)
def pruned_knn_top3(t: Tables):
    """The same rows, found in cells around pivots."""
    return pruned_knn(queries(t), _dictionary(t), lx.RETRIEVED, cell_rows=CELL_ROWS)[0]


def pruned_share(t: Tables) -> float:
    """Pairs of query and row that ``pruned_knn_top3`` compares, of all."""
    _, visits = pruned_knn(queries(t), _dictionary(t), lx.RETRIEVED, cell_rows=CELL_ROWS)
    return visited_share(visits, queries(t).count(), _dictionary(t).count())


@query(
    "knn_argmax",
    "query_id:bigint, row_idx:bigint, sim:double",
    f"WITH {_SQL_RANKED} SELECT query_id, row_idx, sim FROM ranked WHERE rk = 1",
)
def knn_argmax(t: Tables):
    return ln.knn(queries(t), _dictionary(t), 1)


@query(
    "similarity_cutoff",
    "query_id:bigint, row_idx:bigint, sim:double",
    f"""WITH {_SQL_RANKED} SELECT query_id, row_idx, sim FROM ranked WHERE rk <= 3 AND sim >= 0.3""",
)
def similarity_cutoff(t: Tables):
    return ln.knn(queries(t), _dictionary(t), lx.RETRIEVED, floor=0.3)


@query(
    "class_nearest_link",
    "query_id:bigint, cui:string, sim:double",
    f"""WITH {SQL_QUERIES}, {SQL_CONCEPTS},
        ranked AS (
          SELECT q.vec_id AS query_id, c.mapped_cui AS cui, list_cosine_similarity(q.vector, c.vector) AS sim,
                 row_number() OVER (PARTITION BY q.vec_id
                   ORDER BY list_cosine_similarity(q.vector, c.vector) DESC, c.row_idx) AS rk
          FROM pooled q JOIN concepts c ON q.next_label = c.macro_type WHERE c.mapped_cui IS NOT NULL)
        SELECT query_id, cui, sim FROM ranked WHERE rk = 1 AND sim > 0.4 AND cui <> ''""",
)
def class_nearest_link(t: Tables):
    asked = queries(t).withColumn("macro_type", F.col("next_label"))
    return ln.link_nearest(asked, concepts(t), floor=0.4)


def _mentions(t: Tables):
    """Query vectors worded like the part after their own, in their own class."""
    names = t.part.select(
        (F.col("p_partkey") - 1).alias("query_id"), F.col("p_name").alias("term")
    )
    return queries(t).withColumn("macro_type", F.col("label")).join(names, "query_id")


SQL_OVERLAP = """len(list_intersect(list_distinct(string_split(term, ' ')), list_distinct(string_split(entity, ' '))))::double
  / len(list_distinct(list_concat(string_split(term, ' '), string_split(entity, ' '))))"""


@query(
    "class_masked_link",
    "query_id:bigint, canonical_name:string, cui:string, similarity:double",
    f"""WITH {SQL_QUERIES}, {SQL_CONCEPTS},
        mentions AS (SELECT q.*, p_name AS term FROM pooled q JOIN part ON p_partkey = vec_id + 1),
        near AS (
          SELECT m.vec_id, c.row_idx, c.entity, nullif(c.mapped_cui, '') AS cui, {SQL_OVERLAP} AS overlap,
                 list_cosine_similarity(m.vector, c.vector) AS sim
          FROM mentions m JOIN concepts c ON m.label = c.macro_type),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY overlap DESC, row_idx) AS rk
                   FROM near WHERE sim > 0.15)
        SELECT m.vec_id AS query_id, coalesce(r.entity, m.term) AS canonical_name, r.cui,
               coalesce(r.sim, 1.0) AS similarity
        FROM mentions m LEFT JOIN ranked r ON r.vec_id = m.vec_id AND r.rk = 1""",
)
def class_masked_link(t: Tables):
    return ln.link_by_class(_mentions(t), concepts(t), floor=0.15)


@query(
    "hybrid_rerank",
    "query_id:bigint, row_idx:bigint, sim:double, hybrid:double",
    f"""WITH {_SQL_RANKED}, {SQL_CONCEPTS},
        scored AS (
          SELECT r.query_id, r.row_idx, r.rk, r.sim, r.sim + 0.5 * ({SQL_OVERLAP.replace('term', 'p.p_name').replace('entity', 'c.entity')}) AS hybrid
          FROM ranked r JOIN concepts c USING (row_idx) JOIN part p ON p.p_partkey = r.query_id + 1
          WHERE r.rk <= 3 AND r.sim >= 0.2),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, rk) AS b FROM scored)
        SELECT query_id, row_idx, sim, hybrid FROM best WHERE b = 1""",
)
def hybrid_rerank(t: Tables):
    hits = ln.knn(queries(t), _dictionary(t), lx.RETRIEVED)
    worded = hits.join(concepts(t).select("row_idx", "entity"), "row_idx").join(
        _mentions(t).select("query_id", "term"), "query_id"
    )
    return ln.rerank(
        worded, tx.token_jaccard(F.col("term"), F.col("entity")), floor=0.2, keep=("row_idx",)
    )


# The gestalt ratio has no SQL form; tests check it and the re-ranking apart.
@query("gestalt_rerank", "query_id:bigint, row_idx:bigint, sim:double, hybrid:double")
def gestalt_rerank(t: Tables):
    hits = ln.knn(queries(t), _dictionary(t), lx.RETRIEVED)
    worded = hits.join(concepts(t).select("row_idx", "entity", "mapped_cui"), "row_idx").join(
        _mentions(t).select("query_id", "term"), "query_id"
    )
    lexical = sim.best_lexical(F.col("term"), F.col("entity"), F.col("mapped_cui"))
    scored = worded.withColumn("lexical", lexical)
    return ln.rerank(scored, F.col("lexical"), floor=0.2, keep=("row_idx",))


@query(
    "dual_retrieval",
    "query_id:bigint, type:string, candidates:string",
    f"""WITH {SQL_QUERIES},
        sims AS (
          SELECT q.vec_id AS query_id, d.vec_id AS row_idx, d.label < 5 AS diagnosis,
                 list_cosine_similarity(q.vector, d.embedding::double[]) AS sim
          FROM pooled q, embeddings d),
        best AS (SELECT query_id, max(sim) FILTER (diagnosis) AS d, max(sim) FILTER (NOT diagnosis) AS s,
                        arg_max(row_idx, sim) FILTER (diagnosis) AS id FROM sims GROUP BY query_id)
        SELECT query_id, CASE WHEN d >= s AND d >= 0.5 THEN 'CHẨN_ĐOÁN' ELSE 'TRIỆU_CHỨNG' END AS type,
               CASE WHEN d >= s AND d >= 0.5 THEN id::varchar ELSE '' END AS candidates FROM best""",
)
def dual_retrieval(t: Tables):
    """One half of the classes is the diagnosis dictionary, the other the symptoms."""
    q, d = queries(t), _dictionary(t)
    diagnosis = ln.knn(q, d.where(F.col("label") < 5), 1).withColumn("id", F.col("row_idx"))
    symptom = ln.knn(q, d.where(F.col("label") >= 5), 1, floor=lx.DIAGNOSIS_FLOOR)
    return ln.dual_link(q.select("query_id"), diagnosis, symptom).withColumn(
        "candidates", F.array_join("candidates", "|")
    )


@query(
    "candidate_ids",
    "p_brand:string, kept:string, parts:bigint, n:bigint",
    """WITH ids AS (SELECT p_brand, string_agg(DISTINCT p_size::varchar, '|' ORDER BY p_size::varchar)
                      FILTER (p_size > 45) AS id FROM part GROUP BY p_brand)
       SELECT p_brand, coalesce(id, '') AS kept, CASE WHEN id IS NULL THEN 0 ELSE 1 END AS parts,
              CASE WHEN id IS NULL THEN 0 ELSE len(string_split(id, '|')) END AS n FROM ids""",
)
def candidate_ids(t: Tables):
    sizes = F.collect_set(F.when(F.col("p_size") > 45, F.col("p_size").cast("string")))
    ids = t.part.groupBy("p_brand").agg(
        F.array_join(F.sort_array(sizes), "|").alias("id")
    )
    return ids.select(
        "p_brand",
        F.array_join(ln.as_candidates(F.col("id")), ",").alias("kept"),
        F.size(ln.as_candidates(F.col("id"))).alias("parts"),
        F.size(ln.as_candidates(F.col("id"), split_ids=True)).alias("n"),
    )


@query(
    "dictionary_vectors",
    "name:string, dim:bigint, value:double",
    """WITH names AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part),
        grams AS (
          SELECT name, substr('^' || lower(name) || '$', i::int, 3) AS g
          FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM names)),
        counts AS (SELECT name, ('0x' || substr(md5(g), 1, 8))::bigint % 32 AS dim, count(*) AS n
                   FROM grams GROUP BY ALL),
        norms AS (SELECT name, sqrt(sum(n * n)) AS norm FROM counts GROUP BY name)
        SELECT n.name, d.dim, coalesce(c.n, 0) / n.norm AS value
        FROM norms n CROSS JOIN range(32) d(dim) LEFT JOIN counts c ON c.name = n.name AND c.dim = d.dim""",
)
def dictionary_vectors_query(t: Tables):
    names = t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    vectors = dictionary_vectors(names, "name", NgramEncoder(dims=32))
    return vectors.select("name", F.posexplode("vector").alias("dim", "value"))


