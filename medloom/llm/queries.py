"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm import (
    decontaminate,
    line_dedup,
    mixing,
    near_dedup,
    ngram_join,
    periodic_runs,
    preferences,
    prefix_trie,
    token_scan,
    toxicity,
    url_rules,
    warc,
)
from medloom.llm import exact_dedup as exact
from medloom.llm.common import TOKEN, WORD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(read)``; ``read(table)`` is a table of the given folder."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


SQL_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_LINE_DEDUP = rf"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM split
), plain AS (
  SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS plain
  FROM raw
), masked AS (
  SELECT *, list_transform(plain, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS masked FROM plain
), lines AS (
  SELECT doc_id, line_no,
         CASE WHEN len(list_filter(masked, lambda t: t <> '<*>')) >= {line_dedup.SIMILARITY}::double * len(masked)
              THEN masked ELSE plain END AS tokens
  FROM masked
), parsed AS (
  SELECT doc_id, line_no, tokens, [len(tokens)::varchar] || tokens[1:{line_dedup.DEPTH}] AS leaf
  FROM lines WHERE len(tokens) > 0
), kinds AS (
  SELECT leaf, tokens, count(DISTINCT doc_id) AS docs FROM parsed GROUP BY leaf, tokens
), fields AS (
  SELECT leaf, tokens, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY leaf) AS n, sum(docs) OVER (PARTITION BY leaf) AS all_docs FROM kinds)
  WHERE n > 1 AND all_docs >= {line_dedup.SUPPORT}
), marked AS (
  SELECT *, sum(docs) OVER (PARTITION BY leaf, place, token) < {line_dedup.SUPPORT} AS varies FROM fields
), general AS (
  SELECT tokens, list(CASE WHEN varies THEN '<*>' ELSE token END ORDER BY place) AS template
  FROM marked GROUP BY tokens
  HAVING count(*) FILTER (varies) > 0
    AND count(*) FILTER (NOT varies AND token <> '<*>') >= {line_dedup.SIMILARITY}::double * len(tokens)
), named AS (
  SELECT p.doc_id, p.line_no,
         CASE WHEN g.template IS NULL THEN ['l'] || p.tokens ELSE ['t'] || g.template END AS template
  FROM parsed p LEFT JOIN general g ON p.tokens = g.tokens
), first AS (
  SELECT template, count(DISTINCT doc_id) AS docs, min(doc_id) AS doc_id FROM named GROUP BY template
), gone AS (
  SELECT n.doc_id, n.line_no,
         f.docs >= {line_dedup.MIN_DOCS}
           AND NOT (n.doc_id = f.doc_id AND n.line_no = min(n.line_no) OVER (PARTITION BY n.template, n.doc_id)) AS dropped
  FROM named n JOIN first f ON n.template = f.template
), decided AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         list(line_no) FILTER (dropped) AS lines
  FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       sha256(CASE WHEN n_dropped > 0 THEN array_to_string(
         list_filter(string_split(text, chr(10)), lambda l, i: NOT list_contains(c.lines, i - 1)), chr(10)) ELSE text END) AS text_sha256
FROM documents d LEFT JOIN decided c ON d.doc_id = c.doc_id
"""


@query("op1_line_dedup", SQL_LINE_DEDUP)
def _op1(read):
    docs = read("documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


SQL_DECONTAMINATION = rf"""
WITH item_words AS (
  SELECT item_id::varchar AS item_id, regexp_extract_all({SQL_FOLD.format("text")}, '{WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS n,
               unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS i
        FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all({SQL_FOLD.format("text")}, '{WORD}'), []) AS w FROM documents
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.gram = w.gram
), hit AS (
  SELECT doc_id, count(DISTINCT at_word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS at_word FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


@query("op2_decontamination", SQL_DECONTAMINATION)
def _op2(read):
    found = decontaminate.find_hits(read("documents").select("doc_id", "text"), read("benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


SQL_EXACT = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {SQL_FOLD.format("coalesce(text, '')")} AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


@query("op3_exact_dedup", SQL_EXACT)
def _op3(read):
    return exact.exact_dedup(read("documents"))


# all pairs of texts that share a shingle; for tables of some thousand texts
SQL_NEAR = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all({SQL_FOLD.format("text")}, '{WORD}'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {near_dedup.SHINGLE - 1}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {near_dedup.SHINGLE - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE common.n >= {near_dedup.SIMILARITY} * (x.n + y.n - common.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS root FROM docs
  UNION
  SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.doc_id
), classes AS (
  SELECT doc_id, min(root) AS class_id FROM reached GROUP BY doc_id
)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM classes
"""


@query("op4_near_dedup", SQL_NEAR)
def _op4(read):
    return near_dedup.near_dedup(read("documents").select("doc_id", "text"))


SQL_MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('7~' || doc_id::varchar) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::bigint AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int] AS weight
  FROM docs GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::double AS level
  FROM sources WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), targets AS (
  SELECT source, source_size, least(3.0::double * source_size, max(level) OVER () * weight) AS target FROM levels
), cut AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::bigint AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         size * (budget // source_size) + greatest(0, least(size, budget % source_size - before)) END AS taken
FROM cut
"""


@query("op5_mixing", SQL_MIXING)
def _op5(read):
    return mixing.mix(read("documents").select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


SQL_WARC = f"""
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), grouped AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS first
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM grouped
"""


@query("op6_warc", SQL_WARC)
def _op6(read):
    return warc.archive_pages(read("pages").select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op7_token_counts")
def _op7(read):
    return token_scan.count_tokens(read("documents").select("doc_id", "text"))


SQL_PREFERENCES = """
WITH chosen AS (
  SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), echo AS (
  SELECT pair_id, min(turn) FILTER (role = 'user') AS first, max(turn) FILTER (role = 'assistant') AS reply
  FROM chosen GROUP BY pair_id
), rejected AS (
  SELECT c.pair_id, c.turn, c.role,
         CASE WHEN c.role = 'assistant' AND c.turn = e.reply AND f.text IS NOT NULL THEN f.text ELSE c.text END AS text
  FROM chosen c JOIN echo e ON c.pair_id = e.pair_id
  LEFT JOIN chosen f ON f.pair_id = e.pair_id AND f.turn = e.first
), turns AS (
  SELECT *, 'chosen' AS side FROM chosen UNION ALL SELECT *, 'rejected' AS side FROM rejected
), ends AS (
  SELECT pair_id, min(turn) AS stop
  FROM (SELECT pair_id, turn FROM turns GROUP BY pair_id, turn HAVING count(*) < 2 OR count(DISTINCT (role, text)) > 1)
  GROUP BY pair_id
), marked AS (
  SELECT t.*, e.stop IS NULL OR t.turn < e.stop AS shared FROM turns t LEFT JOIN ends e ON t.pair_id = e.pair_id
)
SELECT pair_id, CASE WHEN shared THEN 'prompt' ELSE side END AS part, turn, 1 AS n, role,
       '<|' || role || '|>' || chr(10) || text || chr(10) AS text,
       CASE WHEN NOT shared AND role = 'assistant' THEN length(role) + 5 ELSE length(role) + length(text) + 6 END::int AS masked
FROM marked WHERE NOT shared OR side = 'chosen'
"""


@query("op8_preferences", SQL_PREFERENCES)
def _op8(read):
    return preferences.preference_turns(*preferences.echo_pairs(read("conversations")))


SQL_RULES = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in url_rules.RULES)
SQL_URLS = rf"""
WITH rules AS (
  SELECT verdict, rule, regexp_extract(rule, '^[^/]*') AS rule_host, regexp_extract(rule, '/.*$') AS rule_path
  FROM (VALUES {SQL_RULES}) AS r(verdict, rule)
), rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, {SQL_FOLD.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, '{url_rules.DEFAULT}') AS verdict
FROM urls u LEFT JOIN best b ON u.host = b.host AND u.path = b.path
"""


@query("op9_url_rules", SQL_URLS)
def _op9(read):
    return url_rules.judge(read("pages"))


@query("op10_toxicity")
def _op10(read):
    docs = read("documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, read("labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "starts", "ends")


# all pairs of texts that share a shingle, as for op4
SQL_NGRAMS = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all({SQL_FOLD.format("text")}, '{TOKEN}'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {ngram_join.SHINGLE - 1}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {ngram_join.SHINGLE - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= {ngram_join.PERCENT} * (x.n + y.n - common.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS root FROM docs
  UNION
  SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.root) AS component_id
FROM reached r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id
"""


@query("op11_ngram_join", SQL_NGRAMS)
def _op11(read):
    return ngram_join.ngram_join(read("documents"))


# crc32 bit by bit
SQL_CRC = """xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint,
    list_transform(string_split({}, ''), lambda ch: ascii(ch)::ubigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::ubigint, 1, 2, 3, 4, 5, 6, 7]),
      lambda x, k: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384::ubigint ELSE 0::ubigint END))))"""

SQL_TRIE = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {SQL_CRC.format("conv_id::varchar")} % 6 AS h
  FROM own GROUP BY conv_id
), rows AS (
  SELECT c.conv_id, b.pos, b.role, b.text FROM convs c JOIN own b ON b.conv_id = c.base AND b.pos < c.h
  UNION ALL
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h
), built AS (
  SELECT c.conv_id, coalesce(s, []) AS s
  FROM convs c LEFT JOIN (
    SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS s FROM rows GROUP BY conv_id
  ) r ON c.conv_id = r.conv_id
), steps AS (
  SELECT conv_id, d, s[1:d] AS node, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)
), nodes AS (
  SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN any_value(d) = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(node[d].text)) END AS saved
  FROM steps GROUP BY node
), kids AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), sums AS (
  SELECT s[1:k] AS node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT n.node AS s, saved, kids.n IS NULL AS leaf, unnest(range(0, depth + 1)) AS k FROM nodes n LEFT JOIN kids ON n.node = kids.node)
  GROUP BY 1
)
SELECT n.conv_id, n.depth::bigint AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
       n_leaves, saved_tokens::bigint AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON n.node = s.node LEFT JOIN kids ON n.node = kids.node
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
"""


@query("op12_prefix_trie", SQL_TRIE)
def _op12(read):
    return prefix_trie.prefix_trie(*prefix_trie.regrown(read("conversations")))


@query("op13_periodic_runs")
def _op13(read):
    return periodic_runs.periodic_runs(read("documents"), rewrite=True)
