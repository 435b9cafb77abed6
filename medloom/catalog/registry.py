"""Registration of queries and their SQL counterparts.

A query lists its output columns and types; both sides are cast to them and
doubles are rounded to six places, on output only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(":")) for part in spec.split(",")]


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name; ``spec`` is ``column:type, ...``."""
    columns = _columns(spec)

    def output(df: DataFrame) -> DataFrame:
        def one(col: str, kind: str):
            value = F.col(col).cast(kind)
            # adding zero turns -0.0 into 0.0
            return (F.round(value, 6) + 0.0 if kind == "double" else value).alias(col)

        return df.select(*[one(c, k) for c, k in columns])

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: output(fn(Tables(spark, folder)))
        if sql is not None:
            cast = ", ".join(
                f'round("{c}"::double, 6) + 0.0 AS "{c}"' if k == "double" else f'"{c}"::{k} AS "{c}"'
                for c, k in columns
            )
            ORACLES[name] = f"SELECT {cast} FROM (\n{sql.strip()}\n) AS answer"
        return fn

    return register


# --- SQL text shared by the counterparts (data holds ASCII whitespace only) ---


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def sql_sentences(c: str) -> str:
    marked = f"regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"


def sql_term(c: str) -> str:
    return sql_collapse(f"trim(lower({c}), ' ' || chr(9) || chr(13) || chr(10) || '.,;:-()[]{{}}')")


SQL_LINES = r"""
lines AS (
  SELECT doc_id, i - 1 AS line_no, line,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents)
)"""

# words of the benchmark passages with at least five letters: the dictionary
SQL_TERMS = r"""
terms AS (
  SELECT word, min(item_id) AS item_id
  FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM benchmark)
  WHERE length(word) >= 5 GROUP BY word
)"""

# dictionary words at the start of a space-separated token, with offsets
SQL_MENTIONS = SQL_TERMS + r""",
pieces AS (
  SELECT doc_id, i, piece,
         coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \n]')) AS piece,
               generate_subscripts(string_split_regex(text, '[ \n]'), 1) AS i
        FROM documents)
),
mentions AS (
  SELECT p.doc_id, d.text, p.off::bigint AS start, (p.off + length(p.surface))::bigint AS stop, p.surface, t.item_id
  FROM (SELECT *, regexp_extract(piece, '^\p{L}+') AS surface FROM pieces) p
  JOIN terms t ON lower(p.surface) = t.word
  JOIN documents d ON d.doc_id = p.doc_id
)"""


# --- SQL text for the rules around a mention ----------------------------------


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(c: str, needles) -> str:
    return "(" + " OR ".join(f"contains({c}, {_lit(n)})" for n in needles) + ")"


def sql_flags(source: str, rules) -> str:
    """CTEs adding `in_clause` and `on_line` to rows with text, start, stop."""
    gaps = ", ".join(
        f"CASE WHEN contains(clause, {_lit(n)}) THEN instr(reverse(clause), reverse({_lit(n)})) - 1 + {len(n)} END"
        for n in rules.negators
    )
    between = "right(clause, gap)"
    for phrase in rules.blanked_phrases:
        between = f"replace({between}, {_lit(phrase)}, '')"
    first = " OR ".join(f"starts_with(line, {_lit(p)})" for p in rules.negated_line_starts)
    return f"""ctx AS (
  SELECT *, substr(text, 1, start) AS prefix, substr(text, stop + 1) AS suffix,
         lower(regexp_extract(substr(text, 1, start), '[^.;\n]*$')) AS clause
  FROM {source}),
gaps AS (
  SELECT *, least({gaps}) AS gap,
         lower({sql_strip("regexp_extract(prefix, '[^\n]*$') || substr(text, start + 1, stop - start) || regexp_extract(suffix, '^[^\n]*')")}) AS line
  FROM ctx),
flags AS (
  SELECT *, gap IS NOT NULL AND NOT {sql_any(between, rules.contrast_markers)} AS in_clause,
         ({first}) AS on_line
  FROM gaps)"""


def sql_bounds(c: str, rules) -> str:
    """A struct of the three section starts."""

    def first(pattern: str, miss: str) -> str:
        p = _lit(pattern)
        return (
            f"CASE WHEN regexp_matches({c}, {p}) THEN length(string_split_regex({c}, {p})[1]) ELSE {miss} END"
        )

    return (
        f"struct_pack(s1 := {first(rules.history_header, '-1')}, "
        f"s2 := {first(rules.present_header, f'length({c})')}, "
        f"s3 := {first(rules.hospital_header, f'length({c})')})"
    )


def sql_in(values) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def sql_keep(term: str, kind: str, rules) -> str:
    """The precision filter."""
    return f"""({term} <> ''
  AND NOT (length({term}) < 3 AND {term} NOT IN {sql_in(rules.short_terms)} AND coalesce({kind}, '') <> 'TÊN_XÉT_NGHIỆM')
  AND {term} NOT IN {sql_in(rules.generic_terms)}
  AND NOT (starts_with({term}, {_lit(rules.generic_prefix)}) AND len(string_split_regex({term}, '\\s+')) <= 2)
  AND NOT (coalesce({kind}, '') = 'THUỐC' AND regexp_full_match({term}, {_lit('(?i)' + rules.dose_only)})))"""


def sql_type(term: str, kind: str, disease: str, context: str, rules) -> str:
    return f"""CASE WHEN {sql_any(term, rules.test_phrases)} OR {term} IN {sql_in(rules.test_names)} THEN 'TÊN_XÉT_NGHIỆM'
  WHEN {disease} AND {sql_any(term, rules.symptoms)} THEN 'TRIỆU_CHỨNG'
  WHEN coalesce({kind}, '') = 'TÊN_XÉT_NGHIỆM' AND {context} THEN 'THUỐC' ELSE {kind} END"""


def sql_still_disease(term: str, disease: str, rules) -> str:
    return f"""({disease} AND NOT {sql_any(term, rules.symptoms)} AND NOT {sql_any(term, rules.test_phrases)}
  AND {term} NOT IN {sql_in(rules.test_names)})"""


def sql_context(start: str, stop: str, rules) -> str:
    """Drug context within 40 characters on either side."""
    left = f"lower(substr(text, greatest({start} - 40, 0) + 1, least({start}, 40)))"
    right = f"lower(substr(text, {stop} + 1, 40))"
    # word boundaries are ASCII in this dialect
    dose = rules.dose_after.replace("\\b", "(?:$|[^\\p{L}\\p{N}_])")
    return (
        f"(regexp_matches({right}, {_lit(dose)}) OR regexp_matches({left}, {_lit(rules.drug_before)}))"
    )
