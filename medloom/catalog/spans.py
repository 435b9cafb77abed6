"""Overlap removal and recovery of missed mentions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.catalog.inputs import RULES, document_lines, with_mentions
from medloom.catalog.registry import (
    SQL_LINES, SQL_MENTIONS, Tables, query, sql_any, sql_bounds, sql_in, sql_term, sql_words,
)
from medloom.functions import context as cx
from medloom.functions import text as tx
from medloom.operators import sequence as sq
from medloom.operators import spans as sp

# phrases of one to three words of the benchmark passages, six characters or more,
# wherever they stand in a document: nested and overlapping
SQL_PHRASES = """
parts AS (
  SELECT item_id, string_split_regex(lower(text), '[ \\n]') AS ps FROM benchmark
),
phrases AS (
  SELECT phrase, min(item_id) AS item_id
  FROM (SELECT item_id, array_to_string(ps[i:i + n - 1], ' ') AS phrase
        FROM (SELECT item_id, ps, n, unnest(range(1, len(ps) - n + 2)) AS i FROM parts, (VALUES (1), (2), (3)) AS v(n)))
  WHERE length(phrase) >= 6 GROUP BY phrase
),
pieces AS (
  SELECT doc_id, i, piece, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS off
  FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS piece,
               generate_subscripts(string_split_regex(text, '[ \\n]'), 1) AS i FROM documents)
),
runs AS (
  SELECT doc_id, off AS start, n, CASE n WHEN 1 THEN lower(piece) WHEN 2 THEN lower(piece || ' ' || p2)
         ELSE lower(piece || ' ' || p2 || ' ' || p3) END AS phrase
  FROM (SELECT *, lead(piece, 1) OVER w AS p2, lead(piece, 2) OVER w AS p3 FROM pieces
        WINDOW w AS (PARTITION BY doc_id ORDER BY i)), (VALUES (1), (2), (3)) AS v(n)
),
spans AS (
  SELECT r.doc_id, r.start, (r.start + length(r.phrase))::bigint AS stop, p.item_id FROM runs r JOIN phrases p USING (phrase)
)"""


#: the words of a phrase at most, the characters at least
PHRASE_WORDS, PHRASE_CHARS = 3, 6
#: characters of texts that are cut into phrases together
TEXTS_AT_ONCE = 1 << 16


def _runs(df: DataFrame, key: str) -> DataFrame:
    """``key, start, phrase``: the phrases of a ``text`` in lower case and where they begin.

    Texts are cut at blanks and ends of lines, for Arrow batches of them.
    """

    def phrases(text: str, low: str) -> tuple[np.ndarray, list[str]]:
        sizes = lambda s: np.fromiter(map(len, s.replace("\n", " ").split(" ")), np.int64)
        flat, folded = low.replace("\n", " "), sizes(low)
        ends = np.cumsum(folded + 1) - 1
        begins = ends - folded
        # a letter may have another length in lower case
        starts = begins if len(low) == len(text) and low.isascii() else np.cumsum(plain := sizes(text) + 1) - plain
        at, found = [], []
        for n in range(min(PHRASE_WORDS, len(ends))):
            first, last = begins[: len(begins) - n], ends[n:]
            kept = np.flatnonzero(last - first >= PHRASE_CHARS)
            at.append(starts[kept])
            found += [flat[i:j] for i, j in zip(first[kept].tolist(), last[kept].tolist(), strict=True)]
        return np.concatenate(at), found

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, found, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                of = np.repeat([r for r, _ in rows], [n for _, n in rows])
                fields = [batch.column(key).take(pa.array(of, pa.int64())), pa.array(np.concatenate(starts), pa.int32()), pa.array(found, pa.string())]
                return pa.RecordBatch.from_arrays(fields, [key, "start", "phrase"])

            for row, (text, low) in enumerate(zip(batch.column("text").to_pylist(), batch.column("low").to_pylist(), strict=True)):
                if text is None:
                    continue
                at, some = phrases(text, low)
                rows.append((row, len(some)))
                starts.append(at)
                found += some
                held += len(text)
                if held >= TEXTS_AT_ONCE:
                    yield out()
                    rows, starts, found, held = [], [], [], 0
            if rows:
                yield out()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "text", F.lower("text").alias("low")).mapInArrow(cut, f"{key} {kind}, start int, phrase string")


def phrase_spans(t: Tables):
    """``doc_id, start, end, item_id`` of all phrases, overlapping as they come."""
    phrases = _runs(t.benchmark, "item_id").groupBy("phrase").agg(F.min("item_id").alias("item_id"))
    return _runs(t.documents, "doc_id").join(phrases, "phrase").select(
        "doc_id", "start", (F.col("start") + F.length("phrase")).alias("end"), "item_id"
    )


@query(
    "overlap_islands",
    "doc_id:bigint, island:bigint, start:bigint, end:bigint, item_id:bigint, members:bigint",
    f"""WITH {SQL_PHRASES},
        reached AS (
          SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
          FROM spans),
        numbered AS (
          SELECT *, sum(CASE WHEN r IS NULL OR start >= r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop
                  ROWS UNBOUNDED PRECEDING) - 1 AS island FROM reached)
        SELECT doc_id, island, b.start, b.stop AS "end", b.item_id, members
        FROM (SELECT doc_id, island, count(*) AS members, arg_min(struct_pack(start, stop, item_id),
                     struct_pack(n := start - stop, start, item_id)) AS b FROM numbered GROUP BY doc_id, island)""",
)
def overlap_islands(t: Tables):
    """The longest phrase of each group of overlapping ones."""
    return sp.overlap_islands(phrase_spans(t), ["doc_id"])


@query(
    "overlap_best",
    "doc_id:bigint, start:bigint, end:bigint, item_id:bigint",
    f"""WITH RECURSIVE {SQL_PHRASES},
        sorted AS (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stop, start, item_id) AS i FROM spans),
        placed AS (
          SELECT a.doc_id, a.i, a.start, a.stop, a.item_id, count(b.i) AS before
          FROM sorted a LEFT JOIN sorted b ON a.doc_id = b.doc_id AND b.stop <= a.start GROUP BY ALL),
        dp AS (
          SELECT doc_id, 0::bigint AS i, [0::bigint] AS best, []::boolean[] AS taken FROM placed GROUP BY doc_id
          UNION ALL
          SELECT d.doc_id, p.i,
                 d.best || [greatest(d.best[d.i + 1], d.best[p.before + 1] + p.stop - p.start)],
                 d.taken || [d.best[p.before + 1] + p.stop - p.start > d.best[d.i + 1]]
          FROM dp d JOIN placed p ON p.doc_id = d.doc_id AND p.i = d.i + 1),
        done AS (SELECT doc_id, max(i) AS n, arg_max(taken, i) AS taken FROM dp GROUP BY doc_id),
        back AS (
          SELECT doc_id, n AS i FROM done
          UNION ALL
          SELECT b.doc_id, CASE WHEN d.taken[b.i] THEN p.before ELSE b.i - 1 END
          FROM back b JOIN done d ON d.doc_id = b.doc_id JOIN placed p ON p.doc_id = b.doc_id AND p.i = b.i WHERE b.i > 0)
        SELECT p.doc_id, p.start, p.stop AS "end", p.item_id
        FROM back b JOIN done d ON d.doc_id = b.doc_id JOIN placed p ON p.doc_id = b.doc_id AND p.i = b.i WHERE d.taken[b.i]""",
)
def overlap_best(t: Tables):
    """The disjoint phrases that cover most characters."""
    return sp.overlap_best(phrase_spans(t), ["doc_id"], F.col("end") - F.col("start"))


# stand-ins for bullets and colons, which the tables lack
ITEM = r"^((?:[A-Z][a-z]* ))(.*\S)\s*$"
NAMED = r"^()([^,]*[^,\s])(\s*,\s*)(\S.*)$"
WORDS = 40


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NAME = sql_term(f"regexp_extract(line, {_lit(NAMED)}, 2)")
_IS_TEST = f"({sql_any(_NAME, RULES.test_phrases)} OR {_NAME} IN {sql_in(RULES.test_names)})"


def _sql_target(pattern: str, before: tuple[int, ...], of: int, kind: str, target: str, where: str) -> str:
    skipped = " + ".join(f"length(regexp_extract(line, {_lit(pattern)}, {i}))" for i in before)
    text = f"regexp_extract(line, {_lit(pattern)}, {of})"
    return f"""SELECT doc_id, line_start + {skipped} AS start, line_start + {skipped} + length({text}) AS stop, {text} AS piece,
          '{kind}' AS kind, '{target}' AS target FROM bounded WHERE regexp_matches(line, {_lit(pattern)}) AND {where}"""


_ITEM_TEXT = f"regexp_extract(line, {_lit(ITEM)}, 2)"


@query(
    "recovered_mentions",
    "doc_id:bigint, start:bigint, end:bigint, text:string, kind:string",
    f"""WITH {SQL_LINES}, {SQL_MENTIONS},
        bounded AS (SELECT l.*, b.s2, b.s3 FROM lines l
                    JOIN (SELECT doc_id, unnest({sql_bounds('text', RULES)}) FROM documents) b ON l.doc_id = b.doc_id),
        targets AS (
          {_sql_target(ITEM, (1,), 2, "TRIỆU_CHỨNG", "item",
                       f"line_start >= s2 AND line_start < s3 AND len({sql_words(_ITEM_TEXT)}) <= {WORDS} AND {sql_any(sql_term(_ITEM_TEXT), RULES.symptoms)}")}
          UNION ALL
          {_sql_target(NAMED, (1,), 2, "TÊN_XÉT_NGHIỆM", "name", f"line_start >= s3 AND {_IS_TEST}")}
          UNION ALL
          {_sql_target(NAMED, (1, 2, 3), 4, "KẾT_QUẢ_XÉT_NGHIỆM", "value", f"line_start >= s3 AND {_IS_TEST}")}),
        met AS (
          SELECT t.doc_id, t.start, t.stop, t.piece, t.kind, t.target, min(CASE WHEN m.start IS NOT NULL THEN greatest(m.start, t.start) END) AS hit
          FROM targets t LEFT JOIN mentions m ON m.doc_id = t.doc_id AND m.start < t.stop AND m.stop > t.start GROUP BY ALL),
        cut AS (
          SELECT *, rtrim(CASE WHEN target = 'value' THEN substr(piece, 1, (coalesce(hit, stop) - start)::bigint) ELSE piece END,
                          ' ' || chr(9) || chr(13)) AS kept
          FROM met WHERE hit IS NULL OR target = 'value')
        SELECT doc_id, start, start + length(kept) AS "end", kept AS text, kind FROM cut WHERE kept <> ''""",
)
def recovered_mentions(t: Tables):
    """What dictionary words leave free in list items and named values."""
    found = with_mentions(t).select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.start", "m.end")
    sections = t.documents.select("doc_id", cx.section_bounds(F.col("text"), RULES).alias("bounds"), F.length("text").alias("size"))
    lines = document_lines(t).join(sections, "doc_id").select("doc_id", F.col("line_start").alias("start"), "line", "bounds")
    targets = sp.recovery_targets(lines, ["doc_id"], RULES, ITEM, NAMED, WORDS)
    return sp.recovered_mentions(found, sections.select("doc_id", "size"), targets, ["doc_id"])
