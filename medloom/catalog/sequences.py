"""Tags, spans and offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.catalog.inputs import (
    SQL_RAW_TAG, dictionary_terms, document_lines, raw_tag, tagged_lines, with_mentions,
)
from medloom.catalog.registry import (
    SQL_LINES, SQL_MENTIONS, SQL_TERMS, Tables, query, sql_words,
)
from medloom.functions import text as tx
from medloom.operators import corpus as cp
from medloom.operators import sequence as sq
from medloom.operators.metrics import span_prf
from medloom.operators.wordpiece import with_pieces
from medloom.plans.models import LexiconAnnotator
from medloom.sources import readers

# words of every line with the raw tag, one row each
SQL_TOKENS = f"""{SQL_LINES},
words AS (SELECT doc_id, line_no, {sql_words('line')} AS ws FROM lines),
tokens AS (
  SELECT doc_id, line_no, tok, word, {SQL_RAW_TAG} AS tag
  FROM (SELECT doc_id, line_no, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS tok FROM words)
)"""

SQL_REPAIRED = f"""{SQL_TOKENS},
kinds AS (
  SELECT *, CASE WHEN tag IN ('I-ten_benh') THEN 'Disease/Symptom'
                 WHEN tag IN ('B-drug', 'I-drug') THEN 'Drug'
                 WHEN tag IN ('B-medical_procedure') THEN 'Procedure/Treatment' END AS kind
  FROM tokens
),
repaired AS (
  SELECT doc_id, line_no, tok, word,
         CASE WHEN kind IS NULL THEN 'O'
              WHEN starts_with(tag, 'I-') AND kind = lag(kind) OVER w THEN 'I-' || kind
              ELSE 'B-' || kind END AS tag, kind
  FROM kinds WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY tok)
)"""

SQL_SPANS = f"""{SQL_REPAIRED},
islands AS (
  SELECT *, sum(CASE WHEN left(tag, 2) = 'I-' THEN 0 ELSE 1 END) OVER
            (PARTITION BY doc_id, line_no ORDER BY tok ROWS UNBOUNDED PRECEDING) AS island
  FROM repaired
),
spans AS (
  SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY tok) AS entity, kind AS type,
         min(tok) AS start_token, max(tok) AS end_token
  FROM islands WHERE kind IS NOT NULL GROUP BY doc_id, line_no, island, kind
)"""


def _repaired(t: Tables):
    return tagged_lines(t).withColumn(
        "tokens", sq.repair_bio(F.col("tokens"), lx.CORPUS_TAG_CLASS)
    )


@query(
    "bio_repair",
    "doc_id:bigint, line_no:bigint, tok:bigint, word:string, tag:string",
    f"WITH {SQL_REPAIRED} SELECT * FROM repaired",
)
def bio_repair(t: Tables):
    return _repaired(t).select(
        "doc_id", "line_no", F.posexplode("tokens").alias("tok", "x")
    ).select("doc_id", "line_no", "tok", "x.word", "x.tag")


@query(
    "bio_spans",
    "doc_id:bigint, line_no:bigint, entity:string, type:string, start_token:bigint, end_token:bigint",
    f"WITH {SQL_SPANS} SELECT * FROM spans",
)
def bio_spans(t: Tables):
    return _repaired(t).select(
        "doc_id", "line_no", F.explode(sq.bio_to_spans(F.col("tokens"))).alias("s")
    ).select("doc_id", "line_no", "s.*")


def _word_spans(words):
    """Two overlapping span layers: long words with the next word, then words in `t`."""
    longer = F.filter(
        F.transform(
            words,
            lambda w, i: F.struct(
                F.when(F.length(w) > 8, i).alias("start"), (i + 1).alias("end"),
                F.lit("Disease/Symptom").alias("label"),
            ),
        ),
        lambda s: s["start"].isNotNull(),
    )
    initial = F.filter(
        F.transform(
            words,
            lambda w, i: F.struct(
                F.when(F.lower(w).startswith("t"), i).alias("start"), (i + 2).alias("end"),
                F.lit("Drug").alias("label"),
            ),
        ),
        lambda s: s["start"].isNotNull(),
    )
    return F.concat(longer, initial)


@query(
    "spans_to_bio",
    "doc_id:bigint, line_no:bigint, tok:bigint, word:string, tag:string",
    f"""WITH {SQL_TOKENS},
        spans AS (
          SELECT doc_id, line_no, tok AS a, tok + 1 AS b, 'Disease/Symptom' AS label, 0 AS layer
          FROM tokens WHERE length(word) > 8
          UNION ALL
          SELECT doc_id, line_no, tok, tok + 2, 'Drug', 1 FROM tokens WHERE starts_with(lower(word), 't')
        ),
        covered AS (
          SELECT t.doc_id, t.line_no, t.tok, t.word, s.label, s.a,
                 row_number() OVER (PARTITION BY t.doc_id, t.line_no, t.tok
                                    ORDER BY s.layer DESC, s.a DESC) AS rn
          FROM tokens t LEFT JOIN spans s
            ON t.doc_id = s.doc_id AND t.line_no = s.line_no AND t.tok BETWEEN s.a AND s.b
        )
        SELECT doc_id, line_no, tok, word, CASE WHEN label IS NULL THEN 'O'
               WHEN a = tok THEN 'B-' || label ELSE 'I-' || label END AS tag
        FROM covered WHERE rn = 1""",
)
def spans_to_bio(t: Tables):
    words = document_lines(t).select("doc_id", "line_no", tx.words(F.col("line")).alias("words"))
    tagged = words.withColumn("spans", _word_spans(F.col("words"))).select(
        "doc_id",
        "line_no",
        F.posexplode(sq.spans_to_bio(F.col("words"), F.col("spans"))).alias("tok", "x"),
    )
    return tagged.select("doc_id", "line_no", "tok", "x.word", "x.tag")


#: the text with blank lines; both dialects read it
SQL_BLANKED = (
    "replace(replace(text, concat(chr(10), 'T'), concat(chr(10), chr(10), 'T')), "
    "concat(chr(10), 'A'), concat(chr(10), ' ', chr(10), chr(10), 'A'))"
)


@query(
    "conll_parse",
    "doc_id:bigint, sent_no:bigint, tok:bigint, word:string, tag:string",
    # blank lines are put before lines that open with T, and before some at once two
    f"""WITH broken AS (SELECT doc_id, string_split({SQL_BLANKED}, chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM broken),
        blocks AS (
          SELECT doc_id, line_no, string_split(trim(line), ' ') AS f,
                 sum((trim(line) = '')::int) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM lines),
        fields AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS sent_no FROM blocks WHERE len(f) >= 2)
        SELECT doc_id, sent_no,
               row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY line_no) - 1 AS tok,
               f[1] AS word, f[-1] AS tag FROM fields""",
)
def conll_parse(t: Tables):
    return (
        t.documents.select(
            "doc_id", F.posexplode(readers.conll_sentences(F.expr(SQL_BLANKED))).alias("sent_no", "tokens")
        )
        .select("doc_id", "sent_no", F.posexplode("tokens").alias("tok", "x"))
        .select("doc_id", "sent_no", "tok", "x.word", "x.tag")
    )


@query(
    "underscore_split",
    "doc_id:bigint, line_no:bigint, tok:bigint, word:string, tag:string",
    f"""WITH {SQL_LINES},
        glued AS (SELECT doc_id, line_no, {sql_words(r"regexp_replace(line, '(\S+) (\S+)', '\1_\2', 'g')")} AS ws
                  FROM lines),
        tokens AS (
          SELECT doc_id, line_no, tok0, word, {SQL_RAW_TAG} AS tag
          FROM (SELECT doc_id, line_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS tok0 FROM glued)),
        parts AS (
          SELECT doc_id, line_no, tok0, tag, unnest(ps) AS word, generate_subscripts(ps, 1) AS k
          FROM (SELECT *, list_filter(string_split(word, '_'), lambda p: p <> '') AS ps FROM tokens))
        SELECT doc_id, line_no,
               row_number() OVER (PARTITION BY doc_id, line_no ORDER BY tok0, k) - 1 AS tok, word,
               CASE WHEN k > 1 AND left(tag, 2) IN ('B-', 'I-') THEN 'I-' || substr(tag, 3) ELSE tag END AS tag
        FROM parts""",
)
def underscore_split(t: Tables):
    glued = F.regexp_replace("line", r"(\S+) (\S+)", "$1_$2")
    tokens = F.transform(
        tx.words(glued), lambda w: F.struct(w.alias("word"), raw_tag(w).alias("tag"))
    )
    return (
        document_lines(t)
        .select(
            "doc_id", "line_no", F.posexplode(sq.split_underscores(tokens)).alias("tok", "x")
        )
        .select("doc_id", "line_no", "tok", "x.word", "x.tag")
    )


SQL_PIECES = f"""{SQL_REPAIRED},
        pieces AS (
          SELECT doc_id, line_no, tok, tag, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k
          FROM (SELECT *, regexp_extract_all(word, '.{{1,4}}') AS ps FROM repaired)),
        labelled AS (
          SELECT doc_id, line_no, piece, CASE WHEN k > 1 THEN -100 ELSE CASE tag
                 WHEN 'B-Disease/Symptom' THEN 1 WHEN 'I-Disease/Symptom' THEN 2
                 WHEN 'B-Procedure/Treatment' THEN 3 WHEN 'I-Procedure/Treatment' THEN 4
                 WHEN 'B-Drug' THEN 5 WHEN 'I-Drug' THEN 6 ELSE 0 END END AS label,
                 row_number() OVER (PARTITION BY doc_id, line_no ORDER BY tok, k) - 1 AS pos FROM pieces),
        contents AS (SELECT doc_id, line_no, list(piece ORDER BY pos) AS ps, list(label ORDER BY pos) AS ls
                     FROM labelled GROUP BY doc_id, line_no)"""


def _sql_framed(source: str, length: int) -> str:
    """Pieces and labels of `ps`, `ls` framed, padded and printed."""
    pad = f"list_transform(range({length}), lambda i: "

    def line(values: str, first: str, last: str, fill: str) -> str:
        return f"array_to_string(([{first}] || {values} || [{last}] || {pad}{fill}))[1:{length}], ' ')"

    return (
        f"{line(f'{source}ps', repr('[CLS]'), repr('[SEP]'), repr('[PAD]'))} AS pieces, "
        f"{line(f'{source}ls', '-100', '-100', '-100')} AS labels"
    )


def _pieces() -> Column:
    return F.transform(
        "tokens", lambda x: F.regexp_extract_all(x["word"], F.lit("(.{1,4})"), F.lit(1))
    )


def _printed(aligned: Column) -> list[Column]:
    """Pieces and labels as text: one row per sentence, whatever its length."""
    return [
        F.array_join(aligned["piece"], " ").alias("pieces"),
        F.array_join(aligned["label"].cast("array<string>"), " ").alias("labels"),
    ]


@query(
    "subword_alignment",
    "doc_id:bigint, line_no:bigint, pieces:string, labels:string",
    # the cut at the model's length is the feature; the windows below lose nothing
    f"WITH {SQL_PIECES} SELECT doc_id, line_no, {_sql_framed('', 256)} FROM contents",
)
def subword_alignment(t: Tables):
    aligned = tx.staged(
        _repaired(t), sq.align_subwords(F.col("tokens"), _pieces()).alias("aligned")
    )
    return aligned.select("doc_id", "line_no", *_printed(F.col("aligned")))


# pieces of the benchmark: the first four letters of its words and all stretches of three
# behind the first
SQL_VOCABULARY = r"""
vocabulary AS (
  SELECT DISTINCT piece FROM (
    SELECT substr(word, 1, n) AS piece FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM benchmark), (VALUES (1), (2), (3), (4)) AS v(n)
    UNION ALL
    SELECT '##' || substr(word, i::int, n) FROM (
      SELECT word, n, unnest(range(2, length(word) - n + 2)) AS i
      FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM benchmark), (VALUES (1), (2), (3)) AS v(n)))
  WHERE piece <> ''
)"""


def _vocabulary(t: Tables):
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.col("word") != "")
    starts = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring("word", F.lit(1), n))
    places = F.when(F.length("word") > 1, F.sequence(F.lit(2), F.length("word"))).otherwise(F.array().cast("array<int>"))
    inside = F.flatten(F.transform(places, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(3), F.length("word") - i + 1)), lambda n: F.concat(F.lit("##"), F.substring("word", i, n))
    )))
    return words.select(F.explode(F.concat(starts, inside)).alias("piece")).distinct()


@query(
    "wordpiece_alignment",
    "doc_id:bigint, line_no:bigint, pieces:string, labels:string",
    f"""WITH RECURSIVE {SQL_REPAIRED}, {SQL_VOCABULARY},
        forms AS (SELECT DISTINCT word FROM repaired),
        places AS (
          SELECT word, beg, max(n) AS n
          FROM (SELECT word, beg, n, CASE WHEN beg > 0 THEN '##' ELSE '' END || substr(word, (beg + 1)::int, n::int) AS piece
                FROM (SELECT word, n, unnest(range(0, length(word) - n + 1)) AS beg FROM forms, (VALUES (1), (2), (3), (4)) AS v(n)
                      WHERE length(word) <= 100))
          JOIN vocabulary USING (piece) GROUP BY word, beg),
        chain AS (
          SELECT word, 0::bigint AS beg, []::varchar[] AS ps FROM forms
          UNION ALL
          SELECT c.word, c.beg + p.n, c.ps || [CASE WHEN c.beg > 0 THEN '##' ELSE '' END || substr(c.word, (c.beg + 1)::int, p.n::int)]
          FROM chain c JOIN places p ON p.word = c.word AND p.beg = c.beg),
        cut AS (
          SELECT k.word, coalesce(any_value(ps) FILTER (c.beg = length(k.word)), ['[UNK]']) AS ps
          FROM forms k LEFT JOIN chain c ON c.word = k.word GROUP BY k.word),
        pieces AS (
          SELECT doc_id, line_no, tok, tag, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM repaired JOIN cut USING (word)),
        labelled AS (
          SELECT doc_id, line_no, piece, CASE WHEN k > 1 THEN -100 ELSE CASE tag
                 WHEN 'B-Disease/Symptom' THEN 1 WHEN 'I-Disease/Symptom' THEN 2
                 WHEN 'B-Procedure/Treatment' THEN 3 WHEN 'I-Procedure/Treatment' THEN 4
                 WHEN 'B-Drug' THEN 5 WHEN 'I-Drug' THEN 6 ELSE 0 END END AS label,
                 row_number() OVER (PARTITION BY doc_id, line_no ORDER BY tok, k) - 1 AS pos FROM pieces),
        contents AS (SELECT doc_id, line_no, list(piece ORDER BY pos) AS ps, list(label ORDER BY pos) AS ls
                     FROM labelled GROUP BY doc_id, line_no)
        SELECT doc_id, line_no, {_sql_framed('', 256)} FROM contents""",
)
def wordpiece_alignment(t: Tables):
    """Labels per piece of a vocabulary that the benchmark gives."""
    cut = with_pieces(_repaired(t), _vocabulary(t), ["doc_id", "line_no"], longest=4)
    aligned = tx.staged(cut, sq.align_subwords(F.col("tokens"), F.col("pieces")).alias("aligned"))
    return aligned.select("doc_id", "line_no", *_printed(F.col("aligned")))


@query(
    "subword_windows",
    "doc_id:bigint, line_no:bigint, part:bigint, pieces:string, labels:string",
    f"""WITH {SQL_PIECES},
        windows AS (
          SELECT doc_id, line_no, part, ps[part * 20 + 1:part * 20 + 30] AS ps, ls[part * 20 + 1:part * 20 + 30] AS ls
          FROM (SELECT *, unnest(range(0, greatest(ceil((len(ps) - 30) / 20)::bigint, 0) + 1)) AS part FROM contents))
        SELECT doc_id, line_no, part, {_sql_framed('', 32)} FROM windows""",
)
def subword_windows(t: Tables):
    windows = sq.subword_windows(F.col("tokens"), _pieces(), max_length=32, overlap=10)
    return (
        _repaired(t)
        .select("doc_id", "line_no", F.posexplode(windows).alias("part", "x"))
        .select("doc_id", "line_no", "part", *_printed(F.col("x")))
    )


@query(
    "tag_examples",
    "tag:string, entity:string, example:string",
    f"""WITH {SQL_SPANS},
        first AS (SELECT *, row_number() OVER (PARTITION BY type
                    ORDER BY doc_id, line_no, start_token) AS rn FROM spans)
        SELECT f.type AS tag, f.entity, (SELECT string_agg(r.word, ' ' ORDER BY r.tok) FROM repaired r
               WHERE r.doc_id = f.doc_id AND r.line_no = f.line_no AND r.tok <= f.end_token) AS example
        FROM first f WHERE rn = 1""",
)
def tag_examples(t: Tables):
    ordered = _repaired(t).select(F.struct("doc_id", "line_no").alias("at"), "tokens")
    return cp.tag_examples(ordered, "tokens", "at")


@query(
    "span_examples",
    "tag:string, entity:string, example:string",
    f"""WITH {SQL_TOKENS},
        spans AS (
          SELECT doc_id, line_no, tok AS a, tok + 1 AS b, 'Disease/Symptom' AS label, 0 AS layer
          FROM tokens WHERE length(word) > 8
          UNION ALL
          SELECT doc_id, line_no, tok, tok + 2, 'Drug', 1 FROM tokens WHERE starts_with(lower(word), 't')),
        first AS (SELECT *, row_number() OVER (PARTITION BY label
                    ORDER BY doc_id, line_no, layer, a) AS rn FROM spans)
        SELECT f.label AS tag,
               (SELECT string_agg(k.word, ' ' ORDER BY k.tok) FROM tokens k WHERE k.doc_id = f.doc_id
                AND k.line_no = f.line_no AND k.tok BETWEEN f.a AND f.b) AS entity,
               (SELECT line FROM lines l WHERE l.doc_id = f.doc_id AND l.line_no = f.line_no) AS example
        FROM first f WHERE rn = 1""",
)
def span_examples(t: Tables):
    df = document_lines(t).select(
        F.struct("doc_id", "line_no").alias("at"),
        F.col("line").alias("sentence"),
        tx.words(F.col("line")).alias("words"),
    )
    return cp.span_examples(df.withColumn("spans", _word_spans(F.col("words"))), "at")


@query(
    "span_f1",
    "type:string, tp:bigint, fp:bigint, fn:bigint, precision:double, recall:double, f1:double",
    f"""WITH {SQL_SPANS},
        ptok AS (
          SELECT doc_id, line_no, tok, word,
                 CASE WHEN length(word) > 9 THEN NULL ELSE kind END AS kind FROM repaired),
        ptag AS (
          SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id, line_no ORDER BY tok)
                         THEN 0 ELSE 1 END AS opens FROM ptok),
        pisl AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, line_no ORDER BY tok
                           ROWS UNBOUNDED PRECEDING) AS island FROM ptag),
        pred AS (SELECT doc_id, line_no, kind AS type, min(tok) AS start_token, max(tok) AS end_token
                 FROM pisl WHERE kind IS NOT NULL GROUP BY doc_id, line_no, island, kind),
        joined AS (
          SELECT coalesce(g.type, p.type) AS type, g.type IS NOT NULL AS g, p.type IS NOT NULL AS p
          FROM spans g FULL JOIN pred p USING (doc_id, line_no, type, start_token, end_token)),
        counts AS (
          SELECT coalesce(type, 'ALL (micro)') AS type, count(*) FILTER (g AND p) AS tp,
                 count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn
          FROM joined GROUP BY ROLLUP (type)),
        ratios AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::double ELSE 0 END AS precision,
                          CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::double ELSE 0 END AS recall FROM counts)
        SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                       ELSE 0 END AS f1 FROM ratios""",
)
def span_f1(t: Tables):
    """Repaired tags against a guess that has no long words and merges neighbours."""
    guess = F.transform(
        "tokens",
        lambda x: F.struct(
            x["word"].alias("word"),
            F.when(F.length(x["word"]) > 9, "O")
            .otherwise(F.regexp_replace(x["tag"], "^B-", "I-"))
            .alias("tag"),
        ),
    )
    return span_prf(_repaired(t).withColumn("guess", guess), "tokens", "guess")


@query(
    "mention_merge",
    "doc_id:bigint, start:bigint, end:bigint, label:string, term:string",
    f"""WITH pieces AS (
          SELECT doc_id, i, piece, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
          FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS piece,
                       generate_subscripts(string_split_regex(text, '[ \\n]'), 1) AS i FROM documents)),
        tagged AS (SELECT doc_id, i, piece AS word, off, off + length(piece) AS stop FROM pieces),
        kinds AS (SELECT doc_id, i, off, stop, substr({SQL_RAW_TAG}, 3) AS label, {SQL_RAW_TAG} AS tag FROM tagged),
        kept AS (SELECT * FROM kinds WHERE tag LIKE '%-%'),
        flags AS (SELECT *, CASE WHEN label = lag(label) OVER w AND off - lag(stop) OVER w <= 1
                                 THEN 0 ELSE 1 END AS opens
                  FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)
                    AS island FROM flags),
        merged AS (SELECT doc_id, island, label, min(off) AS start, arg_max(stop, i) AS stop
                   FROM islands GROUP BY doc_id, island, label)
        SELECT m.doc_id, m.start, m.stop AS "end", m.label, substr(d.text, m.start::int + 1, (m.stop - m.start)::int) AS term
        FROM merged m JOIN documents d USING (doc_id)""",
)
def mention_merge(t: Tables):
    tagged = F.transform(
        sq.pieces(F.col("text"), "[ \n]"),
        lambda p: F.struct(
            p["piece"].alias("term"),
            p["start"].alias("start"),
            (p["start"] + F.length(p["piece"])).alias("end"),
            sq.tag_type(raw_tag(p["piece"])).alias("label"),
        ),
    )
    kept = F.filter(tagged, lambda m: m["label"].isNotNull())
    return t.documents.select(
        "doc_id", F.explode(sq.merge_adjacent(F.col("text"), kept)).alias("m")
    ).select("doc_id", "m.*")


SQL_FORWARD = f"""WITH RECURSIVE {SQL_LINES}, {SQL_TERMS},
  grams AS (
    SELECT doc_id, line_no, line, line_start, i, trim(piece, '{lx.PUNCTUATION.replace("'", "''")} ') AS word
    FROM (SELECT doc_id, line_no, line, line_start, unnest(string_split(line, ' ')) AS piece,
                 generate_subscripts(string_split(line, ' '), 1) AS i FROM lines)),
  raw AS MATERIALIZED (
    SELECT g.doc_id, g.line_no, g.line, g.line_start, g.word, t.item_id,
           row_number() OVER (PARTITION BY g.doc_id, g.line_no ORDER BY g.i) AS n
    FROM grams g JOIN terms t ON trim(lower(g.word), ' .,;:-()[]{{}}') = t.word),
  found AS (
    SELECT doc_id, line_no, line, line_start, 0 AS n, 0 AS pos, '' AS word, 0 AS hit, 0::bigint AS item_id
    FROM raw WHERE n = 1
    UNION ALL
    SELECT r.doc_id, r.line_no, r.line, r.line_start, f.n + 1,
           CASE WHEN instr(substr(r.line, f.pos + 1), r.word) > 0
                THEN (f.pos + instr(substr(r.line, f.pos + 1), r.word) - 1 + length(r.word))::int ELSE f.pos END,
           r.word, instr(substr(r.line, f.pos + 1), r.word)::int
                   + CASE WHEN instr(substr(r.line, f.pos + 1), r.word) > 0 THEN f.pos ELSE 0 END, r.item_id
    FROM found f JOIN raw r ON r.doc_id = f.doc_id AND r.line_no = f.line_no AND r.n = f.n + 1)"""


@query(
    "forward_offsets",
    "doc_id:bigint, term:string, start:bigint, end:bigint, label:string",
    SQL_FORWARD
    + """ SELECT doc_id, word AS term, CASE WHEN hit > 0 THEN line_start + hit - 1 END AS start,
          CASE WHEN hit > 0 THEN line_start + hit - 1 + length(word) END AS "end",
          'K' || item_id AS label FROM found WHERE n > 0""",
)
def forward_offsets(t: Tables):
    """Dictionary words per line, placed by forward search."""
    terms = dictionary_terms(t).select(
        F.col("word").alias("term"),
        F.concat(F.lit("K"), F.col("item_id").cast("string")).alias("label"),
        F.col("item_id").alias("row_idx"),
    )
    notes = LexiconAnnotator(terms).annotate(t.documents.select("doc_id", "text"))
    return notes.select(
        "doc_id", F.explode(sq.locate_in_lines(F.col("text"), F.col("raw"))).alias("m")
    ).select("doc_id", "m.*")


@query(
    "global_forward_offsets",
    "doc_id:bigint, term:string, start:bigint, end:bigint",
    f"""WITH RECURSIVE {SQL_MENTIONS},
        words AS (
          SELECT doc_id, any_value(text) AS text, lower(surface) AS w,
                 min(instr(lower(text), lower(surface))) AS off, min(item_id) AS k
          FROM mentions GROUP BY doc_id, lower(surface)),
        ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY off, k, w) AS n FROM words),
        found AS (
          SELECT doc_id, text, 0 AS n, 0 AS pos, '' AS w, 0 AS hit FROM ranked WHERE n = 1
          UNION ALL
          SELECT r.doc_id, r.text, f.n + 1,
                 CASE WHEN instr(substr(lower(r.text), f.pos + 1), r.w) > 0
                      THEN (f.pos + instr(substr(lower(r.text), f.pos + 1), r.w) - 1 + length(r.w))::int
                      ELSE f.pos END,
                 r.w, CASE WHEN instr(substr(lower(r.text), f.pos + 1), r.w) > 0
                      THEN (f.pos + instr(substr(lower(r.text), f.pos + 1), r.w))::int ELSE 0 END
          FROM found f JOIN ranked r ON r.doc_id = f.doc_id AND r.n = f.n + 1)
        SELECT doc_id, CASE WHEN hit > 0 THEN substr(text, hit, length(w)) ELSE w END AS term,
               CASE WHEN hit > 0 THEN hit - 1 END AS start,
               CASE WHEN hit > 0 THEN hit - 1 + length(w) END AS "end" FROM found WHERE n > 0""",
)
def global_forward_offsets(t: Tables):
    """Distinct dictionary words per document, placed by forward search."""
    # a word has one item, so equal words are neighbours in the order of both
    named = F.transform("found", lambda m: F.struct(m["item_id"].alias("k"), F.lower(m["surface"]).alias("term")))
    order = tx.let(F.sort_array(named), lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x != F.get(all_, i - 1))))
    items = F.transform(
        order,
        lambda x: F.struct(
            x["term"].alias("term"),
            F.lit(None).cast("int").alias("start"),
            F.lit(None).cast("int").alias("end"),
        ),
    )
    listed = tx.staged(with_mentions(t), items.alias("items"))
    placed = sq.locate_in_text(F.col("text"), F.col("items"))
    return listed.select("doc_id", F.explode(placed).alias("m")).select("doc_id", "m.*")
