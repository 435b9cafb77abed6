"""Corpus exports, gold sets, relabelling and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.catalog.inputs import RULES, dictionary_terms, document_lines, raw_tag, tagged_lines
from medloom.catalog.registry import (
    SQL_TERMS, Tables, query, sql_context, sql_flags, sql_keep, sql_strip, sql_term, sql_type,
    sql_words,
)
from medloom.catalog.sequences import SQL_REPAIRED, SQL_SPANS
from medloom.functions import text as tx
from medloom.operators import corpus as cp
from medloom.operators import sequence as sq
from medloom.sources.readers import span_sentences
from medloom.sources.writers import conll_block

SENT_ID = ("doc_id", "line_no")


def _sentences(t: Tables):
    """Repaired tagged lines as chat records with their entities."""
    repaired = tagged_lines(t).withColumn(
        "tokens", sq.repair_bio(F.col("tokens"), lx.CORPUS_TAG_CLASS)
    )
    return cp.chat_export(repaired)


# One JSON answer per line, entities in order.
SQL_CHATS = f"""{SQL_SPANS},
texts AS (SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY tok) AS text FROM repaired GROUP BY doc_id, line_no),
answers AS (SELECT doc_id, line_no, to_json(list(struct_pack(entity, type, start_token, end_token)
              ORDER BY start_token))::varchar AS answer FROM spans GROUP BY doc_id, line_no),
chats AS (SELECT t.doc_id, t.line_no, t.text, coalesce(a.answer, '[]') AS answer
          FROM texts t LEFT JOIN answers a USING (doc_id, line_no))"""


@query(
    "chat_records",
    "doc_id:bigint, line_no:bigint, roles:string, question:string, answer:string",
    f"""WITH {SQL_CHATS} SELECT doc_id, line_no, 'system,user,assistant' AS roles, text AS question, answer FROM chats""",
)
def chat_records(t: Tables):
    return _sentences(t).select(
        "doc_id",
        "line_no",
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.get("messages", F.lit(1))["content"].alias("question"),
        F.get("messages", F.lit(2))["content"].alias("answer"),
    )


@query(
    "labelled_text",
    "doc_id:bigint, line_no:bigint, text:string, labels:string",
    f"""WITH {SQL_CHATS},
        labels AS (SELECT doc_id, line_no, string_agg(entity, '|' ORDER BY start_token) AS labels
                   FROM spans WHERE type = 'Disease/Symptom' GROUP BY doc_id, line_no)
        SELECT doc_id, line_no, text, labels FROM chats JOIN labels USING (doc_id, line_no)""",
)
def labelled_text(t: Tables):
    return cp.labelled_text(_sentences(t)).withColumn("labels", F.array_join("labels", "|"))


@query(
    "conll_text",
    "doc_id:bigint, line_no:bigint, value:string",
    f"""WITH {SQL_REPAIRED} SELECT doc_id, line_no,
          string_agg(word || chr(9) || tag, chr(10) ORDER BY tok) || chr(10) AS value
        FROM repaired GROUP BY doc_id, line_no""",
)
def conll_text(t: Tables):
    return _sentences(t).select("doc_id", "line_no", conll_block(F.col("tokens")).alias("value"))


@query(
    "entity_frequency",
    "entity:string, type:string, count:bigint",
    f"""WITH {SQL_SPANS} SELECT lower({sql_strip('entity')}) AS entity, type, count(*) AS count FROM spans
        GROUP BY 1, 2""",
)
def entity_frequency(t: Tables):
    """Entities counted out of the answers of chat records."""
    parsed = cp.assistant_entities(_sentences(t))
    # document, line and place as one number of 37 digits
    order = F.expr(
        "cast(doc_id as decimal(19,0)) * cast(1000000000000000000 as decimal(19,0)) + "
        "cast(line_no as decimal(10,0)) * cast(1000000000 as decimal(10,0)) + pos"
    ).cast("decimal(38,0)")
    rows = parsed.select("doc_id", "line_no", F.posexplode("entities").alias("pos", "e"))
    return cp.entity_frequency(rows, F.col("e.entity"), F.col("e.type"), order)


#: lines whose answer is cut short: one in seven, all over the documents
SQL_BROKEN = "(doc_id * 31 + line_no) % 7 = 3"


@query(
    "entity_totals",
    "lines:bigint, errors:bigint, pairs:bigint",
    f"""WITH {SQL_CHATS},
        broken AS (SELECT *, CASE WHEN {SQL_BROKEN} THEN left(answer, length(answer) - 1) ELSE answer END AS a FROM chats)
        SELECT count(*) AS lines, count(*) FILTER (NOT json_valid(a)) AS errors,
               (SELECT count(DISTINCT (lower({sql_strip('entity')}), type)) FROM spans WHERE NOT {SQL_BROKEN}) AS pairs
        FROM broken""",
)
def entity_totals(t: Tables):
    """Records, unreadable answers and distinct entities, some answers cut short."""
    turn = F.transform(
        "messages",
        lambda m: m.withField(
            "content",
            F.when(
                (m["role"] == "assistant") & F.expr(SQL_BROKEN),
                F.left(m["content"], F.length(m["content"]) - 1),
            ).otherwise(m["content"]),
        ),
    )
    parsed = cp.assistant_entities(_sentences(t).withColumn("messages", turn))
    pairs = parsed.select(F.explode("entities").alias("e")).select(
        F.lower(tx.strip(F.col("e.entity"))).alias("x"), "e.type"
    )
    counted = pairs.agg(F.count_distinct("x", "type").alias("n"))
    return parsed.agg(
        F.count("*").alias("lines"), F.count_if("malformed").alias("errors")
    ).withColumn("pairs", counted.scalar())


def _corpora(t: Tables):
    lines = tagged_lines(t).select(F.concat_ws(".", *SENT_ID).alias("sent_id"), "tokens")
    turns = t.conversations.select(
        F.concat_ws(".", "conv_id", "turn").alias("sent_id"),
        F.transform(
            tx.words(F.col("text")), lambda w: F.struct(w.alias("word"), raw_tag(w).alias("tag"))
        ).alias("tokens"),
    )
    return [lines, turns]


@query(
    "corpus_export",
    "uid:string, split:string, source_idx:bigint, text:string, answer:string",
    f"""WITH {SQL_CHATS},
        turn_words AS (SELECT conv_id, turn, {sql_words('text')} AS ws FROM conversations),
        turn_tokens AS (
          SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS tok FROM turn_words),
        turn_kinds AS (
          SELECT *, CASE WHEN lower(left(word, 1)) IN ('a', 'e') THEN 'Disease/Symptom'
                   WHEN lower(left(word, 1)) IN ('t', 'o', 'i') THEN 'Drug'
                   WHEN lower(left(word, 1)) IN ('d', 'l') THEN 'Procedure/Treatment' END AS kind,
                 lower(left(word, 1)) IN ('a', 'e', 'o', 'i') AS inside FROM turn_tokens),
        turn_edges AS (
          SELECT *, CASE WHEN kind IS NOT NULL AND inside AND kind = lag(kind) OVER
                    (PARTITION BY conv_id, turn ORDER BY tok) THEN 0 ELSE 1 END AS opens FROM turn_kinds),
        turn_islands AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY tok ROWS UNBOUNDED PRECEDING) AS island
                         FROM turn_edges),
        turn_spans AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY tok) AS entity, kind AS type,
                         min(tok) AS start_token, max(tok) AS end_token
                       FROM turn_islands WHERE kind IS NOT NULL GROUP BY conv_id, turn, island, kind),
        turn_answers AS (SELECT conv_id, turn, to_json(list(struct_pack(entity, type, start_token, end_token)
                           ORDER BY start_token))::varchar AS answer FROM turn_spans GROUP BY conv_id, turn),
        everything AS (
          SELECT '0:' || doc_id || '.' || line_no AS uid, 0 AS source_idx, text, answer FROM chats
          UNION ALL
          SELECT '1:' || conv_id || '.' || turn, 1, list_aggregate(ws, 'string_agg', ' '), coalesce(answer, '[]')
          FROM turn_words LEFT JOIN turn_answers USING (conv_id, turn)),
        ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42~' || uid)) AS r, count(*) OVER () AS n FROM everything)
        SELECT uid, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'dev'
               ELSE 'test' END AS split, source_idx, coalesce(text, '') AS text, answer FROM ranked""",
)
def corpus_export(t: Tables):
    return cp.build_corpora(_corpora(t)).withColumn(
        "answer", F.get("messages", F.lit(2))["content"]
    )


@query(
    "span_json_parse",
    "conv_id:bigint, turn:bigint, word:string, tok:bigint, tag:string",
    f"""WITH ws AS (SELECT conv_id, turn, {sql_words('text')} AS ws FROM conversations),
        tokens AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS tok FROM ws),
        spans AS (SELECT conv_id, turn, 1 AS a, 2 AS b, 'Drug' AS label FROM conversations
                  UNION ALL SELECT conv_id, turn, 4, turn + 4, 'Disease/Symptom' FROM conversations)
        SELECT t.conv_id, t.turn, t.word, t.tok,
               coalesce(max(CASE WHEN s.a = t.tok THEN 'B-' || s.label ELSE 'I-' || s.label END), 'O') AS tag
        FROM tokens t LEFT JOIN spans s ON s.conv_id = t.conv_id AND s.turn = t.turn AND t.tok BETWEEN s.a AND s.b
        GROUP BY t.conv_id, t.turn, t.word, t.tok""",
)
def span_json_parse(t: Tables):
    """Turns as span sentences: numbers come as text, one label is unknown."""
    spans = F.array(
        F.array(F.lit("0"), F.lit("9"), F.lit("unknown")),
        F.array(F.lit("1"), F.lit("2"), F.lit("drug")),
        F.array(F.lit("4"), (F.col("turn") + 4).cast("string"), F.lit("ten_benh")),
    )
    df = t.conversations.select(
        "conv_id", "turn", F.col("text").alias("sentence"), spans.alias("seq_label")
    )
    tagged = span_sentences(df, lx.CORPUS_TAG_CLASS).select(
        "conv_id", "turn", F.posexplode(sq.spans_to_bio(F.col("words"), F.col("spans"))).alias("tok", "x")
    )
    return tagged.select("conv_id", "turn", "tok", "x.word", "x.tag")


# --- gold sets ----------------------------------------------------------------


def _truth(t: Tables):
    """Dictionary words as ground truth: repeated, unmapped and unknown types."""
    kind = (
        F.when(F.col("item_id") < 10, "Finding")
        .when(F.col("item_id") < 20, "Antibiotic")
        .when(F.col("item_id") < 30, "Medical Device")
        .otherwise("Vitamin")
    )
    once = dictionary_terms(t).select(
        F.initcap("word").alias("entity"),
        F.when(F.length("word") == 5, "").otherwise(F.concat(F.lit("C"), F.substring("word", 1, 6))).alias("mapped_cui"),
        kind.alias("mapped_type"),
        F.col("item_id").alias("row_idx"),
        "word",
    )
    again = once.where(F.length("word") > 8).select(
        F.concat("entity", F.lit("!")).alias("entity"), F.concat(F.lit("X"), "word").alias("mapped_cui"),
        "mapped_type", (F.col("row_idx") + 1000).alias("row_idx"), "word",
    )
    return once.unionByName(again).drop("word")


SQL_TRUTH = f"""{SQL_TERMS},
truth AS (
  SELECT word, CASE WHEN length(word) = 5 THEN '' ELSE 'C' || substr(word, 1, 6) END AS cui, item_id AS row_idx,
         CASE WHEN item_id < 10 THEN 'Disease/Symptom' WHEN item_id < 20 THEN 'Drug'
              WHEN item_id < 30 THEN 'Procedure/Treatment' END AS cls FROM terms
  UNION ALL
  SELECT word, 'X' || word, item_id + 1000, CASE WHEN item_id < 10 THEN 'Disease/Symptom' WHEN item_id < 20 THEN 'Drug'
              WHEN item_id < 30 THEN 'Procedure/Treatment' END FROM terms WHERE length(word) > 8),
final AS (SELECT word, arg_max(cui, row_idx) AS cui, arg_max(cls, row_idx) AS cls FROM truth WHERE cui <> '' GROUP BY word)"""


def _gold(t: Tables, class_from: str):
    chat = _sentences(t).withColumn("row_idx", F.concat_ws(".", *SENT_ID))
    kept = t.documents.where(F.col("lang") == "en").select(F.explode(F.split("text", "\n")).alias("text"))
    out = cp.gold_set(chat, kept, _truth(t), class_from=class_from)
    gold = F.col("gold_entities")
    return out.select(
        F.col("row_idx").alias("uid"),
        *[
            F.array_join(gold[c], "|").alias(name)
            for c, name in zip(lx.MACRO_CLASSES, ("disease", "procedure", "drug"))
        ],
    )


def _gold_sql(clean: str, cls: str) -> str:
    return f"""WITH {SQL_CHATS}, {SQL_TRUTH},
        kept AS (SELECT DISTINCT {sql_strip('line')} AS text FROM lines JOIN documents USING (doc_id) WHERE lang = 'en'),
        chosen AS (SELECT * FROM chats WHERE {sql_strip('text')} IN (SELECT text FROM kept)),
        found AS (
          SELECT s.doc_id, s.line_no, f.cui, {cls} AS cls
          FROM spans s JOIN chosen c USING (doc_id, line_no) JOIN final f ON lower({clean}) = f.word)
        SELECT doc_id || '.' || line_no AS uid,
               coalesce(string_agg(DISTINCT cui, '|' ORDER BY cui) FILTER (cls = 'Disease/Symptom'), '') AS disease,
               coalesce(string_agg(DISTINCT cui, '|' ORDER BY cui) FILTER (cls = 'Procedure/Treatment'), '') AS procedure,
               coalesce(string_agg(DISTINCT cui, '|' ORDER BY cui) FILTER (cls = 'Drug'), '') AS drug
        FROM found WHERE cls IS NOT NULL GROUP BY doc_id, line_no"""


@query(
    "gold_benchmark",
    "uid:string, disease:string, procedure:string, drug:string",
    _gold_sql(
        f"nfc_normalize(regexp_replace(regexp_replace({sql_strip('s.entity')}, '\\s+', ' ', 'g'), "
        "'[^\\p{L}\\p{N}_ .-]', '', 'g'))",
        "f.cls",
    ),
)
def gold_benchmark(t: Tables):
    return _gold(t, "ontology")


@query(
    "gold_training",
    "uid:string, disease:string, procedure:string, drug:string",
    _gold_sql(
        "regexp_replace(trim(replace(s.entity, '_', ' '), ' .,;!?\"''()[]{}'), '\\s+', ' ', 'g')",
        "s.type",
    ),
)
def gold_training(t: Tables):
    return _gold(t, "annotation")


@query(
    "label_concepts",
    "doc_id:bigint, line_no:bigint, cuis:string, mapped:bigint, unmapped:bigint",
    f"""WITH {SQL_CHATS}, {SQL_TERMS},
        labels AS (SELECT doc_id, line_no, start_token, {sql_strip("replace(lower(entity), '_', ' ')")} AS k
                   FROM spans WHERE type = 'Disease/Symptom'),
        hits AS (SELECT l.*, CASE WHEN t.word IS NULL THEN NULL WHEN length(word) = 5 THEN ''
                   ELSE 'C' || substr(word, 1, 6) END AS cui FROM labels l LEFT JOIN terms t ON l.k = t.word),
        firsts AS (SELECT doc_id, line_no, cui, min(start_token) AS o FROM hits WHERE cui IS NOT NULL GROUP BY ALL),
        joined AS (SELECT doc_id, line_no, string_agg(cui, '|' ORDER BY o) AS cuis FROM firsts GROUP BY ALL)
        SELECT doc_id, line_no, coalesce(any_value(j.cuis), '') AS cuis, count(cui) AS mapped,
               count(*) - count(cui) AS unmapped
        FROM hits LEFT JOIN joined j USING (doc_id, line_no) GROUP BY doc_id, line_no""",
)
def label_concepts(t: Tables):
    labelled = cp.labelled_text(_sentences(t)).withColumn("at", F.struct(*SENT_ID))
    mapped = cp.map_labels(labelled, _truth(t), ident="at")
    return mapped.withColumn("cuis", F.array_join("cuis", "|"))


@query(
    "label_map_totals",
    "mapped:bigint, unmapped:bigint",
    f"""WITH {SQL_CHATS}, {SQL_TERMS},
        labels AS (SELECT {sql_strip("replace(lower(entity), '_', ' ')")} AS k FROM spans WHERE type = 'Disease/Symptom')
        SELECT count(word) AS mapped, count(*) - count(word) AS unmapped FROM labels LEFT JOIN terms ON k = word""",
)
def label_map_totals(t: Tables):
    labelled = cp.labelled_text(_sentences(t)).withColumn("at", F.struct(*SENT_ID))
    return cp.map_labels(labelled, _truth(t), ident="at").agg(
        F.sum("mapped").alias("mapped"), F.sum("unmapped").alias("unmapped")
    )


# --- relabelling --------------------------------------------------------------

SQL_RELABEL = f"""{SQL_CHATS},
found AS (
  SELECT s.doc_id, s.line_no, s.entity, s.type, s.start_token, c.text,
         instr(c.text, s.entity) - 1 AS start, instr(c.text, s.entity) - 1 + length(s.entity) AS stop,
         {sql_term('s.entity')} AS name,
         CASE s.type WHEN 'Disease/Symptom' THEN 'CHẨN_ĐOÁN' WHEN 'Procedure/Treatment' THEN 'TÊN_XÉT_NGHIỆM'
                     ELSE 'THUỐC' END AS kind0
  FROM spans s JOIN chats c USING (doc_id, line_no)),
{sql_flags('found', RULES)},
judged AS (
  SELECT *, {sql_keep('name', 'kind0', RULES)} AS keep,
         {sql_type('name', 'kind0', "type = 'Disease/Symptom'", sql_context('start', 'stop', RULES), RULES)} AS kind
  FROM flags)"""


def _relabelled(t: Tables):
    return cp.relabel(_sentences(t), RULES)


@query(
    "relabel",
    "doc_id:bigint, line_no:bigint, pos:bigint, entity:string, type:string, assertions:string",
    f"""WITH {SQL_RELABEL} SELECT doc_id, line_no,
          row_number() OVER (PARTITION BY doc_id, line_no ORDER BY start_token) - 1 AS pos, entity, kind AS type,
          CASE WHEN in_clause THEN 'isNegated' ELSE '' END AS assertions FROM judged WHERE keep""",
)
def relabel(t: Tables):
    schema = "array<struct<entity:string,type:string,assertions:array<string>>>"
    answer = tx.role_content(F.col("messages"), "assistant")
    return (
        _relabelled(t)
        .select("doc_id", "line_no", F.posexplode(F.from_json(answer, schema)).alias("pos", "e"))
        .select(
            "doc_id", "line_no", "pos", "e.entity", "e.type",
            F.array_join("e.assertions", ",").alias("assertions"),
        )
    )


@query(
    "relabel_counters",
    "total:bigint, modified:bigint, dropped:bigint",
    f"""WITH {SQL_RELABEL} SELECT count(*) AS total,
          count(*) FILTER (keep AND (kind <> type OR in_clause)) AS modified,
          count(*) FILTER (NOT keep) AS dropped FROM judged""",
)
def relabel_counters(t: Tables):
    return _relabelled(t).agg(
        *[F.sum(c).alias(c) for c in ("total", "modified", "dropped")]
    )


@query(
    "token_slices",
    "doc_id:bigint, line_no:bigint, part:string",
    f"""WITH {SQL_REPAIRED} SELECT doc_id, line_no,
          coalesce(string_agg(word, ' ' ORDER BY tok) FILTER (tok BETWEEN 1 AND 4), '') AS part
        FROM repaired GROUP BY doc_id, line_no""",
)
def token_slices(t: Tables):
    words = document_lines(t).withColumn("ws", tx.words(F.col("line"))).where(F.size("ws") > 0)
    return words.select(
        "doc_id", "line_no", tx.token_slice(F.col("ws"), F.lit(1), F.lit(4)).alias("part")
    )
