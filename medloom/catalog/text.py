"""Scans and scalar text rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom import lexicon as lx
from medloom.catalog.inputs import document_lines
from medloom.catalog.registry import (
    SQL_LINES, Tables, query, sql_sentences, sql_strip, sql_term, sql_words,
)
from medloom.functions import text as tx
from medloom.functions.similarity import gestalt, word_error_rate
from medloom.functions.vector import sigmoid
from medloom.sources import readers


@query(
    "note_scan",
    "doc_id:bigint, n_chars:bigint, n_lines:bigint, n_words:bigint",
    f"""SELECT doc_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines,
               len({sql_words('text')}) AS n_words FROM documents""",
)
def note_scan(t: Tables):
    notes = readers.notes_from(t.documents)
    return notes.select(
        "doc_id",
        F.length("text").alias("n_chars"),
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.size(tx.words(F.col("text"))).alias("n_words"),
    )


@query(
    "line_offsets",
    "doc_id:bigint, line_no:bigint, line_start:bigint, line:string",
    f"WITH {SQL_LINES} SELECT * FROM lines",
)
def line_offsets(t: Tables):
    return document_lines(t)


@query(
    "language_flag",
    "doc_id:bigint, lang:string",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[äöüßéèêçñóí]') THEN 'xx' ELSE 'en' END
       AS lang FROM documents""",
)
def language_flag(t: Tables):
    return t.documents.select(
        "doc_id", tx.detect_language(F.col("text"), "äöüßéèêçñóí", "xx").alias("lang")
    )


@query(
    "term_normalise",
    "doc_id:bigint, line_no:bigint, term:string, label:string",
    f"""WITH {SQL_LINES}
        SELECT doc_id, line_no, {sql_term('line')} AS term,
               {sql_strip("replace(lower(line), '_', ' ')")} AS label FROM lines""",
)
def term_normalise(t: Tables):
    return document_lines(t).select(
        "doc_id",
        "line_no",
        tx.normalise_term(F.col("line")).alias("term"),
        tx.label_key(F.col("line")).alias("label"),
    )


@query(
    "clean_text_gold",
    "doc_id:bigint, cleaned:string",
    f"""SELECT doc_id, nfc_normalize(regexp_replace(
            regexp_replace({sql_strip('text')}, '\\s+', ' ', 'g'),
            '[^\\p{{L}}\\p{{N}}_ .-]', '', 'g')) AS cleaned FROM documents""",
)
def clean_text_gold(t: Tables):
    return t.documents.select("doc_id", tx.clean_gold(F.col("text")).alias("cleaned"))


@query(
    "clean_text_training",
    "doc_id:bigint, cleaned:string",
    """SELECT doc_id, regexp_replace(
            trim(replace(text, '_', ' '), ' .,;!?"''()[]{}'), '\\s+', ' ', 'g') AS cleaned
       FROM documents""",
)
def clean_text_training(t: Tables):
    return t.documents.select("doc_id", tx.clean_training(F.col("text")).alias("cleaned"))


@query(
    "sentence_split",
    "doc_id:bigint, sent_no:bigint, sentence:string",
    # some words get a decimal, an exclamation or a question mark
    f"""SELECT doc_id, unnest(sentences) AS sentence,
               generate_subscripts(sentences, 1) - 1 AS sent_no
        FROM (SELECT doc_id, {sql_sentences("replace(replace(replace(text, ' the ', ' 5.5 '), ' of ', '! '), ' la ', '?! ')")} AS sentences
              FROM documents)""",
)
def sentence_split(t: Tables):
    text = F.col("text")
    for word, mark in ((" the ", " 5.5 "), (" of ", "! "), (" la ", "?! ")):
        text = F.replace(text, F.lit(word), F.lit(mark))
    return t.documents.select("doc_id", F.posexplode(tx.sentences(text)).alias("sent_no", "sentence"))


@query(
    "sentence_split_at_points",
    "doc_id:bigint, sent_no:bigint, sentence:string",
    f"""SELECT doc_id, unnest(sentences) AS sentence,
               generate_subscripts(sentences, 1) - 1 AS sent_no
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '.'),
                lambda s: {sql_strip('s')}), lambda s: s <> '') AS sentences FROM documents)""",
)
def sentence_split_at_points(t: Tables):
    return t.documents.select(
        "doc_id", F.posexplode(tx.sentences(F.col("text"), at_points=True)).alias("sent_no", "sentence")
    )


@query(
    "term_cleanup",
    "doc_id:bigint, line_no:bigint, word:string, term:string",
    f"""WITH {SQL_LINES}, cut AS (
          SELECT doc_id, line_no, replace(replace({sql_strip('line')}, '@@', ''), '##', '') AS word
          FROM lines),
        done AS (SELECT *, trim(word, '{lx.PUNCTUATION.replace("'", "''")} ' || chr(9) || chr(10) || chr(13))
                 AS term FROM cut)
        SELECT * FROM done WHERE length(term) >= 3""",
)
def term_cleanup(t: Tables):
    word = tx.drop_subword_marks(F.col("line"))
    return (
        document_lines(t)
        .select("doc_id", "line_no", word.alias("word"))
        .withColumn("term", tx.strip_punctuation(F.col("word")))
        .where(F.length("term") >= lx.MIN_TERM_LENGTH)
    )


def _turn_pairs(t: Tables):
    """Each conversation turn beside the one before it."""
    now = t.conversations.select("conv_id", "turn", F.col("text").alias("now"))
    before = t.conversations.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")
    )
    return now.join(before, ["conv_id", "turn"])


@query(
    "token_jaccard",
    "conv_id:bigint, turn:bigint, jaccard:double",
    f"""WITH sets AS (SELECT conv_id, turn, list_distinct({sql_words('lower(text)')}) AS s
                      FROM conversations)
        SELECT a.conv_id, a.turn,
               CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1.0
                    ELSE len(list_intersect(a.s, b.s))::double
                         / len(list_distinct(list_concat(a.s, b.s))) END AS jaccard
        FROM sets a JOIN sets b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
)
def token_jaccard(t: Tables):
    return _turn_pairs(t).select(
        "conv_id", "turn", tx.token_jaccard(F.col("now"), F.col("before")).alias("jaccard")
    )


# No SQL engine has the gestalt ratio; tests compare it with the definition.
@query("gestalt_ratio", "conv_id:bigint, turn:bigint, ratio:double")
def gestalt_ratio(t: Tables):
    return _turn_pairs(t).select(
        "conv_id", "turn", gestalt(F.col("now"), F.col("before")).alias("ratio")
    )


# a row of the distance table per gold word; within a row, a running minimum
@query(
    "word_error_rate",
    "conv_id:bigint, turn:bigint, wer:double",
    f"""WITH RECURSIVE turns AS (SELECT conv_id, turn, {sql_words('text')} AS ws FROM conversations),
        pairs AS (SELECT b.conv_id, b.turn, a.ws AS g, b.ws AS p
                  FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
        steps AS (
          SELECT conv_id, turn, g, p, 0 AS i, range(0, len(p) + 1) AS costs FROM pairs
          UNION ALL
          SELECT conv_id, turn, g, p, i + 1,
                 list_transform(range(0, len(p) + 1), lambda j: j + list_min(shifted[1:j + 1])) AS costs
          FROM (
            SELECT *, list_transform(range(0, len(p) + 1), lambda j:
                     CASE WHEN j = 0 THEN costs[1] + 1
                          ELSE least(costs[j + 1] + 1, costs[j] + CASE WHEN g[i + 1] = p[j] THEN 0 ELSE 1 END) END - j) AS shifted
            FROM steps WHERE i < len(g)))
        SELECT conv_id, turn, CASE WHEN len(g) > 0 THEN costs[-1] / len(g)::double WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END AS wer
        FROM steps WHERE i = len(g)""",
)
def wer(t: Tables):
    return _turn_pairs(t).select(
        "conv_id", "turn", word_error_rate(F.col("before"), F.col("now")).alias("wer")
    )


@query(
    "fenced_json",
    "event_id:bigint, k:bigint",
    """WITH answers AS (
         SELECT event_id, CASE event_type
             WHEN 'click' THEN 'Result:' || chr(10) || '```JSON' || chr(10) || props || chr(10) || '``` done'
             WHEN 'error' THEN left(props, length(props) - 1)
             ELSE '  ' || props || chr(10) END AS answer
         FROM events),
       cut AS (SELECT event_id, trim(CASE WHEN regexp_matches(answer, '(?is)```json\\s*(.*?)\\s*```')
             THEN regexp_extract(answer, '(?is)```json\\s*(.*?)\\s*```', 1) ELSE answer END,
             ' ' || chr(10)) AS body FROM answers)
       SELECT event_id, CASE WHEN json_valid(body) THEN (body::json ->> 'k')::bigint END AS k FROM cut""",
)
def fenced_json(t: Tables):
    props = F.col("props")
    answer = (
        F.when(
            F.col("event_type") == "click",
            F.concat(F.lit("Result:\n```JSON\n"), props, F.lit("\n``` done")),
        )
        .when(F.col("event_type") == "error", F.left(props, F.length(props) - 1))
        .otherwise(F.concat(F.lit("  "), props, F.lit("\n")))
    )
    parsed = F.from_json(tx.fenced_json(answer), T.StructType([T.StructField("k", T.LongType())]))
    return t.events.select("event_id", parsed["k"].alias("k"))


@query(
    "malformed_json_counts",
    "event_type:string, records:bigint, malformed:bigint, k_sum:bigint",
    """WITH lines AS (SELECT event_type, CASE WHEN event_type = 'error'
             THEN left(props, length(props) - 1) ELSE props END AS line FROM events)
       SELECT event_type, count(*) AS records, count(*) FILTER (NOT json_valid(line)) AS malformed,
              coalesce(sum(CASE WHEN json_valid(line) THEN (line::json ->> 'k')::bigint END), 0) AS k_sum
       FROM lines GROUP BY event_type""",
)
def malformed_json_counts(t: Tables):
    props = F.col("props")
    line = F.when(
        F.col("event_type") == "error", F.left(props, F.length(props) - 1)
    ).otherwise(props)
    schema = T.StructType([T.StructField("k", T.LongType())])
    parsed = readers.parse_json_lines(t.events.withColumn("line", line), "line", schema)
    return parsed.groupBy("event_type").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("malformed") | F.col("parsed.k").isNull()).alias("malformed"),
        F.coalesce(F.sum("parsed.k"), F.lit(0)).alias("k_sum"),
    )


@query(
    "vector_text",
    "vec_id:bigint, n:bigint, total:double",
    """SELECT vec_id, len(v) AS n, list_sum(list_transform(v, lambda x: x::float::double)) AS total
       FROM (SELECT vec_id, list_filter(list_transform(embedding::double[],
               lambda x: printf('%.6f', x)), lambda s: true) AS v FROM embeddings)""",
)
def vector_text(t: Tables):
    printed = F.concat(
        F.lit("["),
        F.array_join(
            F.transform("embedding", lambda x: F.format_string("%.6f", x.cast("double"))), " "
        ),
        F.lit("]"),
    )
    vector = tx.parse_vector(printed)
    return t.embeddings.select(
        "vec_id",
        F.size(vector).alias("n"),
        F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"),
    )


@query(
    "multilabel",
    "vec_id:bigint, cui:string, probability:double",
    """SELECT vec_id, 'C' || (i - 1) AS cui, 1 / (1 + exp(-20 * x)) AS probability
       FROM (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i
             FROM embeddings)
       WHERE 1 / (1 + exp(-20 * x)) >= 0.5""",
)
def multilabel(t: Tables):
    dims = t.embeddings.agg(F.max(F.size("embedding")).alias("n"))
    names = dims.select(
        F.to_json(
            F.transform(
                F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("C"), i.cast("string"))
            )
        ).alias("value")
    )
    classes = readers.class_list(names, "value")
    logits = t.embeddings.select("vec_id", F.posexplode("embedding").alias("class_idx", "x"))
    return (
        logits.withColumn("probability", sigmoid(F.col("x").cast("double") * 20))
        .where(F.col("probability") >= lx.LABEL_PROBABILITY)
        .join(classes, "class_idx")
    )


@query(
    "chat_roles",
    "conv_id:bigint, first_answer:string, last_question:string, n:bigint",
    """SELECT conv_id,
              arg_min(text, turn) FILTER (role = 'assistant') AS first_answer,
              arg_max(text, turn) FILTER (role = 'user') AS last_question, count(*) AS n
       FROM conversations GROUP BY conv_id""",
)
def chat_roles(t: Tables):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    chats = t.conversations.groupBy("conv_id").agg(
        F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
            "messages"
        )
    )
    back = F.from_json(F.to_json("messages"), "array<struct<role:string,content:string>>")
    return chats.withColumn("messages", back).select(
        "conv_id",
        tx.role_content(F.col("messages"), "assistant").alias("first_answer"),
        tx.role_content(F.col("messages"), "user", last=True).alias("last_question"),
        F.size("messages").alias("n"),
    )


@query(
    "first_nonempty_name",
    "p_partkey:bigint, name:string",
    """WITH cells AS (
         SELECT p_partkey, p_size > 25 AS english,
                CASE WHEN p_type = 'PROMO' THEN '' ELSE p_name END AS name,
                CASE WHEN p_type = 'SMALL' THEN NULL WHEN p_size < 10 THEN '' ELSE p_brand END AS local
         FROM part)
       SELECT p_partkey, CASE WHEN english THEN coalesce(nullif(name, ''), nullif(local, ''))
                              ELSE coalesce(nullif(local, ''), nullif(name, '')) END AS name FROM cells""",
)
def first_nonempty_name(t: Tables):
    name = F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_name"))
    local = (
        F.when(F.col("p_type") == "SMALL", F.lit(None).cast("string"))
        .when(F.col("p_size") < 10, "")
        .otherwise(F.col("p_brand"))
    )
    picked = F.when(F.col("p_size") > 25, tx.first_nonempty(name, local)).otherwise(
        tx.first_nonempty(local, name)
    )
    return t.part.select("p_partkey", picked.alias("name"))
