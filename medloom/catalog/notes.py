"""Rules around mentions, and the composite jobs over notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.catalog.inputs import RULES, dictionary_terms, mentions, with_mentions
from medloom.catalog.registry import (
    SQL_MENTIONS, SQL_TERMS, Tables, query, sql_bounds, sql_context, sql_flags, sql_keep,
    sql_sentences, sql_still_disease, sql_strip, sql_term, sql_type, sql_words,
)
from medloom.catalog.sequences import SQL_FORWARD
from medloom.functions import context as cx
from medloom.functions import text as tx
from medloom.functions.similarity import best_overlap
from medloom.operators.lookup import vocabulary_codes
from medloom.plans.extraction import Extractor
from medloom.plans.models import LexiconAnnotator, LexiconMatcher, NgramEncoder, dictionary_vectors
from medloom.plans.notes import Dictionaries, process_notes, typed_mentions
from medloom.sources.writers import note_json



def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(
    "section_bounds",
    "doc_id:bigint, s1:bigint, s2:bigint, s3:bigint",
    f"SELECT doc_id, unnest({sql_bounds('text', RULES)}) FROM documents",
)
def section_bounds(t: Tables):
    bounds = cx.section_bounds(F.col("text"), RULES)
    return t.documents.select("doc_id", bounds.alias("b")).select("doc_id", "b.*")


@query(
    "mention_assertions",
    "doc_id:bigint, start:bigint, end:bigint, assertions:string",
    f"""WITH {SQL_MENTIONS},
        bounds AS (SELECT doc_id, {sql_bounds('text', RULES)} AS b FROM documents),
        {sql_flags('mentions', RULES)}
        SELECT doc_id, start, stop AS "end", concat_ws(',',
               CASE WHEN b.s1 <> -1 AND b.s1 <= start AND start < b.s2 THEN 'isHistorical' END,
               CASE WHEN on_line OR in_clause THEN 'isNegated' END) AS assertions
        FROM flags JOIN bounds USING (doc_id)""",
)
def mention_assertions(t: Tables):
    # each mention leaves its text with its surroundings, which are read as columns of its row
    bounds, blocks = cx.section_bounds(F.col("text"), RULES).alias("bounds"), F.col("_blocks")
    at = lambda c, m: cx.surroundings_nearby(c, blocks, m["start"], m["end"], RULES)
    historical = lambda c, m: cx.is_historical(m["start"], F.col("bounds"))
    cut = mentions(t, bounds, blocks=True, at=at, historical=historical)
    negated = cx.is_negated(F.col("at.prefix"), F.col("at.term"), F.col("at.suffix"), RULES)
    flags = cx.assertion_flags(F.col("historical"), negated)
    return cut.select("doc_id", "start", "end", F.array_join(flags, ",").alias("assertions"))


@query(
    "clause_negation",
    "doc_id:bigint, start:bigint, end:bigint, assertions:string",
    f"""WITH {SQL_MENTIONS}, {sql_flags('mentions', RULES)}
        SELECT doc_id, start, stop AS "end", CASE WHEN in_clause THEN 'isNegated' ELSE '' END AS assertions
        FROM flags""",
)
def clause_negation(t: Tables):
    flags = lambda c, m: cx.assertions(c, m["start"], m["end"], None, RULES, line_rule=False)
    return mentions(t, flags=flags).select(
        "doc_id", "start", "end", F.array_join("flags", ",").alias("assertions")
    )


_WORD = r"[^\s!-/:-@\[-`{-~]"


@query(
    "boundary_repair",
    "doc_id:bigint, start:bigint, end:bigint, term:string",
    f"""WITH {SQL_MENTIONS},
        cut AS (SELECT doc_id, text, start + 1 AS start, stop - 1 AS stop FROM mentions),
        grown AS (
          SELECT doc_id, text, start - length(regexp_extract(substr(text, 1, start), '{_WORD}*$')) AS start,
                 stop + length(regexp_extract(substr(text, stop + 1), '^{_WORD}*')) AS stop FROM cut)
        SELECT doc_id, start, stop AS "end", substr(text, start + 1, stop - start) AS term FROM grown""",
)
def boundary_repair(t: Tables):
    """Mentions with their first and last letter cut off grow back."""

    def grown(c, m):
        span = cx.repair_boundaries(c, m["start"] + 1, m["end"] - 1)
        return tx.let(
            span, lambda s: s.withField("term", tx.slice_text(c, s["start"], s["end"]))
        )

    return mentions(t, grown=grown).select("doc_id", "grown.*")


@query(
    "drug_expansion",
    "doc_id:bigint, start:bigint, end:bigint, display:string",
    f"""WITH {SQL_MENTIONS},
        grown AS (SELECT doc_id, text, start, stop + length(regexp_replace(regexp_extract(
            substr(text, stop + 1), {_lit('(?i)' + RULES.dose_tail)}), '\\s+$', '')) AS stop FROM mentions)
        SELECT doc_id, start, stop AS "end", substr(text, start + 1, stop - start) AS display FROM grown""",
)
def drug_expansion(t: Tables):

    def grown(c, m):
        end = cx.expand_drug(c, m["end"], RULES.dose_tail)
        return tx.let(
            end, lambda e: F.struct(e.alias("end"), tx.slice_text(c, m["start"], e).alias("display"))
        )

    return mentions(t, grown=grown).select("doc_id", "start", "grown.end", "grown.display")


@query(
    "drug_context",
    "doc_id:bigint, start:bigint, end:bigint, in_context:boolean",
    f"""WITH {SQL_MENTIONS} SELECT doc_id, start, stop AS "end", {sql_context('start', 'stop', RULES)} AS in_context
        FROM mentions""",
)
def drug_context(t: Tables):
    near = lambda c, m: cx.has_drug_context(c, m["start"], m["end"], RULES)
    return mentions(t, in_context=near).select("doc_id", "start", "end", "in_context")


SQL_RESULT = f"""{sql_strip("regexp_replace(" + sql_strip("rest") + ", '^[:-]+\\s*', '')")}"""


@query(
    "result_capture",
    "doc_id:bigint, test_end:bigint, text:string, start:bigint, end:bigint",
    f"""WITH {SQL_MENTIONS},
        rests AS (SELECT doc_id, stop, regexp_extract(substr(text, stop + 1), '^[^\\n]*') AS rest FROM mentions),
        cut AS (SELECT *, {SQL_RESULT} AS value FROM rests)
        SELECT doc_id, stop AS test_end, value AS text, stop + instr(rest, value) - 1 AS start,
               stop + instr(rest, value) - 1 + length(value) AS "end" FROM cut WHERE value <> ''""",
)
def result_capture(t: Tables):
    found = mentions(t, r=lambda c, m: cx.result_after(c, m["end"])).select(
        "doc_id", F.col("end").alias("test_end"), "r"
    )
    return found.where(F.col("r").isNotNull()).select("doc_id", "test_end", "r.*")


def _kind(word):
    head = F.lower(F.left(word, F.lit(1)))
    return (
        F.when(head.isin("t", "é"), lx.TEST_NAME)
        .when(head.rlike("^[0-9do]"), lx.DRUG)
        .otherwise(F.lit(None).cast("string"))
    )


_SQL_KIND = """CASE WHEN lower(left({0}, 1)) IN ('t', 'é') THEN 'TÊN_XÉT_NGHIỆM'
  WHEN regexp_matches(lower(left({0}, 1)), '^[0-9do]') THEN 'THUỐC' END"""


@query(
    "precision_filter",
    "word:string, term:string, kind:string, keep:boolean",
    f"""WITH words AS (SELECT DISTINCT unnest({sql_words('text')}) AS word FROM documents),
        terms AS (SELECT word, {sql_term('word')} AS term, {_SQL_KIND.format('word')} AS kind FROM words)
        SELECT *, {sql_keep('term', 'kind', RULES)} AS keep FROM terms""",
)
def precision_filter(t: Tables):
    words = t.documents.select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    terms = words.select(
        "word",
        tx.normalise_term(F.col("word"), RULES.term_strip).alias("term"),
        _kind(F.col("word")).alias("kind"),
    )
    return terms.withColumn("keep", cx.passes_precision(F.col("term"), F.col("kind"), RULES))


@query(
    "type_correction",
    "doc_id:bigint, start:bigint, term:string, type:string, is_disease:boolean",
    f"""WITH {SQL_MENTIONS},
        typed AS (SELECT *, lower(surface) AS term, CASE WHEN item_id > 10 THEN {_SQL_KIND.format('surface')} END AS kind
                  FROM mentions)
        SELECT doc_id, start, term, {sql_type('term', 'kind', 'kind IS NULL', sql_context('start', 'stop', RULES), RULES)} AS type,
               {sql_still_disease('term', 'kind IS NULL', RULES)} AS is_disease FROM typed""",
)
def type_correction(t: Tables):
    term = F.lower("surface")
    kind = F.when(F.col("item_id") > 10, _kind(F.col("surface")))
    fix = cx.correct_type(
        term, kind, kind.isNull(), F.col("in_context"), RULES
    )
    near = lambda c, m: cx.has_drug_context(c, m["start"], m["end"], RULES)
    return mentions(t, in_context=near).select("doc_id", "start", term.alias("term"), fix.alias("f")).select(
        "doc_id", "start", "term", "f.*"
    )


# --- composite jobs -----------------------------------------------------------


def _label(word):
    """Tagger label of a dictionary word, decided by its first letter."""
    head = F.left(word, F.lit(1))
    return (
        F.when(head.isin("t", "l"), "Procedure")
        .when(head.isin("a", "e", "h"), "Disease")
        .when(head.isin("o", "i"), "Drug")
        .when(head == "s", "Disease/Symptom")
        .otherwise("Other")
    )


_SQL_LABEL = """CASE WHEN left({0}, 1) IN ('t', 'l') THEN 'Procedure' WHEN left({0}, 1) IN ('a', 'e', 'h') THEN 'Disease'
  WHEN left({0}, 1) IN ('o', 'i') THEN 'Drug' WHEN left({0}, 1) = 's' THEN 'Disease/Symptom' ELSE 'Other' END"""


# from `labelled` mentions to `typed` ones; `idx` numbers those of a document
SQL_TYPED = f"""grown AS (
          SELECT doc_id, text, idx, label, start - length(regexp_extract(substr(text, 1, start), '{_WORD}*$')) AS start,
                 stop + length(regexp_extract(substr(text, stop + 1), '^{_WORD}*')) AS stop
          FROM labelled WHERE label <> 'Other'),
        named AS (
          SELECT *, {sql_term('substr(text, start + 1, stop - start)')} AS name,
                 CASE label WHEN 'Procedure' THEN 'TÊN_XÉT_NGHIỆM' WHEN 'Drug' THEN 'THUỐC' END AS kind0,
                 label IN ('Disease', 'Disease/Symptom') AS disease0 FROM grown),
        fixed AS (
          SELECT *, {sql_type('name', 'kind0', 'disease0', sql_context('start', 'stop', RULES), RULES)} AS kind,
                 {sql_still_disease('name', 'disease0', RULES)} AS is_disease
          FROM named WHERE {sql_keep('name', 'kind0', RULES)}),
        {sql_flags('fixed', RULES)},
        bounds AS (SELECT doc_id, {sql_bounds('text', RULES)} AS b FROM documents),
        final AS (
          SELECT *, CASE WHEN kind = 'THUỐC' THEN stop + length(regexp_replace(regexp_extract(suffix,
                   {_lit('(?i)' + RULES.dose_tail)}), '\\s+$', '')) ELSE stop END AS shown,
                 CASE WHEN kind = 'TÊN_XÉT_NGHIỆM' AND start >= b.s3
                      THEN regexp_extract(suffix, '^[^\\n]*') ELSE '' END AS rest
          FROM flags JOIN bounds USING (doc_id)),
        valued AS (SELECT *, {SQL_RESULT} AS value FROM final),
        typed AS (
          SELECT doc_id, idx, start, stop, shown, substr(text, start + 1, stop - start) AS term,
                 substr(text, start + 1, shown - start) AS display, kind, is_disease,
                 list_filter([CASE WHEN b.s1 <> -1 AND b.s1 <= start AND start < b.s2 THEN 'isHistorical' END,
                              CASE WHEN on_line OR in_clause THEN 'isNegated' END], lambda x: x IS NOT NULL) AS assertions,
                 nullif(value, '') AS result,
                 CASE WHEN value <> '' THEN stop + instr(rest, value) - 1 END AS result_start FROM valued)"""


@query(
    "typed_mentions",
    "doc_id:bigint, start:bigint, end:bigint, term:string, display:string, kind:string, "
    "is_disease:boolean, assertions:string, result:string, result_start:bigint",
    f"""WITH {SQL_MENTIONS},
        labelled AS (SELECT doc_id, text, start AS idx, start, stop, {_SQL_LABEL.format('lower(surface)')} AS label FROM mentions),
        {SQL_TYPED}
        SELECT doc_id, start, shown AS "end", term, display, kind, is_disease,
               array_to_string(assertions, ',') AS assertions, result, result_start FROM typed""",
)
def typed_mentions_query(t: Tables):
    labelled = F.transform(
        "found",
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _label(F.lower(m["surface"])).alias("label")),
    )
    notes = with_mentions(t).select(
        "doc_id", "text", cx.section_bounds(F.col("text"), RULES).alias("bounds"), labelled.alias("mentions")
    )
    return typed_mentions(notes, RULES).select(
        "doc_id", "start", "end", "term", "display", "kind", "is_disease",
        F.array_join("assertions", ",").alias("assertions"),
        F.col("result.text").alias("result"),
        F.col("result.start").alias("result_start"),
    )


def _annotator(t: Tables) -> LexiconAnnotator:
    return LexiconAnnotator(
        dictionary_terms(t).select(
            F.col("word").alias("term"), _label(F.col("word")).alias("label"),
            F.col("item_id").alias("row_idx"),
        )
    )


def _notes(t: Tables):
    return t.documents.select("doc_id", "text")


SQL_MERGED = (
    SQL_FORWARD
    + f""",
  located AS (
    SELECT doc_id, line_no, n, word AS term, CASE WHEN hit > 0 THEN line_start + hit - 1 END AS start,
           CASE WHEN hit > 0 THEN line_start + hit - 1 + length(word) END AS stop,
           {_SQL_LABEL.format("trim(lower(word), ' .,;:-()[]{}')")} AS label
    FROM found WHERE n > 0),
  opened AS (
    SELECT *, CASE WHEN label = lag(label) OVER w AND start - lag(stop) OVER w <= 1 THEN 0 ELSE 1 END AS opens
    FROM located WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, n)),
  islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no, n ROWS UNBOUNDED PRECEDING) AS island
              FROM opened),
  merged AS (
    SELECT i.doc_id, i.label, arg_min(i.start, struct_pack(line_no, n))::bigint AS start,
           arg_max(i.stop, struct_pack(line_no, n))::bigint AS stop,
           arg_min(i.term, struct_pack(line_no, n)) AS head, count(*) AS parts,
           min(struct_pack(line_no, n)) AS place
    FROM islands i GROUP BY i.doc_id, i.island, i.label),
  cleaned AS (
    SELECT m.doc_id, m.label, m.start, m.stop, m.place, trim(CASE WHEN parts > 1 THEN substr(d.text, m.start + 1, m.stop - m.start)
           ELSE head END, '{lx.PUNCTUATION.replace("'", "''")} ' || chr(9) || chr(10) || chr(13)) AS term
    FROM merged m JOIN documents d USING (doc_id)),
  extracted AS (SELECT * FROM cleaned WHERE length(term) >= 3)"""
)


@query(
    "extract_ner",
    "doc_id:bigint, term:string, start:bigint, end:bigint, label:string",
    SQL_MERGED + ' SELECT doc_id, term, start, stop AS "end", label FROM extracted',
)
def extract_ner(t: Tables):
    return Extractor("ner only", annotator=_annotator(t)).extract(_notes(t))


DIMS = 64

SQL_NGRAMS = f"""grams AS (
  SELECT name, substr('^' || name || '$', i::int, 3) AS g
  FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM names)),
gram_counts AS (SELECT name, ('0x' || substr(md5(g), 1, 8))::bigint % {DIMS} AS dim, count(*) AS n FROM grams GROUP BY ALL),
norms AS (SELECT name, sqrt(sum(n * n)) AS norm FROM gram_counts GROUP BY name),
dots AS (
  SELECT a.name AS q, b.name AS d, sum(a.n * b.n) AS dot FROM gram_counts a JOIN gram_counts b USING (dim) GROUP BY ALL),
sims AS (SELECT q, d, dot / (x.norm * y.norm) AS sim FROM dots JOIN norms x ON x.name = q JOIN norms y ON y.name = d)"""


def _concepts(t: Tables):
    """Dictionary words as concepts of the class their first letter gives."""
    words = dictionary_terms(t)
    cui = (
        F.when(F.length("word") == 5, "")
        .when(F.length("word") == 6, F.concat(F.lit("C_"), "word"))
        .otherwise(F.concat(F.lit("C"), "word"))
    )
    rows = words.select(
        F.col("word").alias("row_idx"), F.col("word").alias("entity"), cui.alias("mapped_cui"),
        _label(F.col("word")).alias("macro_type"),
        _label(F.col("word")).alias("original_type"),
    )
    return rows.withColumn("vector", NgramEncoder(DIMS).vector(F.col("entity")))


def _word_codes(t: Tables):
    vocabulary = dictionary_terms(t).select(
        F.concat(F.lit("C"), "word").alias("CUI"), F.lit("MSH").alias("SAB"),
        F.col("item_id").cast("string").alias("CODE"), F.col("item_id").alias("row_idx"),
    )
    return vocabulary_codes(vocabulary, "row_idx")


@query(
    "extract_linked",
    "doc_id:bigint, term:string, start:bigint, end:bigint, label:string, canonical_name:string, "
    "cui:string, similarity:double, mesh:string",
    SQL_MERGED
    + f""",
  wanted AS (SELECT DISTINCT label, term FROM extracted),
  names AS (SELECT term AS name FROM wanted UNION SELECT word FROM terms),
  {SQL_NGRAMS.replace('grams AS', 'ngrams AS').replace('FROM grams', 'FROM ngrams')},
  near AS (
    SELECT w.label, w.term, d AS entity, sim, row_number() OVER (PARTITION BY w.label, w.term
             ORDER BY list_contains(string_split_regex(lower(w.term), '\\s+'), d)::int DESC, d) AS rk
    FROM wanted w JOIN sims ON q = w.term JOIN terms ON word = d AND {_SQL_LABEL.format('word')} = w.label
    WHERE sim > 0.7)
  SELECT e.doc_id, e.term, e.start, e.stop AS "end", e.label, coalesce(n.entity, e.term) AS canonical_name,
         CASE length(n.entity) WHEN 5 THEN NULL WHEN 6 THEN 'C_' || n.entity ELSE 'C' || n.entity END AS cui,
         coalesce(n.sim, 1.0) AS similarity,
         CASE WHEN length(n.entity) > 6 THEN t.item_id::varchar END AS mesh
  FROM extracted e LEFT JOIN near n ON n.label = e.label AND n.term = e.term AND n.rk = 1
  LEFT JOIN terms t ON t.word = n.entity""",
)
def extract_linked(t: Tables):
    extractor = Extractor(
        "ner + retrieval", annotator=_annotator(t), encoder=NgramEncoder(DIMS),
        concepts=_concepts(t), codes=_word_codes(t),
    )
    return extractor.extract(_notes(t)).withColumn(
        "mesh", F.try_element_at("codes", F.lit("mesh"))
    )


@query(
    "extract_matched",
    "doc_id:bigint, term:string, start:bigint, end:bigint, canonical_name:string, category:string, "
    "label:string, cui:string, similarity:double, mesh:string",
    f"""WITH RECURSIVE {SQL_TERMS},
        sents AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS sent_no FROM (
            SELECT doc_id, {sql_sentences('text')} AS ss FROM documents)),
        grams AS (
          SELECT doc_id, sent_no, i, trim(piece, '{lx.PUNCTUATION.replace("'", "''")} ' || chr(9) || chr(10) || chr(13)) AS word
          FROM (SELECT doc_id, sent_no, unnest(string_split(s, ' ')) AS piece,
                       generate_subscripts(string_split(s, ' '), 1) AS i FROM sents)),
        hits AS (SELECT g.*, t.word AS entity, t.item_id FROM grams g JOIN terms t
                 ON {sql_term('g.word')} = t.word WHERE g.word <> ''),
        best AS (SELECT doc_id, word, min(struct_pack(sent_no, i)) AS first, any_value(entity) AS entity,
                        any_value(item_id) AS item_id FROM hits GROUP BY doc_id, word),
        placed AS (SELECT b.*, d.text, instr(lower(d.text), lower(b.word)) AS off FROM best b JOIN documents d USING (doc_id)),
        ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY off, first) AS n FROM placed),
        found AS (
          SELECT doc_id, text, 0 AS n, 0 AS pos, '' AS word, 0 AS hit, '' AS entity, 0::bigint AS item_id
          FROM ranked WHERE n = 1
          UNION ALL
          SELECT r.doc_id, r.text, f.n + 1,
                 CASE WHEN instr(substr(lower(r.text), f.pos + 1), lower(r.word)) > 0
                      THEN (f.pos + instr(substr(lower(r.text), f.pos + 1), lower(r.word)) - 1 + length(r.word))::int
                      ELSE f.pos END,
                 r.word, CASE WHEN instr(substr(lower(r.text), f.pos + 1), lower(r.word)) > 0
                      THEN (f.pos + instr(substr(lower(r.text), f.pos + 1), lower(r.word)))::int ELSE 0 END,
                 r.entity, r.item_id
          FROM found f JOIN ranked r ON r.doc_id = f.doc_id AND r.n = f.n + 1)
        SELECT doc_id, CASE WHEN hit > 0 THEN substr(text, hit, length(word)) ELSE word END AS term,
               CASE WHEN hit > 0 THEN hit - 1 END AS start,
               CASE WHEN hit > 0 THEN hit - 1 + length(word) END AS "end", entity AS canonical_name,
               CASE WHEN item_id < 10 THEN 'Phenotype' WHEN item_id < 20 THEN 'Drugs' ELSE 'Novel Type' END AS category,
               CASE WHEN item_id < 10 THEN 'Finding' WHEN item_id < 20 THEN 'Vitamin' ELSE 'Novel Type' END AS label,
               'C' || entity AS cui, 1.0 AS similarity, item_id::varchar AS mesh
        FROM found WHERE n > 0""",
)
def extract_matched(t: Tables):
    kind = (
        F.when(F.col("item_id") < 10, "Finding").when(F.col("item_id") < 20, "Vitamin").otherwise("Novel Type")
    )
    matcher = LexiconMatcher(
        dictionary_terms(t).select(
            F.col("word").alias("term"), F.concat(F.lit("C"), "word").alias("cui"),
            kind.alias("type"), F.col("item_id").alias("row_idx"),
        )
    )
    extractor = Extractor("quickumls", matcher=matcher, codes=_word_codes(t))
    return extractor.extract(_notes(t)).withColumn(
        "mesh", F.try_element_at("codes", F.lit("mesh"))
    )


class _LabelScorer:
    """Logits of five classes out of the labels table."""

    def __init__(self, t: Tables):
        self.labels = t.labels

    def score(self, notes):
        logits = F.array(
            F.when(F.col("quality") == 1, 0.4).otherwise(-0.4),
            F.when(F.col("toxic") == 1, 2.0).otherwise(0.0),
            F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.5).otherwise(-1.0),
            F.when(F.col("quality") == 0, 0.9).otherwise(-0.9),
            F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(-2.0),
        )
        return notes.select("doc_id").join(
            self.labels.select("doc_id", F.posexplode(logits).alias("class_idx", "logit")), "doc_id"
        )


@query(
    "extract_doc_class",
    "doc_id:bigint, class_idx:bigint, term:string, canonical_name:string, start:bigint, end:bigint, "
    "cui:string, similarity:double",
    """WITH scored AS (
         SELECT doc_id, 0 AS class_idx, CASE WHEN quality = 1 THEN 0.4 ELSE -0.4 END AS x FROM labels
         UNION ALL SELECT doc_id, 1, CASE WHEN toxic = 1 THEN 2.0 ELSE 0.0 END FROM labels
         UNION ALL SELECT doc_id, 2, CASE WHEN quality = 1 AND toxic = 0 THEN 1.5 ELSE -1.0 END FROM labels
         UNION ALL SELECT doc_id, 3, CASE WHEN quality = 0 THEN 0.9 ELSE -0.9 END FROM labels
         UNION ALL SELECT doc_id, 4, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE -2.0 END FROM labels),
       parts AS (SELECT p_partkey % 4 + 1 AS class_idx, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1),
       hits AS (SELECT s.doc_id, class_idx, 1 / (1 + exp(-x)) AS similarity, d.text,
                  CASE WHEN regexp_matches(d.text, '(?i)[äöüßéèêçñóí]') THEN 'vi' ELSE 'en' END AS lang
                FROM scored s JOIN documents d USING (doc_id) WHERE 1 / (1 + exp(-x)) >= 0.5),
       named AS (
         SELECT h.*, CASE WHEN class_idx > 0 THEN p_name
                          WHEN lang = 'en' THEN 'Of The' ELSE 'Que La' END AS canonical_name,
                CASE WHEN class_idx > 0 THEN [p_name]
                     WHEN lang = 'en' THEN ['Of The', 'Que La', 'Of The'] ELSE ['Que La', 'Que La', 'Of The'] END AS names
         FROM hits h LEFT JOIN parts USING (class_idx)),
       tried AS (SELECT *, list_filter(names, lambda n: contains(lower(text), lower(n)))[1] AS hit FROM named)
       SELECT doc_id, class_idx, CASE WHEN hit IS NULL THEN canonical_name
                ELSE substr(text, instr(lower(text), lower(hit)), length(hit)) END AS term, canonical_name,
              CASE WHEN hit IS NOT NULL THEN instr(lower(text), lower(hit)) - 1 END AS start,
              CASE WHEN hit IS NOT NULL THEN instr(lower(text), lower(hit)) - 1 + length(hit) END AS "end",
              'C' || class_idx AS cui, similarity FROM tried""",
)
def extract_doc_class(t: Tables):
    none = F.lit(None).cast("string")
    kg = t.region.where(F.col("r_regionkey") == 0).select(
        F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("uml_id"), F.lit("Of The").alias("name"), none.alias("medgemma_trans"),
        F.lit("Que La").alias("qwen_trans"), F.lit("").alias("map_trans"),
        F.col("r_regionkey").alias("row_idx"),
    )
    mapped = t.part.select(
        F.concat(F.lit("C"), (F.col("p_partkey") % 4 + 1).cast("string")).alias("mapped_cui"),
        F.col("p_name").alias("entity"),
        F.col("p_partkey").alias("row_idx"),
    )
    classes = t.region.select(
        F.col("r_regionkey").alias("class_idx"),
        F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("cui"),
    )
    extractor = Extractor(
        "doc_class", scorer=_LabelScorer(t), classes=classes, kg=kg, concepts=mapped,
        letters="äöüßéèêçñóí",
    )
    return extractor.extract(_notes(t)).withColumnRenamed("idx", "class_idx")


def _entities(t: Tables):
    """Every note through tagging, rules, retrieval and re-ranking.

    Words are compared by token overlap, which SQL has; the default measure is
    tested apart.
    """
    encoder = NgramEncoder(DIMS, raw=True)
    words = dictionary_terms(t).withColumn("label", _label(F.col("word")))

    def part(label: str, *columns):
        return dictionary_vectors(
            words.where(F.col("label") == label).select(F.col("word").alias("row_idx"), *columns),
            "name", encoder,
        )

    name = F.col("word").alias("name")
    dictionaries = Dictionaries(
        diagnosis=part("Disease", F.concat(F.lit("D"), "word").alias("id"), name),
        drug=part("Drug", F.concat(F.lit("R"), "word").alias("rxcui"), name),
        symptom=part("Disease/Symptom", name),
    )
    return process_notes(
        _notes(t), _annotator(t), dictionaries, encoder, rules=RULES, lexical=best_overlap
    )


def _sql_overlap(query: str, name: str) -> str:
    """Token overlap of two terms."""
    a, b = (f"list_distinct({sql_words(f'lower({x})')})" for x in (query, name))
    return f"(len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))))"


def _sql_reranked(name: str, queries: str, label: str, prefix: str) -> str:
    """CTE: the best of the three nearest words of a label by vector and wording."""
    overlap = f"greatest({_sql_overlap('w.q', 'd')}, {_sql_overlap('w.q', f"'{prefix}' || d")})"
    return f"""{name} AS (
          SELECT q, sim, '{prefix}' || d AS id FROM (
            SELECT q, d, sim, row_number() OVER (PARTITION BY q ORDER BY sim + {lx.LEXICAL_WEIGHT} * overlap DESC, rk) AS b FROM (
              SELECT w.q, d, sim, {overlap} AS overlap, row_number() OVER (PARTITION BY w.q ORDER BY sim DESC, d) AS rk
              FROM {queries} w JOIN close ON close.q = lower(w.q) JOIN terms ON word = d AND {_SQL_LABEL.format('word')} = '{label}'
            ) WHERE rk <= {lx.RETRIEVED} AND sim >= {lx.CANDIDATE_FLOOR})
          WHERE b = 1)"""


SQL_ENTITIES = f"""{SQL_MERGED},
  labelled AS (
    SELECT doc_id, d.text, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS idx, start, stop, label
    FROM extracted JOIN documents d USING (doc_id)),
  placed_labelled AS (SELECT * FROM labelled WHERE start IS NOT NULL),
  {SQL_TYPED.replace('FROM labelled', 'FROM placed_labelled')},
  disease_terms AS (SELECT DISTINCT term AS q FROM typed WHERE is_disease),
  drug_terms AS (SELECT DISTINCT display AS q FROM typed WHERE kind = '{lx.DRUG}'),
  names AS (SELECT lower(q) AS name FROM disease_terms UNION SELECT lower(q) FROM drug_terms UNION SELECT word FROM terms),
  {SQL_NGRAMS.replace('grams AS', 'ngrams AS', 1).replace('FROM grams', 'FROM ngrams')},
  close AS (SELECT q, d, round(sim, 12) AS sim FROM sims),
  {_sql_reranked('diagnoses', 'disease_terms', 'Disease', 'D')},
  {_sql_reranked('drugs', 'drug_terms', 'Drug', 'R')},
  symptoms AS (
    SELECT w.q, max(sim) AS sim FROM disease_terms w JOIN close ON close.q = lower(w.q)
    JOIN terms ON word = d AND {_SQL_LABEL.format('word')} = 'Disease/Symptom' WHERE sim >= {lx.DIAGNOSIS_FLOOR} GROUP BY w.q),
  diseases AS (
    SELECT w.q, d.sim >= coalesce(s.sim, -1) AND d.sim >= {lx.DIAGNOSIS_FLOOR} AS is_diagnosis, d.id
    FROM disease_terms w LEFT JOIN diagnoses d USING (q) LEFT JOIN symptoms s USING (q)),
  coded AS (
    SELECT t.*, CASE WHEN is_disease THEN CASE WHEN d.is_diagnosis THEN '{lx.DIAGNOSIS}' ELSE '{lx.SYMPTOM}' END ELSE kind END AS type,
           CASE WHEN is_disease AND d.is_diagnosis THEN [d.id] WHEN r.sim >= {lx.DRUG_FLOOR} THEN [r.id] ELSE [] END AS ids
    FROM typed t LEFT JOIN diseases d ON is_disease AND t.term = d.q
    LEFT JOIN drugs r ON kind = '{lx.DRUG}' AND t.display = r.q),
  entities AS (
    SELECT doc_id, idx * 2 AS entity_idx, display AS text, type, assertions, start, shown AS stop,
           CASE WHEN type IN ('{lx.DIAGNOSIS}', '{lx.DRUG}') THEN ids END AS candidates FROM coded
    UNION ALL
    SELECT doc_id, idx * 2 + 1, result, '{lx.TEST_RESULT}', [], result_start, result_start + length(result), []
    FROM coded WHERE result IS NOT NULL)"""


@query(
    "note_entities",
    "doc_id:bigint, entity_idx:bigint, text:string, type:string, assertions:string, start:bigint, "
    "end:bigint, candidates:string",
    SQL_ENTITIES
    + """ SELECT doc_id, entity_idx, text, type, array_to_string(assertions, ',') AS assertions, start, stop AS "end",
          array_to_string(candidates, ',') AS candidates FROM entities""",
)
def note_entities(t: Tables):
    return _entities(t).withColumn("assertions", F.array_join("assertions", ",")).withColumn(
        "candidates", F.array_join("candidates", ",")
    )


@query(
    "note_records",
    "doc_id:bigint, json:string",
    SQL_ENTITIES
    + """, records AS (
    SELECT doc_id, string_agg(CASE
             WHEN candidates IS NULL THEN to_json(struct_pack(text, type, assertions, position := [start, stop]))
             ELSE to_json(struct_pack(text, type, assertions, position := [start, stop], candidates)) END, ','
             ORDER BY entity_idx) AS json FROM entities GROUP BY doc_id)
  SELECT doc_id, '[' || coalesce(json, '') || ']' AS json FROM documents LEFT JOIN records USING (doc_id)""",
)
def note_records(t: Tables):
    return note_json(_notes(t), _entities(t))
