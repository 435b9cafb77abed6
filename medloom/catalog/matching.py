"""Dictionary matches that tolerate spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from medloom.catalog.inputs import dictionary_terms
from medloom.catalog.registry import SQL_TERMS, Tables, query
from medloom.operators.similarity_join import similarity_join

THRESHOLD = 0.7

# all pairs of words that have a character trigram in common
SQL_CLOSE = f"""
words AS (
  SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS word FROM documents) WHERE length(word) >= 5
),
grams AS (
  SELECT DISTINCT word, substr('^' || word || '$', i::int, 3) AS g FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
),
term_grams AS (
  SELECT DISTINCT word AS term, substr('^' || word || '$', i::int, 3) AS g FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM terms)
),
sizes AS (SELECT word, count(*) AS n FROM grams GROUP BY word),
term_sizes AS (SELECT term, count(*) AS n FROM term_grams GROUP BY term),
close AS (
  SELECT word, term, common::double / (a.n + b.n - common) AS similarity
  FROM (SELECT word, term, count(*) AS common FROM grams JOIN term_grams USING (g) GROUP BY word, term)
  JOIN sizes a USING (word) JOIN term_sizes b USING (term)
  WHERE common::double / (a.n + b.n - common) >= {THRESHOLD}
)"""


@query(
    "approximate_matches",
    "word:string, term:string, similarity:double",
    f"WITH {SQL_TERMS}, {SQL_CLOSE} SELECT word, term, similarity FROM close",
)
def approximate_matches(t: Tables):
    """Words of the documents and dictionary words of similar spelling."""
    words = t.documents.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("text")).where(F.length("text") >= 5)
    terms = dictionary_terms(t).select(F.col("word").alias("text"))
    return similarity_join(words, terms, THRESHOLD).select(
        F.col("left_text").alias("word"), F.col("right_text").alias("term"), "similarity"
    )
