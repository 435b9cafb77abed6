"""Plug points for taggers, matchers, encoders and document scorers.

Neural weights are not part of this package.  The defaults are a dictionary
tagger and a character n-gram encoder, both native Spark expressions; a model
comes in through the ``Model*`` classes, which feed it Arrow batches.  Accuracy
of a neural tagger is not reproduced by the defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom import lexicon as lx
from medloom import schemas
from medloom.functions import text as tx
from medloom.functions.vector import unit
from medloom.operators.lookup import first_by
from medloom.operators.sequence import longest_matches
from medloom.operators.similarity_join import similarity_join
from medloom.operators.spans import overlap_best


class Annotator(Protocol):
    def annotate(self, notes: DataFrame) -> DataFrame:
        """Add ``raw``, ``array<struct<line_no,word,label>>`` in reading order."""
        ...


class Encoder(Protocol):
    def vector(self, text: Column) -> Column:
        """Unit vector of a string."""
        ...


class Matcher(Protocol):
    def match(self, sentences: DataFrame) -> DataFrame:
        """``[doc_id, sent_no, match_no, ngram, term, cui, similarity, type]``."""
        ...


class Scorer(Protocol):
    def score(self, notes: DataFrame) -> DataFrame:
        """``[doc_id, class_idx, logit]``."""
        ...


def _numbered_words(c: Column) -> Column:
    """``array<struct<at,token>>``: the tokens between single blanks that are not empty."""
    return F.filter(
        F.transform(F.split(c, " "), lambda t, i: F.struct(i.alias("at"), t.alias("token"))), lambda w: w["token"] != ""
    )


def _key(word: Column) -> Column:
    """The dictionary key of a phrase with its punctuation stripped."""
    return tx.normalise_term(word)


def _dictionary_hits(
    pieces: DataFrame, keys: list[str], text: str, terms: DataFrame
) -> DataFrame:
    """Leftmost-longest dictionary matches per row of ``pieces``.

    The dictionary is entered by first words, like a trie: each word of a text meets the
    terms of one word, and the first words of longer ones with the lengths that follow.
    Only where one matches is a longer phrase cut from its line and compared, so a term
    of any length costs no more than its first word occurs.  Neither side has to fit
    anywhere.  Returns the keys and ``hits: array<struct<line_no,start,end,word,hit>>``.
    """
    line, *group = keys[::-1]
    fields = [c for c in terms.columns if c != "key"]
    hit = F.struct(*fields).alias("hit")
    first = F.substring_index("key", " ", 1)
    length = F.size(F.split("key", " "))
    single = terms.where(length == 1).select("key", hit)
    longer = terms.where(length > 1)
    openers = longer.groupBy(first.alias("opener")).agg(F.sort_array(F.collect_set(length)).alias("lengths"))

    several = not longer.isEmpty()
    if several:
        cut = pieces.select(*keys, F.posexplode(_numbered_words(F.col(text))).alias("k", "w")).select(*keys, "k", "w.at", "w.token")
    else:
        # words need no number of their own
        cut = pieces.select(*keys, F.posexplode(F.split(text, " ")).alias("at", "token"))
    words = tx.staged(cut, tx.strip_punctuation(F.col("token")).alias("word")).where(F.col("word") != "")
    place = [F.col("at").alias("start"), (F.col("at") + 1).alias("end"), "word"]
    found = tx.staged(words.select(*keys, *place), _key(F.col("word")).alias("key")).join(single, "key").select(*keys, "start", "end", "word", "hit")
    if several:
        # the first word of a phrase keeps the punctuation behind it
        opener = F.ltrim(F.lower("token"), F.lit(lx.PUNCTUATION + " \t\n\r" + lx.VIETNAMESE.term_strip))
        asked = (
            tx.staged(words.select(*keys, "k", "token"), opener.alias("opener")).join(openers, "opener")
            .groupBy(*keys).agg(F.collect_list(F.struct("k", "lengths")).alias("asked"))
        )

        def phrases(row: Column) -> Column:
            def phrase(k: Column, n: Column) -> Column:
                begin, end = F.get(row["words"], k)["at"], F.get(row["words"], k + n - 1)["at"] + 1
                cut = F.array_join(F.slice(row["tokens"], begin + 1, end - begin), " ")
                return F.struct(begin.alias("start"), end.alias("end"), tx.strip_punctuation(cut).alias("word"))

            fits = lambda a: F.filter(a["lengths"], lambda n: a["k"] + n <= F.size(row["words"]))
            return F.flatten(F.transform("asked", lambda a: F.transform(fits(a), lambda n: phrase(a["k"], n))))

        row = F.struct(F.split(text, " ").alias("tokens"), _numbered_words(F.col(text)).alias("words"))
        cut = pieces.join(asked, keys).select(*keys, F.explode(tx.let(row, phrases)).alias("p")).select(*keys, "p.*")
        more = tx.staged(cut, _key(F.col("word")).alias("key")).join(longer.select("key", hit), "key")
        found = found.unionByName(more.select(*keys, "start", "end", "word", "hit"))
    item = F.struct(F.col(line).cast("int").alias("line_no"), "start", (-F.col("end")).alias("_e"), "end", "word", "hit")
    listed = found.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("_all"))
    return listed.select(*group, longest_matches(F.col("_all")).alias("hits"))


class LexiconAnnotator:
    """Tags dictionary terms: ``terms`` has ``term``, ``label`` and ``row_idx``."""

    def __init__(self, terms: DataFrame):
        keyed = terms.select(tx.normalise_term(F.col("term")).alias("key"), "label", "row_idx")
        self.terms = first_by(keyed.where(F.col("key") != ""), ["key"], "row_idx").drop("row_idx")

    def annotate(self, notes: DataFrame) -> DataFrame:
        lines = notes.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        found = _dictionary_hits(lines, ["doc_id", "line_no"], "line", self.terms)
        raw = F.transform(
            "hits",
            lambda h: F.struct(
                h["line_no"].alias("line_no"), h["word"].alias("word"),
                h["hit"]["label"].alias("label"),
            ),
        )
        return notes.join(found.select("doc_id", raw.alias("raw")), "doc_id", "left").withColumn(
            "raw", F.coalesce("raw", F.expr(f"cast(array() as {schemas.RAW_ENTITY})"))
        )


class LexiconMatcher:
    """Matches ``concepts`` (``term, cui, type, row_idx``) in sentences."""

    def __init__(self, concepts: DataFrame, keep: tuple[str, ...] = ()):
        keyed = concepts.select(
            tx.normalise_term(F.col("term")).alias("key"), "term", "cui", "type", "row_idx"
        )
        self.terms = first_by(keyed.where(F.col("key") != ""), ["key"], "row_idx").select("key", "term", "cui", "type", *keep)

    def match(self, sentences: DataFrame) -> DataFrame:
        found = _dictionary_hits(sentences, ["doc_id", "sent_no"], "sentence", self.terms)
        return found.select("doc_id", F.posexplode("hits").alias("match_no", "h")).select(
            "doc_id",
            F.col("h.line_no").alias("sent_no"),
            "match_no",
            F.col("h.word").alias("ngram"),
            F.col("h.hit.term").alias("term"),
            F.col("h.hit.cui").alias("cui"),
            tx.token_jaccard(F.col("h.word"), F.col("h.hit.term")).alias("similarity"),
            F.col("h.hit.type").alias("type"),
        )


class ApproximateMatcher:
    """Matches phrases of sentences whose spelling is close to a concept's.

    ``concepts`` as for ``LexiconMatcher``.  Phrases of up to ``window`` words are
    compared with terms by their character n-grams; a phrase takes its most similar
    term (the least ``row_idx`` of equals), a sentence the disjoint phrases with the
    greatest sum of similarity times words of the term.
    """

    def __init__(self, concepts: DataFrame, threshold: float = 0.7, window: int = 5, n: int = 3):
        self.terms = LexiconMatcher(concepts, keep=("row_idx",)).terms
        self.threshold, self.window, self.n = threshold, window, n

    def match(self, sentences: DataFrame) -> DataFrame:
        def phrases(words: Column) -> Column:
            def at(w: Column, i: Column) -> Column:
                lengths = F.sequence(F.lit(1), F.least(F.lit(self.window), F.size(words) - i))
                joined = lambda m: F.array_join(F.transform(F.slice(words, i + 1, m), lambda x: x["token"]), " ")
                return F.transform(lengths, lambda m: F.struct(i.alias("start"), (i + m).alias("end"), tx.strip_punctuation(joined(m)).alias("word")))

            return F.flatten(F.transform(words, at))

        cut = sentences.select("doc_id", "sent_no", F.explode(tx.let(_numbered_words(F.col("sentence")), phrases)).alias("p"))
        keyed = tx.staged(cut.select("doc_id", "sent_no", "p.*"), _key(F.col("word")).alias("key"))
        texts = lambda df: df.select(F.col("key").alias("text"))
        close = similarity_join(texts(keyed), texts(self.terms), self.threshold, self.n)
        term = F.struct("term", "cui", "type")
        best = (
            close.join(self.terms.withColumnRenamed("key", "right_text"), "right_text")
            .groupBy(F.col("left_text").alias("key"))
            .agg(F.max("similarity").alias("similarity"), F.min_by(term, F.struct(-F.col("similarity"), "row_idx", "right_text")).alias("concept"))
        )
        found = keyed.join(best, "key").select("doc_id", "sent_no", "start", "end", "word", "similarity", "concept")
        chosen = overlap_best(found, ["doc_id", "sent_no"], F.col("similarity") * F.size(tx.words(F.col("concept.term"))))
        order = F.sort_array(F.collect_list(F.struct("start", "word", "similarity", "concept")))
        return chosen.groupBy("doc_id", "sent_no").agg(order.alias("all")).select(
            "doc_id", "sent_no", F.posexplode("all").alias("match_no", "m")
        ).select(
            "doc_id", "sent_no", "match_no", F.col("m.word").alias("ngram"), F.col("m.concept.term").alias("term"),
            F.col("m.concept.cui").alias("cui"), F.col("m.similarity").alias("similarity"), F.col("m.concept.type").alias("type"),
        )


class ModelAnnotator:
    """A tagging model behind an Arrow UDF.

    ``load`` runs once per Python worker and returns a function from a list of
    lines to a list of ``[(word, label), ...]``.  Blank lines are not sent.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]]):
        cache: dict = {}

        @F.pandas_udf(T.ArrayType(schemas.RAW_ENTITY_ITEM))
        def tag(texts: pd.Series) -> pd.Series:
            if "model" not in cache:
                cache["model"] = load()
            where, lines = [], []
            for row, note in enumerate(texts):
                for n, line in enumerate((note or "").split("\n")):
                    if line.strip():
                        where.append((row, n))
                        lines.append(line)
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for (row, n), found in zip(where, cache["model"](lines) if lines else []):
                out[row].extend({"line_no": n, "word": w, "label": la} for w, la in found)
            return pd.Series(out)

        self._tag = tag

    def annotate(self, notes: DataFrame) -> DataFrame:
        return notes.withColumn("raw", self._tag("text"))


class NgramEncoder:
    """Hashed character n-gram counts, scaled to length one unless ``raw``.

    Retrieval scales vectors itself; raw counts are exact in single precision.
    """

    def __init__(self, dims: int = 128, n: int = 3, *, raw: bool = False):
        self.dims, self.n, self.raw = dims, n, raw

    def vector(self, text: Column) -> Column:
        def buckets(padded: Column) -> Column:
            count = F.length(padded) - (self.n - 1)
            starts = F.filter(
                F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: i <= count
            )

            def bucket(i: Column) -> Column:
                digest = F.md5(F.substring(padded, i, F.lit(self.n)))
                value = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
                return F.pmod(value, F.lit(self.dims))

            return F.transform(starts, bucket)

        def counts(found: Column) -> Column:
            # each bucket that occurs is counted once, not each dimension
            def spread(kinds: Column) -> Column:
                times = F.transform(kinds, lambda b: (F.size(found) - F.size(F.array_remove(found, b))).cast("double"))
                every = F.sequence(F.lit(0).cast("long"), F.lit(self.dims - 1).cast("long"))
                return tx.let(
                    times,
                    lambda n: F.transform(every, lambda d: F.coalesce(F.get(n, (F.array_position(kinds, d) - 1).cast("int")), F.lit(0.0))),
                )

            return tx.let(F.array_distinct(found), spread)

        padded = F.concat(F.lit("^"), F.coalesce(text, F.lit("")), F.lit("$"))
        counted = tx.let(tx.let(padded, buckets), counts)
        scaled = counted if self.raw else tx.let(counted, unit)
        return F.transform(scaled, lambda x: x.cast("float"))


class ModelEncoder:
    """An encoder model behind an Arrow UDF.

    ``load`` runs once per Python worker and returns a function from a list of
    strings to a matrix with one row each.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], object]], batch: int = 64):
        cache: dict = {}

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def encode(texts: pd.Series) -> pd.Series:
            if "model" not in cache:
                cache["model"] = load()
            values, rows = texts.fillna("").tolist(), []
            for at in range(0, len(values), batch):
                found = np.asarray(cache["model"](values[at : at + batch]), dtype="float64")
                length = np.linalg.norm(found, axis=1, keepdims=True)
                rows.extend((found / np.where(length > 0, length, 1.0)).astype("float32"))
            return pd.Series(rows)

        self._encode = encode

    def vector(self, text: Column) -> Column:
        return self._encode(text)


class ModelScorer:
    """A document classifier behind an Arrow UDF.

    ``load`` runs once per Python worker and returns a function from a list of
    texts to a matrix of logits, one row each.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], object]], batch: int = 32):
        cache: dict = {}

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def logits(texts: pd.Series) -> pd.Series:
            if "model" not in cache:
                cache["model"] = load()
            values, rows = texts.fillna("").tolist(), []
            for at in range(0, len(values), batch):
                rows.extend(np.asarray(cache["model"](values[at : at + batch]), dtype="float64"))
            return pd.Series(rows)

        self._logits = logits

    def score(self, notes: DataFrame) -> DataFrame:
        return notes.select("doc_id", F.posexplode(self._logits("text")).alias("class_idx", "logit"))


class ModelMatcher:
    """A concept matcher behind an Arrow UDF.

    ``load`` runs once per Python worker and returns a function from a list of
    sentences to a list of ``[(ngram, term, cui, similarity, type), ...]``.
    """

    _FOUND = "array<struct<ngram:string,term:string,cui:string,similarity:double,type:string>>"

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[tuple]]]]):
        cache: dict = {}
        names = ("ngram", "term", "cui", "similarity", "type")

        @F.pandas_udf(self._FOUND)
        def find(sentences: pd.Series) -> pd.Series:
            if "model" not in cache:
                cache["model"] = load()
            found = cache["model"](sentences.fillna("").tolist())
            return pd.Series([[dict(zip(names, hit)) for hit in hits] for hits in found])

        self._find = find

    def match(self, sentences: DataFrame) -> DataFrame:
        return sentences.select(
            "doc_id", "sent_no", F.posexplode(self._find("sentence")).alias("match_no", "m")
        ).select("doc_id", "sent_no", "match_no", "m.*")


def dictionary_vectors(df: DataFrame, name: str, encoder: Encoder) -> DataFrame:
    """Add ``vector`` of the lower-cased name; a missing name counts as empty."""
    return df.withColumn("vector", encoder.vector(F.lower(F.coalesce(F.col(name), F.lit("")))))
