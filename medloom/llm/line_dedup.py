"""Line dedup with a log-template tree.

Lines are parsed as log lines are: tokens with a digit are variable fields, and a
tree of fixed depth leads from the token count over the first tokens to a leaf.
Within a leaf a token is constant if enough (document, line) pairs have it at its
place; other places generalise to a wildcard.  A generalised template is taken
where enough of its tokens are constant, otherwise the line is its own template.
Templates that recur across documents are dropped but for their first occurrence.

Only lines in leaves that several documents reach with different lines are looked
at token by token, once for each different line.  Everything else is counted by
hashes, and every count is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import saved

DEPTH = 3
#: a template recurs from the second document on
MIN_DOCS = 2
#: (document, line) pairs that make a token constant at its place
SUPPORT = 3
SIMILARITY = 0.8
WILD = "<*>"
#: a token with a digit, found from its start without backtracking
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
BREAK = "\n"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def single_spaced(line: Column) -> Column:
    """Lower-cased line with single blanks.  Most lines have no stray ones and are kept."""
    line = F.lower(line)
    stray = line.startswith(" ") | line.endswith(" ")
    for blanks in ("  ", "\t", "\v", "\f", "\r"):
        stray = stray | line.contains(blanks)
    return F.when(stray, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def rewritten(similarity: float):
    """How a line is read: variable fields generalised, if enough tokens stay constant."""

    def masked(line: Column) -> Column:
        def enough(m: Column) -> Column:
            tokens = F.split(m, " ")
            fields = F.size(F.filter(tokens, lambda t: t == WILD))
            return F.size(tokens) - fields >= similarity * F.size(tokens)

        return bound(F.regexp_replace(line, FIELD, WILD), lambda m: F.when(enough(m), m).otherwise(line))

    return lambda line: bound(single_spaced(line), lambda one: F.when(one.rlike("[0-9]"), masked(one)).otherwise(one))


def spliced(items: Column, places: Column, put: str | None = None) -> Column:
    """``items`` without those at the ``places``, ascending, with ``put`` instead if given.

    Cut between the places, so the work grows with the items and not with both.
    """
    filler = F.array(F.lit(put)) if put is not None else F.array().cast("array<string>")
    cuts = F.concat(F.array(F.lit(-1)), places, F.array(F.lit(2**31 - 1)))

    def between(x: Column) -> Column:
        def part(k: Column) -> Column:
            at = F.get(x["cuts"], k - 1)
            piece = F.slice(x["items"], at + 2, F.get(x["cuts"], k) - at - 1)
            return F.concat(piece, F.when(k < F.size(x["cuts"]) - 1, filler).otherwise(F.array().cast("array<string>")))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(x["cuts"]) - 1), part))

    return bound(F.struct(items.alias("items"), cuts.alias("cuts")), between)


def _hash(*columns: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(F.concat_ws("\x00", *columns)))


def _tokens(m: Column) -> Column:
    return F.octet_length(m) - F.octet_length(F.replace(m, F.lit(" "))) + 1


def _lines(docs: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, line_no, m`` of all lines with a token."""
    # inside the generator, so that a line is rewritten once however often it is used
    lines = F.posexplode(F.transform(F.split("text", BREAK), rewritten(similarity))).alias("line_no", "m")
    return docs.where(F.col("text").isNotNull()).select("doc_id", lines).where(F.col("m") != "")


def _leaf(m: Column, depth: int) -> Column:
    """Token count and leading tokens."""
    return F.concat_ws(" ", _tokens(m).cast("string"), F.substring_index(m, " ", depth))


def parse(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, support: int = SUPPORT
) -> DataFrame:
    """``doc_id, line_no, template, drop`` of every line with a token.

    ``template`` is a hash.  A template recurs if at least ``min_docs`` documents
    have it; its first occurrence, by ``doc_id`` and line, is kept.  ``support`` is
    the least number of (document, line) pairs that keeps a place from generalising.
    Fields and generalised places are the variable tokens of a template; a line with
    too many stays as it is, so rows of different numbers are different templates.
    """
    m = F.col("m")
    lines = saved(
        _lines(docs, similarity).select("doc_id", "line_no", _hash(_leaf(m, depth)).alias("leaf"), _hash(m).alias("line")),
        "lines",
    )
    # different lines with their documents, and leaves worth generalising
    distinct = (
        lines.groupBy("leaf", "line", "doc_id")
        .agg(F.min("line_no").alias("line_no"))
        .groupBy("leaf", "line")
        .agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "line_no")).alias("example"))
    )
    leaves = (
        distinct.groupBy("leaf")
        .agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs"))
        .where((F.col("kinds") > 1) & (F.col("docs") >= support))
        .select("leaf")
    )
    examples = distinct.join(leaves, "leaf", "left_semi").select(
        "leaf", "line", "docs", "example.doc_id", "example.line_no"
    )
    # the text of those lines, each read in one document
    wanted = examples.groupBy("doc_id").agg(
        F.collect_list(F.struct("line_no", "leaf", "line", "docs")).alias("wanted")
    )
    read = lambda split: F.transform(
        "wanted", lambda w: F.struct(w["leaf"].alias("leaf"), w["line"].alias("line"), w["docs"].alias("docs"), F.get(split, w["line_no"]).alias("text"))
    )
    kinds = (
        docs.select("doc_id", "text").join(wanted, "doc_id")
        .select(F.explode(bound(F.split("text", BREAK), read)).alias("w"))
        .select("w.leaf", "w.line", "w.docs", F.split(rewritten(similarity)(F.col("w.text")), " ").alias("tokens"))
        # documents that repeat a doc_id would bring an example twice
        .dropDuplicates(["leaf", "line"])
    )
    kinds = saved(kinds, "kinds")
    fields = kinds.select("leaf", "line", "docs", F.posexplode("tokens").alias("at", "token"))
    rare = (
        fields.groupBy("leaf", "at", "token")
        .agg(F.sum("docs").alias("support"))
        .where(F.col("support") < support)
        .select("leaf", "at", "token")
    )
    # places that vary, by line; a line without any is its own template
    varying = (
        fields.join(rare, ["leaf", "at", "token"], "left_semi")
        .groupBy("line")
        .agg(F.sort_array(F.collect_list("at")).alias("varying"))
    )
    general = (
        kinds.join(varying, "line")
        .select("line", bound(spliced(F.col("tokens"), F.col("varying"), WILD), lambda t: F.when(
            F.size(F.filter(t, lambda x: x != WILD)) >= similarity * F.size(t), _hash(F.lit("t"), F.array_join(t, " "))
        )).alias("general"))
        .where(F.col("general").isNotNull())
    )
    named = lines.join(saved(general, "general"), "line", "left").select(
        "doc_id", "line_no", F.coalesce("general", "line").alias("template")
    )
    named = saved(named, "templates")
    recurring = (
        named.groupBy("template", "doc_id")
        .agg(F.min("line_no").alias("line_no"))
        .groupBy("template")
        .agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "line_no")).alias("first"))
        .where(F.col("docs") >= min_docs)
    )
    recurring = saved(recurring, "recurring")
    here = F.struct("doc_id", "line_no")
    return named.join(recurring, "template", "left").select(
        "doc_id",
        "line_no",
        "template",
        (F.col("first").isNotNull() & ~here.eqNullSafe(F.col("first"))).alias("drop"),
    )


def dedup_lines(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, support: int = SUPPORT
) -> DataFrame:
    """The rows of ``docs`` with recurring lines removed; adds ``n_lines, n_dropped``.

    ``n_lines`` counts lines with a token; blank lines are no lines and stay.  A
    null text stays null.  Rows that repeat a ``doc_id`` are one document: a line
    number is dropped in all of them.  A null ``doc_id`` cannot be addressed, so
    its rows are returned as they are, with 0 counts.  Columns named like the two
    added ones are replaced.
    """
    made = ["n_lines", "n_dropped"]
    columns = [c for c in docs.columns if c not in made]
    known = docs.where(F.col("doc_id").isNotNull())
    decided = (
        parse(known, depth, min_docs, similarity, support)
        .groupBy("doc_id")
        .agg(
            F.countDistinct("line_no").alias("n_lines"),
            F.sort_array(F.collect_set(F.when(F.col("drop"), F.col("line_no")))).alias("__gone"),
        )
    )
    kept = spliced(F.split("text", BREAK), F.col("__gone"))
    text = F.when(F.size("__gone") > 0, F.array_join(kept, BREAK)).otherwise(F.col("text"))
    return (
        docs.select(*columns)
        .join(decided, "doc_id", "left")
        .select(
            *[text.alias("text") if c == "text" else F.col(c) for c in columns],
            F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
