"""Readers.  Every file has an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom import lexicon as lx
from medloom import schemas
from medloom.functions import text as tx


def _padded(c: Column) -> Column:
    return F.lpad(c.cast("string"), 20, "0")


def scan_position() -> Column:
    """Order of a row in its source: file, block in the file, row in the block.

    The running id grows within a block, so the text sorts rows as the files
    hold them, however the scan was split.
    """
    return F.concat_ws(
        ":",
        F.col("_metadata.file_path"),
        _padded(F.col("_metadata.file_block_start")),
        _padded(F.monotonically_increasing_id()),
    )


def _with_position(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("row_idx", T.StringType())])


def _or_empty(read, spark: SparkSession, schema: T.StructType, missing_ok: bool) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if missing_ok and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def read_notes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row per text file: ``doc_id`` is the file name without its suffix."""
    notes = (
        spark.read.option("pathGlobFilter", "*.txt")
        .text(path, wholetext=True)
        .select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("doc_id"),
            newlines(F.col("value")).alias("text"),
        )
    )
    return notes if limit is None else notes.orderBy("doc_id").limit(limit)


def notes_from(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Notes held in a table."""
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, *, missing_ok: bool = True
) -> DataFrame:
    """A dictionary file with a header; ``row_idx`` keeps the file order.

    Ids are read as text, so no code turns into a decimal number.
    """

    def read() -> DataFrame:
        return (
            spark.read.schema(schema)
            .options(header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
            .csv(path)
            .withColumn("row_idx", scan_position())
        )

    return _or_empty(read, spark, _with_position(schema), missing_ok)


def read_parquet(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    missing_ok: bool = True,
) -> DataFrame:
    """A parquet table with ``row_idx`` from the file and row number."""

    def read() -> DataFrame:
        df = spark.read.parquet(path)
        row = _padded(F.col("_metadata.row_index"))
        position = F.concat_ws(":", F.col("_metadata.file_path"), row)
        return df.select("*", position.alias("row_idx"))

    return _or_empty(read, spark, _with_position(schema), missing_ok)


def read_kg(
    spark: SparkSession, path: str, labels: Sequence[str] = lx.KG_LABELS, **options
) -> DataFrame:
    """Graph nodes with one of the labels; the filter reaches the scan."""
    df = read_parquet(spark, path, schemas.KG_NODE, **options)
    return df.where(F.col("labels").isin(list(labels)))


def read_vocabulary(spark: SparkSession, path: str, **options) -> DataFrame:
    """``CUI, SAB, CODE`` rows of the known vocabularies."""
    df = read_parquet(spark, path, schemas.VOCABULARY, **options)
    return df.select("CUI", "SAB", "CODE", "row_idx").where(
        F.col("SAB").isin(list(lx.VOCABULARY_KEY))
    )


def read_mapped_entities(spark: SparkSession, path: str) -> DataFrame:
    """Concept table whose vectors are printed as text in a CSV file."""
    df = read_csv(spark, path, schemas.MAPPED_ENTITY)
    return df.withColumn("vector", tx.parse_vector(F.col("embedding"))).drop("embedding")


def parse_json_lines(df: DataFrame, value: str, schema: T.DataType) -> DataFrame:
    """Add ``parsed`` and ``malformed`` to a frame of JSON text."""
    blank = tx.strip(F.col(value)) == ""
    parsed = F.from_json(F.col(value), schema)
    return (
        df.where(~blank)
        .withColumn("parsed", parsed)
        .withColumn("malformed", F.col("parsed").isNull())
    )


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, *, malformed: str = "fail"
) -> DataFrame:
    """JSON lines.  ``malformed``: ``fail``, ``skip`` or ``keep`` (as null columns)."""
    mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}[malformed]
    return spark.read.schema(schema).option("mode", mode).json(path)


# --- tagged corpora ---------------------------------------------------------


def conll_sentences(text: Column) -> Column:
    """Tagged sentences in a block of CoNLL text.

    Lines of only whitespace end a sentence.  Fields are split at TAB if the
    line has one, else at single spaces; the first is the word, the last the
    tag, and lines with fewer than two are ignored.
    """

    def token(line: Column) -> Column:
        fields = F.split(line, F.when(line.contains("\t"), F.lit("\t")).otherwise(F.lit(" ")))
        return F.when(
            F.size(fields) >= 2,
            F.struct(
                F.get(fields, F.lit(0)).alias("word"), F.element_at(fields, -1).alias("tag")
            ),
        )

    def sentence(block: Column) -> Column:
        lines = F.transform(F.split(block, "\n"), tx.strip)
        return F.array_compact(F.transform(lines, token))

    blocks = F.split(newlines(text), rf"(?U)(?:^|\n){tx.SPACE}*(?:\n{tx.SPACE}*)+")
    return F.filter(F.transform(blocks, sentence), lambda s: F.size(s) > 0)


def read_conll(
    spark: SparkSession, path: str | list[str], *, newline: str = "\n", missing_ok: bool = True
) -> DataFrame:
    """``[sent_id, tokens]`` of a CoNLL file, in file order.

    Records are cut at empty lines, so one large file is read by many tasks;
    lines of only whitespace break sentences inside a record.
    """

    def read() -> DataFrame:
        return (
            spark.read.option("lineSep", newline * 2)
            .text(path)
            .select(scan_position().alias("at"), F.posexplode(conll_sentences(F.col("value"))))
            .select(
                F.concat_ws(":", "at", _padded(F.col("pos"))).alias("sent_id"),
                F.col("col").alias("tokens"),
            )
        )

    return _or_empty(read, spark, schemas.TAGGED_SENTENCE, missing_ok)


def span_sentences(df: DataFrame, tag_map: dict[str, str]) -> DataFrame:
    """``words`` and labelled ``spans`` from ``sentence`` and ``seq_label``."""
    spans = F.transform(
        "seq_label",
        lambda s: F.struct(
            F.get(s, F.lit(0)).try_cast("int").alias("start"),
            F.get(s, F.lit(1)).try_cast("int").alias("end"),
            tx.remap(F.get(s, F.lit(2)), tag_map, None).alias("label"),
        ),
    )
    return df.withColumn("words", tx.words(F.col("sentence"))).withColumn("spans", spans)


def read_span_json(
    spark: SparkSession,
    path: str,
    tag_map: dict[str, str] = lx.CORPUS_TAG_CLASS,
    *,
    missing_ok: bool = True,
) -> DataFrame:
    """A JSON array of sentences with token spans."""

    def read() -> DataFrame:
        df = spark.read.schema(schemas.SPAN_SENTENCE).option("multiLine", True).json(path)
        return df.withColumn("row_idx", scan_position())

    empty = _with_position(schemas.SPAN_SENTENCE)
    return span_sentences(_or_empty(read, spark, empty, missing_ok), tag_map)


# --- terminology ------------------------------------------------------------


def rrf_fields(
    df: DataFrame, value: str, fields: dict[str, int], min_fields: int
) -> DataFrame:
    """Named columns of pipe-delimited lines; rows with too few fields are dropped."""
    parts = F.filter(
        F.array(F.split(tx.strip(F.col(value)), r"\|")), lambda f: F.size(f) >= min_fields
    )
    return df.select(F.explode(parts).alias("_f")).select(
        *[F.get("_f", F.lit(at)).alias(name) for name, at in fields.items()]
    )


def read_rrf(
    spark: SparkSession,
    path: str,
    fields: dict[str, int],
    min_fields: int,
    *,
    missing_ok: bool = False,
) -> DataFrame:
    """A pipe-delimited terminology file."""
    schema = T.StructType([T.StructField("value", T.StringType())])
    lines = _or_empty(lambda: spark.read.text(path), spark, schema, missing_ok)
    return rrf_fields(lines, "value", fields, min_fields)


def class_list(df: DataFrame, value: str) -> DataFrame:
    """``[class_idx, cui]`` from a JSON array of class names."""
    names = F.from_json(F.col(value), T.ArrayType(T.StringType()))
    return df.select(F.posexplode(names).alias("class_idx", "cui"))


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    return class_list(spark.read.text(path, wholetext=True), "value")


def required_setting(spark: SparkSession, name: str) -> str:
    """A path from the session settings; stops when it is not set."""
    value = spark.conf.get(name, None)
    if not value:
        raise ValueError(f"{name} is not set")
    return value
