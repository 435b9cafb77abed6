"""Explicit schemas of every file and table the package reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY_JSON = T.ArrayType(
    T.StructType(
        [
            T.StructField("entity", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("start_token", T.IntegerType()),
            T.StructField("end_token", T.IntegerType()),
        ]
    )
)
MESSAGES = T.ArrayType(
    T.StructType(
        [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
    )
)
CHAT = T.StructType([T.StructField("messages", MESSAGES)])
LABELLED_TEXT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
    ]
)
GOLD = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField(
            "gold_entities",
            T.MapType(T.StringType(), T.ArrayType(T.StringType())),
        ),
    ]
)
GROUND_TRUTH = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("mapped_cui", T.StringType()),
        T.StructField("mapped_type", T.StringType()),
    ]
)
DIAGNOSIS_DICTIONARY = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("name_vi", T.StringType())]
)
DRUG_DICTIONARY = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("term", "rxcui", "tty", "ingredients", "snomed", "atc", "drugbank")
    ]
)
TAGGED_SENTENCE = T.StructType(
    [
        T.StructField("sent_id", T.StringType()),
        T.StructField(
            "tokens",
            T.ArrayType(
                T.StructType(
                    [T.StructField("word", T.StringType()), T.StructField("tag", T.StringType())]
                )
            ),
        ),
    ]
)
SPAN_SENTENCE = T.StructType(
    [
        T.StructField("sentence", T.StringType()),
        # stored as [start, end, label]; the reader turns the numbers into text
        T.StructField("seq_label", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
MAPPED_ENTITY = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("mapped_cui", T.StringType()),
        T.StructField("mapped_type", T.StringType()),
        T.StructField("original_type", T.StringType()),
        T.StructField("embedding", T.StringType()),
    ]
)
VOCABULARY = T.StructType(
    [
        T.StructField("CUI", T.StringType()),
        T.StructField("SAB", T.StringType()),
        T.StructField("CODE", T.StringType()),
    ]
)
KG_NODE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("labels", "name", "uml_id", "medgemma_trans", "qwen_trans", "map_trans")
    ]
)

# element of the arrays a tagger returns, one array per note
RAW_ENTITY = "array<struct<line_no:int,word:string,label:string>>"
RAW_ENTITY_ITEM = T.StructType(
    [
        T.StructField("line_no", T.IntegerType()),
        T.StructField("word", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)
