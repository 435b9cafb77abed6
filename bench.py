"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores, ``BENCH_ONLY`` some
queries.  Queries run to completion (a write that keeps nothing) after one warm-up
query, and again up to three times while they stay under ``REPEAT_SECONDS`` in all;
the median counts.  ``plan`` is the share spent on building the frames, with the jobs
some of them run for it.

The given tables are one file with one row group each, which a single task reads.
Tables of texts are first laid out in as many files as there are cores, as a table on
a cluster is; that is not timed.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from medloom.catalog import QUERIES
from medloom.catalog.registry import Tables
from medloom.catalog.vectors import pruned_share
from medloom.session import local_session

HEADLINE = (
    # scans and text rules
    "line_offsets", "term_normalise", "clean_text_gold", "sentence_split", "precision_filter",
    # sequences
    "bio_repair", "bio_spans", "spans_to_bio", "mention_merge", "forward_offsets", "span_f1",
    # rules around mentions
    "mention_assertions", "drug_expansion", "typed_mentions",
    # lookups, dictionaries, pairs, splits
    "vocabulary_pivot", "concept_codes", "term_map_first", "drug_dictionary", "negative_pairs",
    "split_80_10_10",
    # vectors
    "knn_top3", "pruned_knn_top3", "class_masked_link", "hybrid_rerank", "dual_retrieval",
    # corpora
    "chat_records", "entity_frequency", "gold_benchmark", "relabel", "corpus_export",
    # composite jobs
    "extract_ner", "extract_linked", "extract_matched", "note_entities", "linking_scores",
)
TEXTS = ("documents", "conversations", "pages")
REPEAT_SECONDS = 8


def laid_out(spark, folder: str, files: int) -> str:
    """A folder with the tables of ``folder``, those of texts in several files."""
    own = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(folder):
        table = name.removesuffix(".parquet")
        if table in TEXTS:
            spark.read.parquet(f"{folder}/{name}").repartition(files).write.parquet(f"{own}/{name}")
        else:
            os.symlink(f"{folder}/{name}", f"{own}/{name}")
    return own


def timed(spark, folder: str, name: str) -> tuple[float, float]:
    start = time.perf_counter()
    frame = QUERIES[name](spark, folder)
    planned = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, planned - start


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = local_session(cpus)
    cores = spark.sparkContext.defaultParallelism
    folder = laid_out(spark, given, cores)
    timed(spark, folder, "note_scan")
    seconds: dict[str, float] = {}
    plan: dict[str, float] = {}
    for name in only or HEADLINE:
        runs = [timed(spark, folder, name)]
        while len(runs) < 3 and sum(r[0] for r in runs) < REPEAT_SECONDS:
            runs.append(timed(spark, folder, name))
        seconds[name] = round(statistics.median(r[0] for r in runs), 3)
        plan[name] = round(statistics.median(r[1] for r in runs), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "plan": plan,
                "pruned_knn_share": round(pruned_share(Tables(spark, folder)), 3),
                "sf": os.path.basename(given).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
