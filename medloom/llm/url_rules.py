"""URL rules by a sort-merge range join over reversed-host keys.

A rule fits a host and its subdomains.  With labels reversed (``org.example.www.``)
the hosts it fits are one interval of the sorted keys, those that begin with its
own key; path prefixes are intervals of sorted paths in the same way.  Intervals of
prefixes nest, so a sweep over keys and interval starts in sorted order keeps a
stack of the rules that may still be open: that of the last start passed.

Two sweeps are made: over distinct hosts, to find the rule hosts that enclose them,
and over distinct (rule host, path) keys, to find the longest rule there.  Both
sort by range, so a task holds a stretch of keys; what is open where a stretch
begins is carried over from the stretches before.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import fold, saved

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: the verdict on urls that no rule fits
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return (
        fold(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def host_key(host: Column) -> Column:
    """``www.example.org`` -> ``org.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """``verdict, rule`` pairs as a table; a rule is a host, then a path."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def enclosing(probes: DataFrame, starts: DataFrame) -> DataFrame:
    """``key, stack`` for every distinct probe key.

    ``starts`` has distinct ``key``s and a ``payload``; ``stack`` lists the starts
    whose key is a prefix of the probe's, outermost first, as structs of both.
    """
    # the starts that enclose a start, itself included: one row per prefix of it
    own = F.struct("key", "payload")
    chains = (
        starts.select(
            F.col("key").alias("inner"), F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")
        )
        .select("inner", F.substr("inner", F.lit(1), F.col("n")).alias("key"))
        .join(starts, "key")
        .groupBy("inner")
        .agg(F.sort_array(F.collect_list(own)).alias("chain"))
        .select(F.col("inner").alias("key"), F.lit(0).alias("probe"), "chain")
    )
    asked = probes.select("key").distinct().select("key", F.lit(1).alias("probe"), F.lit(None).cast(chains.schema["chain"].dataType).alias("chain"))
    # written once, so that both uses see the same stretches
    ranged = saved(
        chains.unionByName(asked).repartitionByRange("key").withColumn("stretch", F.spark_partition_id()), "sweep"
    )
    carried = (
        ranged.groupBy("stretch")
        .agg(F.max(F.when(F.col("probe") == 0, F.struct("key", "chain"))).alias("latest"))
        .select(
            "stretch",
            F.last("latest", ignorenulls=True)
            .over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))["chain"]
            .alias("carried"),
        )
    )
    passed = F.last("chain", ignorenulls=True).over(
        W.partitionBy("stretch").orderBy("key", "probe").rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        ranged.withColumn("open", passed)
        .where(F.col("probe") == 1)
        .join(carried, "stretch")
        .select(
            "key",
            # what has ended before the key is popped
            F.filter(
                F.coalesce("open", "carried"), lambda s: F.startswith(F.col("key"), s["key"])
            ).alias("stack"),
        )
        .where(F.size("stack") > 0)
    )


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The longest rule wins (host and path together; of two as long, the one with
    the longer host).  Of equal rules with different verdicts ``block`` wins.
    ``rule`` is null and the verdict ``default`` where none fits.  Rules without
    ``/`` have an empty path and fit every path.  Null rules are ignored; a null
    url, or one without ``://``, has an empty host, which no rule fits.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    rule_host = fold(F.regexp_extract("rule", "^[^/]*", 0))
    by_rule = (
        rules.where(F.col("rule").isNotNull())
        .select(
            host_key(rule_host).alias("host_key"),
            F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("rule_path"),
            F.concat(rule_host, F.regexp_extract("rule", "^[^/]*(.*)$", 1)).alias("rule"),
            "verdict",
        )
        .groupBy("host_key", "rule_path", "rule")
        .agg(F.max("verdict").alias("verdict"))
    )
    host, path = split_url(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    # distinct, so that a host or page with a third of all rows is one key
    urls = named.select("host", "path").distinct()

    hosts = enclosing(
        urls.select(host_key(F.col("host")).alias("key")),
        by_rule.select(F.col("host_key").alias("key"), F.lit("").alias("payload")).distinct(),
    )
    # no host contains "/", so a key here is a prefix only within one rule host
    level_key = lambda level, tail: F.concat(level, F.lit("/"), tail)
    levels = (
        urls.withColumn("key", host_key(F.col("host")))
        .join(hosts, "key")
        .select("host", "path", F.explode("stack.key").alias("level"))
        .select("host", "path", level_key(F.col("level"), F.col("path")).alias("key"))
    )
    found = enclosing(
        levels,
        by_rule.select(
            level_key(F.col("host_key"), F.col("rule_path")).alias("key"),
            F.struct("rule", "verdict").alias("payload"),
        ),
    ).select("key", F.element_at("stack", -1).alias("top"))
    best = (
        levels.join(found, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("top.payload.rule"), F.length("key"), "top")).alias("best"))
        .select("host", "path", F.col("best.top.payload").alias("won"))
    )
    return named.join(saved(best, "best"), ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )
