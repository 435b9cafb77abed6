"""Preference pairs: one prompt, two masked completions.

Chosen and rejected conversations are tables of turns.  Their longest common turn
prefix is found by counting, not by aligning lists: turns of both sides meet on
(pair, turn), the least turn that differs ends the prefix, and everything before it
is rendered once.  A conversation is never gathered, so its length is no limit;
the output is one row per rendered turn, in the order of its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import saved

HEADER = "<|{}|>\n"
TRAINED = "assistant"


def _turns(side: DataFrame, name: str) -> DataFrame:
    """Turns of one side; the place of a turn is its number, then a count.

    The count tells rows apart that repeat a turn number; null numbers come last.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    last = F.lit((1 << 63) - 1)
    turns = side.select(
        "pair_id", F.coalesce(F.col("turn").cast("long"), last).alias("at"), role.alias("role"), text.alias("text")
    )
    repeat = F.row_number().over(W.partitionBy("pair_id", "at").orderBy("role", "text"))
    return turns.select("pair_id", F.struct("at", repeat.alias("n")).alias("place"), "role", "text", F.lit(name).alias("side"))


def preference_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of both sides: ``pair_id, part, turn, n, role, text, masked``.

    Inputs have ``pair_id, turn, role, text``.  ``part`` is ``prompt`` for the
    longest common prefix of turns (equal number, role and text), which is emitted
    once, else ``chosen`` or ``rejected``.  ``text`` is ``<|role|>``, the turn and
    a line end; its first ``masked`` characters do not count for the loss: all of a
    prompt or of other roles, the header only of an assistant's completion.  Null
    role and text are empty; ``turn`` is null where it was.  Equal conversations
    are all prompt; a side that is missing or shorter has fewer completion rows.
    ``n`` counts rows that repeat a turn number.
    """
    turns = _turns(chosen, "chosen").unionByName(_turns(rejected, "rejected"))
    content = F.struct("role", "text")
    # a place differs unless both sides have it with equal content
    differs = (F.count("*") < 2) | (F.min(content) != F.max(content))
    ends = (
        turns.groupBy("pair_id", "place")
        .agg(differs.alias("differs"))
        .where("differs")
        .groupBy("pair_id")
        .agg(F.min("place").alias("end"))
        .select(F.col("pair_id").alias("pair"), "end")
    )
    shared = F.col("end").isNull() | (F.col("place") < F.col("end"))
    header = F.concat(F.lit(HEADER.split("{}")[0]), F.col("role"), F.lit(HEADER.split("{}")[1]))
    body = F.concat(header, F.col("text"), F.lit("\n"))
    trained = ~F.col("shared") & (F.col("role") == TRAINED)
    return (
        turns.join(saved(ends, "ends"), F.col("pair_id").eqNullSafe(F.col("pair")), "left")
        .withColumn("shared", shared)
        .where(~F.col("shared") | (F.col("side") == "chosen"))
        .select(
            "pair_id",
            F.when(F.col("shared"), "prompt").otherwise(F.col("side")).alias("part"),
            F.when(F.col("place.at") < (1 << 63) - 1, F.col("place.at")).alias("turn"),
            F.col("place.n").alias("n"),
            "role",
            body.alias("text"),
            F.when(trained, F.length(header)).otherwise(F.length(body)).alias("masked"),
        )
    )


def records(turns: DataFrame) -> DataFrame:
    """``pair_id, prompt, chosen, rejected`` strings and the spans that are trained.

    Gathers each conversation into a row, as training on it does anyway; for
    tables whose conversations fit a training context.  Spans are ``[start, end)``
    character offsets within their completion.
    """
    part = lambda name: F.expr(
        f"transform(array_sort(collect_list(case when part = '{name}' then struct(coalesce(turn, {(1 << 63) - 1}L) as at, n, text, masked) end)), t -> struct(t.text, t.masked))"
    )
    text = lambda c: F.array_join(F.col(f"{c}.text"), "")

    def spans(c: str):
        return F.expr(
            f"filter(transform({c}, (t, i) -> struct("
            f"cast(aggregate(slice({c}, 1, i), 0, (s, x) -> s + length(x.text)) + t.masked as int) as start, "
            f"cast(aggregate(slice({c}, 1, i), 0, (s, x) -> s + length(x.text)) + length(t.text) as int) as end)), "
            "s -> s.start < s.end)"
        )

    grouped = turns.groupBy("pair_id").agg(*[part(p).alias(p) for p in ("prompt", "chosen", "rejected")])
    return grouped.select(
        "pair_id",
        *[text(p).alias(p) for p in ("prompt", "chosen", "rejected")],
        spans("chosen").alias("chosen_spans"),
        spans("rejected").alias("rejected_spans"),
    )


def echo_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made from one table of conversations.

    Chosen is the conversation; in the rejected one the last assistant turn only
    echoes the first user turn.  Conversations without either turn are equal on
    both sides.  The two turn numbers are aggregates, so no conversation is gathered.
    """
    chosen = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    is_user, is_reply = F.col("role") == "user", F.col("role") == TRAINED
    echo = (
        chosen.groupBy("pair_id")
        .agg(
            F.min(F.when(is_user, F.struct("turn", "text"))).alias("first"),
            F.max(F.when(is_reply, F.col("turn"))).alias("reply"),
        )
        .select(F.col("pair_id").alias("pair"), "first", "reply")
    )
    swapped = (F.col("turn") == F.col("reply")) & is_reply & F.col("first").isNotNull()
    rejected = chosen.join(saved(echo, "echo"), F.col("pair_id").eqNullSafe(F.col("pair")), "left").select(
        "pair_id", "turn", "role", F.when(swapped, F.col("first.text")).otherwise(F.col("text")).alias("text")
    )
    return chosen, rejected
