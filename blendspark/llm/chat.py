"""Preference formatting: the shared turns once as prompt, the rest as two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendspark.llm.frames import let, ranges_for, running_sums
from blendspark.operators.lineage import cut

# How a turn is written.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"

TURN = "struct<role: string, text: string>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array<struct<role, text>> in order of turn.

    Null role or text counts as empty; a null turn number comes first; turns that
    share a number are ordered by role and text; rows that repeat all of these stay
    as turns of their own.  Rows without conv_id belong to no conversation and are
    left out.  Extra columns are ignored.
    """
    clean = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    listed = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    equal = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_other = F.array_position(equal, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(equal)).cast("int")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def rendering(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def learned_spans(turns: Column) -> Column:
    """array<struct<start, end>>: the characters (code points, end exclusive) of a
    rendering that carry loss, which are text and end mark of assistant turns."""
    def placed(t: Column) -> Column:
        ends = running_sums(F.transform(t, lambda x: F.length(rendered(x))))
        spans = let(ends, lambda e: F.transform(t, lambda x, i: F.struct(
            (F.get(e, i) + F.length(x["role"]) + len(OPEN) + len(CLOSE)).cast("int").alias("start"), F.get(e, i + 1).cast("int").alias("end"),
            (x["role"] == LEARNED).alias("learned"),
        )))
        return F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return let(turns, placed)


def preference_rows(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen, rejected (arrays of turns).  One row per pair: pair_id,
    shared (turns in the prompt), prompt, chosen, rejected, chosen_mask, rejected_mask.

    The longest common prefix of turns is rendered once; each completion is what its
    side has after it, with the spans that carry loss.  A side that ends inside the
    prefix, or two equal sides, have empty completions and no spans.  A null side
    counts as one without turns.  Turns and texts may be of any number and length; an
    empty table gives no rows.
    """
    none = F.array().cast(f"array<{TURN}>")
    sides = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    cut = sides.withColumn("shared", shared_turns(F.col("c"), F.col("r"))).select(
        "pair_id", "shared", F.slice("c", 1, F.col("shared")).alias("p"),
        F.slice("c", F.col("shared") + 1, F.size("c")).alias("c"), F.slice("r", F.col("shared") + 1, F.size("r")).alias("r"),
    )
    return cut.select(
        "pair_id", "shared", rendering(F.col("p")).alias("prompt"), rendering(F.col("c")).alias("chosen"),
        rendering(F.col("r")).alias("rejected"), learned_spans(F.col("c")).alias("chosen_mask"),
        learned_spans(F.col("r")).alias("rejected_mask"),
    )


def reply_at(turns: Column) -> Column:
    """Where the reply starts: the last assistant turn, without one the last turn (from 1)."""
    back = F.array_position(F.transform(F.reverse(turns), lambda t: t["role"]), LEARNED)
    return F.when(back > 0, F.size(turns) - back + 1).otherwise(F.size(turns)).cast("int")


def following(ids: DataFrame) -> DataFrame:
    """ids (conv_id, distinct) with next_id, the next one (after the last: the first).

    The ranges come from a sample, so they are written before they are used twice."""
    ranged = cut(ids.repartitionByRange(ranges_for(ids), "conv_id").withColumn("part", F.spark_partition_id()))
    led = ranged.withColumn("next_id", F.lead("conv_id").over(Window.partitionBy("part").orderBy("conv_id")))
    # One row a range: the number of ranges is fixed by the shuffle setting.
    heads = (
        ranged.groupBy("part").agg(F.min("conv_id").alias("own"))
        .selectExpr("own", "lag(part) over (order by part) as before", "max(part) over () as last")
        .selectExpr("coalesce(before, last) as part", "own")
    )
    return led.join(heads, "part").select("conv_id", F.coalesce("next_id", "own").alias("next_id"))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs for ``preference_rows`` out of conversations alone: chosen is a whole
    conversation, rejected has its reply (the last assistant turn and what follows)
    replaced by the reply of the next conversation by conv_id."""
    whole = conversations(turns)
    order = following(turns.where("conv_id is not null").select("conv_id").distinct())
    replies = whole.withColumn("at", reply_at(F.col("turns"))).select(
        F.col("conv_id").alias("next_id"), F.slice("turns", F.col("at"), F.size("turns")).alias("reply")
    )
    placed = whole.join(order, "conv_id").withColumn("at", reply_at(F.col("turns"))).join(replies, "next_id")
    return placed.select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", 1, F.col("at") - 1), F.col("reply")).alias("rejected"),
    )
