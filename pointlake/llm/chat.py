"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and the
others as named users; ``mask`` lists the character spans of the assistant's words.  System turns keep
their role and are no participants.

Turns are numbered inside their conversation by turn number, speaker and the digest of their text, in ranges of
the whole order, so no task holds a conversation; a dialogue is cut into parts of ``part_turns`` turns by
that position.  A row never holds more than a part, whatever the turn numbers are, and a very long
conversation is many rows; parts and speakers meet in one join on the conversation, which may be split where
a conversation is hot.  Everything is Spark expressions.

Defined results: equal rows of a conversation are one turn; turns without a number come last; a NULL text is
empty, a NULL speaker is ``unknown``; rows with a NULL conversation form one conversation; a conversation of
system turns only has no perspective; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.blocks import ordinal
from pointlake.llm.common import store

PART_TURNS = 64
SYSTEM = "system"
UNKNOWN = "unknown"


def numbered(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, who, said)`` with ``place``, from 0 inside each conversation.  Sorted ranges of
    all turns are written; a turn's place is its place in the range plus what earlier ranges hold of the
    conversation."""
    order = [F.asc_nulls_last("turn"), "who", "digest"]
    ranges = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = turns.withColumn("digest", F.md5(F.col("said").cast("binary"))).repartitionByRange(ranges, "conv_id", *order)
    rows = store(sorted_.withColumn("range", F.spark_partition_id().cast("bigint")), "chat-turns")
    return ordinal(rows, ["conv_id"], order, "place", F.col("range")).drop("range", "digest")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, assistant, part, n_turns, text, mask)`` per conversation, participant and part; spans
    count from the start of their part."""
    rows = numbered(turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{speaker}`"), F.lit(UNKNOWN)).alias("who"),
                                 F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("said")).distinct())
    rows = rows.withColumn("part", F.floor(F.col("place") / part_turns).cast("bigint"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "who", "said"))).alias("turns"))
    people = rows.filter(F.col("who") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("who").alias("assistant")).distinct()
    each = parts.join(people, parts["conv_id"].eqNullSafe(people["c"])).drop("c")
    me = F.col("assistant")
    head = lambda t: F.when(t["who"] == SYSTEM, F.lit("<|system|>\n")).when(t["who"] == me, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), t["who"], F.lit("|>\n")))
    end = "<|end|>\n"
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["said"].alias("said"), F.length(t["said"]).alias("n"), (t["who"] == me).alias("own")))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["head"])
        return F.struct((a + x["n"] + len(end)).alias("at"), F.when(x["own"], F.array_append(s["spans"], F.concat_ws(":", a, a + x["n"]))).otherwise(s["spans"]).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    done = each.withColumn("pieces", pieces)
    return done.select("conv_id", "assistant", "part", F.size("turns").cast("bigint").alias("n_turns"),
                       F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["said"], F.lit(end))), "").alias("text"),
                       F.aggregate("pieces", start, step, lambda s: F.concat_ws(",", s["spans"])).alias("mask"))
