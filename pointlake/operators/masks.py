"""Run-length form of point masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointlake.functions.blocks import BLOCK_BITS, block_of
from pointlake.functions.vectors import let

MASK = ("scene_id", "pred_id")
CHUNK_BITS = 22


def mask_runs(mask: DataFrame, key: Sequence[str] = MASK, bits: int = BLOCK_BITS) -> DataFrame:
    """Runs of consecutive points: 1-based ``start`` and ``length``.

    Runs are found inside blocks of the index range; only runs that touch a block edge (at most two
    per block) are then stitched over the mask."""
    key = list(key)
    pts = mask.select(*key, "point_idx", block_of(F.col("point_idx"), bits).alias("_b"))
    gap = F.col("point_idx") - F.row_number().over(W.partitionBy(*key, "_b").orderBy("point_idx"))
    runs = pts.withColumn("_g", gap).groupBy(*key, "_b", "_g").agg(F.min("point_idx").alias("lo"), F.max("point_idx").alias("hi"))
    low_edge = F.col("lo") == F.shiftleft("_b", bits)
    high_edge = F.col("hi") == F.shiftleft(F.col("_b") + 1, bits) - 1
    inner = runs.filter(~(low_edge | high_edge)).select(*key, "lo", "hi")
    edge = runs.filter(low_edge | high_edge)
    w = W.partitionBy(*key).orderBy("lo")
    fresh = F.when(F.lag("hi").over(w) == F.col("lo") - 1, 0).otherwise(1)
    edge = edge.withColumn("_f", fresh).withColumn("_r", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = edge.groupBy(*key, "_r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*key, "lo", "hi")
    return inner.unionByName(joined).select(*key, (F.col("lo") + 1).alias("start"), (F.col("hi") - F.col("lo") + 1).alias("length"))


def encode_runs(runs: DataFrame, key: Sequence[str] = MASK, bits: int = CHUNK_BITS) -> DataFrame:
    """The exchange form ``"start length start length ..."``.  A mask over more than ``2**22``
    points is written as several chunks; the chunks in order are the whole text."""
    key = list(key)
    part = F.shiftright(F.col("start") - 1, bits)
    rows = F.sort_array(F.collect_list(F.struct("start", "length")))
    text = F.array_join(F.flatten(F.transform(rows, lambda s: F.array(s["start"], s["length"]))), " ")
    return runs.withColumn("chunk", part).groupBy(*key, "chunk").agg(text.alias("counts"))


def decode_runs(encoded: DataFrame, key: Sequence[str] = MASK) -> DataFrame:
    """Back to one row per point."""
    nums = F.transform(F.filter(F.split("counts", " "), lambda t: t != ""), lambda t: t.cast("bigint"))
    at = F.sequence(F.lit(0), (F.size(nums) / 2).cast("int") - 1)
    pairs = F.when(F.size(nums) > 0, let(nums, lambda v: F.transform(at, lambda i: F.struct(F.get(v, i * 2).alias("s"), F.get(v, i * 2 + 1).alias("n")))))
    runs = encoded.select(*key, F.explode(pairs).alias("p"))
    return expand_runs(runs.select(*key, F.col("p.s").alias("start"), F.col("p.n").alias("length")), key)


def expand_runs(runs: DataFrame, key: Sequence[str] = MASK, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per point of each run.  Long runs are cut into blocks first, so no array grows with
    the run."""
    last = F.col("start") + F.col("length") - 1
    blocks = F.sequence(F.shiftright("start", bits), F.shiftright(last, bits))
    cut = runs.withColumn("_b", F.explode(blocks))
    lo = F.greatest(F.col("start"), F.shiftleft("_b", bits))
    hi = F.least(last, F.shiftleft(F.col("_b") + 1, bits) - 1)
    return cut.select(*key, F.explode(F.sequence(lo - 1, hi - 1)).alias("point_idx"))


def dense_runs(runs: DataFrame, lengths: DataFrame, key: Sequence[str] = MASK, bits: int = BLOCK_BITS) -> DataFrame:
    """Masks as runs of 0 and 1 that cover all ``n_points`` of their scene (``lengths(scene_id,
    n_points)``): the dense mask without a row per point and mask.

    The end of the previous run is looked up inside a block of starts, or in the last earlier block."""
    key = list(key)
    ends = runs.withColumn("_end", F.col("start") + F.col("length") - 1).withColumn("_b", F.shiftright("start", bits))
    inside = F.lag("_end").over(W.partitionBy(*key, "_b").orderBy("start"))
    per_block = ends.groupBy(*key, "_b").agg(F.max("_end").alias("_top"))
    earlier = per_block.select(*key, "_b", F.lag("_top").over(W.partitionBy(*key).orderBy("_b")).alias("_before"))
    linked = ends.withColumn("_in", inside).join(earlier, [*key, "_b"])
    prev = F.coalesce("_in", "_before", F.lit(0).cast("bigint"))
    zeros = linked.select(*key, (prev + 1).alias("start"), (F.col("start") - prev - 1).alias("length"))
    tails = ends.groupBy(*key).agg(F.max("_end").alias("_end")).join(lengths, "scene_id").select(
        *key, (F.col("_end") + 1).alias("start"), (F.col("n_points") - F.col("_end")).alias("length"))
    gaps = zeros.unionByName(tails).filter("length > 0")
    return runs.select(*key, "start", "length", F.lit(1).alias("value")).unionByName(gaps.withColumn("value", F.lit(0)))
