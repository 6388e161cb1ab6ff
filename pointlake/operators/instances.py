"""Instance statistics and batch-wide numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointlake.functions.blocks import attach, ordinal
from pointlake.schema import IGNORE
from pointlake.session import cut_lineage


def segment_stats(rows: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A2: mean, min and max of each column per segment."""
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*group).agg(*aggs)


def instance_stats(points: DataFrame) -> DataFrame:
    """A1: centre, extent, size and class (of the first point) per instance."""
    aggs = [f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    first = F.min(F.struct("point_idx", "sem_label"))["sem_label"].alias("inst_class")
    return (points.filter(F.col("inst_label") >= 0).groupBy("scene_id", "inst_label")
            .agg(*aggs, F.count(F.lit(1)).alias("n_points"), first))


def centre_offsets(points: DataFrame) -> DataFrame:
    """A1: ``centre - xyz`` for instance points; NULL elsewhere."""
    stats = instance_stats(points).select("scene_id", "inst_label", "x_mean", "y_mean", "z_mean", "n_points")
    out = attach(points, stats, ["scene_id", "inst_label"], how="left")
    for c in "xyz":
        out = out.withColumn(f"off_{c}", F.col(f"{c}_mean") - F.col(c))
    return out.drop("x_mean", "y_mean", "z_mean")


def _batches(scenes: DataFrame, scenes_per_batch: int, scene: str) -> DataFrame:
    """Add ``batch_id``: scenes in order of their ids, ``scenes_per_batch`` to a batch.  Ids may be names or
    have gaps.  Scenes are dealt to ranges of ids, which are written once and numbered each on its own."""
    dealt = cut_lineage(scenes.repartitionByRange(scene).withColumn("_range", F.spark_partition_id()))
    ranked = ordinal(dealt, [], [scene], "_rank", F.col("_range"))
    return ranked.withColumn("batch_id", F.floor(F.col("_rank") / scenes_per_batch).cast("bigint")).drop("_range", "_rank")


def batch_offsets(points: DataFrame, scenes_per_batch: int, scene_order: str = "scene_id") -> DataFrame:
    """First row of each scene inside its batch.  A batch holds ``scenes_per_batch`` scenes,
    which bounds the window."""
    sizes = points.groupBy(scene_order).agg(F.count(F.lit(1)).alias("n_points"))
    sizes = _batches(sizes, scenes_per_batch, scene_order)
    w = W.partitionBy("batch_id").orderBy(scene_order).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("row_offset", F.coalesce(F.sum("n_points").over(w), F.lit(0)))


def globalise_instances(points: DataFrame, scenes_per_batch: int) -> DataFrame:
    """Instance ids unique inside a batch: add the instance totals of earlier scenes."""
    tops = points.groupBy("scene_id").agg(F.max("inst_label").alias("_top"))
    tops = _batches(tops, scenes_per_batch, "scene_id")
    w = W.partitionBy("batch_id").orderBy("scene_id").rowsBetween(W.unboundedPreceding, -1)
    base = tops.select("scene_id", F.coalesce(
        F.sum(F.greatest(F.col("_top") + 1, F.lit(0))).over(w), F.lit(0)).alias("_base"))
    return (attach(points, base, ["scene_id"])
            .withColumn("inst_label", F.when(F.col("inst_label") == IGNORE, F.col("inst_label"))
                        .otherwise(F.col("inst_label") + F.col("_base"))).drop("_base"))
