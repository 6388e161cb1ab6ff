"""Grid group-bys (V1-V7, V9, V10) and the depth-map reduction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointlake.functions import rng
from pointlake.functions.blocks import attach, block_of, ordinal, with_stats

CELL = ("vx", "vy", "vz")


def with_cells(points: DataFrame, size: float, cols: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Integer voxel coordinates ``floor(xyz / size)``."""
    for v, c in zip(CELL, cols):
        points = points.withColumn(v, F.floor(F.col(c) / size).cast("bigint"))
    return points


def voxel_table(points: DataFrame, batch: Sequence[str] = ("scene_id",), *pooled: Column) -> DataFrame:
    """V1: one row per occupied voxel, numbered by first appearance, with any ``pooled`` aggregates."""
    cells = points.groupBy(*batch, *CELL).agg(F.min("point_idx").alias("first_idx"),
                                              F.count(F.lit(1)).alias("n_points"), *pooled)
    return ordinal(cells, batch, ["first_idx"], "voxel_id", block_of(F.col("first_idx")), store=True)


def point_voxels(points: DataFrame, voxels: DataFrame, batch: Sequence[str] = ("scene_id",)) -> DataFrame:
    """V1: the point -> voxel map in long form."""
    return attach(points, voxels.select(*batch, *CELL, "voxel_id"), [*batch, *CELL])


def voxel_representatives(points: DataFrame, seed: int | None = None) -> DataFrame:
    """V2: one point per voxel and the voxel's dense id; the lowest index, or a seeded random
    member when ``seed`` is given (training)."""
    key = F.col("point_idx") if seed is None else rng.draw(seed, F.col("scene_id"), F.col("point_idx"))
    best = F.min(F.struct(key.alias("k"), F.col("point_idx").alias("p")))["p"]
    cells = points.groupBy("scene_id", *CELL).agg(best.alias("rep_idx"))
    strip = F.struct("vx", F.shiftright("vy", 6).alias("sy"))  # a wall at constant x is many strips
    return ordinal(cells, ["scene_id"], ["vx", "vy", "vz"], "voxel_id", strip, store=True)


def pool_voxels(points: DataFrame, feats: Sequence[str], mode: str, batch: Sequence[str] = ("scene_id",)) -> DataFrame:
    """V3: reduce feature columns per voxel: ``unique``, ``first``, ``last``, ``sum``, ``mean``."""
    row = F.struct("point_idx", *feats)
    groups = points.groupBy(*batch, *CELL)
    n = F.count(F.lit(1))
    if mode in ("sum", "mean"):
        fn = F.sum if mode == "sum" else F.avg
        return groups.agg(*[fn(c).alias(c) for c in feats], n.alias("n_points"))
    if mode not in ("first", "last", "unique"):
        raise ValueError(f"unknown mode {mode}")
    pick = F.max(row) if mode == "last" else F.min(row)
    out = groups.agg(pick.alias("_r"), n.alias("n_points"))
    values = [F.col(f"_r.{c}").alias(c) for c in feats]
    if mode == "unique":
        bad = F.raise_error(F.lit("a voxel holds more than one point"))
        values = [F.when(F.col("n_points") == 1, F.col(f"_r.{c}")).otherwise(bad).alias(c) for c in feats]
    return out.select(*batch, *CELL, *values, "n_points")


def sample_voxels(points: DataFrame, keep: Sequence[str], seed: int, shift_to_origin: bool = False) -> DataFrame:
    """V4: one seeded random point per voxel with the given columns."""
    draw = rng.draw(seed, F.col("scene_id"), F.col("point_idx"))
    row = F.struct(draw.alias("k"), F.col("point_idx"), *[F.col(c) for c in keep])
    out = points.groupBy("scene_id", *CELL).agg(F.min(row).alias("_r"))
    out = out.select("scene_id", *CELL, F.col("_r.point_idx").alias("point_idx"),
                     *[F.col(f"_r.{c}").alias(c) for c in keep])
    if shift_to_origin:
        out = with_stats(out, ["scene_id"], **{f"_m{c}": ("min", F.col(c)) for c in CELL})
        for c in CELL:
            out = out.withColumn(c, F.col(c) - F.col(f"_m{c}")).drop(f"_m{c}")
    return out


def mean_voxels(points: DataFrame, feats: Sequence[str], size: float) -> DataFrame:
    """V5: mean position and features per voxel of the origin-shifted scene; the voxel coordinate is
    recomputed from the mean position."""
    pts = with_stats(points, ["scene_id"], **{f"_m{c}": ("min", F.col(c)) for c in "xyz"})
    for v, c in zip(CELL, "xyz"):
        pts = pts.withColumn(f"_r{c}", F.col(c) - F.col(f"_m{c}")).withColumn(v, F.floor(F.col(f"_r{c}") / size).cast("bigint"))
    out = pts.groupBy("scene_id", *CELL).agg(
        *[F.avg(c).alias(c) for c in ("x", "y", "z")], *[F.avg(f).alias(f) for f in feats],
        *[F.floor(F.avg(f"_r{c}") / size).cast("bigint").alias(f"n{v}") for v, c in zip(CELL, "xyz")],
        F.count(F.lit(1)).alias("n_points"))
    return out.drop(*CELL).withColumnsRenamed({f"n{v}": v for v in CELL})


def hard_voxels(points: DataFrame, max_points: int, max_voxels: int) -> DataFrame:
    """V6: at most ``max_points`` rows per voxel (in index order) and the first ``max_voxels``
    voxels of a scene, in long form with ``slot`` and ``n_kept``.

    The ``slot <= max_points`` filter on ``row_number`` lets the planner cut each voxel to
    ``max_points`` rows before the shuffle."""
    voxels = voxel_table(points).filter(F.col("voxel_id") < max_voxels)
    slot = F.row_number().over(W.partitionBy("scene_id", *CELL).orderBy("point_idx"))
    kept = points.withColumn("slot", slot).filter(F.col("slot") <= max_points)
    return (kept.join(voxels, ["scene_id", *CELL])
            .withColumn("slot", F.col("slot") - 1)
            .withColumn("n_kept", F.least(F.col("n_points"), F.lit(max_points))))


def pad_voxels(hard: DataFrame, feats: Sequence[str], max_points: int) -> DataFrame:
    """V6: the padded form: one array of ``max_points`` feature vectors per voxel, zero-filled."""
    vec = F.array(*[F.col(f).cast("double") for f in feats])
    lists = hard.groupBy("scene_id", "voxel_id", *CELL, "n_kept").agg(
        F.sort_array(F.collect_list(F.struct("slot", vec.alias("f")))).alias("_l"))
    zero = F.array(*[F.lit(0.0)] * len(feats))
    return lists.withColumn("points", F.concat(F.transform("_l", lambda s: s["f"]), F.array_repeat(
        zero, max_points - F.size("_l")))).drop("_l")


def devoxelise(point_map: DataFrame, voxel_values: DataFrame) -> DataFrame:
    """V7: give every point its voxel's values."""
    return attach(point_map, voxel_values, ["scene_id", "voxel_id"])


def batch_shape(points: DataFrame, floor: int = 128, by: Sequence[str] = ()) -> DataFrame:
    """V9: spatial shape ``max + 1`` per axis, at least ``floor``."""
    aggs = [F.greatest(F.max(v) + 1, F.lit(floor)).cast("bigint").alias(f"n{v}") for v in CELL]
    return points.groupBy(*by).agg(*aggs) if by else points.agg(*aggs)


def voxel_rows(queries: DataFrame, voxels: DataFrame, value: str = "voxel_id") -> DataFrame:
    """Row index of a voxel coordinate, -1 when the voxel is empty."""
    return (queries.join(voxels.select("scene_id", *CELL, value), ["scene_id", *CELL], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(-1).cast("bigint"))))


def downsample_depth(depth: DataFrame, factor: int, image: Sequence[str] = ("scene_id", "frame")) -> DataFrame:
    """Block mean over ``factor x factor`` pixels; pixels beyond the edge count as zero."""
    cell = [F.floor(F.col(c) / factor).cast("bigint").alias(c) for c in ("u", "v")]
    return depth.groupBy(*image, *cell).agg((F.sum("depth") / (factor * factor)).alias("depth"))


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("bigint")
