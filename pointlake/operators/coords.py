"""Coordinate columns and per-scene normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.blocks import attach, ordinal, with_stats

XYZ = ("x", "y", "z")


def centre_scene(points: DataFrame) -> DataFrame:
    """Subtract the scene mean."""
    out = with_stats(points, ["scene_id"], **{f"_m{c}": ("avg", F.col(c)) for c in XYZ})
    for c in XYZ:
        out = out.withColumn(c, F.col(c) - F.col(f"_m{c}"))
    return out.drop(*[f"_m{c}" for c in XYZ])


def normalise_colour(c: Column) -> Column:
    """0..255 -> -1..1."""
    return c / 127.5 - 1.0


def restore_colour(c: Column) -> Column:
    """-1..1 -> 0..255."""
    return (c + 1.0) * 127.5


def to_voxel_scale(points: DataFrame, scale: float) -> DataFrame:
    """``xyz * scale`` shifted so the scene starts at the origin; adds sx, sy, sz."""
    out = with_stats(points, ["scene_id"], **{f"_m{c}": ("min", F.col(c) * scale) for c in XYZ})
    for c in XYZ:
        out = out.withColumn(f"s{c}", F.col(c) * scale - F.col(f"_m{c}"))
    return out.drop(*[f"_m{c}" for c in XYZ])


def point_features(use_rgb: bool, use_xyz: bool) -> Column:
    """Rgb, xyz or both as one vector."""
    if not (use_rgb or use_xyz):
        raise ValueError("choose rgb, xyz or both")
    names = (["r", "g", "b"] if use_rgb else []) + (list(XYZ) if use_xyz else [])
    return F.array(*[F.col(n).cast("double") for n in names])


def transform_homogeneous(matrix: Sequence[float | Column], xyz: Sequence[Column]) -> list[Column]:
    """M1: row-major 4x4 matrix applied to ``(x, y, z, 1)`` with perspective divide."""
    m = [v if isinstance(v, Column) else F.lit(float(v)) for v in matrix]
    rows = [m[4 * i] * xyz[0] + m[4 * i + 1] * xyz[1] + m[4 * i + 2] * xyz[2] + m[4 * i + 3] for i in range(4)]
    return [rows[i] / rows[3] for i in range(3)]


def rotate_z(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """M2: rotation about z."""
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def wrap_period(value: Column, offset: float, period: float) -> Column:
    """M3: value folded into one period."""
    return value - F.floor(value / period + offset) * period


def voxel_centre(coords_zyx: Sequence[Column], size: Sequence[float], origin: Sequence[float],
                 stride: int = 1) -> list[Column]:
    """M4: centre of a voxel; coordinates come in z, y, x order."""
    return [(coords_zyx[2 - i] + 0.5) * (size[i] * stride) + origin[i] for i in range(3)]


# Corner signs of a box, bottom face then top face.
BOX_CORNERS = ((1, 1, -1), (1, -1, -1), (-1, -1, -1), (-1, 1, -1), (1, 1, 1), (1, -1, 1), (-1, -1, 1), (-1, 1, 1))


def box_corners(boxes: DataFrame) -> DataFrame:
    """M5: eight corner rows per box ``(cx, cy, cz, dx, dy, dz, heading)``."""
    template = F.array(*[F.struct(F.lit(i).alias("corner"), *[F.lit(s / 2).alias(n) for n, s in zip("abc", t)])
                         for i, t in enumerate(BOX_CORNERS)])
    out = boxes.withColumn("_t", F.explode(template))
    rx, ry = rotate_z(F.col("_t.a") * F.col("dx"), F.col("_t.b") * F.col("dy"), F.col("heading"))
    return (out.withColumn("corner", F.col("_t.corner")).withColumn("x", rx + F.col("cx"))
            .withColumn("y", ry + F.col("cy")).withColumn("z", F.col("_t.c") * F.col("dz") + F.col("cz")).drop("_t"))


def grid_size(lo: Column, hi: Column, voxel: float) -> Column:
    """M6: cells per axis, ties rounded to even."""
    return F.rint((hi - lo) / voxel).cast("bigint")


def pad_pair(desired: Column, current: Column) -> Column:
    """M8: (before, after) padding."""
    if_ok = F.when(desired >= current, desired - current).otherwise(
        F.raise_error(F.lit("desired size is below the current size")).cast("bigint"))
    return F.struct(F.lit(0).cast("bigint").alias("before"), if_ok.alias("after"))


def pad_array(values: Column, desired: int, fill) -> Column:
    """M8: pad an array at its end."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(desired) - F.size(values), F.lit(0))))


def ravel_key(points: DataFrame, cols: Sequence[str] = ("vx", "vy", "vz"), name: str = "key") -> DataFrame:
    """M9: one integer per voxel: min-shifted mixed-radix code over the scene's extent."""
    stats = {f"_lo{c}": ("min", F.col(c)) for c in cols} | {f"_hi{c}": ("max", F.col(c)) for c in cols}
    out = with_stats(points, ["scene_id"], **stats)
    code = F.lit(0).cast("bigint")
    for c in cols:
        code = code * (F.col(f"_hi{c}") - F.col(f"_lo{c}") + 1) + (F.col(c) - F.col(f"_lo{c}"))
    return out.withColumn(name, code).drop(*stats)


def class_colours(label: Column, palette: Sequence[tuple[int, int, int]]) -> Column:
    """Class -> palette colour, black when missing."""
    table = F.array(*[F.array(*[F.lit(v) for v in rgb]) for rgb in palette])
    ok = (label >= 0) & (label < len(palette))
    return F.when(ok, F.element_at(table, (F.when(ok, label).otherwise(0) + 1).cast("int"))).otherwise(
        F.array(F.lit(0), F.lit(0), F.lit(0)))


def instance_colours(points: DataFrame, palette_size: int) -> DataFrame:
    """Instances ranked by size (largest first, id breaks ties) share a palette modulo its
    length; adds ``colour_idx``, -1 on background."""
    sizes = (points.filter("inst_label >= 0").groupBy("scene_id", "inst_label")
             .agg(F.count(F.lit(1)).alias("_n")).withColumn("_neg", -F.col("_n")))
    ranked = ordinal(sizes, ["scene_id"], ["_neg", "inst_label"], "_rank", F.col("_neg"), store=True)
    colour = ranked.select("scene_id", "inst_label", (F.col("_rank") % palette_size).alias("colour_idx"))
    return (attach(points, colour, ["scene_id", "inst_label"], how="left")
            .withColumn("colour_idx", F.coalesce("colour_idx", F.lit(-1).cast("bigint"))))
