"""Seeded selection of points, captions and scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions import rng
from pointlake.functions.blocks import shuffled, with_stats


def first_proposals(proposals: DataFrame, n: int) -> DataFrame:
    """T5: proposals are numbered from 0, so the first ``n`` are a filter."""
    return proposals.filter(F.col("proposal_id") < n)


def captions_to_draw(n: Column, select: str, num: int = 1, ratio: float = 1.0) -> Column:
    """How many of ``n`` captions a policy keeps."""
    part = F.floor(n * ratio).cast("bigint")
    if select == "all" or (select == "ratio" and ratio == 1.0):
        return n
    if select == "fixed":
        return F.least(F.lit(num), n)
    if select == "ratio":
        return F.greatest(F.lit(1), part)
    if select == "hybrid":
        return F.least(F.greatest(F.lit(1), F.lit(num), part), n)
    raise ValueError(f"unknown policy {select}")


def select_captions(captions: DataFrame, seed: int, select: str, num: int = 1, ratio: float = 1.0,
                    stride: int = 1, rank: str = "frame") -> DataFrame:
    """Every ``stride``-th caption of a scene from a seeded start, then a seeded draw.  ``rank``
    numbers the captions of a scene from 0."""
    if stride > 1:
        start = rng.draw(seed + 101, F.col("scene_id")) % stride
        captions = captions.filter((F.col(rank) >= start) & ((F.col(rank) - start) % stride == 0))
    drawn = shuffled(captions, ["scene_id"], rank, "_pos", seed)
    return drawn.filter(F.col("_pos") < captions_to_draw(F.col("_pos_n"), select, num, ratio)).drop("_pos", "_pos_n")


def subsample(points: DataFrame, factor: float, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``int(n / factor)`` rows of each scene (or of each scene and label), without replacement."""
    drawn = shuffled(points, ["scene_id", *by], "point_idx", "_pos", seed, keys=["scene_id", *by, "point_idx"], nullable=by)
    return drawn.filter(F.col("_pos") < F.floor(F.col("_pos_n") / factor)).drop("_pos", "_pos_n")


def sample_fixed(points: DataFrame, target: int, seed: int, far: float = 40.0) -> DataFrame:
    """Exactly ``target`` rows per scene.

    Points at least ``far`` away are kept and near ones drawn; when the far points alone exceed the
    target, all points are drawn from; a scene that is too small repeats a random subset (``copy`` 1).
    A scene with fewer than ``target / 2`` points cannot be filled and raises.  A target of -1 keeps all
    rows."""
    if target == -1:
        return points.withColumn("copy", F.lit(0))
    dist = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    is_far = dist >= far
    pts = with_stats(points, ["scene_id"], _n=("count",), _far=("sum", F.when(is_far, 1).otherwise(0)))
    fits = F.col("_n") > target
    keep_far = fits & (F.col("_far") < target) & is_far
    pool = F.when(keep_far, 0).otherwise(1)
    need = F.when(~fits, F.lit(target) - F.col("_n")).when(F.col("_far") < target, F.lit(target) - F.col("_far")).otherwise(target)
    drawn = shuffled(pts.withColumn("_pool", pool).withColumn("_need", need), ["scene_id", "_pool"], "point_idx", "_pos", seed,
                     keys=["scene_id", "point_idx"])
    chosen = F.col("_pos") < F.col("_need")
    short = F.when(F.col("_need") > F.col("_n"), F.raise_error(F.lit("scene holds less than half the target")).cast("int"))
    copies = (F.when(F.col("_pool") == 0, 1)
              .when(~fits, F.coalesce(short, F.when(chosen, 2).otherwise(1)))
              .otherwise(F.when(chosen, 1).otherwise(0)))
    rows = drawn.withColumn("_copies", copies).filter("_copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return rows.select(*points.columns, "copy")


def split_four(points: DataFrame) -> DataFrame:
    """Interleaved pieces ``point_idx % 4``, each shifted to its own origin."""
    pieces = points.withColumn("piece", F.col("point_idx") % 4)
    out = with_stats(pieces, ["scene_id", "piece"], **{f"_m{c}": ("min", F.col(c)) for c in "xyz"})
    for c in "xyz":
        out = out.withColumn(c, F.col(c) - F.col(f"_m{c}")).drop(f"_m{c}")
    return out


def merge_four(pieces: DataFrame) -> DataFrame:
    """The pieces back as one table; rows keep their index, so order is a sort on it."""
    return pieces.drop("piece")


def permute_points(points: DataFrame, seed: int) -> DataFrame:
    """A seeded permutation of each scene as the new index; the old one stays as origin_idx."""
    return (shuffled(points, ["scene_id"], "point_idx", "_pos", seed)
            .withColumn("origin_idx", F.col("point_idx")).withColumn("point_idx", F.col("_pos")).drop("_pos", "_pos_n"))


def repeat_scenes(scenes: DataFrame, times: int) -> DataFrame:
    """List every scene ``times`` times."""
    return scenes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
