"""Point -> image projection and depth check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.blocks import attach, block_of


def pair_with_frames(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Every point with every camera of its scene, joined per block of points."""
    return attach(points, frames, ["scene_id"])


def plane_margins(pose: str = "pose", bias: tuple[str, str] | None = None, far: float | None = None) -> list[tuple[list[Column], Column]]:
    """The planes of a view in world coordinates: ``a . p + b`` is not negative for points before the camera
    whose pixel lies in the image (a pixel truncates toward zero, so the image begins at -1), and not
    farther than ``far``."""
    m = F.col(pose)
    (r0, t0), (r1, t1), (r2, t2) = [([m[4 * i + k] for k in range(3)], m[4 * i + 3]) for i in range(3)]
    if bias:
        t0, t1 = t0 - F.col(bias[0]), t1 - F.col(bias[1])
    planes = [(r2, t2)]
    for r, t, f, c, size in ((r0, t0, "fx", "cx", "w"), (r1, t1, "fy", "cy", "h")):
        low, high = F.col(c) + 1.5, F.col(c) + 0.5 - F.col(size)
        planes.append(([F.col(f) * a + low * b for a, b in zip(r, r2)], F.col(f) * t + low * t2))
        planes.append(([-(F.col(f) * a + high * b) for a, b in zip(r, r2)], -(F.col(f) * t + high * t2)))
    if far is not None:
        planes.append(([-a for a in r2], F.lit(float(far)) - t2))
    return planes


def may_see(planes: list[tuple[list[Column], Column]]) -> Column:
    """Whether a box ``_lox.._hiz`` reaches the inner side of every plane; rounding counts as reaching."""
    out = F.lit(True)
    for normal, offset in planes:
        ends = [(a * F.col(f"_lo{c}"), a * F.col(f"_hi{c}")) for a, c in zip(normal, "xyz")]
        most = sum((F.greatest(*e) for e in ends), offset)
        scale = sum((F.greatest(F.abs(e[0]), F.abs(e[1])) for e in ends), F.abs(offset))
        out = out & (most >= -1e-9 * scale)
    return out


def visible_pairs(points: DataFrame, frames: DataFrame, cell: float = 1.0, pose: str = "pose", bias: tuple[str, str] | None = None,
                  far: float | None = None) -> DataFrame:
    """Points with the cameras of their scene that may see them.

    Points are boxed by grid cell and block of indexes; only boxes meet frames, and a pair stays if the box reaches
    into all planes of the view.  Points then join the pairs of their box, so no point meets a frame that looks
    elsewhere, and a crowded cell is as many boxes as it has blocks."""
    spot = [f"_c{c}" for c in "xyz"]
    left = points.withColumns({n: F.floor(F.col(c) / cell) for n, c in zip(spot, "xyz")} | {"_b": block_of(F.col("point_idx"))})
    key = ["scene_id", *spot, "_b"]
    edges = [f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = left.groupBy(*key).agg(*edges).withColumn("_box", F.pmod(F.xxhash64(*spot, "_b"), F.lit(1 << 26)))
    pairs = attach(boxes, frames, ["scene_id"], key="_box").filter(may_see(plane_margins(pose, bias, far)))
    kept = pairs.select(*key, *[c for c in frames.columns if c != "scene_id"])
    return left.join(kept, key).drop(*spot, "_b")


def world_to_camera(points: DataFrame, pose: str = "pose") -> DataFrame:
    """Rigid 4x4 world -> camera transform; adds xc, yc and depth d."""
    m = F.col(pose)
    rows = [m[4 * i] * F.col("x") + m[4 * i + 1] * F.col("y") + m[4 * i + 2] * F.col("z") + m[4 * i + 3] for i in range(3)]
    return points.withColumn("xc", rows[0]).withColumn("yc", rows[1]).withColumn("d", rows[2])


def invert_rigid(pose: Column) -> Column:
    """Inverse of a rigid camera -> world matrix, for sources that store it that way."""
    r = [[pose[4 * i + j] for j in range(3)] for i in range(3)]
    t = [pose[4 * i + 3] for i in range(3)]
    cells: list[Column] = []
    for i in range(3):
        cells += [r[j][i] for j in range(3)]
        cells.append(-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2]))
    return F.array(*cells, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def to_pixels(cam: DataFrame, bias: tuple[str, str] | None = None) -> DataFrame:
    """Pinhole projection; the pixel is ``u + 0.5`` truncated toward zero."""
    bx, by = (F.col(bias[0]), F.col(bias[1])) if bias else (F.lit(0.0), F.lit(0.0))
    u = (F.col("xc") - bx) * F.col("fx") / F.col("d") + F.col("cx") + 0.5
    v = (F.col("yc") - by) * F.col("fy") / F.col("d") + F.col("cy") + 0.5
    def pixel(x: Column) -> Column:
        # a point near the camera plane lies far outside any image: NULL instead of a failing cast
        return F.when((F.col("d") != 0) & (F.abs(x) < float(1 << 62)), x).cast("bigint")
    return cam.withColumns({"u": pixel(u), "v": pixel(v)})


def inside_image(pixels: DataFrame) -> DataFrame:
    """In front of the camera and inside the image."""
    return pixels.filter("d >= 0 AND u >= 0 AND u < w AND v >= 0 AND v < h")


def depth_consistent(pixels: DataFrame, depth: DataFrame, tolerance: float = 0.2,
                     image: Sequence[str] = ("scene_id", "frame")) -> DataFrame:
    """Keep points whose distance agrees with the depth image; adds the flat pixel index.  Both sides are
    merged: a depth table exploded from images is far larger than its estimate, so it must not be broadcast."""
    seen = depth.filter(F.col("depth") != 0)
    out = pixels.hint("merge").join(seen, [*image, "u", "v"])
    return (out.filter(F.abs(F.col("depth") - F.col("d")) <= F.col("depth") * tolerance)
            .withColumn("flat", F.col("v") * F.col("w") + F.col("u")))


def depth_tiles(images: DataFrame, side: int = 16, image: Sequence[str] = ("scene_id", "frame")) -> DataFrame:
    """Depth images ``(image, h, w, depth)``, row by row in one array, as tiles of ``side`` pixels: ``(image, tu, tv,
    tile)``."""
    across, down = [F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / side)) for n in ("w", "h")]
    cut = images.select(*image, "h", "w", "depth", F.explode(down).alias("tv")).select("*", F.explode(across).alias("tu"))
    rows = F.sequence(F.col("tv") * side, F.least(F.col("tv") * side + side, F.col("h")) - 1)
    width = F.least(F.lit(side), F.col("w") - F.col("tu") * side)
    tile = F.flatten(F.transform(rows, lambda y: F.slice("depth", (y * F.col("w") + F.col("tu") * side + 1).cast("int"), width.cast("int"))))
    return cut.select(*image, "tu", "tv", tile.alias("tile"))


def depth_consistent_tiled(pixels: DataFrame, tiles: DataFrame, side: int = 16, tolerance: float = 0.2,
                           image: Sequence[str] = ("scene_id", "frame")) -> DataFrame:
    """J2 by tiles: a pixel joins its tile and is looked up by its place, so depth is one row per tile."""
    placed = pixels.withColumns({"tu": F.floor(F.col("u") / side), "tv": F.floor(F.col("v") / side)})
    met = placed.join(tiles, [*image, "tu", "tv"])
    width = F.least(F.lit(side), F.col("w") - F.col("tu") * side)
    place = (F.col("v") - F.col("tv") * side) * width + F.col("u") - F.col("tu") * side
    out = met.withColumn("depth", F.get("tile", place.cast("int"))).drop("tu", "tv", "tile")
    return (out.filter((F.col("depth") != 0) & (F.abs(F.col("depth") - F.col("d")) <= F.col("depth") * tolerance))
            .withColumn("flat", F.col("v") * F.col("w") + F.col("u")))


def depth_in_metres(raw: DataFrame, per_metre: float = 1000.0, col: str = "depth") -> DataFrame:
    """Stored depth units to metres; 0 stays the missing value."""
    return raw.withColumn(col, F.col(col).cast("double") / per_metre)


def unflatten(flat: Column, width: Column) -> tuple[Column, Column]:
    """``(u, v)`` of a flat pixel index."""
    return flat % width, F.floor(flat / width).cast("bigint")


def rescale_intrinsics(frames: DataFrame, native_height: int = 480) -> DataFrame:
    """Intrinsics (and principal-axis shifts, when present) of images whose height differs from the
    native one."""
    ratio = F.lit(float(native_height - 1)) / (F.col("h") - 1)
    for c in [n for n in ("fx", "fy", "cx", "cy", "bx", "by") if n in frames.columns]:
        frames = frames.withColumn(c, F.when(F.col("h") != native_height, F.col(c) / ratio).otherwise(F.col(c)))
    return frames
