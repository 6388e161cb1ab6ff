"""Seeded augmentation of coordinates and colours.

Parameters are drawn from ``(seed, scene_id)`` as column arithmetic, so no parameter table is joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions import rng
from pointlake.functions.blocks import attach, with_stats
from pointlake.session import cut_lineage

XYZ = ("x", "y", "z")


def scene_key() -> Column:
    return F.col("scene_id")


def gate(seed: int, config: dict | bool | None) -> Column:
    """A step runs when it is enabled and its per-scene coin falls below ``p``."""
    if config is None or config is False:
        return F.lit(False)
    if config is True:
        return F.lit(True)
    if not config.get("enabled", True):
        return F.lit(False)
    return rng.coin(seed, config["p"], scene_key()) if "p" in config else F.lit(True)


def _matmul(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def _axis_rotation(axis: int, t: Column) -> list[list[Column]]:
    one, zero, c, s = F.lit(1.0), F.lit(0.0), F.cos(t), F.sin(t)
    if axis == 0:
        return [[one, zero, zero], [zero, c, -s], [zero, s, c]]
    if axis == 1:
        return [[c, zero, s], [zero, one, zero], [-s, zero, c]]
    return [[c, s, zero], [-s, c, zero], [zero, zero, one]]


def affine_parameters(scenes: DataFrame, seed: int, jitter: bool = True, flip_p: float | None = 0.5,
                      rotation: Sequence[float] | None = (0.0, 0.0, 1.0), rotation_p: float = 1.0,
                      shuffle: bool = False) -> DataFrame:
    """G1: the nine entries ``m00..m22`` of each scene's matrix, one row per scene.

    ``identity + 0.1 N(0,1)``, an x flip, then one rotation per axis with its angle scaled by
    ``rotation``; with ``shuffle`` one of the six axis orders is drawn per scene."""
    cur = scenes.select("scene_id").distinct()
    sid = scene_key()
    cells = {}
    for i in range(3):
        for j in range(3):
            v = F.lit(1.0 if i == j else 0.0)
            cells[f"m{i}{j}"] = v + rng.normal(seed + 10 * (3 * i + j), sid) * 0.1 if jitter else v
    cur = cur.select("scene_id", *[c.alias(n) for n, c in cells.items()])
    if flip_p is not None:
        cur = cur.withColumn("m00", F.when(rng.coin(seed + 100, flip_p, sid), -F.col("m00")).otherwise(F.col("m00")))
    if rotation is None:
        return cur
    for a in range(3):
        angle = (rng.uniform(seed + 110 + a, sid) * (2 * math.pi) - math.pi) * rotation[a]
        cur = cur.withColumn(f"t{a}", F.when(rng.coin(seed + 120, rotation_p, sid), angle).otherwise(0.0))
    order = F.floor(rng.uniform(seed + 130, sid) * 6).cast("int") if shuffle else F.lit(0)
    cur = cur.withColumn("_order", order)
    # fixed values: the six orders of three axes
    orders = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
    for step in range(3):  # multiply one rotation at a time so expressions stay small
        axis = F.element_at(F.array(*[F.lit(o[step]) for o in orders]), F.col("_order") + 1) if shuffle else None
        rot = [_axis_rotation(a, F.col(f"t{a}")) for a in range(3)]
        if shuffle:
            pick = [[F.when(axis == 0, rot[0][i][j]).when(axis == 1, rot[1][i][j]).otherwise(rot[2][i][j])
                     for j in range(3)] for i in range(3)]
        else:
            pick = rot[step]
        m = _matmul([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)], pick)
        cur = cur.select("scene_id", "_order", "t0", "t1", "t2",
                         *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    return cur.drop("_order", "t0", "t1", "t2")


def apply_affine(points: DataFrame, params: DataFrame) -> DataFrame:
    """G1: row vector times matrix."""
    out = attach(points, params, ["scene_id"])
    new = [sum((F.col(c) * F.col(f"m{i}{j}") for i, c in enumerate(XYZ)), F.lit(0.0)).alias(f"_n{XYZ[j]}") for j in range(3)]
    out = out.select("*", *new)
    for c in XYZ:
        out = out.withColumn(c, F.col(f"_n{c}")).drop(f"_n{c}")
    return out.drop(*[f"m{i}{j}" for i in range(3) for j in range(3)])


def jitter_points(points: DataFrame, seed: int, value: float | None = None) -> DataFrame:
    """Uniform noise per point and axis; its width is ``value`` or 10 % of the mean extent."""
    if value is None:
        stats = {f"_{k}{c}": (fn, F.col(c)) for c in XYZ for k, fn in (("lo", "min"), ("hi", "max"))}
        points = with_stats(points, ["scene_id"], **stats)
        width = sum((F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in XYZ), F.lit(0.0)) / 3 * 0.1
    else:
        stats, width = {}, F.lit(float(value))
    points = points.withColumn("_w", width)
    for i, c in enumerate(XYZ):
        points = points.withColumn(c, F.col(c) + (rng.uniform(seed + i, scene_key(), F.col("point_idx")) - 0.5) * F.col("_w"))
    return points.drop("_w", *stats)


def scale_scene(points: DataFrame, seed: int, lo: float, hi: float) -> DataFrame:
    """Scale about the centre of the bounding box."""
    stats = {f"_{k}{c}": (fn, F.col(c)) for c in XYZ for k, fn in (("lo", "min"), ("hi", "max"))}
    out = with_stats(points, ["scene_id"], **stats)
    factor = rng.uniform(seed, scene_key()) * (hi - lo) + lo
    for c in XYZ:
        mid = (F.col(f"_hi{c}") + F.col(f"_lo{c}")) / 2.0
        out = out.withColumn(c, (F.col(c) - mid) * factor + mid)
    return out.drop(*stats)


def jitter_colour(points: DataFrame, seed: int, cols: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """One colour offset per scene."""
    for i, c in enumerate(cols):
        points = points.withColumn(c, F.col(c) + rng.normal(seed + 10 * i, scene_key()) * 0.1)
    return points


BRICK_BITS = 2  # cells per axis of a brick: 4, so its 64 cells are the bits of one BIGINT
HALO = 2  # two passes of a 3-tap filter reach two nodes


def blur_weights(node: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Weight of raw node ``raw`` in blurred node ``node`` along an axis of ``size`` nodes: the number of ways to go from
    one to the other in two steps of at most one node inside the grid, over 9 (zeros lie outside)."""
    lo = np.maximum(np.maximum(node, raw) - 1, 0)
    hi = np.minimum(np.minimum(node, raw) + 1, size - 1)
    return np.where((raw >= 0) & (raw < size), np.maximum(hi - lo + 1, 0), 0) / 9.0


def noise_cells(bricks: DataFrame, seed: int) -> DataFrame:
    """Corner values ``cx, cy, cz`` (order: i, j, k bits) of the grid cells that hold points.

    ``bricks`` has a row per 4 x 4 x 4 cells: ``scene_id``, ``_key`` of the scene, nodes per axis ``bx, by, bz``, the brick's
    place ``bi, bj, bk`` and the bits ``cells`` of those in use.  A node's noise depends on ``(seed, scene, node)`` alone, so a
    brick draws its nodes and their halo itself and blurs them by one small matrix per axis: nothing is
    exchanged between bricks, and empty space costs nothing."""
    schema = f"scene_id {bricks.schema['scene_id'].dataType.simpleString()}, i bigint, j bigint, k bigint, cx array<double>, cy array<double>, cz array<double>"
    side = 1 << BRICK_BITS

    def blurred(key: np.ndarray, sizes: list[np.ndarray], first: list[np.ndarray]) -> np.ndarray:
        raw = [f[:, None] + np.arange(-HALO, side + 1 + HALO) for f in first]
        shown = [np.maximum(r, 0) for r in raw]
        nodes = shown[0][:, :, None, None], shown[1][:, None, :, None], shown[2][:, None, None, :]
        wi, wj, wk = (blur_weights((f[:, None] + np.arange(side + 1))[:, :, None], r[:, None, :], s[:, None, None]) for f, r, s in zip(first, raw, sizes))
        noise = np.stack([rng.normal_array(seed + 10 * a, key[:, None, None, None], *nodes) for a in range(3)], axis=1)
        return np.einsum("nax,nby,ncz,ndxyz->ndabc", wi, wj, wk, noise, optimize=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                col = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_key", "bx", "by", "bz", "bi", "bj", "bk", "cells")}
                first = [col[c] << BRICK_BITS for c in ("bi", "bj", "bk")]
                value = blurred(col["_key"], [col[c] for c in ("bx", "by", "bz")], first)
                owner, code = np.nonzero(col["cells"][:, None] >> np.arange(side ** 3) & 1)
                at = [code >> (2 - a) * BRICK_BITS & side - 1 for a in range(3)]
                corners = np.stack([value[owner, :, at[0] + (c >> 2 & 1), at[1] + (c >> 1 & 1), at[2] + (c & 1)] for c in range(8)], axis=-1)
                offsets = pa.array(np.arange(0, 8 * len(owner) + 1, 8, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("scene_id").take(pa.array(owner)), *[pa.array(first[a][owner] + at[a]) for a in range(3)],
                     *[pa.ListArray.from_arrays(offsets, pa.array(corners[:, a].reshape(-1))) for a in range(3)]],
                    names=["scene_id", "i", "j", "k", "cx", "cy", "cz"])

    return bricks.mapInArrow(run, schema)


def elastic(points: DataFrame, gran: float, mag: float, seed: int) -> DataFrame:
    """Move each point by trilinearly interpolated noise times ``mag``; the grid spans
    ``[-(b-1) gran, (b-1) gran]`` per axis with ``b = max|x| // gran + 3`` nodes, and points outside it stay.  The noise is
    blurred by two passes of a 3-tap box filter per axis; only cells that hold points are worked out."""
    gran = int(gran)
    nodes = [(F.floor(F.floor(F.max(F.abs(c))) / gran) + 3).cast("bigint").alias(f"b{c}") for c in XYZ]
    pts = attach(points, points.groupBy("scene_id").agg(*nodes), ["scene_id"])
    for c, i in zip(XYZ, "ijk"):
        # node spacing is 2 * gran because b nodes span 2 (b - 1) gran
        pos = (F.col(c) + (F.col(f"b{c}") - 1) * gran) / (2.0 * gran)
        pts = pts.withColumn(f"_p{i}", pos).withColumn(
            i, F.greatest(F.least(F.floor(f"_p{i}").cast("bigint"), F.col(f"b{c}") - 2), F.lit(0).cast("bigint")))
    inner = [F.col(n).bitwiseAND((1 << BRICK_BITS) - 1) for n in "ijk"]
    code = F.shiftleft(inner[0], 2 * BRICK_BITS) + F.shiftleft(inner[1], BRICK_BITS) + inner[2]
    places = [F.shiftright(n, BRICK_BITS).alias(f"b{n}") for n in "ijk"]
    bit = F.expr("shiftleft(1L, CAST(_code AS INT))")
    used = pts.select("scene_id", rng.key_of(scene_key()).alias("_key"), "bx", "by", "bz", *places, code.alias("_code"))
    cells = noise_cells(used.groupBy(*[c for c in used.columns if c != "_code"]).agg(F.bit_or(bit).alias("cells")), seed)
    out = attach(pts, cells, ["scene_id", "i", "j", "k"], how="left")
    frac = [F.col(f"_p{i}") - F.col(i) for i in "ijk"]
    inside = F.lit(True)
    for f in frac:
        inside = inside & f.between(0.0, 1.0)
    for c in XYZ:
        total = F.lit(0.0)
        for corner in range(8):
            weight = F.lit(1.0)
            for axis in range(3):
                bit = corner >> (2 - axis) & 1
                weight = weight * (frac[axis] if bit else F.lit(1.0) - frac[axis])
            total = total + weight * F.col(f"c{c}")[corner]
        out = out.withColumn(f"_g{c}", F.when(inside, total).otherwise(0.0))
    for c in XYZ:
        out = out.withColumn(c, F.col(c) + F.col(f"_g{c}") * mag)
    return out.select(*points.columns)


CROP_GRID = 64  # most cells per axis of the count grid of a scene


def crop(points: DataFrame, full_scale: int, max_points: int, seed: int, step: int = 32,
         big: int = 1_000_000) -> DataFrame:
    """Shrink the xy window from ``full_scale`` by ``step`` (twice that while more than ``big``
    points remain), with a new random shift each time, until at most ``max_points`` remain.

    Attempt ``t`` of the loop uses a window shrunk by ``m`` steps with ``t <= m <= 2t``.  A scene is counted once into an xy
    grid (about 64 points a cell, at most 64 x 64 cells, each with the box of its points).  Cells wholly inside a window and
    cells that touch it bound its count from both sides, which settles most attempts.  A fold lists the windows
    that are reached and still in doubt (none or one for most scenes); points are tested one by one against
    these only.  A second fold finds the attempt at which each scene stops, and the points of that window
    are kept (shifted)."""
    last = math.ceil(full_scale / step) + 1
    attempts = [(t, m) for t in range(last) for m in range(t, min(2 * t, last) + 1)]
    bounds = [f(c).alias(f"_{k}{c}") for c in XYZ for k, f in (("lo", F.min), ("hi", F.max))]
    scenes = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"), *bounds)
    shifts = [F.array(*[rng.uniform(seed + a, scene_key(), F.lit(t)) for t in range(last)]).alias(f"_u{c}") for a, c in enumerate(XYZ)]
    scenes = cut_lineage(scenes.select("*", *shifts))
    code = lambda t, m: (t * (1 << 20) + m).cast("int")

    def moved(a: int, at: Column, t: Column, m: Column) -> Column:
        """Coordinate ``at`` on axis ``a`` as attempt ``t`` shifts it; non-decreasing in ``at``."""
        c = XYZ[a]
        return at + F.least(side(a, m) - (F.col(f"_hi{c}") - F.col(f"_lo{c}")) + 0.001, F.lit(0.0)) * F.get(F.col(f"_u{c}"), t)

    def side(a: int, m: Column) -> Column:
        return F.lit(float(full_scale)) - m * float(step) if a < 2 else F.lit(float(full_scale))

    def holds(t: Column, m: Column, least: str = "{}", most: str = "{}") -> Column:
        """Whether all from the columns ``least`` to ``most`` lie in the window."""
        ok = F.lit(True)
        for a, c in enumerate(XYZ):
            ok = ok & (moved(a, F.col(least.format(c)), t, m) >= 0) & (moved(a, F.col(most.format(c)), t, m) < side(a, m))
        return ok

    # scenes that fit need no attempt
    large = scenes.filter(F.col("_n") > max_points)
    axis = F.least(F.lit(CROP_GRID), F.ceil(F.sqrt("_n") / 8).cast("int"))
    pts = attach(points.select("scene_id", "point_idx", *XYZ), large.select("*", axis.alias("_g")), ["scene_id"])
    for c in "xy":
        room = F.col(f"_hi{c}") - F.col(f"_lo{c}")
        pts = pts.withColumn(f"_c{c}", F.when(room > 0, F.least(F.floor((F.col(c) - F.col(f"_lo{c}")) / room * F.col("_g")).cast("int"), F.col("_g") - 1)).otherwise(0))
    boxes = [f(c).alias(f"_{k}_{c}") for c in XYZ for k, f in (("a", F.min), ("b", F.max))]
    cells = pts.groupBy("scene_id", "_cx", "_cy").agg(F.count(F.col("x") + F.col("y") + F.col("z")).alias("_in"), *boxes)
    cells = cells.join(large, "scene_id")
    tries = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in attempts])
    seen = cells.withColumn("_a", F.explode(tries)).select("*", "_a.t", "_a.m")
    touched = seen.filter(holds(F.col("t"), F.col("m"), "_b_{}", "_a_{}"))
    inside = F.when(holds(F.col("t"), F.col("m"), "_a_{}", "_b_{}"), F.col("_in")).otherwise(0)
    counts = touched.groupBy("scene_id", "t", "m").agg(F.sum(inside).alias("lo"), F.sum("_in").alias("hi"))

    def table(rows: DataFrame, n: str, out: str) -> DataFrame:
        return rows.groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct(code(F.col("t"), F.col("m")), n))).alias(out))

    def at(name: str, t: Column, m: Column) -> Column:
        return F.coalesce(F.try_element_at(name, code(t, m)), F.lit(0).cast("bigint"))

    # windows that the loop can reach given both bounds, with the steps by which the next one shrinks, and those in doubt
    def reach(s, t):
        def follow(w):
            lo, hi = at("_lo", t, w["m"]), at("_hi", t, w["m"])
            after = lambda g: F.struct((w["m"] + w["g"]).alias("m"), F.lit(g).alias("g"))
            return F.array_compact(F.array(F.when(F.greatest(lo, F.lit(max_points + 1)) <= F.least(hi, F.lit(big)), after(1)),
                                           F.when(hi > max(max_points, big), after(2))))

        def settled(w):
            lo, hi = at("_lo", t, w["m"]), at("_hi", t, w["m"])
            return (hi <= max_points) | ((lo > max_points) & ((lo > big) | (hi <= big)))

        doubt = F.transform(F.filter(s["open"], lambda w: ~settled(w)), lambda w: F.struct(t.alias("t"), w["m"].alias("m")))
        return F.struct(F.array_distinct(F.flatten(F.transform(s["open"], follow))).alias("open"), F.array_union(s["doubt"], doubt).alias("doubt"))

    times = F.sequence(F.lit(0), F.lit(last - 1))
    none = F.array().cast("array<struct<t: int, m: int>>")
    first = F.struct(F.array(F.struct(F.lit(0).alias("m"), F.when(F.col("_n") > big, 2).otherwise(1).alias("g"))).alias("open"), none.alias("doubt"))
    known = table(counts, "lo", "_lo").join(table(counts, "hi", "_hi"), "scene_id").join(large.select("scene_id", "_n"), "scene_id")
    known = cut_lineage(known.select("scene_id", "_lo", "_hi", F.aggregate(times, first, reach)["doubt"].alias("_doubt")))

    unsure = known.filter(F.size("_doubt") > 0).select("scene_id", "_doubt").join(large, "scene_id")
    near = attach(points.select("scene_id", "point_idx", *XYZ), unsure, ["scene_id"])
    hits = near.select("scene_id", F.explode(F.filter("_doubt", lambda w: holds(w["t"], w["m"]))).alias("_w"))
    hits = hits.groupBy("scene_id", "_w.t", "_w.m").agg(F.count(F.lit(1)).alias("n"))

    # state: last attempt, steps shrunk, points left, window of the last attempt
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("m"), F.col("_n").alias("n"), F.lit(0).alias("used"))

    def advance(s, t):
        n = F.coalesce(F.try_element_at("_exact", code(t, s["m"])), at("_lo", t, s["m"]))
        shrink = F.when(s["n"] > big, 2).otherwise(1)
        return F.when(s["n"] > max_points, F.struct(t.alias("t"), (s["m"] + shrink).alias("m"), n.alias("n"), s["m"].alias("used"))).otherwise(s)

    end = F.aggregate(times, start, advance)
    chosen = scenes.join(known.select("scene_id", "_lo").join(table(hits, "n", "_exact"), "scene_id", "left"), "scene_id", "left").select(*scenes.columns, end.alias("_e"))
    chosen = chosen.select(*scenes.columns, F.col("_e.t").alias("_t"), F.col("_e.used").alias("_m"))
    out = attach(points, chosen, ["scene_id"])
    whole = F.col("_t") < 0
    at_t = F.greatest("_t", F.lit(0))
    out = out.filter(whole | holds(at_t, F.col("_m"))).select("*", *[
        F.when(whole, F.col(c)).otherwise(moved(a, F.col(c), at_t, F.col("_m"))).alias(f"_s{c}") for a, c in enumerate(XYZ)])
    for c in XYZ:
        out = out.withColumn(c, F.col(f"_s{c}"))
    return out.select(*points.columns)


def world_rotation(points: DataFrame, seed: int) -> DataFrame:
    """One random xy rotation per scene."""
    t = rng.uniform(seed, scene_key()) * (2 * math.pi) - math.pi
    x = F.col("x") * F.cos(t) - F.col("y") * F.sin(t)
    y = F.col("x") * F.sin(t) + F.col("y") * F.cos(t)
    return points.withColumn("_x", x).withColumn("y", y).withColumn("x", F.col("_x")).drop("_x")


def world_flip(points: DataFrame, seed: int) -> DataFrame:
    """Flip x, y, both or nothing, with equal chance."""
    kind = F.floor(rng.uniform(seed, scene_key()) * 4)
    x = F.when(kind.isin(0, 2), -F.col("x")).otherwise(F.col("x"))
    y = F.when(kind.isin(1, 2), -F.col("y")).otherwise(F.col("y"))
    return points.withColumn("x", x).withColumn("y", y)


def world_scaling(points: DataFrame, seed: int, lo: float, hi: float) -> DataFrame:
    """One xy factor per scene."""
    f = rng.uniform(seed, scene_key()) * (hi - lo) + lo
    return points.withColumn("x", F.col("x") * f).withColumn("y", F.col("y") * f)


def world_translation(points: DataFrame, seed: int, std: Sequence[float]) -> DataFrame:
    """One Gaussian shift per scene."""
    for i, c in enumerate(XYZ):
        points = points.withColumn(c, F.col(c) + rng.normal(seed + 10 * i, scene_key()) * float(std[i]))
    return points


def when_gated(points: DataFrame, seed: int, config: dict | bool | None,
               step: Callable[[DataFrame], DataFrame], cols: Sequence[str] = XYZ) -> DataFrame:
    """Run ``step`` on the scenes whose gate is open; the others keep their values."""
    marked = points.select("*", gate(seed, config).alias("_on"), *[F.col(c).alias(f"_o{c}") for c in cols])
    out = step(marked)
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_on"), F.col(c)).otherwise(F.col(f"_o{c}")))
    return out.select(*points.columns)
