"""Radius neighbours by a grid-cell join."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointlake.functions.blocks import attach, block_of, ordinal

CELL = ("_cx", "_cy", "_cz")


def offsets_struct(reach: int, half: bool):
    """Neighbour cell offsets; ``half`` keeps one of each opposite pair."""
    steps = [o for o in product(range(-reach, reach + 1), repeat=3) if not half or o > (0, 0, 0)]
    return F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in zip(o, "abc")]) for o in steps])


def squared_distance(a: str, b: str):
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0.0))


def radius_pairs(points: DataFrame, radius: float, group: Sequence[str] = ("scene_id",), crowded: int = 8192) -> DataFrame:
    """Every pair ``src < dst`` of a group with ``d**2 < radius**2``, once.

    Cells have edge ``radius``; each point looks into its own cell and 13 of the 26 neighbours, so a
    pair is met exactly once.  The largest cell is counted first: when it holds more than
    ``crowded`` points, the points of a cell are dealt into parts of that size and each part is joined
    by its own task.  Both sides hold every point, so they are merged and never broadcast: their size is
    underestimated after the look-ups are exploded."""
    group = list(group)
    cells = points.select(*group, "point_idx", "x", "y", "z",
                          *[F.floor(F.col(c) / radius).cast("bigint").alias(n) for c, n in zip("xyz", CELL)])
    sizes = cells.groupBy(*group, *CELL).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.array(F.struct(*[F.lit(0).cast("bigint").alias(n) for n in "abc"]))
    look = F.concat(zero, offsets_struct(1, half=True))
    own = (F.col("_o.a") == 0) & (F.col("_o.b") == 0) & (F.col("_o.c") == 0)
    target = [(F.col(n) + F.col(f"_o.{k}")).alias(n) for n, k in zip(CELL, "abc")]
    p_cols = [F.col("point_idx").alias("p"), *[F.col(c).alias(f"p{c}") for c in "xyz"]]
    q_cols = [F.col("point_idx").alias("q"), *[F.col(c).alias(f"q{c}") for c in "xyz"]]
    key = [*group, *CELL]
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= crowded:
        left = cells.withColumn("_o", F.explode(look)).select(*group, *p_cols, own.alias("own"), *target)
        right = cells.select(*key, *q_cols)
    else:
        parts = sizes.select(*key, F.ceil(F.col("_n") / crowded).alias("_parts"))
        # look-ups are made per cell, and only cells that hold points are looked into
        goals = sizes.withColumn("_o", F.explode(look)).select(
            *group, *[F.col(n).alias(f"from{n}") for n in CELL], own.alias("own"), *target).join(parts, key)
        goals = goals.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
        goals = goals.withColumnsRenamed({n: f"to{n}" for n in CELL}).withColumnsRenamed({f"from{n}": n for n in CELL})
        left = attach(cells, goals, key).select(*group, *p_cols, "own", "_part", *[F.col(f"to{n}").alias(n) for n in CELL])
        right = attach(cells, parts, key).select(*key, (F.col("point_idx") % F.col("_parts")).alias("_part"), *q_cols)
        key = [*key, "_part"]
    pairs = left.hint("merge").join(right, key).filter(~F.col("own") | (F.col("p") < F.col("q")))
    near = pairs.filter(squared_distance("p", "q") < radius * radius)
    return near.select(*group, F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"))


def _lowest(pairs: DataFrame, group: Sequence[str], cap: int) -> DataFrame:
    """The ``cap`` lowest ``dst`` per ``src``; Spark cuts to ``cap`` before the shuffle and after it."""
    rank = F.row_number().over(W.partitionBy(*group, "src").orderBy("dst"))
    return pairs.withColumn("_k", rank).filter(F.col("_k") <= cap).drop("_k")


def capped_neighbours(points: DataFrame, radius: float, cap: int, group: Sequence[str] = ("scene_id",), head: int = 256,
                      crowded: int = 8192) -> DataFrame:
    """J4 with a cap: the ``cap`` lowest indices within ``radius`` of each point, itself included.

    1. Points are numbered inside their cell by index.  Each point looks at the first ``head`` members of its 27
       cells only, so it meets at most ``27 * head`` points however crowded they are.
    2. What a crowded cell holds beyond its head has higher indices than ``next``, its first member after the head.
       A point is closed if it has found ``cap`` neighbours below the least ``next`` around it, or if no cell
       around it is crowded.
    3. Only the others look at all members of their cells, which are dealt into parts of ``crowded``.

    Joins of points with points are merged, never broadcast."""
    group = list(group)
    key = [*group, *CELL]
    cells = points.select(*group, "point_idx", "x", "y", "z", *[F.floor(F.col(c) / radius).cast("bigint").alias(n) for c, n in zip("xyz", CELL)])
    cells = ordinal(cells, key, ["point_idx"], "_rank", block_of(F.col("point_idx")))
    around = offsets_struct(1, half=False)
    target = [(F.col(n) + F.col(f"_o.{k}")).alias(n) for n, k in zip(CELL, "abc")]
    p_cols = [F.col("point_idx").alias("p"), *[F.col(c).alias(f"p{c}") for c in "xyz"]]
    q_cols = [F.col("point_idx").alias("q"), *[F.col(c).alias(f"q{c}") for c in "xyz"]]

    def near(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        met = left.hint("merge").join(right, on).filter(squared_distance("p", "q") < radius * radius)
        return _lowest(met.select(*group, F.col("p").alias("src"), F.col("q").alias("dst")), group, cap)

    looking = cells.withColumn("_o", F.explode(around)).select(*group, *p_cols, *target)
    first = near(looking, cells.filter(F.col("_rank") < head).select(*key, *q_cols), key)

    # cells next to a crowded one: the lowest index that a head does not show
    hidden = cells.filter(F.col("_rank") == head).withColumn("_o", F.explode(around)).select(*group, *target, F.col("point_idx").alias("next"))
    limits = hidden.groupBy(*key).agg(F.min("next").alias("next"))
    found = first.groupBy(*group, F.col("src").alias("point_idx")).agg(F.count(F.lit(1)).alias("_n"), F.max("dst").alias("_top"))
    doubtful = attach(cells, limits, key).hint("merge").join(found, [*group, "point_idx"]).filter((F.col("_n") < cap) | (F.col("_top") >= F.col("next")))

    parts = cells.groupBy(*key).agg(F.floor(F.max("_rank") / crowded).alias("_last"))
    again = doubtful.withColumn("_o", F.explode(around)).select(*group, *p_cols, *target).join(parts, key)
    again = again.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last")))).drop("_last")
    rest = near(again, cells.withColumn("_part", F.floor(F.col("_rank") / crowded)).select(*key, "_part", *q_cols), [*key, "_part"])
    closed = first.hint("merge").join(doubtful.select(*group, F.col("point_idx").alias("src")), [*group, "src"], "left_anti")
    return closed.unionByName(rest)


def radius_neighbours(points: DataFrame, radius: float, group: Sequence[str] = ("scene_id",),
                      cap: int | None = None, crowded: int = 8192) -> DataFrame:
    """Directed neighbour lists, each point included in its own; ``cap`` keeps the lowest
    indices per point."""
    group = list(group)
    if cap is not None:
        return capped_neighbours(points, radius, cap, group, max(256, 2 * cap), crowded)
    pairs = radius_pairs(points, radius, group, crowded)
    loops = points.select(*group, F.col("point_idx").alias("src"), F.col("point_idx").alias("dst"))
    return pairs.unionByName(pairs.select(*group, F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(loops)
