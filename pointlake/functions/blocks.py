"""Joins, statistics, positions and running sums that stay balanced under a hot key.

A scene, voxel, instance or class may hold a third of all rows.  Rows carry a dense integer key
(``point_idx``); ``key >> 16`` is a *block* of at most 65536 neighbouring keys.  Work is keyed by
``(group, block)`` and only one row per block is ever keyed by the group alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.functions import rng
from pointlake.session import cut_lineage

BLOCK_BITS = 16
_BLK = "_blk"


def block_of(key: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(key.cast("bigint"), bits)


def _equal(left: DataFrame, right: DataFrame, on: Sequence[str], nullable: Sequence[str]) -> DataFrame:
    """Inner join on ``on`` where the columns in ``nullable`` also meet at NULL."""
    if not nullable:
        return left.join(right, list(on))
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [left[c].eqNullSafe(other[f"_r_{c}"]) if c in nullable else left[c] == other[f"_r_{c}"] for c in on]
    return left.join(other, same).drop(*[f"_r_{c}" for c in on])


def _keyed(rows: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``rows`` with the join keys of ``group``, which also meet at NULL: each key with NULL replaced, and a
    number whose bits say which keys are NULL.  Windows over these columns share the join's partitioning."""
    plain = {f.name: not isinstance(f.dataType, (T.NumericType, T.StringType)) for f in rows.schema.fields}
    missing = F.lit(0)
    for bit, c in enumerate(group):
        missing = missing + F.when(F.col(c).isNull(), 1 << bit).otherwise(0)
    filled = [F.struct(c) if plain[c] else F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)) for c in group]
    names = [f"_k{i}" for i in range(len(group))] + ["_k"]
    return rows.select("*", *[k.alias(n) for k, n in zip([*filled, missing], names, strict=True)]), names


def attach(rows: DataFrame, dim: DataFrame, on: Sequence[str], key: str = "point_idx",
           how: str = "inner", bits: int = BLOCK_BITS) -> DataFrame:
    """Join ``dim`` to ``rows`` on ``on``, spreading each key over its blocks.

    ``dim`` is first copied to the blocks in which its key occurs (one row per block, not per row of
    ``rows``), then joined on ``(on, block)``."""
    on = list(on)
    left = rows.withColumn(_BLK, block_of(F.col(key), bits))
    present = left.select(*on, _BLK).distinct()
    return left.join(present.join(dim, on), [*on, _BLK], how).drop(_BLK)


def with_stats(rows: DataFrame, on: Sequence[str], key: str = "point_idx",
               bits: int = BLOCK_BITS, **stats: tuple) -> DataFrame:
    """Add group statistics to every row: ``name=("min"|"max"|"sum"|"avg", column)``,
    ``name=("count",)`` or ``name=("first", column)`` (value at the lowest key).

    Partial statistics per block are merged over the blocks of a group, then joined back on
    ``(on, block)``: no task sees a whole group."""
    left, keys = _keyed(rows, list(on))
    left = left.withColumn(_BLK, block_of(F.col(key), bits))
    whole = W.partitionBy(*keys)
    partial, merged = [], []
    for name, (fn, *arg) in stats.items():
        p = f"_p_{name}"
        if fn == "count":
            partial.append(F.count(F.lit(1)).alias(p))
            merged.append(F.sum(p).over(whole).alias(name))
        elif fn == "avg":
            partial += [F.sum(arg[0]).alias(p), F.count(arg[0]).alias(p + "n")]
            merged.append((F.sum(p).over(whole) / F.sum(p + "n").over(whole)).alias(name))
        elif fn == "first":
            partial.append(F.min(F.struct(F.col(key).alias("k"), arg[0].alias("v"))).alias(p))
            merged.append(F.min(p).over(whole)["v"].alias(name))
        else:
            agg = {"min": F.min, "max": F.max, "sum": F.sum}[fn]
            partial.append(agg(arg[0]).alias(p))
            merged.append(agg(p).over(whole).alias(name))
    per_block = left.groupBy(*keys, _BLK).agg(*partial).select(*keys, _BLK, *merged)
    return left.join(per_block, [*keys, _BLK]).select(*rows.columns, *stats)


def ordinal(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str,
            block: Column, start: int = 0, store: bool = False) -> DataFrame:
    """Position of each row in its group.  ``block`` must be non-decreasing in ``order``; rows are
    numbered inside ``(group, block)`` and shifted by the sizes of the earlier blocks.

    The rows are read twice; ``store`` writes them to the checkpoint folder first, for small tables
    that are costly to derive (groups of points, pairs, instances)."""
    left, keys = _keyed(cut_lineage(rows) if store else rows, list(group))
    left = left.withColumn(_BLK, block)
    before = W.partitionBy(*keys).orderBy(_BLK).rowsBetween(W.unboundedPreceding, -1)
    sizes = (left.groupBy(*keys, _BLK).agg(F.count(F.lit(1)).alias("_n"))
             .select(*keys, _BLK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = F.row_number().over(W.partitionBy(*keys, _BLK).orderBy(*order))
    place = (F.col("_before") + F.col("_in") - 1 + start).cast("bigint")
    return left.withColumn("_in", inside).join(sizes, [*keys, _BLK]).select(*[c for c in rows.columns if c != name], place.alias(name))


def running_sum(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], block: Column,
                **sums: Column) -> DataFrame:
    """Exclusive running sums within a group (the sum of ``column`` over earlier rows); NULL keys form groups."""
    left, keys = _keyed(rows, list(group))
    left = left.withColumn(_BLK, block)
    before = W.partitionBy(*keys).orderBy(_BLK).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, _BLK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    sizes = left.groupBy(*keys, _BLK).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    sizes = sizes.select(*keys, _BLK, *[F.coalesce(F.sum(f"_t_{n}").over(before), zero).alias(f"_b_{n}")
                                         for n in sums])
    left = left.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"_i_{n}")
                              for n, c in sums.items()])
    out = left.join(sizes, [*keys, _BLK])
    return out.select(*[c for c in rows.columns if c not in sums], *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])


def shuffled(rows: DataFrame, group: Sequence[str], key: str, name: str, seed: int,
             keys: Sequence[str] | None = None, nullable: Sequence[str] = ()) -> DataFrame:
    """Seeded random position (0-based) of each row in its group, and the group size ``<name>_n``.
    Rows whose key is NULL form a group in the columns named ``nullable`` and are left out otherwise.

    The draw is uniform, so its upper 16 bits cut a group of any size into at most 65536 equal bins.
    Bins are counted map-side; a group's window sees its bins, a bin's window sees its rows."""
    group = list(group)
    draw_keys = [F.col(k) for k in (keys or [*group, key])]
    left = rows.withColumn("_h", rng.draw(seed, *draw_keys)).withColumn(_BLK, F.shiftright("_h", 15))
    whole = W.partitionBy(*group)
    before = whole.orderBy(_BLK).rowsBetween(W.unboundedPreceding, -1)
    bins = left.groupBy(*group, _BLK).agg(F.count(F.lit(1)).alias("_n")).select(
        *group, _BLK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(f"{name}_n"))
    inside = F.row_number().over(W.partitionBy(*group, _BLK).orderBy("_h", key))
    return (_equal(left.withColumn("_in", inside), bins, [*group, _BLK], nullable)
            .withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("bigint")).drop(_BLK, "_h", "_in", "_before"))
