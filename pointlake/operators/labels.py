"""Label maps, filters and class-score selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.blocks import attach, ordinal, with_stats
from pointlake.schema import IGNORE, ClassSplit

CODE_BASE = 1000


def lookup(col: Column, table: Mapping[int, float], default) -> Column:
    """Map a bounded literal vocabulary; unmapped values take ``default``."""
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col.cast("int")), F.lit(default))


def map_classes(label: Column, class_ids: Sequence[int], squeeze: bool = True) -> Column:
    """Listed class -> its position (or itself); anything else -> IGNORE."""
    return lookup(label, {c: (i if squeeze else c) for i, c in enumerate(class_ids)}, IGNORE)


def map_base_flag(label: Column, split: ClassSplit) -> Column:
    """Base -> 1, novel and ignored classes -> 0, anything else -> IGNORE."""
    table = {c: 1 for c in split.base} | {c: 0 for c in (*split.novel, *split.ignored)}
    return lookup(label, table, IGNORE)


def apply_label_mode(points: DataFrame, split: ClassSplit, mode: str) -> DataFrame:
    """``base`` keeps base classes only, ``all`` keeps every valid class; adds ``label``
    (squeezed) and ``is_base``, and P4 hides instances whose label is ignored."""
    keep = {"base": split.base, "all": split.valid}[mode]
    return propagate_ignore(
        points.withColumn("is_base", map_base_flag(F.col("sem_label"), split))
        .withColumn("label", map_classes(F.col("sem_label"), keep)), "label")


def propagate_ignore(points: DataFrame, label: str = "sem_label") -> DataFrame:
    """No semantic label, no instance label."""
    return points.withColumn("inst_label", F.when(F.col(label) == IGNORE, F.lit(IGNORE).cast("bigint"))
                             .otherwise(F.col("inst_label")))


def hide_novel_instances(points: DataFrame, flag: str = "is_base") -> DataFrame:
    """P5: instances of novel classes are not shown in training."""
    return points.withColumn("inst_label", F.when(F.col(flag) == 0, F.lit(IGNORE).cast("bigint"))
                             .otherwise(F.col("inst_label")))


def densify_instances(points: DataFrame, valid: Column) -> DataFrame:
    """Rows outside ``valid`` lose their instance; surviving ids become 0..k-1 per scene."""
    masked = points.withColumn("inst_label", F.when(valid, F.col("inst_label")).otherwise(IGNORE).cast("bigint"))
    ids = masked.filter("inst_label >= 0").select("scene_id", "inst_label").distinct()
    dense = ordinal(ids, ["scene_id"], ["inst_label"], "_dense", F.shiftright("inst_label", 16), store=True)
    return (attach(masked, dense, ["scene_id", "inst_label"], how="left")
            .withColumn("inst_label", F.coalesce("_dense", F.lit(IGNORE).cast("bigint"))).drop("_dense"))


def drop_scenes_without_instances(points: DataFrame) -> DataFrame:
    """Keep scenes that still have an instance."""
    return with_stats(points, ["scene_id"], _top=("max", F.col("inst_label"))).filter("_top >= 0").drop("_top")


def shift_class(cls: Column, shift: int) -> Column:
    """``cls - shift`` unless missing."""
    return F.when(cls == IGNORE, cls).otherwise(cls - shift)


def encode_gt(sem: Column, inst: Column, shift: int = 0) -> Column:
    """``class * 1000 + instance + 1`` with classes counted from 1; 0 when the instance is
    missing.  Instance numbers that would spill into the class part raise."""
    number = inst + 1
    code = F.greatest(sem - shift + 1, F.lit(0)) * CODE_BASE + number
    return (F.when(number < 0, F.lit(0).cast("bigint"))
            .when(number >= CODE_BASE, F.raise_error(F.lit("instance number does not fit the code")).cast("bigint"))
            .otherwise(code.cast("bigint")))


def code_class(code: Column) -> Column:
    """P10: class part of an instance code."""
    return F.floor(code / CODE_BASE).cast("bigint")


def is_void(code: Column, valid_ids: Sequence[int]) -> Column:
    """P10: the code's class is not evaluated."""
    return ~code_class(code).isin(*valid_ids)


def within_xy(points: DataFrame, box: Sequence[float]) -> DataFrame:
    """Inclusive range filter on x and y; ``box`` is x0 y0 z0 x1 y1 z1."""
    return points.filter(F.col("x").between(box[0], box[3]) & F.col("y").between(box[1], box[4]))


def clip_to_box(points: DataFrame, box: Sequence[float]) -> DataFrame:
    """Move outside points onto the box."""
    for i, c in enumerate("xyz"):
        points = points.withColumn(c, F.greatest(F.least(F.col(c), F.lit(float(box[i + 3]))), F.lit(float(box[i]))))
    return points


def drop_named(rows: DataFrame, name: str, col: str = "name") -> DataFrame:
    """Drop records of one name."""
    return rows.filter(F.col(col) != name)


def keep_named(rows: DataFrame, names: Sequence[str], col: str = "name") -> DataFrame:
    """Keep records of the given names."""
    return rows.filter(F.col(col).isin(*names))


def keep_points(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """Restrict every column to the chosen ``(scene_id, point_idx)`` rows."""
    return points.join(chosen.select("scene_id", "point_idx"), ["scene_id", "point_idx"], "left_semi")


def mask_invalid_scores(logits: Column, valid: Sequence[int], floor: float = -1e6) -> Column:
    """Classes outside ``valid`` get a score no argmax can pick."""
    ok = F.array(*[F.lit(c) for c in valid])
    return F.transform(logits, lambda x, i: F.when(F.array_contains(ok, i), x).otherwise(F.lit(floor)))


def select_scores(logits: Column, class_ids: Sequence[int]) -> Column:
    """Keep the columns of the given classes, in that order."""
    return F.array(*[logits[c] for c in class_ids])


def remap_scores(logits: Column, sources: Mapping[int, Sequence[int]]) -> Column:
    """Score of a target class = best score of its source classes."""
    return F.array(*[F.array_max(F.array(*[logits[s] for s in sources[t]])) for t in sorted(sources)])


def shift_instances(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """P20: add a per-point offset table to points that belong to an instance."""
    joined = points.join(offsets, ["scene_id", "point_idx"], "left")
    moved = F.col("inst_label") >= 0
    return joined.select(*[
        (F.when(moved, F.col(c) + F.coalesce(F.col(f"off_{c}"), F.lit(0.0))).otherwise(F.col(c)).alias(c)
         if c in ("x", "y", "z") else F.col(c)) for c in points.columns])


def blank_unobserved(preds: DataFrame, observed: DataFrame, pred: str = "pred") -> DataFrame:
    """Points no image sees get IGNORE as prediction."""
    seen = observed.select("scene_id", "point_idx").distinct().withColumn("_seen", F.lit(True))
    return (preds.join(seen, ["scene_id", "point_idx"], "left")
            .withColumn(pred, F.when(F.col("_seen"), F.col(pred)).otherwise(IGNORE).cast("bigint")).drop("_seen"))


def concat_tables(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def common_classes(a: Sequence[int], b: Sequence[int]) -> Column:
    """Class ids in both lists."""
    return F.array_intersect(F.array(*[F.lit(x) for x in a]), F.array(*[F.lit(x) for x in b]))
