"""Instance proposals and predicted instances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions import rng
from pointlake.functions.blocks import attach, block_of, ordinal, with_stats
from pointlake.functions.vectors import mean_vector, sigmoid, softmax
from pointlake.operators.voxel import CELL, voxel_table
from pointlake.session import cut_lineage


def class_candidates(scores: DataFrame, probs: str, threshold: float, ignored: Sequence[int], min_points: int) -> DataFrame:
    """``(point, class)`` rows whose probability exceeds the threshold, for classes that have at
    least ``min_points`` candidates in the scene.

    Probabilities sum to 1, so a point yields fewer than ``1 / threshold`` rows."""
    skip = F.array(*[F.lit(c) for c in ignored]) if ignored else F.array().cast("array<int>")
    hits = F.filter(F.transform(F.col(probs), lambda p, i: F.struct(i.alias("class_id"), p.alias("prob"))),
                    lambda s: (s["prob"] > threshold) & ~F.array_contains(skip, s["class_id"]))
    rows = scores.withColumn("_h", F.explode(hits))
    rows = rows.select(*[c for c in scores.columns], F.col("_h.class_id").cast("bigint").alias("class_id"), F.col("_h.prob").alias("prob"))
    counted = with_stats(rows, ["scene_id", "class_id"], _n=("count",))
    return counted.filter(F.col("_n") >= min_points).drop("_n")


def shift_by_offset(points: DataFrame) -> DataFrame:
    """Move points by their predicted offset to the instance centre."""
    for c in "xyz":
        points = points.withColumn(c, F.col(c) + F.col(f"pred_off_{c}"))
    return points


def number_proposals(clusters: DataFrame) -> DataFrame:
    """Proposals of all classes of a scene in one numbering, by class then component order."""
    key = ["scene_id", "class_id", "label"]
    rows = clusters.withColumn("_blk", block_of(F.col("point_idx")))
    # the blocks in which a proposal has points, written once: the clusters are read for them and for the result only
    present = cut_lineage(rows.select(*key, "_blk").distinct())
    block = F.shiftleft(F.col("class_id").cast("bigint"), 44) + F.shiftright("label", 16)
    numbered = ordinal(present.select(*key).distinct(), ["scene_id"], ["class_id", "label"], "proposal_id", block, store=True)
    return rows.join(present.join(numbered, key), [*key, "_blk"]).drop("_blk")


def proposal_scores(members: DataFrame, logits: DataFrame, n_classes: int, label_shift: int = 0) -> DataFrame:
    """Mean raw scores of a proposal's points, classes from ``label_shift`` on."""
    rows = members.select("scene_id", "proposal_id", "point_idx").join(logits.select("scene_id", "point_idx", "logits"), ["scene_id", "point_idx"])
    out = mean_vector(rows, ["scene_id", "proposal_id"], "logits", n_classes, "cls_scores")
    return out.withColumn("cls_scores", F.slice("cls_scores", label_shift + 1, n_classes - label_shift))


def revoxelise(members: DataFrame, feats: Sequence[str], scale: float, shape: int,
               seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """V8: voxelize each proposal on its own grid of at most ``shape`` cells per axis.  With a ``seed`` each
    proposal moves by a random shift inside its grid.  A point outside the grid raises.

    Returns the voxel table with mean features and the member -> voxel rows."""
    key = ["scene_id", "proposal_id"]
    stats = {f"_{k}{c}": (fn, F.col(c)) for c in "xyz" for k, fn in (("lo", "min"), ("hi", "max"))}
    pts = with_stats(members, key, **stats)
    extent = F.greatest(*[F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in "xyz"])
    fit = F.when(extent > 0, F.lit(1.0) / (extent / shape) - 0.01)
    pts = pts.withColumn("_s", F.least(F.lit(float(scale)), fit))  # least() skips the NULL of a flat proposal
    for axis, (v, c) in enumerate(zip(CELL, "xyz")):
        place = F.col(c) * F.col("_s") - F.col(f"_lo{c}") * F.col("_s")
        if seed is not None:
            room = F.lit(float(shape)) - (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * F.col("_s")
            wide, tight = [rng.uniform(seed + 2 * axis + k, F.col("scene_id"), F.col("proposal_id")) for k in (0, 1)]
            place = place + F.greatest(room - 0.001, F.lit(0.0)) * wide + F.least(room + 0.001, F.lit(0.0)) * tight
        outside = F.raise_error(F.concat(F.lit("a point lies outside the grid of proposal "), F.col("proposal_id").cast("string")))
        pts = pts.withColumn(v, F.when((place >= 0) & (place < shape), F.floor(place)).otherwise(outside.cast("bigint")))
    pts = pts.drop("_s", *stats)
    return voxel_table(pts, key, *[F.avg(f).alias(f) for f in feats]), pts


def predicted_instances(proposals: DataFrame, masks: DataFrame, semantic: DataFrame, class_ids: Sequence[int],
                        stuff: Sequence[int] = (), prob_threshold: float = 0.001, mask_threshold: float = -0.5,
                        min_points: int = 100, probs: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Predicted instances and their masks.

    ``proposals(scene_id, proposal_id, cls_scores, iou_score)``, ``masks(scene_id, proposal_id,
    point_idx, mask_score)``, ``semantic(scene_id, point_idx, pred)``.  Returns ``(meta, mask)``:
    ``meta(scene_id, pred_id, label_id, conf, mask_id)``, ``mask(scene_id, mask_id, point_idx)``.  The
    classes of a proposal share one mask, which is stored once; proposals without a prediction have none.  Stuff classes become one instance
    with confidence 1 and the mask of their predicted points (mask ids ``-1 - class``)."""
    on = masks.filter(F.col("mask_score") > mask_threshold).select("scene_id", F.col("proposal_id").alias("mask_id"), "point_idx")
    sizes = on.groupBy("scene_id", F.col("mask_id").alias("proposal_id")).agg(F.count(F.lit(1)).alias("n"))
    prob = F.col(probs) if probs else softmax(F.col("cls_scores"))
    things = F.array(*[F.lit(c) for c in class_ids if c not in set(stuff)])
    kept = F.filter(F.transform(prob, lambda p, i: F.struct(i.alias("c"), p.alias("p"))),
                    lambda s: (s["p"] > prob_threshold) & F.array_contains(things, s["c"]))
    thing_rows = (proposals.join(sizes.filter(F.col("n") >= min_points), ["scene_id", "proposal_id"])
                  .withColumn("_k", F.explode(kept))
                  .select("scene_id", F.col("_k.c").alias("class_id"), F.col("proposal_id").cast("bigint").alias("mask_id"),
                          (F.col("_k.p") * sigmoid(F.col("iou_score"))).alias("conf")))
    kept_masks = thing_rows.select("scene_id", "mask_id").distinct()
    on = attach(on.withColumn("mask_id", F.col("mask_id").cast("bigint")), kept_masks, ["scene_id", "mask_id"])
    mask, rows = on, thing_rows
    if stuff:
        points = semantic.filter(F.col("pred").isin(*stuff)).select("scene_id", (-F.col("pred") - 1).cast("bigint").alias("mask_id"), "point_idx")
        mask = on.unionByName(points)
        rows = thing_rows.unionByName(points.select("scene_id", "mask_id").distinct().select(
            "scene_id", (-F.col("mask_id") - 1).cast("int").alias("class_id"), "mask_id", F.lit(1.0).alias("conf")))
    block = F.shiftleft(F.col("class_id").cast("bigint"), 44) + F.shiftright(F.col("mask_id"), 16)
    numbered = ordinal(rows, ["scene_id"], ["class_id", "mask_id"], "pred_id", block, store=True)
    meta = numbered.select("scene_id", "pred_id", (F.col("class_id") + 1).cast("bigint").alias("label_id"), "conf", "mask_id")
    return meta, mask
