"""Overlaps between point sets and the choices built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.blocks import attach
from pointlake.operators.labels import code_class
from pointlake.session import cut_lineage

IOU_EPS = 1e-5
POINT = ["scene_id", "point_idx"]


def overlap_counts(members: DataFrame, labels: DataFrame, part: str, label: str) -> DataFrame:
    """Points shared by each ``(part, label)`` pair: one join on the point key, then a count that is
    combined map-side."""
    hit = members.select(*POINT, part).join(labels.select(*POINT, label), POINT)
    return hit.groupBy("scene_id", part, label).agg(F.count(F.lit(1)).alias("inter"))


def proposal_iou(members: DataFrame, points: DataFrame, on: Column | None = None) -> DataFrame:
    """IoU of proposals with ground-truth instances, ``inter / (a + b - inter + 1e-5)``.

    J10: ``on`` keeps only member points whose mask passes; the proposal size counts them too."""
    used = members if on is None else members.filter(on)
    gt = points.filter("inst_label >= 0").select(*POINT, "inst_label")
    inter = overlap_counts(used, gt, "proposal_id", "inst_label")
    n_prop = used.groupBy("scene_id", "proposal_id").agg(F.count(F.lit(1)).alias("n_prop"))
    n_gt = gt.groupBy("scene_id", "inst_label").agg(F.count(F.lit(1)).alias("n_gt"))
    out = inter.join(n_prop, ["scene_id", "proposal_id"]).join(n_gt, ["scene_id", "inst_label"])
    return out.withColumn("iou", F.col("inter") / (F.col("n_prop") + F.col("n_gt") - F.col("inter") + IOU_EPS))


def best_gt(ious: DataFrame, inst_class: DataFrame | None = None) -> DataFrame:
    """Instance with the highest IoU per proposal; the lowest id wins ties; instances of
    ignored classes are skipped."""
    if inst_class is not None:
        fg = inst_class.filter(F.col("inst_class") >= 0).select("scene_id", "inst_label")
        ious = ious.join(fg, ["scene_id", "inst_label"], "left_semi")
    top = F.max(F.struct(F.col("iou").alias("iou"), (-F.col("inst_label")).alias("neg")))
    return (ious.groupBy("scene_id", "proposal_id").agg(top.alias("_t"))
            .select("scene_id", "proposal_id", (-F.col("_t.neg")).alias("best_inst"), F.col("_t.iou").alias("best_iou")))


def mask_targets(members: DataFrame, points: DataFrame, best: DataFrame, threshold: float) -> DataFrame:
    """1/0 for members in / outside the matched instance, -1 when the match is too weak."""
    named = attach(members.select("scene_id", "proposal_id", "point_idx"), best, ["scene_id", "proposal_id"], how="left")
    named = named.join(points.select(*POINT, "inst_label"), POINT)
    inside = F.when(F.col("inst_label") == F.col("best_inst"), 1).otherwise(0)
    return named.withColumn("mask_label", F.when(F.col("best_iou") >= threshold, inside).otherwise(-1)).drop("best_inst", "best_iou")


def assign_proposals(ious: DataFrame, pos_threshold: float, rescue_threshold: float | None = None) -> DataFrame:
    """T4: proposal -> instance when its best IoU reaches the threshold.  With a rescue threshold
    the best proposal of each instance is assigned too; when instances share a proposal the one
    with the higher id keeps it."""
    best = best_gt(ious)
    out = best.filter(F.col("best_iou") >= pos_threshold).select("scene_id", "proposal_id", F.col("best_inst").alias("assigned"))
    if rescue_threshold is None:
        return out
    top = F.max(F.struct(F.col("iou").alias("iou"), (-F.col("proposal_id")).alias("neg")))
    rescued = (ious.groupBy("scene_id", "inst_label").agg(top.alias("_t")).filter(F.col("_t.iou") >= rescue_threshold)
               .groupBy("scene_id", (-F.col("_t.neg")).alias("proposal_id")).agg(F.max("inst_label").alias("rescued")))
    return (out.join(rescued, ["scene_id", "proposal_id"], "full")
            .select("scene_id", "proposal_id", F.coalesce("rescued", "assigned").alias("assigned")))


def mask_key(mask: DataFrame) -> str:
    """Column that names the masks: ``mask_id`` where predictions share masks, else ``pred_id``."""
    return "mask_id" if "mask_id" in mask.columns else "pred_id"


def evaluation_pairs(mask: DataFrame, meta: DataFrame, codes: DataFrame, valid_ids: Sequence[int],
                     min_points: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlaps of predicted instances with ground truth of the same class.

    ``mask(scene_id, pred_id, point_idx)``, ``meta(scene_id, pred_id, label_id, conf)``,
    ``codes(scene_id, point_idx, code)``.  Predictions may share masks: ``mask(scene_id, mask_id, point_idx)`` and
    ``meta`` with ``mask_id``.  Points are then counted once per mask, and the predictions of a mask are
    attached to its counts, so no point is copied per class.  The results are instance tables, written to the
    checkpoint folder because the AP reads them many times and the points should be read once:
    predictions with size and void count, ground truth with size, and pairs with IoU."""
    part = mask_key(mask)
    shared = cut_lineage(overlap_counts(mask, codes, part, "code"))
    void = ~code_class(F.col("code")).isin(*valid_ids)
    stats = shared.groupBy("scene_id", part).agg(
        F.sum("inter").alias("n_pred"), F.sum(F.when(void, F.col("inter")).otherwise(0)).alias("void"))
    preds = (meta.filter(F.col("label_id").isin(*valid_ids)).join(stats, ["scene_id", part])
             .filter(F.col("n_pred") >= min_points).select("scene_id", *dict.fromkeys(["pred_id", part]), F.col("label_id").alias("class_id"), "conf", "n_pred", "void"))
    preds = cut_lineage(preds)
    gts = (codes.filter(F.col("code") != 0).groupBy("scene_id", "code").agg(F.count(F.lit(1)).alias("n_gt"))
           .withColumn("class_id", code_class(F.col("code"))).filter(F.col("class_id").isin(*valid_ids)))
    gts = cut_lineage(gts)
    pairs = (shared.filter(F.col("code") != 0).join(preds, ["scene_id", part])
             .filter(F.col("class_id") == code_class(F.col("code"))).join(gts.drop("class_id"), ["scene_id", "code"]))
    pairs = pairs.withColumn("iou", F.col("inter") / (F.col("n_gt") + F.col("n_pred") - F.col("inter")))
    return preds, gts, cut_lineage(pairs)


def paint_instances(mask: DataFrame, meta: DataFrame) -> DataFrame:
    """Each point gets its most confident instance (lowest id on ties).  Of the predictions that share a
    mask only the best can be seen, so a mask meets its points once."""
    part = mask_key(mask)
    top = F.max(F.struct("conf", (-F.col("pred_id")).alias("neg"))).alias("_t")
    named = attach(mask.select("scene_id", part, "point_idx"), meta.groupBy("scene_id", part).agg(top), ["scene_id", part])
    return named.groupBy(*POINT).agg(F.max("_t").alias("_t")).select(*POINT, (-F.col("_t.neg")).alias("pred_id"), F.col("_t.conf").alias("conf"))
