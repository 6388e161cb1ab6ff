"""Semantic, binary, offset and loss-shaped metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.vectors import exp_shifted, total
from pointlake.schema import IGNORE, ClassSplit

EPS = 1e-10
HARMONIC_EPS = 1e-9


def class_areas(preds: DataFrame, n_classes: int, pred: str = "pred", target: str = "gt") -> DataFrame:
    """A5: intersection, predicted, target and union area of every class.

    Points become at most ``n_classes**2`` confusion counts in the map-side aggregate; everything
    later works on those."""
    p, t = F.col(pred), F.col(target)
    confusion = (preds.filter(t != IGNORE).groupBy(p.alias("p"), t.alias("t")).agg(F.count(F.lit(1)).alias("n")))
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("p").cast("bigint").alias("class_id"), F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0).alias("i"),
                 F.col("n").alias("o"), F.lit(0).cast("bigint").alias("t")),
        F.struct(F.col("t").cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("i"),
                 F.lit(0).cast("bigint").alias("o"), F.col("n").alias("t")))).alias("s")).select("s.*")
    sums = sides.groupBy("class_id").agg(F.sum("i").alias("inter"), F.sum("o").alias("area_pred"),
                                         F.sum("t").alias("area_gt"))
    ids = preds.sparkSession.range(n_classes).withColumnRenamed("id", "class_id")
    zero = F.lit(0).cast("bigint")
    out = ids.join(sums, "class_id", "left")
    out = out.select("class_id", *[F.coalesce(c, zero).alias(c) for c in ("inter", "area_pred", "area_gt")])
    return out.withColumn("area_union", F.col("area_pred") + F.col("area_gt") - F.col("inter"))


def semantic_class_metrics(areas: DataFrame) -> DataFrame:
    """A6 per class: IoU, precision, recall and share of predictions."""
    total = areas.agg(F.sum("area_pred")).scalar()
    return areas.select(
        "class_id", (F.col("inter") / (F.col("area_union") + EPS)).alias("iou"),
        (F.col("inter") / (F.col("area_pred") + EPS)).alias("prec"),
        (F.col("inter") / (F.col("area_gt") + EPS)).alias("acc"),
        (F.col("area_pred") / (total + EPS)).alias("label_ratio"))


def semantic_summary(areas: DataFrame) -> DataFrame:
    """A6 over classes: mIoU, mPre, mAcc, allPre, allAcc."""
    return areas.agg(
        F.avg(F.col("inter") / (F.col("area_union") + EPS)).alias("miou"),
        F.avg(F.col("inter") / (F.col("area_pred") + EPS)).alias("mpre"),
        F.avg(F.col("inter") / (F.col("area_gt") + EPS)).alias("macc"),
        (F.sum("inter") / (F.sum("area_pred") + EPS)).alias("all_pre"),
        (F.sum("inter") / (F.sum("area_gt") + EPS)).alias("all_acc"))


def binary_accuracy(preds: DataFrame, split: ClassSplit, flag: str = "pred_base", target: str = "gt") -> DataFrame:
    """Per class, share of points put on the expected side (novel classes on side 0)."""
    expected = F.when(F.col(target).isin(*split.novel), 0).otherwise(1)
    hit = F.when(F.col(flag).cast("int") == expected, 1).otherwise(0)
    per = (preds.filter(F.col(target).between(0, split.n_classes - 1))
           .groupBy(F.col(target).cast("bigint").alias("class_id"))
           .agg(F.sum(hit).alias("inter"), F.count(F.lit(1)).alias("area_gt")))
    ids = preds.sparkSession.range(split.n_classes).withColumnRenamed("id", "class_id")
    per = ids.join(per, "class_id", "left").fillna(0)
    return per.withColumn("acc", F.col("inter") / (F.col("area_gt") + EPS))


def open_vocab(metric: DataFrame, split: ClassSplit, value: str, train_only: Sequence[int] = ()) -> DataFrame:
    """Base mean, novel mean, harmonic and size-weighted mean; train-only classes are left
    out of both sides."""
    drop = set(train_only)
    base = [c for c in split.base if c not in drop]
    novel = [c for c in split.novel if c not in drop]
    means = metric.agg(F.avg(F.when(F.col("class_id").isin(*base), F.col(value))).alias("base_mean"),
                       F.avg(F.when(F.col("class_id").isin(*novel), F.col(value))).alias("novel_mean"))
    return means.select(
        "base_mean", "novel_mean", harmonic(F.col("base_mean"), F.col("novel_mean")).alias("harmonic_mean"),
        ((F.col("base_mean") * len(base) + F.col("novel_mean") * len(novel)) / (len(base) + len(novel)))
        .alias("weighted_mean"))


def harmonic(b: Column, n: Column) -> Column:
    """``2bn / (b + n + 1e-9)``."""
    return b * n * 2.0 / (b + n + HARMONIC_EPS)


def point_accuracy(preds: DataFrame, pred: str = "pred", target: str = "gt") -> DataFrame:
    """A10: percent of labelled points predicted right."""
    hit = F.when(F.col(pred) == F.col(target), 1.0).otherwise(0.0)
    return preds.filter(F.col(target) != IGNORE).agg((F.avg(hit) * 100.0).alias("acc"))


def point_miou(areas: DataFrame) -> DataFrame:
    """Percent mIoU over all classes (an absent class counts as 0)."""
    return areas.agg((F.avg(F.col("inter") / (F.col("area_union") + EPS)) * 100.0).alias("miou"))


def offset_mae(points: DataFrame) -> DataFrame:
    """Absolute offset error summed over axes, per instance point."""
    err = sum((F.abs(F.col(f"pred_off_{c}") - F.col(f"off_{c}")) for c in "xyz"), F.lit(0.0))
    return points.filter(F.col("inst_label") >= 0).agg((F.sum(err) / F.count(F.lit(1))).alias("mae"))


def weighted_mean(rows: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """Meter state per group: weighted sum, weight and mean."""
    return rows.groupBy(*group).agg(
        F.sum(F.col(value) * F.col(weight)).alias("total"), F.sum(weight).alias("weight"),
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def best_epoch(rows: DataFrame, group: Sequence[str], metric: str, epoch: str) -> DataFrame:
    """Best metric and the earliest epoch reaching it."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("e")))
    return rows.groupBy(*group).agg(best.alias("_b")).select(
        *group, F.col("_b.m").alias("best_metric"), (-F.col("_b.e")).alias("best_epoch"))


def log_sum_exp(logits: Column) -> Column:
    """Stable ``log(sum(exp(x)))`` of a vector."""
    return F.array_max(logits) + F.log(total(exp_shifted(logits)))


def cross_entropy(scores: DataFrame, logits: str, target: str) -> DataFrame:
    """Mean cross-entropy over labelled rows."""
    t = F.col(target).cast("int")
    picked = F.element_at(F.col(logits), F.when(t >= 0, t + 1).otherwise(1))
    return (scores.filter(F.col(target) != IGNORE)
            .agg(F.avg(log_sum_exp(F.col(logits)) - picked).alias("loss")))


def bce_terms(logit: Column, label: Column) -> Column:
    """Stable binary cross-entropy on a logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def bce_with_logits(rows: DataFrame, logit: str, label: str) -> DataFrame:
    """Mean binary cross-entropy over labelled rows."""
    return (rows.filter(F.col(label) != IGNORE)
            .agg(F.avg(bce_terms(F.col(logit), F.col(label).cast("double"))).alias("loss")))


def cosine_loss(rows: DataFrame, cosine: Column) -> DataFrame:
    """Mean of ``1 - cos``."""
    return rows.agg(F.avg(F.lit(1.0) - cosine).alias("loss"))


def unit_distance_loss(rows: DataFrame, dot: Column) -> DataFrame:
    """Mean of ``2 - 2 a.b`` for unit vectors."""
    return rows.agg(F.avg(F.lit(2.0) - dot * 2.0).alias("loss"))


def mask_bce(rows: DataFrame, prob: str = "prob", label: str = "mask_label") -> DataFrame:
    """Weighted mask loss; rows labelled -1 have weight 0; divided by ``sum(w) + 1``.
    Logs are floored at -100."""
    p, y = F.col(prob), F.col(label)
    term = -(y * F.greatest(F.log(p), F.lit(-100.0)) + (F.lit(1.0) - y) * F.greatest(F.log(F.lit(1.0) - p), F.lit(-100.0)))
    used = y != -1
    return rows.agg((F.sum(F.when(used, term).otherwise(0.0)) / (F.sum(F.when(used, 1.0).otherwise(0.0)) + 1.0)).alias("loss"))


def iou_score_mse(rows: DataFrame, score: str, iou: str, weight: str) -> DataFrame:
    """Weighted squared error of the IoU score, divided by ``sum(w) + 1``."""
    err = (F.col(score) - F.col(iou)) * (F.col(score) - F.col(iou)) * F.col(weight)
    return rows.agg((F.sum(err) / (F.sum(weight) + 1.0)).alias("loss"))
