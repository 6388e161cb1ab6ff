"""Instance average precision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.blocks import running_sum
from pointlake.operators.components import contract_pieces, star_components
from pointlake.operators.metrics import harmonic
from pointlake.schema import ClassSplit
from pointlake.session import cut_lineage

# fixed values: nine thresholds from 0.50 to 0.90, then 0.25
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.25)
CODE_BASE = 1000
SCORE_BLOCKS = 4096
_CURVE = ["class_id", "thr"]


def _per_threshold(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    return rows.withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def _visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ``(scene_id, class_id, thr, label, code, pred_id, conf)`` sorted by cluster, code and prediction: the first free
    prediction of an instance claims it, later free ones are duplicates and stay free.  A task holds the claimed
    predictions of one cluster and the free ones of one instance, whatever the number of clusters."""
    cluster = place = None
    taken: set[int] = set()
    confs: list[float] = []
    out: list[tuple] = []

    def close() -> None:
        if confs:
            best = max(confs)
            hit = confs.index(best)
            out.extend((*cluster[:3], place, c, int(i == hit)) for i, c in enumerate(confs))
            confs.clear()

    def ready() -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["scene_id", "class_id", "thr", "code", "score", "tp"])
        out.clear()
        return rows

    for batch in batches:
        for *key, code, pred, conf in zip(*(batch[c].tolist() for c in ("scene_id", "class_id", "thr", "label", "code", "pred_id", "conf")), strict=True):
            if key != cluster:
                close()
                cluster, place = key, code
                taken.clear()
            elif code != place:
                close()
                place = code
            if pred not in taken or (confs and pred == first):
                if not confs:
                    first = pred
                    taken.add(pred)
                confs.append(conf)
        yield ready()
    close()
    yield ready()


def match_events(preds: DataFrame, gts: DataFrame, pairs: DataFrame, min_points: int,
                 thresholds: Sequence[float] = THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """A14 steps 5 and 6: ``events(class_id, thr, score, tp)`` and ``missed(class_id, thr, missed)``.

    Instances of one scene are disjoint, so above IoU 0.5 a prediction meets one instance only: the
    best confidence is the hit and the others are duplicates.  The same holds below 0.5 for
    instances none of whose predictions meet another instance.  Only instances that compete for
    a prediction need the ordered visit; it runs per cluster of competing instances."""
    counts = (F.col("code") >= CODE_BASE) & (F.col("n_gt") >= min_points)
    over = _per_threshold(pairs, thresholds).filter(F.col("iou") > F.col("thr"))
    cand = over.filter(counts).select("scene_id", "class_id", "thr", "code", "pred_id", "conf")
    key = ["scene_id", "class_id", "thr"]

    plain_thr = cand.filter("thr >= 0.5")
    low = cand.filter("thr < 0.5")
    shared = low.groupBy(*key, "pred_id").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m")
    rivals = low.join(shared, [*key, "pred_id"], "left_semi").select(*key, "code").distinct()
    contested = low.join(rivals, [*key, "code"], "left_semi")
    plain = plain_thr.unionByName(low.join(rivals, [*key, "code"], "left_anti"))

    top = plain.groupBy(*key, "code").agg(F.max("conf").alias("score"), F.count(F.lit(1)).alias("n"))
    # every confidence except one copy of the best is a duplicate
    conf_counts = plain.groupBy(*key, "code", "conf").agg(F.count(F.lit(1)).alias("k"))
    dup = conf_counts.join(top, [*key, "code"]).select(
        "class_id", "thr", F.col("conf").alias("score"), F.lit(0).alias("tp"),
        (F.col("k") - F.when(F.col("conf") == F.col("score"), 1).otherwise(0)).alias("n")).filter("n > 0")
    ids = {f.name: f.dataType.simpleString() for f in cand.schema.fields}
    schema = f"scene_id {ids['scene_id']}, class_id {ids['class_id']}, thr double, code {ids['code']}, score double, tp int"
    if contested.isEmpty():
        visited = contested.sparkSession.createDataFrame([], schema)
    else:
        # instances linked by shared predictions form small clusters, each visited on its own
        contested = cut_lineage(contested)
        links = contested.select(*key, (F.col("code") * 2).alias("a"), (F.col("pred_id") * 2 + 1).alias("b"), F.xxhash64(*key).alias("piece"))
        clusters = star_components(contract_pieces(links, key), key).filter(F.col("node") % 2 == 0)
        named = contested.join(clusters.select(*key, F.shiftright("node", 1).alias("code"), "label"), [*key, "code"])
        dealt = named.select(*key, "label", "code", "pred_id", "conf").repartition(*key, "label").sortWithinPartitions(*key, "label", "code", "pred_id")
        visited = cut_lineage(dealt.mapInPandas(_visit, schema))

    claimed = top.select(*key, "code", "score").unionByName(visited.filter("tp = 1").select(*key, "code", "score"))
    one = F.lit(1).cast("bigint").alias("n")
    hits = claimed.select("class_id", "thr", "score", F.lit(1).alias("tp"), one)
    dups = dup.unionByName(visited.filter("tp = 0").select("class_id", "thr", "score", "tp", one))

    met = over.select("scene_id", "pred_id", "thr").distinct()
    small = pairs.withColumn("_ig", F.when(F.col("code") < CODE_BASE, F.col("inter")).otherwise(0)
                             + F.when(F.col("n_gt") < min_points, F.col("inter")).otherwise(0))
    ignored = small.groupBy("scene_id", "pred_id").agg(F.sum("_ig").alias("_ig"))
    alone = _per_threshold(preds.join(ignored, ["scene_id", "pred_id"], "left"), thresholds)
    alone = alone.join(met, ["scene_id", "pred_id", "thr"], "left_anti")
    share = (F.col("void") + F.coalesce("_ig", F.lit(0))) / F.col("n_pred")
    false_pos = alone.filter(share <= F.col("thr")).select("class_id", "thr", F.col("conf").alias("score"), F.lit(0).alias("tp"), one)

    counted = gts.filter(counts).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_gt"))
    found = claimed.groupBy(*_CURVE).agg(F.count(F.lit(1)).alias("found"))
    missed = (_per_threshold(counted, thresholds).join(found, _CURVE, "left")
              .select(*_CURVE, (F.col("n_gt") - F.coalesce("found", F.lit(0))).alias("missed")))
    return hits.unionByName(dups).unionByName(false_pos), missed


def precision_recall(events: DataFrame, missed: DataFrame) -> DataFrame:
    """One point per distinct score: precision and recall of keeping scores at or above it,
    and those of the next point (the last one is the artificial point (1, 0)).

    Events are first counted per score; running sums go through score blocks, so a class with any
    number of predictions is spread over tasks."""
    steps = events.groupBy(*_CURVE, "score").agg(F.sum(F.when(F.col("tp") == 1, F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("n"))
    steps = cut_lineage(steps)
    totals = steps.groupBy(*_CURVE).agg(F.sum("hit").alias("all_hit"), F.sum("n").alias("all_n"))
    block = F.floor(F.greatest(F.least(F.col("score"), F.lit(1.0)), F.lit(0.0)) * SCORE_BLOCKS)
    cum = running_sum(steps, _CURVE, ["score"], block, before_hit=F.col("hit"), before_n=F.col("n"))
    cum = cum.join(totals, _CURVE).join(missed, _CURVE)

    def point(hit: Column, n: Column) -> tuple[Column, Column]:
        tp = F.col("all_hit") - hit
        return tp / (F.col("all_n") - n), tp / (F.col("all_hit") + F.col("missed"))

    p, r = point(F.col("before_hit"), F.col("before_n"))
    after_n = F.col("before_n") + F.col("n")
    last = after_n >= F.col("all_n")
    left = F.when(last, F.lit(1)).otherwise(F.col("all_n") - after_n)
    tp2 = F.col("all_hit") - F.col("before_hit") - F.col("hit")
    return cum.select(*_CURVE, "score", p.alias("precision"), r.alias("recall"),
                      F.when(last, 1.0).otherwise(tp2 / left).alias("next_precision"),
                      F.when(last, 0.0).otherwise(tp2 / (F.col("all_hit") + F.col("missed"))).alias("next_recall"))


def average_precision(preds: DataFrame, gts: DataFrame, pairs: DataFrame, class_ids: Sequence[int], min_points: int,
                      thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """``(class_id, thr, ap, rc)`` for every evaluated class; NaN without ground truth, 0
    without predictions.

    With weights ``(r[k-1] - r[k+1]) / 2`` the sum over points equals the trapezoid sum over
    neighbouring points, which each row can compute from itself."""
    events, missed = match_events(preds, gts, pairs, min_points, thresholds)
    missed = cut_lineage(missed)
    curve = precision_recall(events, missed)
    area = (F.col("recall") - F.col("next_recall")) * (F.col("precision") + F.col("next_precision")) / 2.0
    ap = curve.groupBy(*_CURVE).agg(F.sum(area).alias("ap"), F.max("recall").alias("rc"))
    grid = preds.sparkSession.range(len(class_ids)).select(
        F.element_at(F.array(*[F.lit(c) for c in class_ids]), (F.col("id") + 1).cast("int")).cast("bigint").alias("class_id"))
    grid = _per_threshold(grid, thresholds)
    out = grid.join(missed.select(*_CURVE, F.lit(True).alias("has_gt")), _CURVE, "left").join(ap, _CURVE, "left")
    nan = F.lit(float("nan"))
    return out.select(*_CURVE, *[F.when(F.col("has_gt"), F.coalesce(c, F.lit(0.0))).otherwise(nan).alias(c) for c in ("ap", "rc")])


def class_averages(aps: DataFrame) -> DataFrame:
    """A15 per class: plain means (NaN stays) over thresholds but 0.25, at 0.5 and at 0.25."""
    def mean(col, cond):
        return F.avg(F.when(cond, F.col(col)))
    t = F.col("thr")
    aggs = []
    for col in ("ap", "rc"):
        aggs += [mean(col, t != 0.25).alias(col), mean(col, t == 0.5).alias(f"{col}50"), mean(col, t == 0.25).alias(f"{col}25")]
    return aps.groupBy("class_id").agg(*aggs)


def overall_averages(aps: DataFrame) -> DataFrame:
    """A15 over classes: NaN rows are left out."""
    t = F.col("thr")
    aggs = []
    for col in ("ap", "rc"):
        ok = ~F.isnan(F.col(col))
        aggs += [F.avg(F.when(ok & cond, F.col(col))).alias(f"all_{col}{n}")
                 for n, cond in (("", t != 0.25), ("50", t == 0.5), ("25", t == 0.25))]
    return aps.agg(*aggs)


def open_vocab_ap(class_avgs: DataFrame, split: ClassSplit, shift: int = 1) -> DataFrame:
    """Base and novel means (NaN left out) of ap, ap50, ap25 and the harmonic AP50; class ids
    are counted from ``shift``."""
    cls = F.col("class_id") - shift
    aggs = [F.avg(F.when(cls.isin(*ids) & ~F.isnan(F.col(c)), F.col(c))).alias(f"{c}_{n}")
            for c in ("ap", "ap50", "ap25") for n, ids in (("base", split.base), ("novel", split.novel))]
    out = class_avgs.agg(*aggs)
    return out.withColumn("hap50", harmonic(F.col("ap50_base"), F.col("ap50_novel")))
