"""Checked queries: semantic and open-vocabulary metrics."""

from pyspark.sql import functions as F

from pointlake.functions import vectors as V
from pointlake.operators import instances, metrics as M
from pointlake.plans.fixtures import N_CLASSES, SPLIT
from pointlake.plans.registry import query

BASE, NOVEL = SPLIT.base, SPLIT.novel
AREAS = """SELECT c.class_id, coalesce(i, 0) AS inter, coalesce(o, 0) AS area_pred, coalesce(g, 0) AS area_gt,
 coalesce(o, 0) + coalesce(g, 0) - coalesce(i, 0) AS area_union FROM ids c
 LEFT JOIN (SELECT gt AS class_id, count(*) AS g, sum(CASE WHEN pred = gt THEN 1 ELSE 0 END) AS i FROM preds WHERE gt <> -100 GROUP BY gt) a ON a.class_id = c.class_id
 LEFT JOIN (SELECT pred AS class_id, count(*) AS o FROM preds WHERE gt <> -100 GROUP BY pred) b ON b.class_id = c.class_id"""
USES = ("preds", "ids")
IOU = f"SELECT class_id, inter/(area_union + 1e-10) AS iou, inter/(area_pred + 1e-10) AS prec, inter/(area_gt + 1e-10) AS acc FROM ({AREAS}) ar"


def ov_sql(inner, col, base=BASE, novel=NOVEL):
    return (f"SELECT bm AS base_mean, nm AS novel_mean, 2*bm*nm/(bm+nm+1e-9) AS harmonic_mean, (bm*{len(base)} + nm*{len(novel)})/{len(base) + len(novel)} AS weighted_mean FROM "
            f"(SELECT avg({col}) FILTER (WHERE class_id IN {tuple(base)}) AS bm, avg({col}) FILTER (WHERE class_id IN {tuple(novel)}) AS nm FROM ({inner}) s) m")


OV_COLS = "base_mean double, novel_mean double, harmonic_mean double, weighted_mean double"


def areas(t):
    return M.class_areas(t.preds, N_CLASSES)


@query("a5_class_areas", "class_id bigint, inter bigint, area_pred bigint, area_gt bigint, area_union bigint", AREAS, USES)
def _(t):
    return areas(t)


@query("a6_class_metrics", "class_id bigint, iou double, prec double, acc double, label_ratio double",
       f"SELECT class_id, inter/(area_union + 1e-10) AS iou, inter/(area_pred + 1e-10) AS prec, inter/(area_gt + 1e-10) AS acc, area_pred/(sum(area_pred) OVER () + 1e-10) AS label_ratio FROM ({AREAS}) ar",
       USES)
def _(t):
    return M.semantic_class_metrics(areas(t))


@query("a6_summary", "miou double, mpre double, macc double, all_pre double, all_acc double",
       f"SELECT avg(inter/(area_union + 1e-10)) AS miou, avg(inter/(area_pred + 1e-10)) AS mpre, avg(inter/(area_gt + 1e-10)) AS macc, sum(inter)/(sum(area_pred) + 1e-10) AS all_pre, sum(inter)/(sum(area_gt) + 1e-10) AS all_acc FROM ({AREAS}) ar",
       USES)
def _(t):
    return M.semantic_summary(areas(t))


@query("a7_binary_accuracy", "class_id bigint, inter bigint, area_gt bigint, acc double",
       f"""SELECT c.class_id, coalesce(i, 0) AS inter, coalesce(g, 0) AS area_gt, coalesce(i, 0)/(coalesce(g, 0) + 1e-10) AS acc FROM ids c LEFT JOIN
       (SELECT gt AS class_id, count(*) AS g, sum(CASE WHEN (pred NOT IN {NOVEL}) = (gt NOT IN {NOVEL}) THEN 1 ELSE 0 END) AS i FROM preds WHERE gt >= 0 GROUP BY gt) a ON a.class_id = c.class_id""",
       USES)
def _(t):
    return M.binary_accuracy(t.preds.withColumn("pred_base", ~F.col("pred").isin(*NOVEL)), SPLIT)


@query("a7_label_detector", "quality bigint, n bigint, acc double",
       "SELECT quality, count(*) AS n, avg(CASE WHEN (toxic = 0) = (quality = 1) THEN 1e0 ELSE 0e0 END) AS acc FROM labels GROUP BY quality")
def _(t):
    hit = F.when((F.col("toxic") == 0) == (F.col("quality") == 1), 1.0).otherwise(0.0)
    return t.base("labels").groupBy("quality").agg(F.count("*").alias("n"), F.avg(hit).alias("acc"))


@query("a8_open_vocab_iou", OV_COLS, ov_sql(IOU, "iou"), USES)
def open_vocab_iou(t):
    return M.open_vocab(M.semantic_class_metrics(areas(t)), SPLIT, "iou")


@query("a8_open_vocab_acc", OV_COLS, ov_sql(IOU, "acc"), USES)
def _(t):
    return M.open_vocab(M.semantic_class_metrics(areas(t)), SPLIT, "acc")


@query("a9_without_train_only", OV_COLS, ov_sql(IOU, "iou", [c for c in BASE if c not in (3, 18)], [c for c in NOVEL if c != 9]), USES)
def _(t):
    return M.open_vocab(M.semantic_class_metrics(areas(t)), SPLIT, "iou", train_only=(3, 18, 9))


@query("a10_point_accuracy", "acc double", "SELECT avg(CASE WHEN pred = gt THEN 1e0 ELSE 0e0 END)*100 AS acc FROM preds WHERE gt <> -100", USES)
def _(t):
    return M.point_accuracy(t.preds)


@query("a11_point_miou", "miou double", f"SELECT avg(inter/(area_union + 1e-10))*100 AS miou FROM ({AREAS}) ar", USES)
def _(t):
    return M.point_miou(areas(t))


OFF = "SELECT scene_id, inst_label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n FROM pm WHERE inst_label >= 0 GROUP BY scene_id, inst_label"


@query("a12_offset_mae", "mae double",
       f"SELECT sum(abs(p.r/1e3 - (mx - x)) + abs(p.g/1e3 - (my - y)) + abs(p.b/1e3 - (mz - z)))/count(*) AS mae FROM pm p JOIN ({OFF}) o ON o.scene_id = p.scene_id AND o.inst_label = p.inst_label",
       ("pm",))
def _(t):
    pts = instances.centre_offsets(t.points_m)
    for c, k in zip("xyz", "rgb"):
        pts = pts.withColumn(f"pred_off_{c}", F.col(k) / 1000.0)
    return M.offset_mae(pts)


@query("a13_weighted_mean", "event_type string, total double, weight double, mean double",
       "SELECT event_type, sum(value*(event_id % 7 + 1)) AS total, sum(event_id % 7 + 1) AS weight, sum(value*(event_id % 7 + 1))/sum(event_id % 7 + 1) AS mean FROM events GROUP BY event_type")
def _(t):
    return M.weighted_mean(t.base("events").withColumn("w", F.col("event_id") % 7 + 1), ["event_type"], "value", "w")


@query("a22_best_epoch", "user_id bigint, best_metric double, best_epoch bigint",
       "SELECT user_id, value AS best_metric, event_id AS best_epoch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) e WHERE k = 1")
def _(t):
    return M.best_epoch(t.base("events"), ["user_id"], "value", "event_id")


@query("a17_cross_entropy", "loss double",
       "SELECT avg(lse - l) AS loss FROM (SELECT scene_id, point_idx, ln(sum(exp(logit))) AS lse, sum(CASE WHEN class_id = gt THEN logit ELSE 0e0 END) AS l FROM logits WHERE gt <> -100 GROUP BY scene_id, point_idx) s",
       ("logits",))
def _(t):
    return M.cross_entropy(t.logits, "logits", "gt")


SCORE = "((point_idx*37 + scene_id*11) % 41 - 20)/8e0"


@query("a17_binary_cross_entropy", "loss double",
       f"SELECT avg(greatest(s, 0e0) - s*y + ln(1 + exp(-abs(s)))) AS loss FROM (SELECT {SCORE} AS s, CASE WHEN gt IN {NOVEL} THEN 0 ELSE 1 END AS y FROM preds WHERE gt <> -100) q",
       USES)
def _(t):
    lab = F.when(F.col("gt") == -100, -100).when(F.col("gt").isin(*NOVEL), 0).otherwise(1)
    return M.bce_with_logits(t.preds.selectExpr("*", f"{SCORE} AS s").withColumn("y", lab), "s", "y")


CENTROID = "SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) u GROUP BY label, i) g GROUP BY label"


def with_centroid(t):
    emb = t.base("embeddings")
    means = V.mean_vector(emb, ["label"], "embedding", 64, "centroid")
    return emb.join(means.select("label", V.l2_normalise(F.col("centroid")).alias("centroid")), "label")


UNIT = f"SELECT e.*, list_inner_product(CAST(embedding AS DOUBLE[]), centroid)/sqrt(list_inner_product(centroid, centroid)) AS d, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings e JOIN ({CENTROID}) c ON c.label = e.label"


@query("a17_cosine_losses", "cosine_loss double, distance_loss double",
       f"SELECT avg(1 - d/n) AS cosine_loss, avg(2 - 2*d) AS distance_loss FROM ({UNIT}) u")
def _(t):
    pairs = with_centroid(t)
    c = M.cosine_loss(pairs, V.cosine(F.col("embedding"), F.col("centroid"))).withColumnRenamed("loss", "cosine_loss")
    d = M.unit_distance_loss(pairs, V.dot(F.col("embedding"), F.col("centroid"))).withColumnRenamed("loss", "distance_loss")
    return c.join(F.broadcast(d))  # one row each


@query("a17_mask_losses", "mask_loss double, score_loss double",
       f"""SELECT sum(CASE WHEN y = -1 THEN 0e0 WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END)/(sum(CASE WHEN y = -1 THEN 0 ELSE 1 END) + 1) AS mask_loss,
       sum(CASE WHEN y = -1 THEN 0e0 ELSE (p - r/255e0)*(p - r/255e0) END)/(sum(CASE WHEN y = -1 THEN 0 ELSE 1 END) + 1) AS score_loss
       FROM (SELECT 1/(1 + exp(-({SCORE}))) AS p, r, CASE WHEN sem_label < 0 THEN -1 WHEN inst_label % 2 = 0 THEN 1 ELSE 0 END AS y FROM points) q""", ("points",))
def _(t):
    rows = t.points.selectExpr("r/255e0 AS iou", f"1/(1 + exp(-({SCORE}))) AS prob",
                               "CASE WHEN sem_label < 0 THEN -1 WHEN inst_label % 2 = 0 THEN 1 ELSE 0 END AS mask_label")
    rows = rows.withColumn("w", F.when(F.col("mask_label") == -1, 0.0).otherwise(1.0))
    a = M.mask_bce(rows).withColumnRenamed("loss", "mask_loss")
    b = M.iou_score_mse(rows, "prob", "iou", "w").withColumnRenamed("loss", "score_loss")
    return a.join(F.broadcast(b))  # one row each
