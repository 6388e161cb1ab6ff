"""Checked queries: label maps, filters and class scores."""

from pyspark.sql import functions as F

from pointlake.operators import labels as L
from pointlake.plans.fixtures import N_CLASSES, SPLIT
from pointlake.plans.registry import query

BASE, NOVEL, VALID = SPLIT.base, SPLIT.novel, SPLIT.valid


def cases(col, table, default):
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def position(col, ids):
    return cases(col, {c: i for i, c in enumerate(ids)}, -100)


FLAG = cases("sem_label", {c: 1 for c in BASE} | {c: 0 for c in (*NOVEL, *SPLIT.ignored)}, -100)
CODE = "CASE WHEN inst_label + 1 < 0 THEN 0 ELSE greatest(sem_label + 1, 0)*1000 + inst_label + 1 END"


@query("p1_class_mapper", "scene_id bigint, point_idx bigint, squeezed bigint, kept bigint",
       f"SELECT scene_id, point_idx, {position('sem_label', BASE)} AS squeezed, {cases('sem_label', {c: c for c in BASE}, -100)} AS kept FROM points",
       ("points",))
def _(t):
    s = F.col("sem_label")
    return t.points.select("scene_id", "point_idx", L.map_classes(s, BASE).alias("squeezed"), L.map_classes(s, BASE, False).alias("kept"))


@query("p2_base_flag", "scene_id bigint, point_idx bigint, flag bigint",
       f"SELECT scene_id, point_idx, {FLAG} AS flag FROM points", ("points",))
def _(t):
    return t.points.select("scene_id", "point_idx", L.map_base_flag(F.col("sem_label"), SPLIT).alias("flag"))


@query("p3_label_modes", "scene_id bigint, point_idx bigint, base_label bigint, all_label bigint",
       f"SELECT scene_id, point_idx, {position('sem_label', BASE)} AS base_label, {position('sem_label', VALID)} AS all_label FROM points",
       ("points",))
def _(t):
    both = L.apply_label_mode(t.points, SPLIT, "base").withColumnRenamed("label", "base_label")
    return both.withColumn("all_label", L.map_classes(F.col("sem_label"), VALID))


@query("p4_propagate_ignore", "scene_id bigint, point_idx bigint, inst_label bigint",
       f"SELECT scene_id, point_idx, CASE WHEN {position('sem_label', VALID)} = -100 THEN -100 ELSE inst_label END AS inst_label FROM points",
       ("points",))
def _(t):
    return L.apply_label_mode(t.points, SPLIT, "all")


@query("p5_hide_novel_instances", "scene_id bigint, point_idx bigint, inst_label bigint",
       f"SELECT scene_id, point_idx, CASE WHEN {FLAG} = 0 THEN -100 ELSE inst_label END AS inst_label FROM points", ("points",))
def _(t):
    return L.hide_novel_instances(t.points.withColumn("is_base", L.map_base_flag(F.col("sem_label"), SPLIT)))


@query("p6_densify_instances", "scene_id bigint, point_idx bigint, inst_label bigint",
       f"""SELECT p.scene_id, p.point_idx, coalesce(d.k, -100) AS inst_label FROM points p LEFT JOIN (
       SELECT scene_id, inst_label, row_number() OVER (PARTITION BY scene_id ORDER BY inst_label) - 1 AS k FROM
       (SELECT DISTINCT scene_id, inst_label FROM points WHERE inst_label >= 0 AND {FLAG} = 1 AND x_mm >= 1000) u) d
       ON d.scene_id = p.scene_id AND d.inst_label = p.inst_label AND {FLAG} = 1 AND p.x_mm >= 1000""", ("points",))
def _(t):
    pts = t.points.withColumn("flag", L.map_base_flag(F.col("sem_label"), SPLIT))
    return L.densify_instances(pts, (F.col("flag") == 1) & (F.col("x_mm") >= 1000))


@query("p7_drop_empty_scenes", "scene_id bigint, n bigint",
       f"""SELECT scene_id, count(*) AS n FROM points WHERE scene_id IN
       (SELECT scene_id FROM points GROUP BY scene_id HAVING max(CASE WHEN {FLAG} = 0 THEN inst_label ELSE -100 END) >= 0) GROUP BY scene_id""",
       ("points",))
def _(t):
    flag = L.map_base_flag(F.col("sem_label"), SPLIT)
    only_novel = t.points.withColumn("inst_label", F.when(flag == 0, F.col("inst_label")).otherwise(-100))
    return L.drop_scenes_without_instances(only_novel).groupBy("scene_id").agg(F.count("*").alias("n"))


@query("p8_shift_class", "scene_id bigint, point_idx bigint, cls bigint",
       "SELECT scene_id, point_idx, CASE WHEN sem_label = -100 THEN -100 ELSE sem_label - 2 END AS cls FROM points", ("points",))
def _(t):
    return t.points.withColumn("cls", L.shift_class(F.col("sem_label"), 2))


@query("p9_encode_gt", "scene_id bigint, point_idx bigint, code bigint, shifted bigint",
       f"SELECT scene_id, point_idx, {CODE} AS code, CASE WHEN inst_label + 1 < 0 THEN 0 ELSE greatest(sem_label - 1, 0)*1000 + inst_label + 1 END AS shifted FROM points",
       ("points",))
def _(t):
    s, i = F.col("sem_label"), F.col("inst_label")
    return t.points.select("scene_id", "point_idx", L.encode_gt(s, i).alias("code"), L.encode_gt(s, i, 2).alias("shifted"))


@query("p10_decode_gt", "scene_id bigint, point_idx bigint, cls bigint, void boolean",
       "SELECT scene_id, point_idx, code // 1000 AS cls, code // 1000 NOT BETWEEN 1 AND 19 AS void FROM gt_codes", ("gt_codes",))
def _(t):
    c = F.col("code")
    return t.gt_codes.select("scene_id", "point_idx", L.code_class(c).alias("cls"), L.is_void(c, range(1, 20)).alias("void"))


@query("p14_range_filter", "scene_id bigint, point_idx bigint",
       "SELECT scene_id, point_idx FROM pm WHERE x BETWEEN 1e0 AND 205e-2 AND y BETWEEN 5e-2 AND 11e-1", ("pm",))
def _(t):
    return L.within_xy(t.points_m, (1.0, 0.05, -9.0, 2.05, 1.1, -8.0))


@query("p15_clip_points", "scene_id bigint, point_idx bigint, x double, y double, z double",
       "SELECT scene_id, point_idx, greatest(least(x, 205e-2), 1e0) AS x, greatest(least(y, 11e-1), 5e-2) AS y, greatest(least(z, 1e-1), 2e-2) AS z FROM pm",
       ("pm",))
def _(t):
    return L.clip_to_box(t.points_m, (1.0, 0.05, 0.02, 2.05, 1.1, 0.1))


@query("p16_filter_by_name", "event_type string, n bigint, kept bigint",
       "SELECT event_type, count(*) AS n, sum(CASE WHEN event_type IN ('view','error') THEN 1 ELSE 0 END) AS kept FROM events WHERE event_type <> 'click' GROUP BY event_type")
def _(t):
    rows = L.drop_named(t.base("events"), "click", "event_type")
    kept = L.keep_named(rows, ("view", "error"), "event_type").groupBy("event_type").agg(F.count("*").alias("kept"))
    return (rows.groupBy("event_type").agg(F.count("*").alias("n")).join(kept, "event_type", "left").fillna(0))


@query("p17_keep_points", "scene_id bigint, point_idx bigint, sem_label bigint, r bigint",
       "SELECT scene_id, point_idx, sem_label, r FROM points p WHERE EXISTS (SELECT 1 FROM corr c WHERE c.scene_id = p.scene_id AND c.point_idx = p.point_idx)",
       ("points", "corr"))
def _(t):
    return L.keep_points(t.points, t.corr)


@query("p18_mask_invalid", "scene_id bigint, point_idx bigint, pred_valid bigint, pred_base bigint",
       f"""SELECT scene_id, point_idx, arg_max(class_id, logit*100 - class_id/1e3) FILTER (WHERE class_id IN {VALID}) AS pred_valid,
       arg_max({position('class_id', BASE)}, logit*100 - class_id/1e3) FILTER (WHERE class_id IN {BASE}) AS pred_base FROM logits GROUP BY scene_id, point_idx""",
       ("logits",))
def _(t):
    from pointlake.functions.vectors import argmax
    lg = F.col("logits")
    return t.logits.select("scene_id", "point_idx", argmax(L.mask_invalid_scores(lg, VALID)).alias("pred_valid"),
                           argmax(L.select_scores(lg, BASE)).alias("pred_base"))


REMAP = {0: (0, 3, 7), 1: (1, 2), 2: (19,), 3: (4, 5, 6, 8, 9)}


@query("p19_remap_categories", "scene_id bigint, point_idx bigint, target bigint, score double",
       f"SELECT scene_id, point_idx, target, max(logit) AS score FROM (SELECT *, {cases('class_id', {s: k for k, v in REMAP.items() for s in v}, -1)} AS target FROM logits) r WHERE target >= 0 GROUP BY scene_id, point_idx, target",
       ("logits",))
def _(t):
    return t.logits.select("scene_id", "point_idx", F.posexplode(L.remap_scores(F.col("logits"), REMAP)).alias("target", "score"))


@query("p20_shift_instances", "scene_id bigint, point_idx bigint, x double, y double, z double",
       "SELECT scene_id, point_idx, CASE WHEN inst_label >= 0 THEN x + r/1e3 ELSE x END AS x, CASE WHEN inst_label >= 0 THEN y + g/1e3 ELSE y END AS y, CASE WHEN inst_label >= 0 THEN z + b/1e3 ELSE z END AS z FROM pm",
       ("pm",))
def _(t):
    off = t.points.selectExpr("scene_id", "point_idx", "r/1e3 AS off_x", "g/1e3 AS off_y", "b/1e3 AS off_z")
    return L.shift_instances(t.points_m.select("scene_id", "point_idx", "inst_label", "x", "y", "z"), off)


@query("p21_blank_unobserved", "scene_id bigint, point_idx bigint, pred bigint",
       "SELECT p.scene_id, p.point_idx, CASE WHEN c.point_idx IS NULL THEN -100 ELSE pred END AS pred FROM preds p LEFT JOIN (SELECT DISTINCT scene_id, point_idx FROM corr) c ON c.scene_id = p.scene_id AND c.point_idx = p.point_idx",
       ("preds", "corr"))
def _(t):
    return L.blank_unobserved(t.preds, t.corr)


@query("u1_concat", "scene_id bigint, source string, n bigint",
       "SELECT scene_id, source, count(*) AS n FROM (SELECT scene_id, 'gt' AS source FROM points UNION ALL SELECT scene_id, 'pred' AS source FROM pred_inst) u GROUP BY scene_id, source",
       ("points", "pred_inst"))
def _(t):
    a = t.points.select("scene_id", "point_idx", F.lit("gt").alias("source"))
    b = t.pred_inst.select("scene_id", F.lit("pred").alias("source"), "point_idx")
    return L.concat_tables(a, b).groupBy("scene_id", "source").agg(F.count("*").alias("n"))


@query("u5_common_classes", "scene_id bigint, class_id bigint",
       f"SELECT DISTINCT scene_id, sem_label AS class_id FROM points WHERE sem_label IN {BASE} AND sem_label BETWEEN 2 AND 19", ("points",))
def _(t):
    both = L.common_classes(BASE, range(2, N_CLASSES))
    return t.points.filter(F.array_contains(both, F.col("sem_label").cast("int"))).select("scene_id", F.col("sem_label").alias("class_id")).distinct()
