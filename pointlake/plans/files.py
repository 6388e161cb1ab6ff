"""Checked queries: sources, sinks and the prediction stream."""

from pyspark.sql import functions as F

from pointlake.operators import instance_ap as AP
from pointlake.operators.metrics import best_epoch
from pointlake.plans.fixtures import N_CLASSES
from pointlake.plans.overlaps import AP_SQL, PER_CLASS, USES, ap_table
from pointlake.plans.registry import query
from pointlake.sources import readers as R
from pointlake.sources import writers as K
from pointlake.sources.named_files import write_named_files
from pointlake.streaming.predictions import run_metrics, watch_predictions

PT = "scene_id bigint, point_idx bigint, "
EVAL_IDS = tuple(2 * i + 1 for i in range(N_CLASSES))


@query("s4_list_scenes", "scene_id bigint, n bigint", "SELECT scene_id, count(*) AS n FROM points GROUP BY scene_id", ("points",))
def _(t):
    path = t.scratch("scenes")
    K.write_scene_arrays(t.points, path, ["sem_label"])
    return t.spark.read.parquet(path).groupBy("scene_id").agg(F.count("*").alias("n"))


ROOM = "concat('Area_', scene_id % 6 + 1, '_', 'room', scene_id)"
FILE = "concat('c', sem_label, '_', inst_label, '.txt')"


@query("s1_object_files", "scene_id string, point_idx bigint, x double, y double, z double, r double, g double, b double, sem_label bigint, inst_label bigint",
       f"""SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY f, point_idx) - 1 AS point_idx, x - min(x) OVER w AS x, y - min(y) OVER w AS y, z - min(z) OVER w AS z, r, g, b, CASE WHEN sem_label < 15 THEN sem_label ELSE 15 END AS sem_label,
       dense_rank() OVER (PARTITION BY scene_id ORDER BY f) AS inst_label FROM (SELECT {ROOM} AS scene_id, {FILE} AS f, point_idx, CAST(x_mm AS DOUBLE) AS x, y_mm/2e0 AS y, CAST(z_mm AS DOUBLE) AS z, r, g, b, sem_label FROM points WHERE inst_label >= 0) p WINDOW w AS (PARTITION BY scene_id)""", ("points",))
def _(t):
    """Object files written from the points and read back: rooms at the origin, instances by file name, classes
    15 and above unknown."""
    root = t.scratch("objects")
    seen = t.points.filter("inst_label >= 0")
    line = F.format_string("%d %.1f %d %d %d %d", "x_mm", F.col("y_mm") / 2, "z_mm", "r", "g", "b")
    path = F.expr(f"concat('Area_', scene_id % 6 + 1, '/room', scene_id, '/Annotations/', {FILE})")
    write_named_files(seen.select(path.alias("path"), F.col("point_idx").alias("place"), line.alias("line"), F.lit(1).alias("times")), root)
    return R.read_object_files(t.spark, root, [*[f"c{i}" for i in range(15)], "clutter"])


@query("s4_scenes_by_suffix", "scene_id bigint", "SELECT DISTINCT scene_id FROM points WHERE sem_label <> 12", ("points",))
def _(t):
    root = t.scratch("split")
    names = t.scenes.select(F.concat("scene_id", F.lit("_labels.txt")).alias("path")).unionByName(
        t.points.filter("sem_label <> 12").select(F.concat("scene_id", F.lit("_clean.txt")).alias("path")).distinct())
    write_named_files(names.select("path", F.lit(0).alias("place"), F.lit("data").alias("line"), F.lit(1).alias("times")), root)
    return R.list_scenes(t.spark, root, "_clean.txt")


@query("s11_id_lists", PT + "id bigint", "SELECT scene_id, point_idx, sem_label AS id FROM points", ("points",))
def _(t):
    root = t.scratch("ids")
    rows = t.points.select(F.concat("scene_id", F.lit(".txt")).alias("path"), F.col("point_idx").alias("place"), F.col("sem_label").cast("string").alias("line"), F.lit(1).alias("times"))
    write_named_files(rows, root)
    return R.read_id_lists(t.spark, f"{root}/*.txt")


@query("s5_split_by_area", "scene_id bigint, split string", "SELECT DISTINCT scene_id, CASE WHEN scene_id % 6 + 1 = 5 THEN 'test' ELSE 'train' END AS split FROM points", ("points",))
def _(t):
    rooms = t.scenes.withColumn("room", F.concat(F.lit("Area_"), F.col("scene_id") % 6 + 1, F.lit("_office_"), F.col("scene_id")))
    return R.split_by_area(rooms, 5, "room")


@query("s6_scene_list", PT + "sem_label bigint", "SELECT scene_id, point_idx, sem_label FROM points WHERE scene_id IN (SELECT scene_id FROM points WHERE sem_label IN (5, 12))", ("points",))
def _(t):
    path = t.scratch("list")
    t.points.filter("sem_label IN (5, 12)").select("scene_id").distinct().select(F.concat(F.lit("  "), F.col("scene_id"), F.lit(" ")).alias("value")).write.text(path)
    return R.restrict_to_scenes(t.points, R.read_scene_list(t.spark, path).select(F.col("scene_id").cast("bigint")))


@query("s7_fill_labels", PT + "sem_label bigint, inst_label bigint", "SELECT scene_id, point_idx, CASE WHEN r < 100 THEN -100 ELSE sem_label END AS sem_label, -100 AS inst_label FROM points", ("points",))
def _(t):
    half = t.points.select("scene_id", "point_idx", F.when(F.col("r") >= 100, F.col("sem_label")).alias("sem_label"))
    return R.fill_missing_labels(half)


@query("s8_k6_caption_files", "scene_id bigint, image bigint, caption string", "SELECT scene_id, frame AS image, caption FROM captions", ("captions",))
def _(t):
    path = t.scratch("captions")
    K.captions_json(t.captions, "frame").write.text(path)
    return R.read_captions(t.spark, path, "view", per_line=True)


@query("s9_k6_correspondence", "scene_id bigint, image bigint, point_idx bigint", "SELECT scene_id, frame AS image, point_idx FROM corr", ("corr",))
def _(t):
    path = t.scratch("corr")
    rows = t.corr.selectExpr("'view' AS level", "scene_id", "frame AS image", "point_idx")
    K.write_correspondence(rows, path)
    return R.read_correspondence(t.spark, path, "view")


@query("s10_complete_scenes", "scene_id bigint, n_images bigint", "SELECT scene_id, count(*) AS n_images FROM frames WHERE scene_id NOT IN (SELECT scene_id FROM points WHERE sem_label = 12) GROUP BY scene_id", ("frames", "points"))
def _(t):
    kinds = F.array(*[F.lit(k) for k in ("pose", "depth", "color")])
    files = t.frames.select("scene_id", "frame", F.explode(kinds).alias("kind"))
    # scenes with a point of class 12 miss one depth image
    short = t.points.filter("sem_label = 12").select("scene_id").distinct().withColumn("short", F.lit(True))
    files = files.join(short, "scene_id", "left").filter(F.coalesce(~(F.col("short") & (F.col("kind") == "depth") & (F.col("frame") == 0)), F.lit(True)))
    return R.complete_scenes(files, strict=False)


LOST, UNEVEN = "(scene_id % 3 = 0 AND frame = 0)", "scene_id % 5 = 1"


@query("s10_frames", "scene_id bigint, frame bigint, image bigint, tx double, ty double, tz double, fx double, fy double, cx double, cy double, h bigint, w bigint",
       f"""SELECT scene_id, frame, frame*20 AS image, -tx_mm/1e3 AS tx, -5e-1 AS ty, 2e0 AS tz, fx*k AS fx, fy*k AS fy, cx*k AS cx, cy*k AS cy, CASE WHEN k = 2 THEN 47 ELSE 24 END AS h, w
       FROM (SELECT *, CASE WHEN frame % 2 = 1 THEN 2 ELSE 1 END AS k FROM frames) f WHERE NOT {LOST} AND NOT {UNEVEN}""", ("frames",))
def _(t):
    """Pose and intrinsic texts, file lists and image sizes as one table: lost cameras, a scene with a missing file,
    images of twice the height."""
    root = t.scratch("scan")
    shots = t.frames.withColumn("image", F.col("frame") * 20)
    lost = F.expr(LOST)
    cells = [[1.0, 0.0, 0.0, F.col("tx_mm") / 1000.0], [0.0, 1.0, 0.0, 0.5], [0.0, 0.0, 1.0, -2.0], [0.0, 0.0, 0.0, 1.0]]
    text = [F.when(lost, F.lit("-inf -inf -inf -inf")).otherwise(F.concat_ws(" ", *[F.lit(c) if isinstance(c, float) else c for c in row])) for row in cells]
    lines = shots.select(F.format_string("%d/pose/%d.txt", "scene_id", "image").alias("path"), F.posexplode(F.array(*text)).alias("place", "line"), F.lit(1).alias("times"))
    blank = shots.select("scene_id", "frame", "image", F.explode(F.array(F.lit("depth"), F.lit("color"))).alias("kind")).filter(f"NOT (kind = 'color' AND frame = 5 AND {UNEVEN})")
    blank = blank.select(F.concat_ws("/", "scene_id", "kind", F.concat("image", F.lit(".png"))).alias("path"), F.lit(0).alias("place"), F.lit("pixels").alias("line"), F.lit(1).alias("times"))
    k = ["30 0 16 0", "0 30 12 0", "0 0 1 0", "0 0 0 1"]
    lens = t.scenes.select(F.concat("scene_id", F.lit("/intrinsic_depth.txt")).alias("path"), F.posexplode(F.array(*[F.lit(x) for x in k])).alias("place", "line"), F.lit(1).alias("times"))
    write_named_files(lines.unionByName(blank).unionByName(lens), root)
    sizes = shots.select(F.col("scene_id").cast("string").alias("scene_id"), F.col("image").cast("string").alias("image"), F.expr("CASE WHEN frame % 2 = 1 THEN 47 ELSE h END").alias("h"), "w")
    files = R.list_scan_images(t.spark, root)
    frames = R.assemble_frames(files, R.read_pose_texts(t.spark, f"{root}/*/pose/*.txt"), sizes, R.read_intrinsics(t.spark, f"{root}/*/intrinsic_depth.txt"), strict=False, native_height=24)
    return frames.select("*", *[F.col("pose")[4 * i + 3].alias(c) for i, c in enumerate(("tx", "ty", "tz"))])


@query("s11_k2_manifests", "scene_id bigint, mask_path string, label_id bigint, conf double, valid boolean",
       "SELECT scene_id, concat('predicted_masks/', scene_id, '_', lpad(CAST(row_number() OVER (PARTITION BY scene_id ORDER BY pred_id) - 1 AS VARCHAR), 3, '0'), '.txt') AS mask_path, 2*class_id + 1 AS label_id, conf, true AS valid FROM pred_meta", ("pred_meta",))
def _(t):
    path = t.scratch("instances")
    meta = t.pred_meta.selectExpr("scene_id", "pred_id", "class_id + 1 AS label_id", "conf")
    K.write_pred_instances(meta, t.pred_inst, path, EVAL_IDS)
    rows = R.read_instance_manifests(t.spark, f"{path}/manifest")
    return rows.withColumn("scene_id", F.regexp_extract("mask_path", r"/(\d+)_", 1))


@query("s12_scene_offsets", PT + "x double, y double, z double", "SELECT scene_id, point_idx, x + scene_id/1e1 AS x, y - 5e-1 AS y, z + 2e0 AS z FROM pm", ("pm",))
def _(t):
    path = t.scratch("offsets")
    vec = F.array(F.col("scene_id") / 10.0, F.lit(-0.5), F.lit(2.0))
    t.scenes.select(F.to_json(F.create_map(F.col("scene_id").cast("string"), vec)).alias("value")).write.text(path)
    offsets = R.read_scene_offsets(t.spark, path, per_line=True)
    return R.add_scene_offsets(t.points_m, offsets.withColumn("scene_id", F.col("scene_id").cast("bigint")))


@query("k1_scene_arrays", PT + "gt bigint, pred bigint", "SELECT scene_id, point_idx, gt, pred FROM preds", ("preds",))
def _(t):
    path = t.scratch("arrays")
    K.write_scene_arrays(t.preds, path, ["gt", "pred"])
    return R.read_scene_arrays(t.spark, path, "point_idx bigint, gt bigint, pred bigint, scene_id bigint")


@query("k2_instance_masks", "scene_id bigint, pred_id bigint, point_idx bigint", "SELECT scene_id, pred_id, point_idx FROM pred_inst", ("pred_inst",))
def _(t):
    path = t.scratch("instances")
    K.write_pred_instances(t.pred_meta.withColumn("label_id", F.col("class_id") + 1), t.pred_inst, path)
    return t.spark.read.parquet(f"{path}/masks")


@query("k2_dense_masks", "scene_id bigint, pred_id bigint, start bigint, length bigint, value bigint",
       """SELECT scene_id, pred_id, min(point_idx) + 1 AS start, count(*) AS length, value FROM (SELECT *, point_idx - row_number() OVER (PARTITION BY scene_id, pred_id, value ORDER BY point_idx) AS g FROM (
       SELECT m.scene_id, m.pred_id, p.point_idx, CASE WHEN q.pred_id = m.pred_id THEN 1 ELSE 0 END AS value FROM pred_meta m JOIN points p ON p.scene_id = m.scene_id LEFT JOIN pred_inst q ON q.scene_id = p.scene_id AND q.point_idx = p.point_idx) d) r
       GROUP BY scene_id, pred_id, value, g""", ("pred_meta", "points", "pred_inst"))
def _(t):
    return K.dense_mask(t.pred_inst, t.points)


@query("k3_gt_codes", PT + "code bigint", "SELECT scene_id, point_idx, CASE WHEN code = 0 THEN 0 ELSE (2*(code // 1000) - 1)*1000 + code % 1000 END AS code FROM gt_codes", ("gt_codes",))
def _(t):
    return K.remap_gt_codes(t.gt_codes, EVAL_IDS)


@query("k4_export_instances", "scene_id bigint, pred_id bigint, label_id bigint, n_points bigint, conf double",
       "SELECT scene_id, inst_label AS pred_id, arg_min(sem_label, point_idx) AS label_id, count(*) AS n_points, 1e0 AS conf FROM points WHERE inst_label <> 0 GROUP BY scene_id, inst_label", ("points",))
def _(t):
    return K.export_instances(t.points)[0]


@query("k5_metric_csv", "class string, class_id bigint, ap double, ap50 double, ap25 double",
       f"{AP_SQL} SELECT concat('class_', class_id) AS class, class_id, ap, ap50, ap25 FROM (SELECT class_id, {PER_CLASS} FROM res GROUP BY class_id) c", USES)
def _(t):
    path = t.scratch("csv")
    rows = AP.class_averages(ap_table(t)).withColumn("class", F.concat(F.lit("class_"), "class_id"))
    K.write_metric_csv(rows, path)
    return t.spark.read.csv(path, header=True, schema="class string, class_id bigint, ap double, ap50 double, ap25 double")


@query("k7_merge_indexes", "scene_id string, image bigint, point_idx bigint", "SELECT concat('scene_', scene_id) AS scene_id, frame AS image, point_idx FROM corr", ("corr",))
def _(t):
    path = t.scratch("index")
    rows = t.corr.selectExpr("concat('scene_', scene_id) AS scene", "frame AS image", "point_idx")
    rows.repartition("scene").write.partitionBy("scene").parquet(path)
    merged = t.scratch("merged")
    K.merge_indexes(t.spark, f"{path}/scene=*", merged, folder_key="scene")
    return t.spark.read.parquet(merged)


EPOCHS = "SELECT scene_id, point_idx, CAST(point_idx % 3 AS INTEGER) + 1 AS epoch, gt, CASE WHEN point_idx % 5 = 0 THEN gt ELSE pred END AS pred FROM preds"
R1 = f"""SELECT 'run' AS run, epoch, avg(i/(o + t - i + 1e-10)) AS miou, avg(i/(o + 1e-10)) AS mpre, avg(i/(t + 1e-10)) AS macc, sum(i)/(sum(o) + 1e-10) AS all_pre,
 sum(i)/(sum(t) + 1e-10) AS all_acc, (SELECT count(*) FROM ({EPOCHS}) w WHERE w.epoch = q.epoch) AS n_points FROM (
 SELECT e.epoch, c.class_id, coalesce(sum(CASE WHEN gt >= 0 AND gt = c.class_id AND pred = c.class_id THEN 1 END), 0) AS i,
  coalesce(sum(CASE WHEN gt >= 0 AND pred = c.class_id THEN 1 END), 0) AS o, coalesce(sum(CASE WHEN gt = c.class_id THEN 1 END), 0) AS t
 FROM ({EPOCHS}) e, (SELECT unnest(range(20)) AS class_id) c GROUP BY e.epoch, c.class_id) q GROUP BY epoch"""


def epoch_metrics(t, max_files):
    root = t.scratch("stream")
    rows = t.preds.selectExpr("'run' AS run", "CAST(point_idx % 3 AS INT) + 1 AS epoch", "scene_id", "point_idx", "gt",
                              "CASE WHEN point_idx % 5 = 0 THEN gt ELSE pred END AS pred")
    rows.repartition(6).write.parquet(f"{root}/in")
    watch_predictions(t.spark, f"{root}/in", f"{root}/counts", f"{root}/state", max_files=max_files).awaitTermination()
    return run_metrics(t.spark, f"{root}/counts", N_CLASSES)


@query("r1_watch_predictions", "run string, epoch int, miou double, mpre double, macc double, all_pre double, all_acc double, n_points bigint", R1, ("preds",))
def _(t):
    return epoch_metrics(t, 2)


@query("r1_best_epoch", "run string, best_metric double, best_epoch int",
       f"SELECT run, miou AS best_metric, epoch AS best_epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY miou DESC, epoch) AS k FROM ({R1}) r) z WHERE k = 1", ("preds",))
def _(t):
    return best_epoch(epoch_metrics(t, 1000), ["run"], "miou", "epoch")
