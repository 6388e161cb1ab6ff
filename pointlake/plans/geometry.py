"""Checked queries: coordinates, instances and batch numbering."""

from pyspark.sql import functions as F

from pointlake.operators import coords as C
from pointlake.operators import instances as I
from pointlake.plans.fixtures import N_CLASSES
from pointlake.plans.registry import query

PT = "scene_id bigint, point_idx bigint, "
XYZ = "x double, y double, z double"


@query("p11_centre_and_normalise", PT + XYZ + ", r double, r_back double",
       "SELECT scene_id, point_idx, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z, r/127.5e0 - 1 AS r, CAST(r AS DOUBLE) AS r_back FROM pm WINDOW w AS (PARTITION BY scene_id)",
       ("pm",))
def _(t):
    out = C.centre_scene(t.points_m).withColumn("r", C.normalise_colour(F.col("r")))
    return out.withColumn("r_back", C.restore_colour(F.col("r")))


@query("p12_voxel_scale", PT + "sx double, sy double, sz double",
       "SELECT scene_id, point_idx, x*50 - min(x*50) OVER w AS sx, y*50 - min(y*50) OVER w AS sy, z*50 - min(z*50) OVER w AS sz FROM pm WINDOW w AS (PARTITION BY scene_id)",
       ("pm",))
def _(t):
    return C.to_voxel_scale(t.points_m, 50.0)


@query("p13_point_features", PT + "dim bigint, v double",
       "SELECT scene_id, point_idx, 0 AS dim, CAST(r AS DOUBLE) AS v FROM pm UNION ALL SELECT scene_id, point_idx, 1, CAST(g AS DOUBLE) FROM pm UNION ALL SELECT scene_id, point_idx, 2, CAST(b AS DOUBLE) FROM pm UNION ALL SELECT scene_id, point_idx, 3, x FROM pm UNION ALL SELECT scene_id, point_idx, 4, y FROM pm UNION ALL SELECT scene_id, point_idx, 5, z FROM pm",
       ("pm",))
def _(t):
    return t.points_m.select("scene_id", "point_idx", F.posexplode(C.point_features(True, True)).alias("dim", "v"))


MATRIX = (0.8, -0.6, 0.0, 1.5, 0.6, 0.8, 0.0, -2.0, 0.0, 0.0, 1.0, 0.25, 0.0, 0.0, 0.125, 2.0)
ROWS = [f"({MATRIX[4*i]}e0*x + {MATRIX[4*i+1]}e0*y + {MATRIX[4*i+2]}e0*z + {MATRIX[4*i+3]}e0)" for i in range(4)]


@query("m1_homogeneous_transform", PT + XYZ,
       f"SELECT scene_id, point_idx, {ROWS[0]}/{ROWS[3]} AS x, {ROWS[1]}/{ROWS[3]} AS y, {ROWS[2]}/{ROWS[3]} AS z FROM pm", ("pm",))
def _(t):
    out = C.transform_homogeneous(MATRIX, [F.col(c) for c in "xyz"])
    return t.points_m.select("scene_id", "point_idx", *[e.alias(c) for e, c in zip(out, "xyz")])


@query("m2_rotate_z", PT + "x double, y double",
       "SELECT scene_id, point_idx, x*cos(scene_id/7e0) - y*sin(scene_id/7e0) AS x, x*sin(scene_id/7e0) + y*cos(scene_id/7e0) AS y FROM pm", ("pm",))
def _(t):
    x, y = C.rotate_z(F.col("x"), F.col("y"), F.col("scene_id") / 7.0)
    return t.points_m.select("scene_id", "point_idx", x.alias("x"), y.alias("y"))


@query("m3_wrap_period", PT + "v double",
       "SELECT scene_id, point_idx, v - floor(v/3.141592653589793e0 + 5e-1)*3.141592653589793e0 AS v FROM (SELECT scene_id, point_idx, (r - 128)/10e0 AS v FROM points) q", ("points",))
def _(t):
    import math
    return t.points.select("scene_id", "point_idx", C.wrap_period((F.col("r") - 128) / 10.0, 0.5, math.pi).alias("v"))


@query("m4_voxel_centre", PT + XYZ,
       "SELECT scene_id, point_idx, (x_mm // 50 + 5e-1)*1e-1 - 1 AS x, (y_mm // 50 + 5e-1)*2e-1 + 2 AS y, (z_mm // 50 + 5e-1)*4e-1 + 3 AS z FROM points", ("points",))
def _(t):
    zyx = [F.floor(F.col(f"{c}_mm") / 50) for c in "zyx"]
    out = C.voxel_centre(zyx, (0.05, 0.1, 0.2), (-1.0, 2.0, 3.0), stride=2)
    return t.points.select("scene_id", "point_idx", *[e.alias(c) for e, c in zip(out, "xyz")])


BOX = "SELECT scene_id, inst_label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz, inst_label/4e0 AS heading FROM pm WHERE inst_label >= 0 GROUP BY scene_id, inst_label"
CORNERS = ", ".join(f"({i}, {a/2}e0, {b/2}e0, {c/2}e0)" for i, (a, b, c) in enumerate(C.BOX_CORNERS))


@query("m5_box_corners", "scene_id bigint, inst_label bigint, corner bigint, " + XYZ,
       f"""SELECT scene_id, inst_label, k AS corner, a*dx*cos(heading) - b*dy*sin(heading) + cx AS x, a*dx*sin(heading) + b*dy*cos(heading) + cy AS y, c*dz + cz AS z
       FROM ({BOX}) q CROSS JOIN (VALUES {CORNERS}) k(k, a, b, c)""", ("pm",))
def _(t):
    s = I.instance_stats(t.points_m)
    boxes = s.select("scene_id", "inst_label", *[F.col(f"{c}_mean").alias(f"c{c}") for c in "xyz"],
                     *[(F.col(f"{c}_max") - F.col(f"{c}_min")).alias(f"d{c}") for c in "xyz"], (F.col("inst_label") / 4.0).alias("heading"))
    return C.box_corners(boxes)


@query("m6_grid_size", "scene_id bigint, nx bigint, ny bigint, nz bigint",
       "SELECT scene_id, round_even((max(x) - min(x))/2e-2, 0) AS nx, round_even((max(y) - min(y))/2e-2, 0) AS ny, round_even((max(z) - min(z))/2e-2, 0) AS nz FROM pm GROUP BY scene_id",
       ("pm",))
def _(t):
    return t.points_m.groupBy("scene_id").agg(*[C.grid_size(F.min(c), F.max(c), 0.02).alias(f"n{c}") for c in "xyz"])


@query("m8_padding", "scene_id bigint, n_before bigint, n_after bigint, padded bigint",
       "SELECT scene_id, 0 AS n_before, 1024 - count(*) AS n_after, 8 AS padded FROM points GROUP BY scene_id", ("points",))
def _(t):
    out = t.points.groupBy("scene_id").agg(F.count("*").alias("n"), F.array(F.min("r"), F.max("r")).alias("v"))
    out = out.withColumn("p", C.pad_pair(F.lit(1024).cast("bigint"), F.col("n")))
    return out.select("scene_id", F.col("p.before").alias("n_before"), F.col("p.after").alias("n_after"),
                      F.size(C.pad_array(F.col("v"), 8, 0)).alias("padded"))


@query("m9_ravel_key", PT + "key bigint",
       """SELECT scene_id, point_idx, ((vx - min(vx) OVER w)*(max(vy) OVER w - min(vy) OVER w + 1) + (vy - min(vy) OVER w))*(max(vz) OVER w - min(vz) OVER w + 1) + (vz - min(vz) OVER w) AS key
       FROM (SELECT scene_id, point_idx, x_mm // 50 AS vx, y_mm // 50 AS vy, z_mm // 50 AS vz FROM points) q WINDOW w AS (PARTITION BY scene_id)""", ("points",))
def _(t):
    return C.ravel_key(t.points.selectExpr("scene_id", "point_idx", "x_mm div 50 AS vx", "y_mm div 50 AS vy", "z_mm div 50 AS vz"))


PALETTE = [((37 * i) % 256, (91 * i + 17) % 256, (151 * i + 43) % 256) for i in range(N_CLASSES)]


@query("j12_class_colours", PT + "r bigint, g bigint, b bigint",
       "SELECT scene_id, point_idx, CASE WHEN pred = 0 THEN 128 ELSE (37*pred) % 256 END AS r, CASE WHEN pred = 0 THEN 128 ELSE (91*pred + 17) % 256 END AS g, CASE WHEN pred = 0 THEN 128 ELSE (151*pred + 43) % 256 END AS b FROM preds",
       ("preds",))
def _(t):
    grey = F.array(F.lit(128), F.lit(128), F.lit(128))
    rgb = F.when(F.col("pred") == 0, grey).otherwise(C.class_colours(F.col("pred"), PALETTE))
    return t.preds.withColumn("c", rgb).select("scene_id", "point_idx", *[F.col("c")[i].alias(n) for i, n in enumerate("rgb")])


@query("j12_instance_colours", PT + "colour_idx bigint",
       """SELECT p.scene_id, p.point_idx, coalesce(k % 5, -1) AS colour_idx FROM points p LEFT JOIN (SELECT scene_id, inst_label, row_number() OVER (PARTITION BY scene_id ORDER BY count(*) DESC, inst_label) - 1 AS k
       FROM points WHERE inst_label >= 0 GROUP BY scene_id, inst_label) s ON s.scene_id = p.scene_id AND s.inst_label = p.inst_label""", ("points",))
def _(t):
    return C.instance_colours(t.points, 5)


STATS = ", ".join(f"{n}({c}) AS {c}_{a}" for c in "xyz" for n, a in (("avg", "mean"), ("min", "min"), ("max", "max")))
STAT_COLS = ", ".join(f"{c}_{a} double" for c in "xyz" for a in ("mean", "min", "max"))


@query("a1_instance_stats", "scene_id bigint, inst_label bigint, n_points bigint, inst_class bigint, " + STAT_COLS,
       f"SELECT scene_id, inst_label, count(*) AS n_points, arg_min(sem_label, point_idx) AS inst_class, {STATS} FROM pm WHERE inst_label >= 0 GROUP BY scene_id, inst_label", ("pm",))
def _(t):
    return I.instance_stats(t.points_m)


@query("a1_centre_offsets", PT + "off_x double, off_y double, off_z double, n_points bigint",
       """SELECT p.scene_id, p.point_idx, mx - x AS off_x, my - y AS off_y, mz - z AS off_z, n AS n_points FROM pm p LEFT JOIN (SELECT scene_id, inst_label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n
       FROM pm WHERE inst_label >= 0 GROUP BY scene_id, inst_label) s ON s.scene_id = p.scene_id AND s.inst_label = p.inst_label""", ("pm",))
def _(t):
    return I.centre_offsets(t.points_m)


@query("a2_segment_stats", "scene_id bigint, pred_id bigint, " + STAT_COLS,
       f"SELECT p.scene_id, q.pred_id, {STATS} FROM pm p JOIN pred_inst q ON q.scene_id = p.scene_id AND q.point_idx = p.point_idx GROUP BY p.scene_id, q.pred_id", ("pm", "pred_inst"))
def _(t):
    rows = t.pred_inst.join(t.points_m.select("scene_id", "point_idx", *"xyz"), ["scene_id", "point_idx"])
    return I.segment_stats(rows, ["scene_id", "pred_id"], ["x", "y", "z"])


@query("w1_batch_offsets", "scene_id bigint, batch_id bigint, n_points bigint, row_offset bigint",
       'SELECT scene_id, scene_id // 4 AS batch_id, n AS n_points, coalesce(sum(n) OVER (PARTITION BY scene_id // 4 ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_offset FROM (SELECT scene_id, count(*) AS n FROM points GROUP BY scene_id) s',
       ("points",))
def _(t):
    return I.batch_offsets(t.points, 4)


@query("w2_global_instances", PT + "inst_label bigint",
       """SELECT p.scene_id, p.point_idx, CASE WHEN inst_label = -100 THEN -100 ELSE inst_label + base END AS inst_label FROM points p JOIN (SELECT scene_id, coalesce(sum(greatest(m + 1, 0)) OVER
       (PARTITION BY scene_id // 4 ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM (SELECT scene_id, max(inst_label) AS m FROM points GROUP BY scene_id) s) b ON b.scene_id = p.scene_id""",
       ("points",))
def _(t):
    return I.globalise_instances(t.points, 4)
