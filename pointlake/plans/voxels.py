"""Checked queries: voxelization."""

from pyspark.sql import functions as F

from pointlake.operators import sampling, voxel as V
from pointlake.plans.draws import draw
from pointlake.plans.registry import query

SIZE = 50
CELL_SQL = "SELECT *, x_mm // 50 AS vx, y_mm // 50 AS vy, z_mm // 50 AS vz FROM points"
VOX = f"SELECT scene_id, vx, vy, vz, first_idx, n_points, row_number() OVER (PARTITION BY scene_id ORDER BY first_idx) - 1 AS voxel_id FROM (SELECT scene_id, vx, vy, vz, min(point_idx) AS first_idx, count(*) AS n_points FROM ({CELL_SQL}) c GROUP BY scene_id, vx, vy, vz) g"
V3 = "scene_id bigint, vx bigint, vy bigint, vz bigint, "
PT = "scene_id bigint, point_idx bigint, "


def cells(t, pts=None):
    return V.with_cells(t.points if pts is None else pts, SIZE, ("x_mm", "y_mm", "z_mm"))


@query("v1_voxel_table", V3 + "first_idx bigint, n_points bigint, voxel_id bigint", VOX, ("points",))
def _(t):
    return V.voxel_table(cells(t))


@query("v1_point_voxel_map", PT + "voxel_id bigint",
       f"SELECT p.scene_id, p.point_idx, v.voxel_id FROM ({CELL_SQL}) p JOIN ({VOX}) v ON v.scene_id = p.scene_id AND v.vx = p.vx AND v.vy = p.vy AND v.vz = p.vz", ("points",))
def _(t):
    c = cells(t)
    return V.point_voxels(c, V.voxel_table(c))


@query("v2_representatives", V3 + "rep_idx bigint, voxel_id bigint",
       f"SELECT scene_id, vx, vy, vz, rep_idx, row_number() OVER (PARTITION BY scene_id ORDER BY vx, vy, vz) - 1 AS voxel_id FROM (SELECT scene_id, vx, vy, vz, min(point_idx) AS rep_idx FROM ({CELL_SQL}) c GROUP BY scene_id, vx, vy, vz) g", ("points",))
def _(t):
    return V.voxel_representatives(cells(t))


@query("v2_random_representatives", V3 + "rep_idx bigint",
       f"SELECT scene_id, vx, vy, vz, point_idx AS rep_idx FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, vx, vy, vz ORDER BY {draw(11, 'scene_id', 'point_idx')}, point_idx) AS k FROM ({CELL_SQL}) c) q WHERE k = 1", ("points",))
def _(t):
    return V.voxel_representatives(cells(t), seed=11)


@query("v3_pool_mean", V3 + "r double, g double, n_points bigint",
       f"SELECT scene_id, vx, vy, vz, avg(r) AS r, avg(g) AS g, count(*) AS n_points FROM ({CELL_SQL}) c GROUP BY scene_id, vx, vy, vz", ("points",))
def _(t):
    return V.pool_voxels(cells(t), ["r", "g"], "mean")


@query("v3_pool_sum", V3 + "r bigint, g bigint, n_points bigint",
       f"SELECT scene_id, vx, vy, vz, sum(r) AS r, sum(g) AS g, count(*) AS n_points FROM ({CELL_SQL}) c GROUP BY scene_id, vx, vy, vz", ("points",))
def _(t):
    return V.pool_voxels(cells(t), ["r", "g"], "sum")


@query("v3_pool_first_last", V3 + "r_first bigint, r_last bigint",
       f"SELECT scene_id, vx, vy, vz, arg_min(r, point_idx) AS r_first, arg_max(r, point_idx) AS r_last FROM ({CELL_SQL}) c GROUP BY scene_id, vx, vy, vz", ("points",))
def _(t):
    c = cells(t)
    a = V.pool_voxels(c, ["r"], "first").withColumnRenamed("r", "r_first")
    b = V.pool_voxels(c, ["r"], "last").withColumnRenamed("r", "r_last").drop("n_points")
    return a.join(b, ["scene_id", "vx", "vy", "vz"])


@query("v3_pool_unique", PT + "r bigint", "SELECT scene_id, point_idx, r FROM points", ("points",))
def _(t):
    # one millimetre cells along the point index hold one point each
    c = t.points.selectExpr("scene_id", "point_idx", "r", "point_idx AS vx", "point_idx % 3 AS vy", "point_idx % 7 AS vz")
    return V.pool_voxels(c, ["r"], "unique").withColumn("point_idx", F.col("vx"))


@query("v4_one_per_voxel", V3 + "point_idx bigint, r bigint, sem_label bigint",
       f"""SELECT scene_id, vx - min(vx) OVER w AS vx, vy - min(vy) OVER w AS vy, vz - min(vz) OVER w AS vz, point_idx, r, sem_label FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, vx, vy, vz
       ORDER BY {draw(5, 'scene_id', 'point_idx')}, point_idx) AS k FROM ({CELL_SQL}) c) q WHERE k = 1 WINDOW w AS (PARTITION BY scene_id)""", ("points",))
def _(t):
    return V.sample_voxels(cells(t), ["r", "sem_label"], 5, shift_to_origin=True)


@query("v5_mean_voxels", V3 + "x double, y double, z double, r double, n_points bigint",
       """SELECT scene_id, CAST(floor(avg(mx)/50) AS BIGINT) AS vx, CAST(floor(avg(my)/50) AS BIGINT) AS vy, CAST(floor(avg(mz)/50) AS BIGINT) AS vz, avg(mx + lx) AS x, avg(my + ly) AS y, avg(mz + lz) AS z, avg(r) AS r, count(*) AS n_points
       FROM (SELECT scene_id, r, x_mm - min(x_mm) OVER w AS mx, y_mm - min(y_mm) OVER w AS my, z_mm - min(z_mm) OVER w AS mz, min(x_mm) OVER w AS lx, min(y_mm) OVER w AS ly, min(z_mm) OVER w AS lz FROM points WINDOW w AS (PARTITION BY scene_id)) q
       GROUP BY scene_id, mx // 50, my // 50, mz // 50""", ("points",))
def _(t):
    pts = t.points.selectExpr("scene_id", "point_idx", "x_mm AS x", "y_mm AS y", "z_mm AS z", "r")
    return V.mean_voxels(pts, ["r"], SIZE)


@query("v6_hard_voxels", "scene_id bigint, voxel_id bigint, slot bigint, point_idx bigint, n_kept bigint",
       f"""SELECT p.scene_id, v.voxel_id, k - 1 AS slot, p.point_idx, least(v.n_points, 3) AS n_kept FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, vx, vy, vz ORDER BY point_idx) AS k FROM ({CELL_SQL}) c) p
       JOIN ({VOX}) v ON v.scene_id = p.scene_id AND v.vx = p.vx AND v.vy = p.vy AND v.vz = p.vz WHERE k <= 3 AND voxel_id < 200""", ("points",))
def _(t):
    return V.hard_voxels(cells(t), 3, 200)


@query("v6_padded_voxels", "scene_id bigint, voxel_id bigint, n_kept bigint, n_slots bigint, total double",
       f"""SELECT p.scene_id, v.voxel_id, least(v.n_points, 3) AS n_kept, 3 AS n_slots, sum(r) AS total FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, vx, vy, vz ORDER BY point_idx) AS k FROM ({CELL_SQL}) c) p
       JOIN ({VOX}) v ON v.scene_id = p.scene_id AND v.vx = p.vx AND v.vy = p.vy AND v.vz = p.vz WHERE k <= 3 AND voxel_id < 200 GROUP BY p.scene_id, v.voxel_id, v.n_points""", ("points",))
def _(t):
    pad = V.pad_voxels(V.hard_voxels(cells(t), 3, 200), ["r", "g"], 3)
    return pad.select("scene_id", "voxel_id", "n_kept", F.size("points").alias("n_slots"),
                      F.aggregate("points", F.lit(0.0), lambda s, p: s + p[0]).alias("total"))


@query("v7_devoxelise", PT + "r double",
       f"SELECT scene_id, point_idx, avg(r) OVER (PARTITION BY scene_id, vx, vy, vz) AS r FROM ({CELL_SQL}) c", ("points",))
def _(t):
    c = cells(t)
    vox = V.voxel_table(c)
    values = V.pool_voxels(c, ["r"], "mean").join(vox, ["scene_id", "vx", "vy", "vz"]).select("scene_id", "voxel_id", "r")
    return V.devoxelise(V.point_voxels(c.select("scene_id", "point_idx", "vx", "vy", "vz"), vox), values)


@query("v9_batch_shape", "batch_id bigint, nvx bigint, nvy bigint, nvz bigint",
       f"SELECT scene_id // 4 AS batch_id, greatest(max(vx) + 1, 64) AS nvx, greatest(max(vy) + 1, 64) AS nvy, greatest(max(vz) + 1, 64) AS nvz FROM ({CELL_SQL}) c GROUP BY scene_id // 4", ("points",))
def _(t):
    c = cells(t).withColumn("batch_id", F.floor(F.col("scene_id") / 4))
    return V.batch_shape(c, 64, ["batch_id"])


@query("v10_voxel_rows", V3 + "voxel_id bigint",
       f"SELECT q.scene_id, q.vx, q.vy, q.vz, coalesce(v.voxel_id, -1) AS voxel_id FROM (SELECT DISTINCT scene_id, vx + 1 AS vx, vy, vz FROM ({CELL_SQL}) c) q LEFT JOIN ({VOX}) v ON v.scene_id = q.scene_id AND v.vx = q.vx AND v.vy = q.vy AND v.vz = q.vz", ("points",))
def _(t):
    c = cells(t)
    return V.voxel_rows(c.selectExpr("scene_id", "vx + 1 AS vx", "vy", "vz").distinct(), V.voxel_table(c))


@query("v11_downsample_depth", "scene_id bigint, frame bigint, u bigint, v bigint, depth double",
       "SELECT scene_id, frame, u // 5 AS u, v // 5 AS v, sum(depth)/25 AS depth FROM depth GROUP BY scene_id, frame, u // 5, v // 5", ("depth",))
def _(t):
    return V.downsample_depth(t.depth, 5)


@query("t10_split_four", PT + "piece bigint, x double, y double, z double",
       "SELECT scene_id, point_idx, point_idx % 4 AS piece, x - min(x) OVER w AS x, y - min(y) OVER w AS y, z - min(z) OVER w AS z FROM pm WINDOW w AS (PARTITION BY scene_id, point_idx % 4)", ("pm",))
def _(t):
    return sampling.split_four(t.points_m)


@query("t10_merge_four", PT + "sem_label bigint", "SELECT scene_id, point_idx, sem_label FROM points", ("points",))
def _(t):
    return sampling.merge_four(sampling.split_four(t.points_m))
