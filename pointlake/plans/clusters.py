"""Checked queries: radius graph, components, proposals and predicted instances."""

from pyspark.sql import functions as F

from pointlake.functions.vectors import softmax
from pointlake.operators import components, proposals as PR, radius, sampling
from pointlake.operators.calibrate import calibrate
from pointlake.plans import draws
from pointlake.plans.fixtures import SPLIT
from pointlake.plans.vectors import NB
from pointlake.plans.registry import query

PT = "scene_id bigint, point_idx bigint, "
R = 40
MM = "SELECT scene_id, point_idx, sem_label AS class_id, x_mm AS x, y_mm AS y, z_mm AS z, r, g, b FROM points"
NEAR = "(a.x - b.x)*(a.x - b.x) + (a.y - b.y)*(a.y - b.y) + (a.z - b.z)*(a.z - b.z) < {r2}"


def mm(t):
    """Points with millimetre coordinates as doubles, and their class."""
    return t.points.selectExpr("scene_id", "point_idx", "sem_label AS class_id", "double(x_mm) AS x", "double(y_mm) AS y", "double(z_mm) AS z", "r", "g", "b")


@query("j4_radius_neighbours", "scene_id bigint, src bigint, dst bigint",
       f"SELECT a.scene_id, a.point_idx AS src, b.point_idx AS dst FROM ({MM}) a JOIN ({MM}) b ON a.scene_id = b.scene_id AND {NEAR.format(r2=R*R)}", ("points",))
def _(t):
    return radius.radius_neighbours(mm(t), float(R))


@query("j4_capped_neighbours", "scene_id bigint, src bigint, dst bigint",
       f"SELECT scene_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, src ORDER BY dst) AS k FROM (SELECT a.scene_id, a.point_idx AS src, b.point_idx AS dst FROM ({MM}) a JOIN ({MM}) b ON a.scene_id = b.scene_id AND {NEAR.format(r2=R*R)}) p) q WHERE k <= 5", ("points",))
def _(t):
    return radius.radius_neighbours(mm(t), float(R), cap=5)


PROB = "SELECT scene_id, point_idx, class_id, exp(logit)/sum(exp(logit)) OVER (PARTITION BY scene_id, point_idx) AS prob FROM logits"
CAND = f"SELECT scene_id, point_idx, class_id, prob FROM (SELECT *, count(*) OVER (PARTITION BY scene_id, class_id) AS n FROM ({PROB}) p WHERE prob > 2e-1 AND class_id NOT IN (0, 1)) q WHERE n >= 50"


@query("c5_class_candidates", PT + "class_id bigint, prob double", CAND, ("logits",))
def _(t):
    return PR.class_candidates(t.logits.withColumn("probs", softmax(F.col("logits"))), "probs", 0.2, (0, 1), 50)


# points without an instance are candidates too: their offset is a constant here
SHIFT = "SELECT p.scene_id, p.point_idx, p.x + coalesce((mx - p.x)*5e-1, 25e-2) AS x, p.y + coalesce((my - p.y)*5e-1, 25e-2) AS y, p.z + coalesce((mz - p.z)*5e-1, 25e-2) AS z FROM pm p LEFT JOIN (SELECT scene_id, inst_label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pm WHERE inst_label >= 0 GROUP BY scene_id, inst_label) i ON i.scene_id = p.scene_id AND i.inst_label = p.inst_label"


@query("c6_shift_by_offset", PT + "x double, y double, z double", SHIFT, ("pm",))
def _(t):
    from pointlake.operators.instances import centre_offsets
    pts = centre_offsets(t.points_m)
    for c in "xyz":
        pts = pts.withColumn(f"pred_off_{c}", F.coalesce(F.col(f"off_{c}") * 0.5, F.lit(0.25)))
    return PR.shift_by_offset(pts)


MIN_SIZE = 10
# components by growing reachability: the least reachable index labels a point
LABELS = f"""SELECT scene_id, class_id, src AS point_idx, min(dst) AS label FROM reach GROUP BY scene_id, class_id, src"""
REACH = f"""WITH RECURSIVE v AS (SELECT * FROM ({MM}) m WHERE class_id >= 0), e AS (SELECT a.scene_id, a.class_id, a.point_idx AS src, b.point_idx AS dst FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.class_id = b.class_id AND {NEAR.format(r2=R*R)}),
 reach AS (SELECT * FROM e UNION SELECT r.scene_id, r.class_id, r.src, e.dst FROM reach r JOIN e ON e.scene_id = r.scene_id AND e.class_id = r.class_id AND e.src = r.dst)"""
CLUSTERS = f"SELECT *, count(*) OVER (PARTITION BY scene_id, class_id, label) AS size FROM ({LABELS}) l QUALIFY size >= {MIN_SIZE}"


def clusters(t, **kw):
    return components.cluster_points(mm(t).filter("class_id >= 0"), float(R), MIN_SIZE, **kw)


@query("c7_components", PT + "class_id bigint, label bigint, size bigint", f"{REACH} {CLUSTERS}", ("points",))
def _(t):
    return clusters(t)


@query("c7_components_refined", PT + "class_id bigint, label bigint, size bigint", f"{REACH} {CLUSTERS}", ("points",))
def _(t):
    # the same result through the splitting of crowded cells
    return clusters(t, direct_limit=1)


@query("c7_class_mean_threshold", PT + "class_id bigint, label bigint, size bigint",
       f"{REACH} SELECT *, count(*) OVER (PARTITION BY scene_id, class_id, label) AS size FROM ({LABELS}) l QUALIFY size >= CASE WHEN class_id < 10 THEN 3e-1 ELSE 3e-1*(class_id*2) END", ("points",))
def _(t):
    means = [-1.0 if c < 10 else c * 2.0 for c in range(20)]
    return components.cluster_points(mm(t).filter("class_id >= 0"), float(R), components.size_threshold(F.col("class_id"), means, 0.3))


NUMBERED = f"SELECT c.*, dense_rank() OVER (PARTITION BY scene_id ORDER BY class_id, label) - 1 AS proposal_id FROM ({CLUSTERS}) c"


def members(t):
    return PR.number_proposals(clusters(t))


@query("w3_number_proposals", PT + "class_id bigint, proposal_id bigint", f"{REACH} {NUMBERED}", ("points",))
def _(t):
    return members(t)


@query("t5_first_proposals", PT + "proposal_id bigint", f"{REACH} SELECT * FROM ({NUMBERED}) n WHERE proposal_id < 3", ("points",))
def _(t):
    return sampling.first_proposals(members(t), 3)


@query("c8_proposal_scores", "scene_id bigint, proposal_id bigint, class_pos bigint, score double",
       f"{REACH} SELECT n.scene_id, n.proposal_id, l.class_id - 2 AS class_pos, avg(l.logit) AS score FROM ({NUMBERED}) n JOIN logits l ON l.scene_id = n.scene_id AND l.point_idx = n.point_idx WHERE l.class_id >= 2 GROUP BY n.scene_id, n.proposal_id, l.class_id", ("points", "logits"))
def _(t):
    out = PR.proposal_scores(members(t), t.logits, 20, label_shift=2)
    return out.select("scene_id", "proposal_id", F.posexplode("cls_scores").alias("class_pos", "score"))


# coordinates in metres: a proposal of less than 100 grid lengths fits its grid
INST = "SELECT q.scene_id, q.pred_id AS proposal_id, q.point_idx, p.x_mm/1e3 AS x, p.y_mm/1e3 AS y, p.z_mm/1e3 AS z, p.r FROM pred_inst q JOIN points p ON p.scene_id = q.scene_id AND p.point_idx = q.point_idx"
SCALED = f"""SELECT *, least(2e1, 1/(greatest(hx - lx, hy - ly, hz - lz)/12) - 1e-2) AS s FROM (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy, min(z) OVER w AS lz, max(z) OVER w AS hz
 FROM ({INST}) i WINDOW w AS (PARTITION BY scene_id, proposal_id)) a"""


def revoxelised(*shifts):
    cells = ", ".join(f"CAST(floor({c}*s - l{c}*s + {m}) AS BIGINT) AS v{c}" for c, m in zip("xyz", shifts))
    rows = f"SELECT scene_id, proposal_id, vx, vy, vz, avg(r) AS r, count(*) AS n_points, min(point_idx) AS first_idx FROM (SELECT scene_id, proposal_id, point_idx, r, {cells} FROM ({SCALED}) b) c GROUP BY scene_id, proposal_id, vx, vy, vz"
    return f"SELECT *, row_number() OVER (PARTITION BY scene_id, proposal_id ORDER BY first_idx) - 1 AS voxel_id FROM ({rows}) v"


def shift_sql(axis, c, seed):
    wide, tight = [draws.uniform(seed + 2*axis + k, "scene_id", "proposal_id") for k in (0, 1)]
    room = f"(12e0 - (h{c} - l{c})*s"
    return f"(greatest({room} - 1e-3), 0e0)*{wide} + least({room} + 1e-3), 0e0)*{tight})"


V8 = "scene_id bigint, proposal_id bigint, vx bigint, vy bigint, vz bigint, r double, n_points bigint, voxel_id bigint"


def instance_members(t):
    metres = mm(t).selectExpr("scene_id", "point_idx", "r", *[f"{c}/1e3D AS {c}" for c in "xyz"])
    return t.pred_inst.withColumnRenamed("pred_id", "proposal_id").join(metres, ["scene_id", "point_idx"])


@query("v8_revoxelise_proposals", V8, revoxelised("0", "0", "0"), ("points", "pred_inst"))
def _(t):
    return PR.revoxelise(instance_members(t), ["r"], 20.0, 12)[0]


@query("v8_random_shift", V8, revoxelised(*[shift_sql(i, c, 23) for i, c in enumerate("xyz")]), ("points", "pred_inst"))
def _(t):
    return PR.revoxelise(instance_members(t), ["r"], 20.0, 12, seed=23)[0]


MASK_SCORE = "((point_idx*13 + pred_id*5) % 19 - 9)/6e0"
IOU_SCORE = "((pred_id*3 + scene_id) % 7 - 3)/2e0"
STUFF = (3, 7)
BASE_SCORE = "((mask_id*5 + scene_id*3) % 11 - 5)/4e0"
MEANS = "SELECT q.scene_id, q.pred_id AS mask_id, l.class_id, avg(l.logit) AS s FROM pred_inst q JOIN logits l ON l.scene_id = q.scene_id AND l.point_idx = q.point_idx GROUP BY q.scene_id, q.pred_id, l.class_id"
C9 = f"""SELECT scene_id, class_id + 1 AS label_id, conf, mask_id, n, row_number() OVER (PARTITION BY scene_id ORDER BY class_id, mask_id) - 1 AS pred_id FROM (
 SELECT m.scene_id, m.class_id, m.mask_id, p*(1/(1 + exp(-({IOU_SCORE.replace('pred_id', 'm.mask_id').replace('scene_id', 'm.scene_id')})))) AS conf, n FROM (SELECT scene_id, mask_id, class_id, exp(s)/sum(exp(s)) OVER (PARTITION BY scene_id, mask_id) AS p FROM ({MEANS}) a) m
 JOIN (SELECT scene_id, pred_id AS mask_id, count(*) AS n FROM pred_inst WHERE {MASK_SCORE} > -5e-1 GROUP BY scene_id, pred_id) k ON k.scene_id = m.scene_id AND k.mask_id = m.mask_id WHERE p > 1e-3 AND n >= 30 AND class_id >= 2 AND class_id NOT IN {STUFF}
 UNION ALL SELECT scene_id, pred AS class_id, -1 - pred AS mask_id, 1e0 AS conf, count(*) AS n FROM preds WHERE pred IN {STUFF} GROUP BY scene_id, pred) u"""


def instances(t):
    rows = t.pred_inst.withColumnRenamed("pred_id", "proposal_id")
    scores = PR.proposal_scores(rows, t.logits, 20)
    props = scores.selectExpr("scene_id", "proposal_id", "cls_scores", f"{IOU_SCORE.replace('pred_id', 'proposal_id')} AS iou_score")
    masks = rows.selectExpr("*", f"{MASK_SCORE.replace('pred_id', 'proposal_id')} AS mask_score")
    return PR.predicted_instances(props, masks, t.preds, range(2, 20), STUFF, min_points=30)


@query("c9_predicted_instances", "scene_id bigint, pred_id bigint, label_id bigint, conf double, mask_id bigint", C9, ("pred_inst", "logits", "preds"))
def _(t):
    return instances(t)[0]


@query("c9_instance_masks", "scene_id bigint, pred_id bigint, n bigint", f"SELECT scene_id, pred_id, n FROM ({C9}) c", ("pred_inst", "logits", "preds"))
def _(t):
    meta, mask = instances(t)
    sizes = mask.groupBy("scene_id", "mask_id").agg(F.count("*").alias("n"))
    return meta.join(sizes, ["scene_id", "mask_id"])


CAL_MEANS = f"""SELECT scene_id, mask_id, class_id, CASE WHEN side IS NULL THEN 0e0 ELSE p/sum(CASE WHEN side IS NULL THEN 0e0 ELSE p END) OVER (PARTITION BY scene_id, mask_id) END AS p FROM (
 SELECT *, exp(s)/sum(exp(s)) OVER (PARTITION BY scene_id, mask_id, side)*CASE WHEN side = 'b' THEN b ELSE 1 - b END AS p FROM (
 SELECT *, {NB} AS side, 1/(1 + exp(-({BASE_SCORE}))) AS b FROM ({MEANS}) m) x) y"""


@query("c9_calibrated_classes", "scene_id bigint, mask_id bigint, label_id bigint, conf double",
       f"""SELECT m.scene_id, m.mask_id, m.class_id + 1 AS label_id, p*(1/(1 + exp(-({IOU_SCORE.replace('pred_id', 'm.mask_id').replace('scene_id', 'm.scene_id')})))) AS conf FROM ({CAL_MEANS}) m
       JOIN (SELECT scene_id, pred_id AS mask_id, count(*) AS n FROM pred_inst WHERE {MASK_SCORE} > -5e-1 GROUP BY scene_id, pred_id) k ON k.scene_id = m.scene_id AND k.mask_id = m.mask_id WHERE p > 1e-3 AND n >= 30 AND class_id >= 2""",
       ("pred_inst", "logits"))
def _(t):
    rows = t.pred_inst.withColumnRenamed("pred_id", "proposal_id")
    scores = PR.proposal_scores(rows, t.logits, 20)
    props = scores.selectExpr("scene_id", "proposal_id", "cls_scores", f"{IOU_SCORE.replace('pred_id', 'proposal_id')} AS iou_score")
    props = props.withColumn("probs", calibrate(F.col("cls_scores"), F.expr(BASE_SCORE.replace("mask_id", "proposal_id")), SPLIT))
    masks = rows.selectExpr("*", f"{MASK_SCORE.replace('pred_id', 'proposal_id')} AS mask_score")
    return PR.predicted_instances(props, masks, t.preds, range(2, 20), min_points=30, probs="probs")[0]
