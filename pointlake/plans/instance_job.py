"""Checked queries of the instance job: proposals, predicted instances with shared masks, AP and exported files."""

from pyspark.sql import functions as F

from pointlake.operators import overlap as OV
from pointlake.operators import proposals as PR
from pointlake.plans import jobs
from pointlake.plans.clusters import C9, IOU_SCORE, MASK_SCORE, STUFF, instances
from pointlake.plans.fixtures import SPLIT
from pointlake.plans.overlaps import MIN, VALID, VISITED_HIT, ap_sql
from pointlake.plans.registry import query
from pointlake.schema import ClassSplit
from pointlake.session import cut_lineage
from pointlake.sources import readers as R
from pointlake.sources import writers as K

USES = ("pred_inst", "logits", "preds", "gt_codes")
MASKS = f"SELECT scene_id, pred_id AS mask_id, point_idx FROM pred_inst WHERE {MASK_SCORE} > -5e-1 UNION ALL SELECT scene_id, -1 - pred AS mask_id, point_idx FROM preds WHERE pred IN {STUFF}"
# class counts of the job: proposals of at least 30 points, classes 2 to 18
MIN_JOB = 30
JOB_IDS = tuple(range(3, 20))


def job_pairs(ids, least):
    return f"""WITH RECURSIVE cm AS ({C9}), mk AS ({MASKS}),
 shared AS (SELECT m.scene_id, m.mask_id, g.code, count(*) AS inter FROM mk m JOIN gt_codes g ON g.scene_id = m.scene_id AND g.point_idx = m.point_idx GROUP BY m.scene_id, m.mask_id, g.code),
 ms AS (SELECT scene_id, mask_id, sum(inter) AS n_pred, sum(CASE WHEN code // 1000 NOT IN {ids} THEN inter ELSE 0 END) AS void FROM shared GROUP BY scene_id, mask_id),
 pr AS (SELECT c.scene_id, c.pred_id, c.mask_id, c.label_id AS class_id, c.conf, s.n_pred, s.void FROM cm c JOIN ms s ON s.scene_id = c.scene_id AND s.mask_id = c.mask_id WHERE c.label_id IN {ids} AND s.n_pred >= {least}),
 gt AS (SELECT scene_id, code, code // 1000 AS class_id, count(*) AS n_gt FROM gt_codes WHERE code <> 0 AND code // 1000 IN {ids} GROUP BY scene_id, code),
 pairs AS (SELECT s.scene_id, p.pred_id, s.code, p.class_id, p.conf, s.inter, g.n_gt, p.n_pred, s.inter/CAST(g.n_gt + p.n_pred - s.inter AS DOUBLE) AS iou FROM shared s JOIN pr p ON p.scene_id = s.scene_id AND p.mask_id = s.mask_id JOIN gt g ON g.scene_id = s.scene_id AND g.code = s.code AND g.class_id = p.class_id)"""


@query("j11_shared_masks", "scene_id bigint, pred_id bigint, code bigint, inter bigint, iou double", f"{job_pairs(VALID, MIN)} SELECT * FROM pairs", USES)
def _(t):
    meta, mask = instances(t)
    return OV.evaluation_pairs(mask, meta, t.gt_codes, VALID, MIN)[2]


def inputs(t):
    """Scored proposals and mask scores, as a network would hand them over."""
    rows = t.pred_inst.withColumnRenamed("pred_id", "proposal_id")
    scores = PR.proposal_scores(rows, t.logits, 20)
    props = scores.selectExpr("scene_id", "proposal_id", "cls_scores", f"{IOU_SCORE.replace('pred_id', 'proposal_id')} AS iou_score")
    return props, rows.selectExpr("*", f"{MASK_SCORE.replace('pred_id', 'proposal_id')} AS mask_score")


JOB_SPLIT = ClassSplit(20, novel=SPLIT.novel, ignored=(0, 1, 19))
JOB_AP = ap_sql(job_pairs(JOB_IDS, MIN_JOB), VISITED_HIT.replace(f"n_gt >= {MIN}", f"n_gt >= {MIN_JOB}")).replace(f"n_gt < {MIN}", f"n_gt < {MIN_JOB}").replace(f"n_gt >= {MIN} ", f"n_gt >= {MIN_JOB} ").replace("unnest(range(1, 20))", "unnest(range(3, 20))")


@query("a14_from_proposals", "class_id bigint, thr double, ap double, rc double", f"{JOB_AP} SELECT class_id, thr, ap, rc FROM res", USES)
def _(t):
    return jobs.instances_from_proposals(*inputs(t), t.preds, t.gt_codes, JOB_SPLIT, STUFF, MIN_JOB)["ap"]


@query("t6_paint_shared_masks", "scene_id bigint, point_idx bigint, pred_id bigint, conf double",
       f"SELECT scene_id, point_idx, pred_id, conf FROM (SELECT m.scene_id, m.point_idx, c.pred_id, c.conf, row_number() OVER (PARTITION BY m.scene_id, m.point_idx ORDER BY round(c.conf, 9) DESC, c.pred_id) AS k FROM ({MASKS}) m JOIN ({C9}) c ON c.scene_id = m.scene_id AND c.mask_id = m.mask_id) q WHERE k = 1",
       ("pred_inst", "logits", "preds"))
def _(t):
    meta, mask = instances(t)
    return OV.paint_instances(mask, meta.withColumn("conf", F.round("conf", 9)))


@query("k2_mask_files", "scene_id bigint, pred_id bigint, label_id bigint, n_ones bigint, ones bigint, n_lines bigint",
       f"SELECT c.scene_id, c.pred_id, c.label_id, count(*) AS n_ones, sum(m.point_idx) AS ones, any_value(p.n) AS n_lines FROM ({C9}) c JOIN ({MASKS}) m ON m.scene_id = c.scene_id AND m.mask_id = c.mask_id JOIN (SELECT scene_id, count(*) AS n FROM preds GROUP BY scene_id) p ON p.scene_id = c.scene_id GROUP BY c.scene_id, c.pred_id, c.label_id",
       ("pred_inst", "logits", "preds"))
def _(t):
    """The manifest read back, joined with the files it names."""
    path = t.scratch("instances")
    meta, mask = (cut_lineage(d) for d in instances(t))
    K.write_pred_instances(meta, mask, path)
    K.write_mask_files(meta, mask, t.points, path)
    named = R.read_instance_manifests(t.spark, f"{path}/manifest").filter("valid").select("mask_path", "label_id")
    lines = R.read_id_lists(t.spark, f"{path}/predicted_masks/*.txt")
    sizes = lines.groupBy("scene_id").agg(F.sum("id").alias("n_ones"), F.sum(F.col("id") * F.col("point_idx")).alias("ones"), F.count(F.lit(1)).alias("n_lines"))
    files = sizes.select(F.concat(F.lit("predicted_masks/"), "scene_id", F.lit(".txt")).alias("mask_path"), "n_ones", "ones", "n_lines")
    return K.pred_manifest(meta).join(meta.select("scene_id", "pred_id", "label_id"), ["scene_id", "pred_id"]).join(named, ["mask_path", "label_id"]).join(files, "mask_path")
