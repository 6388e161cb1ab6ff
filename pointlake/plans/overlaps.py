"""Checked queries: overlaps, masks and instance AP."""

from pyspark.sql import functions as F

from pointlake.operators import instance_ap as AP
from pointlake.operators import masks as MK
from pointlake.operators import overlap as OV
from pointlake.plans.fixtures import SPLIT
from pointlake.plans.registry import query

PT = "scene_id bigint, point_idx bigint, "
MASK_PROB = "1/(1 + exp(-(((point_idx*13 + {p}*5) % 19 - 9)/6e0)))"


def iou_sql(source):
    return f"""SELECT o.scene_id, o.proposal_id, o.inst_label, o.inter, o.inter/(a.n + b.n - o.inter + 1e-5) AS iou FROM
 (SELECT q.scene_id, q.pred_id AS proposal_id, p.inst_label, count(*) AS inter FROM ({source}) q JOIN points p ON p.scene_id = q.scene_id AND p.point_idx = q.point_idx WHERE p.inst_label >= 0 GROUP BY q.scene_id, q.pred_id, p.inst_label) o
 JOIN (SELECT scene_id, pred_id, count(*) AS n FROM ({source}) q GROUP BY scene_id, pred_id) a ON a.scene_id = o.scene_id AND a.pred_id = o.proposal_id
 JOIN (SELECT scene_id, inst_label, count(*) AS n FROM points WHERE inst_label >= 0 GROUP BY scene_id, inst_label) b ON b.scene_id = o.scene_id AND b.inst_label = o.inst_label"""


IOU = iou_sql("SELECT * FROM pred_inst")
IOU_ON = iou_sql(f"SELECT * FROM pred_inst WHERE {MASK_PROB.format(p='pred_id')} > 5e-1")
BOTH = ("points", "pred_inst")


def props(t):
    return t.pred_inst.withColumnRenamed("pred_id", "proposal_id")


def ious(t):
    return OV.proposal_iou(props(t), t.points)


@query("j9_proposal_iou", "scene_id bigint, proposal_id bigint, inst_label bigint, inter bigint, iou double", IOU, BOTH)
def _(t):
    return ious(t)


@query("j10_masked_iou", "scene_id bigint, proposal_id bigint, inst_label bigint, inter bigint, iou double", IOU_ON, BOTH)
def _(t):
    return OV.proposal_iou(props(t), t.points, F.expr(MASK_PROB.format(p="proposal_id")) > 0.5)


BEST = f"SELECT scene_id, proposal_id, inst_label AS best_inst, iou AS best_iou FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, proposal_id ORDER BY iou DESC, inst_label) AS k FROM ({IOU}) i) q WHERE k = 1"


@query("t2_best_gt", "scene_id bigint, proposal_id bigint, best_inst bigint, best_iou double", BEST, BOTH)
def _(t):
    return OV.best_gt(ious(t))


@query("t2_best_gt_of_base", "scene_id bigint, proposal_id bigint, best_inst bigint, best_iou double",
       f"SELECT scene_id, proposal_id, inst_label AS best_inst, iou AS best_iou FROM (SELECT i.*, row_number() OVER (PARTITION BY i.scene_id, proposal_id ORDER BY iou DESC, i.inst_label) AS k FROM ({IOU}) i JOIN (SELECT DISTINCT scene_id, inst_label FROM points WHERE sem_label IN {SPLIT.base}) c ON c.scene_id = i.scene_id AND c.inst_label = i.inst_label) q WHERE k = 1", BOTH)
def _(t):
    from pointlake.operators.instances import instance_stats
    cls = instance_stats(t.points_m).select("scene_id", "inst_label", F.when(F.col("inst_class").isin(*SPLIT.base), F.col("inst_class")).otherwise(-100).alias("inst_class"))
    return OV.best_gt(ious(t), cls)


@query("t3_mask_targets", PT + "proposal_id bigint, mask_label bigint",
       f"SELECT q.scene_id, q.point_idx, q.pred_id AS proposal_id, CASE WHEN best_iou >= 85e-2 THEN CASE WHEN p.inst_label = best_inst THEN 1 ELSE 0 END ELSE -1 END AS mask_label FROM pred_inst q JOIN points p ON p.scene_id = q.scene_id AND p.point_idx = q.point_idx LEFT JOIN ({BEST}) b ON b.scene_id = q.scene_id AND b.proposal_id = q.pred_id", BOTH)
def _(t):
    return OV.mask_targets(props(t), t.points, OV.best_gt(ious(t)), 0.85)


@query("t4_assign_proposals", "scene_id bigint, proposal_id bigint, assigned bigint",
       f"SELECT scene_id, proposal_id, best_inst AS assigned FROM ({BEST}) b WHERE best_iou >= 85e-2", BOTH)
def _(t):
    return OV.assign_proposals(ious(t), 0.85)


RESCUE = f"""SELECT coalesce(a.scene_id, r.scene_id) AS scene_id, coalesce(a.proposal_id, r.proposal_id) AS proposal_id, coalesce(r.inst_label, a.best_inst) AS assigned FROM (SELECT * FROM ({BEST}) b WHERE best_iou >= 95e-2) a FULL JOIN
 (SELECT scene_id, proposal_id, max(inst_label) AS inst_label FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, inst_label ORDER BY iou DESC, proposal_id) AS k FROM ({IOU}) i) q WHERE k = 1 AND iou >= 2e-1 GROUP BY scene_id, proposal_id) r ON r.scene_id = a.scene_id AND r.proposal_id = a.proposal_id"""


@query("t4_assign_with_rescue", "scene_id bigint, proposal_id bigint, assigned bigint", RESCUE, BOTH)
def _(t):
    return OV.assign_proposals(ious(t), 0.95, 0.2)


SPREAD = "SELECT scene_id, point_idx, pred_id FROM pred_inst UNION ALL SELECT scene_id, point_idx, inst_label + 8 FROM points WHERE inst_label >= 0"


@query("t6_paint_instances", PT + "pred_id bigint, conf double",
       f"SELECT scene_id, point_idx, pred_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, point_idx ORDER BY conf DESC, pred_id) AS k FROM (SELECT *, ((pred_id*7 + scene_id*3) % 10 + 1)/10e0 AS conf FROM ({SPREAD}) s) c) q WHERE k = 1", ("pred_inst", "points"))
def _(t):
    mask = t.pred_inst.unionByName(t.points.filter("inst_label >= 0").selectExpr("scene_id", "point_idx", "inst_label + 8 AS pred_id"))
    meta = mask.select("scene_id", "pred_id").distinct().selectExpr("*", "((pred_id*7 + scene_id*3) % 10 + 1)/10e0 AS conf")
    return OV.paint_instances(mask, meta)


SEM_MASK = "SELECT scene_id, pred AS pred_id, point_idx FROM preds"
RUNS = f"SELECT scene_id, pred_id, min(point_idx) + 1 AS start, count(*) AS length FROM (SELECT *, point_idx - row_number() OVER (PARTITION BY scene_id, pred_id ORDER BY point_idx) AS g FROM ({SEM_MASK}) m) q GROUP BY scene_id, pred_id, g"


def wide_mask(t):
    return t.preds.selectExpr("scene_id", "pred + 0 AS pred_id", "point_idx")


@query("w8_mask_runs", "scene_id bigint, pred_id bigint, start bigint, length bigint", RUNS, ("preds",))
def _(t):
    return MK.mask_runs(wide_mask(t), bits=4)


@query("w8_encode", "scene_id bigint, pred_id bigint, counts string",
       f"SELECT scene_id, pred_id, string_agg(concat(start, ' ', length), ' ' ORDER BY start) AS counts FROM ({RUNS}) r GROUP BY scene_id, pred_id", ("preds",))
def _(t):
    return MK.encode_runs(MK.mask_runs(wide_mask(t)))


@query("w8_decode", "scene_id bigint, pred_id bigint, point_idx bigint", SEM_MASK, ("preds",))
def _(t):
    return MK.decode_runs(MK.encode_runs(MK.mask_runs(wide_mask(t))))


MIN = 50
VALID = tuple(range(1, 20))
EV = f"""WITH shared AS (SELECT q.scene_id, q.pred_id, g.code, count(*) AS inter FROM pred_inst q JOIN gt_codes g ON g.scene_id = q.scene_id AND g.point_idx = q.point_idx GROUP BY q.scene_id, q.pred_id, g.code),
 pr AS (SELECT m.scene_id, m.pred_id, m.class_id + 1 AS class_id, m.conf, s.n_pred, s.void FROM pred_meta m JOIN (SELECT scene_id, pred_id, sum(inter) AS n_pred, sum(CASE WHEN code // 1000 NOT IN {VALID} THEN inter ELSE 0 END) AS void FROM shared GROUP BY scene_id, pred_id) s ON s.scene_id = m.scene_id AND s.pred_id = m.pred_id WHERE m.class_id + 1 IN {VALID} AND n_pred >= {MIN}),
 gt AS (SELECT scene_id, code, code // 1000 AS class_id, count(*) AS n_gt FROM gt_codes WHERE code <> 0 AND code // 1000 IN {VALID} GROUP BY scene_id, code),
 pairs AS (SELECT s.scene_id, s.pred_id, s.code, p.class_id, p.conf, s.inter, g.n_gt, p.n_pred, s.inter/CAST(g.n_gt + p.n_pred - s.inter AS DOUBLE) AS iou FROM shared s JOIN pr p ON p.scene_id = s.scene_id AND p.pred_id = s.pred_id JOIN gt g ON g.scene_id = s.scene_id AND g.code = s.code AND g.class_id = p.class_id)"""
USES = ("pred_inst", "gt_codes", "pred_meta")


def evaluation(t, min_points=MIN):
    meta = t.pred_meta.selectExpr("scene_id", "pred_id", "class_id + 1 AS label_id", "conf")
    return OV.evaluation_pairs(t.pred_inst, meta, t.gt_codes, VALID, min_points)


@query("j11_evaluation_pairs", "scene_id bigint, pred_id bigint, code bigint, inter bigint, iou double", f"{EV} SELECT * FROM pairs", USES)
def _(t):
    return evaluation(t)[2]


# Where no prediction meets two instances the best confidence is the hit.
BEST_HIT = f"hit AS (SELECT *, row_number() OVER (PARTITION BY scene_id, code, thr ORDER BY conf DESC, pred_id) AS k FROM ov WHERE code >= 1000 AND n_gt >= {MIN})"
# Where predictions meet several instances: instances by code, predictions by id, the first free one claims the instance.
VISITED_HIT = f"""cand AS (SELECT scene_id, class_id, thr, code, pred_id, conf FROM ov WHERE code >= 1000 AND n_gt >= {MIN}),
 grp AS (SELECT scene_id, class_id, thr, code, list(pred_id ORDER BY pred_id) AS ps, row_number() OVER (PARTITION BY scene_id, class_id, thr ORDER BY code) AS place FROM cand GROUP BY scene_id, class_id, thr, code),
 visit AS (SELECT DISTINCT scene_id, class_id, thr, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS code, CAST([] AS BIGINT[]) AS free, CAST([] AS BIGINT[]) AS taken FROM grp
   UNION ALL SELECT scene_id, class_id, thr, place, code, free, CASE WHEN len(free) > 0 THEN list_append(taken, free[1]) ELSE taken END FROM (
     SELECT g.scene_id, g.class_id, g.thr, g.place, g.code, list_filter(g.ps, lambda p: NOT list_contains(v.taken, p)) AS free, v.taken
     FROM visit v JOIN grp g ON g.scene_id = v.scene_id AND g.class_id = v.class_id AND g.thr = v.thr AND g.place = v.place + 1) n),
 hit AS (SELECT c.*, row_number() OVER (PARTITION BY c.scene_id, c.code, c.thr ORDER BY c.conf DESC, c.pred_id) AS k FROM cand c JOIN (SELECT scene_id, class_id, thr, code, unnest(free) AS pred_id FROM visit) f
   ON f.scene_id = c.scene_id AND f.class_id = c.class_id AND f.thr = c.thr AND f.code = c.code AND f.pred_id = c.pred_id)"""


def ap_sql(pairs, hit):
    return f"""{pairs}, thr AS (SELECT unnest([5e-1, 55e-2, 6e-1, 65e-2, 7e-1, 75e-2, 8e-1, 85e-2, 9e-1, 25e-2]) AS thr),
 ov AS (SELECT * FROM pairs, thr WHERE iou > thr),
 {hit},
 ig AS (SELECT scene_id, pred_id, sum(CASE WHEN n_gt < {MIN} THEN inter ELSE 0 END) AS ig FROM pairs GROUP BY scene_id, pred_id),
 ev AS (SELECT class_id, thr, conf AS score, CASE WHEN k = 1 THEN 1 ELSE 0 END AS tp FROM hit UNION ALL
   SELECT p.class_id, thr.thr, p.conf, 0 FROM pr p CROSS JOIN thr LEFT JOIN ig ON ig.scene_id = p.scene_id AND ig.pred_id = p.pred_id
   WHERE NOT EXISTS (SELECT 1 FROM ov o WHERE o.scene_id = p.scene_id AND o.pred_id = p.pred_id AND o.thr = thr.thr) AND (p.void + coalesce(ig.ig, 0))/CAST(p.n_pred AS DOUBLE) <= thr.thr),
 miss AS (SELECT g.class_id, thr.thr, g.n - coalesce(h.n, 0) AS missed FROM (SELECT class_id, count(*) AS n FROM gt WHERE n_gt >= {MIN} GROUP BY class_id) g CROSS JOIN thr LEFT JOIN (SELECT class_id, thr, count(*) AS n FROM hit WHERE k = 1 GROUP BY class_id, thr) h ON h.class_id = g.class_id AND h.thr = thr.thr),
 st AS (SELECT class_id, thr, score, sum(tp) AS tp, count(*) AS n FROM ev GROUP BY class_id, thr, score),
 cu AS (SELECT s.class_id, s.thr, s.score, coalesce(sum(tp) OVER w, 0) AS c, coalesce(sum(n) OVER w, 0) AS k, sum(tp) OVER a AS t_all, sum(n) OVER a AS n_all, m.missed FROM st s JOIN miss m ON m.class_id = s.class_id AND m.thr = s.thr
   WINDOW w AS (PARTITION BY s.class_id, s.thr ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY s.class_id, s.thr)),
 pt AS (SELECT class_id, thr, score, CAST(t_all - c AS DOUBLE)/(n_all - k) AS p, CAST(t_all - c AS DOUBLE)/(t_all + missed) AS r FROM cu),
 full_pt AS (SELECT * FROM pt UNION ALL SELECT DISTINCT class_id, thr, CAST('Infinity' AS DOUBLE), 1e0, 0e0 FROM pt),
 nb AS (SELECT *, coalesce(lag(r) OVER w, r) AS r_before, coalesce(lead(r) OVER w, 0e0) AS r_after FROM full_pt WINDOW w AS (PARTITION BY class_id, thr ORDER BY score)),
 ap AS (SELECT class_id, thr, sum(p*5e-1*(r_before - r_after)) AS ap, max(r) AS rc FROM nb GROUP BY class_id, thr),
 res AS (SELECT v.class_id, thr.thr, CASE WHEN m.class_id IS NULL THEN CAST('NaN' AS DOUBLE) ELSE coalesce(ap.ap, 0e0) END AS ap, CASE WHEN m.class_id IS NULL THEN CAST('NaN' AS DOUBLE) ELSE coalesce(ap.rc, 0e0) END AS rc
   FROM (SELECT unnest(range(1, 20)) AS class_id) v CROSS JOIN thr LEFT JOIN miss m ON m.class_id = v.class_id AND m.thr = thr.thr LEFT JOIN ap ON ap.class_id = v.class_id AND ap.thr = thr.thr)"""


AP_SQL = ap_sql(EV, BEST_HIT)


def ap_table(t):
    return AP.average_precision(*evaluation(t), VALID, MIN)


@query("w4_precision_recall", "class_id bigint, thr double, score double, p double, r double", f"{AP_SQL} SELECT * FROM pt", USES)
def _(t):
    curve = AP.precision_recall(*AP.match_events(*evaluation(t), MIN))
    return curve.withColumnsRenamed({"precision": "p", "recall": "r"})


@query("a14_average_precision", "class_id bigint, thr double, ap double, rc double", f"{AP_SQL} SELECT class_id, thr, ap, rc FROM res", USES)
def _(t):
    return ap_table(t)


PER_CLASS = ", ".join(f"avg({c}) FILTER (WHERE thr <> 25e-2) AS {c}, avg({c}) FILTER (WHERE thr = 5e-1) AS {c}50, avg({c}) FILTER (WHERE thr = 25e-2) AS {c}25" for c in ("ap", "rc"))
OVERALL = ", ".join(f"avg({c}) FILTER (WHERE NOT isnan({c}) AND {w}) AS all_{c}{n}" for c in ("ap", "rc") for n, w in (("", "thr <> 25e-2"), ("50", "thr = 5e-1"), ("25", "thr = 25e-2")))


@query("a15_class_averages", "class_id bigint, ap double, ap50 double, ap25 double, rc double, rc50 double, rc25 double", f"{AP_SQL} SELECT class_id, {PER_CLASS} FROM res GROUP BY class_id", USES)
def _(t):
    return AP.class_averages(ap_table(t))


@query("a15_overall_averages", "all_ap double, all_ap50 double, all_ap25 double, all_rc double, all_rc50 double, all_rc25 double", f"{AP_SQL} SELECT {OVERALL} FROM res", USES)
def _(t):
    return AP.overall_averages(ap_table(t))


SIDES = ", ".join(f"avg({c}) FILTER (WHERE class_id - 1 IN {ids} AND NOT isnan({c})) AS {c}_{n}" for c in ("ap", "ap50", "ap25") for n, ids in (("base", SPLIT.base), ("novel", SPLIT.novel)))


@query("a16_open_vocab_ap", "ap_base double, ap_novel double, ap50_base double, ap50_novel double, ap25_base double, ap25_novel double, hap50 double",
       f"{AP_SQL} SELECT *, 2*ap50_base*ap50_novel/(ap50_base + ap50_novel + 1e-9) AS hap50 FROM (SELECT {SIDES} FROM (SELECT class_id, {PER_CLASS} FROM res GROUP BY class_id) c) s", USES)
def _(t):
    return AP.open_vocab_ap(AP.class_averages(ap_table(t)), SPLIT)


# Wide predictions cover two instances of their class, narrow ones compete with them.
WIDE = "SELECT scene_id, point_idx, point_idx % 4 AS pred_id FROM points WHERE r >= 9 UNION ALL SELECT scene_id, point_idx, 4 + point_idx % 8 AS pred_id FROM points WHERE r >= 40"
WIDE_CLASS = "((CASE WHEN pred_id < 4 THEN pred_id ELSE pred_id - 4 END)*5 + scene_id) % 20"
WIDE_CONF = "((pred_id*7 + scene_id*3) % 10 + 1)/10e0"
EV_WIDE = EV.replace("pred_inst q", f"({WIDE}) q").replace("FROM pred_meta m", f"FROM (SELECT scene_id, pred_id, {WIDE_CONF} AS conf, {WIDE_CLASS} AS class_id FROM (SELECT DISTINCT scene_id, pred_id FROM ({WIDE}) x) y) m").replace("WITH", "WITH RECURSIVE", 1)


@query("a14_contested_visits", "class_id bigint, thr double, ap double, rc double", f"{ap_sql(EV_WIDE, VISITED_HIT)} SELECT class_id, thr, ap, rc FROM res", ("points", "gt_codes"))
def _(t):
    mask = t.points.filter("r >= 9").selectExpr("scene_id", "point_idx", "point_idx % 4 AS pred_id").unionByName(
        t.points.filter("r >= 40").selectExpr("scene_id", "point_idx", "4 + point_idx % 8 AS pred_id"))
    meta = mask.select("scene_id", "pred_id").distinct().selectExpr("scene_id", "pred_id", f"{WIDE_CLASS} + 1 AS label_id", f"{WIDE_CONF.replace('10e0', '10D')} AS conf")
    return AP.average_precision(*OV.evaluation_pairs(mask, meta, t.gt_codes, VALID, MIN), VALID, MIN)
