"""Point-cloud views over the base tables, as Spark plans and as SQL common table expressions.

A scene is 1000 consecutive order keys, so the number of scenes grows with the data; coordinates are
integer millimetres.  Classes 5, 9, 12 and 16 are novel, 19 is ignored, the others are base.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.operators import projection
from pointlake.schema import ClassSplit
from pointlake.session import cut_lineage, use_checkpoint_dir

N_CLASSES = 20
SPLIT = ClassSplit(N_CLASSES, novel=(5, 9, 12, 16), ignored=(19,))
N_FRAMES = 6
PIXELS = 24 * 32
CELL_M = 0.5

SCENE = "CAST((o_orderkey - o_orderkey % 1000)/1000 AS BIGINT)"
POINT_COLS = [
    "o_orderkey AS point_id", f"{SCENE} AS scene_id", "o_orderkey % 1000 AS point_idx",
    "CASE WHEN o_orderkey % 17 = 0 THEN CAST(-100 AS BIGINT) ELSE o_orderkey % 8 END AS inst_label",
    f"CASE WHEN o_orderkey % 17 = 0 THEN CAST(-100 AS BIGINT) ELSE CAST(((o_orderkey % 8)*5 + {SCENE}) % 20 AS BIGINT) END AS sem_label",
    "(o_orderkey % 4)*1000 + (o_orderkey*7919)%161 AS x_mm",
    "CASE WHEN o_orderkey % 8 >= 4 THEN 1000 ELSE 0 END + (o_orderkey*104729)%161 AS y_mm",
    "(o_orderkey*1299709)%157 AS z_mm",
    "o_custkey % 256 AS r", "(o_custkey*7) % 256 AS g", "(o_custkey*13) % 256 AS b",
]
METRE_COLS = ["x_mm/1e3 AS x", "y_mm/1e3 AS y", "z_mm/1e3 AS z"]
PRED = ("CASE WHEN sem_label < 0 THEN CAST(0 AS BIGINT) "
        "WHEN (point_idx*7919 + scene_id*31) % 101 < 5 + 10*(sem_label % 5) + (CASE WHEN sem_label IN (5,9,12,16) THEN 20 ELSE 0 END) "
        "THEN (sem_label + 1) % 20 ELSE sem_label END")
FRAME_COLS = ["{k}*500 AS tx_mm", "30e0 AS fx", "30e0 AS fy", "16e0 AS cx", "12e0 AS cy", "24 AS h", "32 AS w"]
DEPTH = ("CASE WHEN (u*7 + v*3 + frame) % 11 = 0 THEN 0e0 "
         "WHEN (u*5 + v + scene_id) % 7 = 0 THEN 12e-1 ELSE 208e-2 END")
LOGIT = "((point_idx*31 + {c}*17 + scene_id*7) % 97)/16e0 + CASE WHEN {c} = pred THEN 8e0 ELSE 0e0 END"
PRED_INST = "CASE WHEN point_idx % 23 = 0 THEN (point_idx + 1) % 8 ELSE point_idx % 8 END"
CONF = "((pred_id*7 + scene_id*3) % 10 + 1)/10e0"
PRED_CLASS = "(pred_id*5 + scene_id) % 20"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "points": ((), f"SELECT {', '.join(POINT_COLS)} FROM orders"),
    "pm": (("points",), f"SELECT *, {', '.join(METRE_COLS)} FROM points"),
    "preds": (("points",), f"SELECT scene_id, point_idx, sem_label AS gt, {PRED} AS pred FROM points"),
    "ids": ((), f"SELECT range AS class_id FROM range({N_CLASSES})"),
    "logits": (("preds", "ids"), "SELECT p.scene_id, p.point_idx, p.gt, p.pred, c.class_id, "
               f"{LOGIT.format(c='c.class_id').replace('point_idx', 'p.point_idx').replace('scene_id', 'p.scene_id').replace('pred', 'p.pred')} AS logit "
               "FROM preds p CROSS JOIN ids c"),
    "frames": (("points",), "SELECT s.scene_id, f.range AS frame, "
               f"{', '.join(FRAME_COLS).format(k='f.range')} FROM (SELECT DISTINCT scene_id FROM points) s CROSS JOIN range({N_FRAMES}) f"),
    "depth": (("frames",), f"SELECT scene_id, frame, u, v, {DEPTH} AS depth FROM (SELECT f.scene_id, f.frame, "
              f"k.range % 32 AS u, CAST((k.range - k.range % 32)/32 AS BIGINT) AS v FROM frames f CROSS JOIN range({PIXELS}) k) d"),
    "proj": (("points", "frames"), "SELECT *, CAST(trunc((x_mm - tx_mm)/1e3*fx/d+cx+5e-1) AS BIGINT) AS u, "
             "CAST(trunc((y_mm - 500)/1e3*fy/d+cy+5e-1) AS BIGINT) AS v FROM (SELECT p.scene_id, f.frame, p.point_idx, "
             "p.x_mm, p.y_mm, f.tx_mm, f.fx, f.fy, f.cx, f.cy, f.h, f.w, (p.z_mm+2000)/1e3 AS d "
             "FROM points p JOIN frames f ON p.scene_id=f.scene_id) q"),
    "corr": (("proj", "depth"), "SELECT t.scene_id, t.frame, t.point_idx, t.u, t.v FROM proj t "
             "JOIN depth z ON z.scene_id=t.scene_id AND z.frame=t.frame AND z.u=t.u AND z.v=t.v "
             "WHERE t.u>=0 AND t.u<t.w AND t.v>=0 AND t.v<t.h AND t.d>=0 AND z.depth<>0 AND abs(z.depth-t.d) <= 2e-1*z.depth"),
    "captions": (("frames",), "SELECT f.scene_id, f.frame, concat(a.p_name, ' ', b.p_name) AS caption FROM frames f "
                 "JOIN part a ON a.p_partkey = (f.scene_id*6 + f.frame) % (SELECT count(*) FROM part) "
                 "JOIN part b ON b.p_partkey = (f.scene_id*3 + f.frame*2) % (SELECT count(*) FROM part)"),
    "pred_inst": (("points",), f"SELECT scene_id, point_idx, {PRED_INST} AS pred_id FROM points WHERE r >= 9"),
    "pred_meta": (("pred_inst",), f"SELECT scene_id, pred_id, {CONF} AS conf, {PRED_CLASS} AS class_id, count(*) AS n "
                  "FROM pred_inst GROUP BY scene_id, pred_id"),
    "gt_codes": (("points",), "SELECT scene_id, point_idx, CASE WHEN inst_label < 0 THEN 0 ELSE (sem_label+1)*1000 + inst_label + 1 END AS code FROM points"),
    "feats": (("points",), "SELECT p.scene_id, p.point_idx, p.sem_label, p.inst_label, e.embedding, e.vec_id FROM points p "
              "JOIN embeddings e ON e.vec_id = p.point_id % (SELECT count(*) FROM embeddings)"),
}


def with_clause(names: tuple[str, ...]) -> str:
    """The named views and the views they read, as one WITH clause."""
    order: list[str] = []

    def visit(name):
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    return ("WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + " ") if order else ""


class Tables:
    """Base tables and point-cloud views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A new folder below the checkpoint folder, for queries that write files and read them."""
        return f"{use_checkpoint_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    @cached_property
    def points(self) -> DataFrame:
        return self.base("orders").selectExpr(*POINT_COLS)

    @cached_property
    def points_m(self) -> DataFrame:
        """Points with coordinates in metres as well."""
        return self.points.selectExpr("*", *METRE_COLS)

    @cached_property
    def preds(self) -> DataFrame:
        return self.points.selectExpr("scene_id", "point_idx", "sem_label AS gt", f"{PRED} AS pred")

    @cached_property
    def logits(self) -> DataFrame:
        """One row per point with the vector of class scores."""
        one = LOGIT.format(c="c")
        return self.preds.selectExpr("scene_id", "point_idx", "gt", "pred",
                                     f"transform(sequence(0, {N_CLASSES - 1}), c -> {one}) AS logits")

    @cached_property
    def scenes(self) -> DataFrame:
        return self.points.select("scene_id").distinct()

    @cached_property
    def frames(self) -> DataFrame:
        return (self.scenes.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(N_FRAMES - 1).cast("bigint"))))
                .selectExpr("scene_id", "frame", *[c.format(k="frame") for c in FRAME_COLS]))

    @cached_property
    def dealt_frames(self) -> DataFrame:
        """The frames dealt to all tasks, for views in which this small table grows 768 times."""
        return self.frames.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "scene_id", "frame")

    @cached_property
    def depth(self) -> DataFrame:
        grid = self.dealt_frames.select("scene_id", "frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PIXELS - 1).cast("bigint"))).alias("k"))
        return (grid.selectExpr("scene_id", "frame", "k % 32 AS u", "k div 32 AS v")
                .selectExpr("scene_id", "frame", "u", "v", f"{DEPTH} AS depth"))

    @cached_property
    def posed_frames(self) -> DataFrame:
        """Frames with world -> camera poses in metres."""
        zero, one = F.lit(0.0), F.lit(1.0)
        return self.frames.withColumn("pose", F.array(one, zero, zero, -F.col("tx_mm") / 1000.0, zero, one, zero, F.lit(-0.5), zero, zero, one, F.lit(2.0), zero, zero, zero, one))

    @cached_property
    def depth_images(self) -> DataFrame:
        """The depth view with one row per image."""
        pixel = DEPTH.replace("u*", "(k % 32)*").replace("v*", "(k div 32)*").replace("+ v ", "+ (k div 32) ").replace("12e-1", "1.2D").replace("208e-2", "2.08D").replace("0e0", "0D")
        return self.dealt_frames.selectExpr("scene_id", "frame", "h", "w", f"transform(sequence(0, {PIXELS - 1}), k -> {pixel}) AS depth")

    @cached_property
    def camera_points(self) -> DataFrame:
        """Points in the coordinates of each camera of their scene that may see them, with pixel positions."""
        pairs = projection.visible_pairs(self.points_m.select("scene_id", "point_idx", "x_mm", "y_mm", "z_mm", *"xyz"), self.posed_frames, CELL_M).drop(*"xyz", "pose")
        cam = pairs.selectExpr("*", "(x_mm - tx_mm)/1e3 AS xc", "(y_mm - 500)/1e3 AS yc", "(z_mm + 2000)/1e3 AS d")
        return projection.to_pixels(cam)

    @cached_property
    def corr(self) -> DataFrame:
        tiles = projection.depth_tiles(self.depth_images)
        return projection.depth_consistent_tiled(projection.inside_image(self.camera_points), tiles).select("scene_id", "frame", "point_idx", "u", "v")

    @cached_property
    def corr_index(self) -> DataFrame:
        """The correspondence written once, as an index file would be, for queries that read it often."""
        return cut_lineage(self.corr)

    @cached_property
    def captions(self) -> DataFrame:
        part = self.base("part").select("p_partkey", "p_name")
        n = part.agg(F.count(F.lit(1))).scalar()
        keys = self.frames.select("scene_id", "frame", n.alias("n_parts")).selectExpr("scene_id", "frame", "(scene_id*6 + frame) % n_parts AS ka", "(scene_id*3 + frame*2) % n_parts AS kb")
        a = part.selectExpr("p_partkey AS ka", "p_name AS na")
        b = part.selectExpr("p_partkey AS kb", "p_name AS nb")
        return keys.join(a, "ka").join(b, "kb").selectExpr("scene_id", "frame", "concat(na, ' ', nb) AS caption")

    @cached_property
    def pred_inst(self) -> DataFrame:
        return self.points.filter("r >= 9").selectExpr("scene_id", "point_idx", f"{PRED_INST} AS pred_id")

    @cached_property
    def pred_meta(self) -> DataFrame:
        return (self.pred_inst.groupBy("scene_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))
                .selectExpr("scene_id", "pred_id", f"{CONF} AS conf", f"{PRED_CLASS} AS class_id", "n"))

    @cached_property
    def gt_codes(self) -> DataFrame:
        return self.points.selectExpr(
            "scene_id", "point_idx", "CASE WHEN inst_label < 0 THEN 0 ELSE (sem_label+1)*1000 + inst_label + 1 END AS code")

    @cached_property
    def feats(self) -> DataFrame:
        """A feature vector per point, taken from the embeddings table."""
        emb = self.base("embeddings").select("vec_id", "embedding")
        n = emb.agg(F.count(F.lit(1))).scalar()
        keyed = self.points.select("*", n.alias("n_vecs")).selectExpr("scene_id", "point_idx", "sem_label", "inst_label", "point_id % n_vecs AS vec_id")
        return keyed.join(emb, "vec_id")
