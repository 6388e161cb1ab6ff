"""Whole jobs on the point-cloud views."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.operators import augment as G
from pointlake.plans import catalogue, jobs
from pointlake.plans.fixtures import SPLIT, Tables
from pointlake.sources import readers as R


@pytest.fixture(scope="module")
def t(spark, sf):
    return Tables(spark, sf)


def test_semantic_evaluation_agrees_with_the_query(spark, sf, t):
    out = jobs.evaluate_semantic(t.preds, SPLIT)
    want = catalogue()["a8_open_vocab_iou"].run(spark, sf).first()
    got = out["iou"].first()
    assert got["harmonic_mean"] == pytest.approx(want["harmonic_mean"], abs=1e-6)
    assert out["classes"].count() == 20


def test_instance_evaluation(t):
    meta = t.pred_meta.selectExpr("scene_id", "pred_id", "class_id + 1 AS label_id", "conf")
    out = jobs.evaluate_instances(t.pred_inst, meta, t.gt_codes, SPLIT, 50)
    assert out["ap"].count() == 19 * 10
    row = out["overall"].first()
    assert 0 < row["all_ap"] <= row["all_ap50"] <= 1


def test_grouping(t):
    pts = t.logits.join(t.points_m.select("scene_id", "point_idx", "x", "y", "z"), ["scene_id", "point_idx"])
    pts = pts.select("*", *[F.lit(0.0).alias(f"pred_off_{c}") for c in "xyz"])
    members, scores = jobs.group_instances(pts, 20, 0.06, 5, min_points=20)
    ids = members.select("scene_id", "proposal_id").distinct().count()
    assert ids == scores.count() > 0
    assert members.groupBy("scene_id", "proposal_id").agg((F.count("*") - F.max("size")).alias("d")).filter("d <> 0").count() == 0


def test_caption_index_and_entities(spark, t, tmp_path):
    pose = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0)], -F.col("tx_mm") / 1000.0, *[F.lit(v) for v in (0.0, 1.0, 0.0, -0.5, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0)])
    frames = t.frames.withColumn("pose", pose).withColumnRenamed("frame", "image")
    jobs.index_captions(t.points_m, frames, t.depth.withColumnRenamed("frame", "image"), str(tmp_path / "corr"))
    corr = R.read_correspondence(spark, str(tmp_path / "corr"), "view").withColumnRenamed("image", "frame")
    same = corr.select("scene_id", "frame", "point_idx").exceptAll(t.corr.select("scene_id", "frame", "point_idx"))
    # metres are rounded differently in the two forms, so pixels on an edge may differ
    assert same.count() <= 0.01 * corr.count()
    lexicon = t.base("part").select(F.explode(F.split("p_name", " ")).alias("word"), F.lit("NN").alias("tag")).distinct()
    found, points = jobs.entity_captions(t.captions, corr, lexicon, 20, 0.3)
    sizes = points.groupBy("scene_id", "entity").count().join(found, ["scene_id", "entity"])
    assert found.count() == sizes.count() > 0
    assert sizes.filter("count <> n_points").count() == 0
    kept, rest = jobs.clean_captions(t.captions, corr.filter("frame > 1"))
    assert kept.filter("frame < 2").count() == 0 and rest.count() == corr.filter("frame > 1").count()


def test_training_points(t):
    steps = [lambda d: G.world_scaling(d, 5, 0.9, 1.1), lambda d: G.jitter_points(d, 6, 0.001)]
    rows, vox = jobs.training_points(t.points_m, SPLIT, steps)
    pdf = rows.toPandas()
    assert vox.agg(F.sum("n_points")).first()[0] == len(pdf)
    assert pdf.groupby("scene_id")["voxel_id"].nunique().sum() == vox.count()
    assert np.array([len(f) for f in pdf["feats"]]).min() == 6
    base = pdf[pdf.is_base == 1]
    assert (pdf[pdf.is_base != 1]["inst_label"] == -100).all()
    for _, part in base.groupby("scene_id"):
        ids = sorted(part["inst_label"].unique())
        assert ids == list(range(len(ids)))
    assert pdf[["sx", "sy", "sz"]].min().min() == 0
