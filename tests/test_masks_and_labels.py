"""Run-length masks, label maps, metrics and text expressions on small hand-made inputs."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pointlake import IGNORE, ClassSplit
from pointlake.functions import text as TX
from pointlake.functions import vectors as V
from pointlake.operators import calibrate, coords, labels, masks, metrics, overlap
from pointlake.operators.instances import batch_offsets, globalise_instances
from pointlake.operators.proposals import revoxelise


def encode(spark, rows, **kw):
    df = spark.createDataFrame(rows, "scene_id bigint, pred_id bigint, point_idx bigint")
    runs = masks.mask_runs(df, **kw)
    return df, masks.encode_runs(runs)


@pytest.mark.parametrize("mask,text", [("01101", "2 2 5 1"), ("111", "1 3"), ("1", "1 1"), ("0110000001", "2 2 10 1")])
@pytest.mark.parametrize("bits", [0, 1, 2, 16])
def test_encode_goldens(spark, mask, text, bits):
    rows = [(1, 0, i) for i, c in enumerate(mask) if c == "1"]
    _, enc = encode(spark, rows, bits=bits)
    assert [r["counts"] for r in enc.collect()] == [text]


def test_decode_inverts_encode_and_long_masks_come_in_chunks(spark):
    r = np.random.default_rng(1)
    rows = [(s, p, int(i)) for s in range(2) for p in range(3) for i in np.flatnonzero(r.random(500) < 0.6)]
    df, enc = encode(spark, rows, bits=3)
    assert sorted(masks.decode_runs(enc).collect()) == sorted(df.collect())
    pieces = masks.encode_runs(masks.mask_runs(df, bits=3), bits=6).orderBy("scene_id", "pred_id", "chunk").collect()
    whole = {}
    for p in pieces:
        whole.setdefault((p.scene_id, p.pred_id), []).append(p.counts)
    assert {k: " ".join(v) for k, v in whole.items()} == {(e.scene_id, e.pred_id): e.counts for e in enc.collect()}


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_dense_runs_cover_the_scene(spark, bits):
    r = np.random.default_rng(6)
    dense = {(s, p): r.random(90) < 0.5 for s in range(2) for p in range(3)}
    rows = [(s, p, int(i)) for (s, p), m in dense.items() for i in np.flatnonzero(m)]
    df, _ = encode(spark, rows)
    lengths = spark.createDataFrame([(0, 90), (1, 90)], "scene_id bigint, n_points bigint")
    got = masks.dense_runs(masks.mask_runs(df, bits=bits), lengths, bits=bits).orderBy("start").collect()
    for key, m in dense.items():
        out = np.concatenate([np.full(g.length, g.value) for g in got if (g.scene_id, g.pred_id) == key])
        assert (out == m).all()
    cut = masks.expand_runs(masks.mask_runs(df, bits=bits), bits=bits)
    assert sorted(cut.collect()) == sorted(df.collect())


def test_empty_counts_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, 0, "")], "scene_id bigint, pred_id bigint, counts string")
    assert masks.decode_runs(df).count() == 0


def test_class_maps(spark):
    split = ClassSplit(6, novel=(1, 4), ignored=(5,))
    assert split.base == (0, 2, 3) and split.valid == (0, 1, 2, 3, 4)
    df = spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 4, 5, 77, IGNORE)], "c bigint")
    c = F.col("c")
    got = df.select(labels.map_classes(c, split.base).alias("a"), labels.map_classes(c, split.base, False).alias("b"),
                    labels.map_base_flag(c, split).alias("f")).collect()
    assert [r.a for r in got] == [0, IGNORE, 1, 2, IGNORE, IGNORE, IGNORE, IGNORE]
    assert [r.b for r in got] == [0, IGNORE, 2, 3, IGNORE, IGNORE, IGNORE, IGNORE]
    assert [r.f for r in got] == [1, 0, 1, 1, 0, 0, IGNORE, IGNORE]


def test_instance_code_overflow_is_refused(spark):
    df = spark.createDataFrame([(3, 998), (3, IGNORE)], "s bigint, i bigint")
    assert [r[0] for r in df.select(labels.encode_gt(F.col("s"), F.col("i"))).collect()] == [4999, 0]
    bad = spark.createDataFrame([(3, 999)], "s bigint, i bigint")
    with pytest.raises(PySparkException):
        bad.select(labels.encode_gt(F.col("s"), F.col("i"))).collect()


# published base/novel pairs and their harmonic means
PUBLISHED = [(67.8, 62.2, 64.9), (70.4, 46.4, 55.9), (76.6, 40.3, 52.8), (58.3, 25.6, 35.6), (53.9, 29.8, 38.4),
             (58.7, 56.9, 57.8), (54.8, 22.2, 31.6), (60.9, 10.0, 17.2), (48.2, 9.5, 15.8), (0.0, 0.0, 0.0)]


def test_harmonic_mean_reproduces_published_rows(spark):
    df = spark.createDataFrame(PUBLISHED, "b double, n double, h double")
    for r in df.withColumn("got", metrics.harmonic(F.col("b"), F.col("n"))).collect():
        assert r.got == pytest.approx(r.h, abs=0.1)
        assert r.got <= (r.b + r.n) / 2 + 1e-9


def test_calibration_forms_agree(spark):
    r = np.random.default_rng(2)
    split = ClassSplit(7, novel=(2, 5), ignored=(6,))
    rows = [(int(i), [float(v) for v in r.normal(size=7) * 20], float(r.normal())) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, l array<double>, b double")
    df = df.withColumn("a", calibrate.calibrate(F.col("l"), F.col("b"), split))
    for row in calibrate.calibrate_rows(df, "l", F.col("b"), split).collect():
        np.testing.assert_allclose(row.a, row.probs, atol=1e-12)
        assert sum(row.a) == pytest.approx(1) and row.a[6] == 0


def test_wide_vectors_are_pooled_alike(spark):
    r = np.random.default_rng(4)
    rows = [(i % 2, [float(v) for v in r.normal(size=200)]) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, v array<double>")
    for row in V.mean_vector(df, ["g"], "v", 200).collect():
        np.testing.assert_allclose(row.pooled, np.mean([v for g, v in rows if g == row.g], axis=0))
        assert row.n_rows == 10


def test_score_matrix_and_argmax_ties(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "f array<double>")
    got = [r.logits for r in V.score_matrix(df, "f", np.array([[1.0, 0.0], [0.0, 1.0]]), True, 10.0).collect()]
    np.testing.assert_allclose(got, [[6, 8], [0, 0]])
    assert spark.createDataFrame([([1.0, 5.0, 5.0],)], "l array<double>").select(V.argmax(F.col("l"))).first()[0] == 1


def test_text_expressions(spark):
    df = spark.createDataFrame([("Wall",), ("chair",)], "n string")
    got = df.select(TX.prompt(F.col("n"), "lseg").alias("a"), TX.prompt(F.col("n"), "full").alias("b")).collect()
    assert [r.a for r in got] == ["Wall", "a chair in a scene"]
    assert got[1].b == "a bad photo of a chair."
    one = spark.createDataFrame([("room blue room", "best_miou_61.5_epoch_12.txt", "Area_3/office_1/Annotations")], "w string, f string, p string")
    m, e = TX.best_of_name(F.col("f"))
    row = one.select(TX.drop_first(F.split("w", " "), "room").alias("w"), m.alias("m"), e.alias("e"), TX.room_id(F.col("p")).alias("r")).first()
    assert row.w == ["blue", "room"] and row.m == 61.5 and row.e == 12 and row.r == "Area_3_office_1"
    long = "w " * 75 + "w"
    df = spark.createDataFrame([(long,), (long[2:],)], "t string")
    assert [r[0] for r in df.select(TX.needs_summary(F.col("t"))).collect()] == [True, False]


def test_box_corners_of_a_turned_box(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 2.0, 4.0, 6.0, math.pi / 2)], "id int, cx double, cy double, cz double, dx double, dy double, dz double, heading double")
    rows = coords.box_corners(df).orderBy("corner").collect()
    np.testing.assert_allclose([(r.x, r.y, r.z) for r in rows[:2]], [(-1, 3, 0), (3, 3, 0)], atol=1e-12)


def test_rescue_lets_the_later_instance_keep_a_shared_proposal(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.6), (1, 0, 1, 0.5), (1, 1, 2, 0.1)], "scene_id int, proposal_id int, inst_label int, iou double")
    plain = {r.proposal_id: r.assigned for r in overlap.assign_proposals(df, 0.55).collect()}
    rescued = {r.proposal_id: r.assigned for r in overlap.assign_proposals(df, 0.55, 0.3).collect()}
    assert plain == {0: 0} and rescued == {0: 1}


def test_batches_of_named_scenes(spark):
    """Names and ids with gaps fill batches in order."""
    for ids in (["s_a", "s_c", "s_b", "s_x", "s_d"], [7, 900, 44, 5000, 901]):
        pts = spark.createDataFrame([(s, i, i % 2) for s in ids for i in range(3)], ["scene_id", "point_idx", "inst_label"])
        got = {r.scene_id: (r.batch_id, r.row_offset) for r in batch_offsets(pts, 2).collect()}
        assert [got[s] for s in sorted(ids)] == [(0, 0), (0, 3), (1, 0), (1, 3), (2, 0)]
        named = {(r.scene_id, r.point_idx): r.inst_label for r in globalise_instances(pts, 2).collect()}
        assert [named[s, 1] for s in sorted(ids)] == [1, 3, 1, 3, 1]


def test_revoxelise_outside_grid(spark):
    rows = spark.createDataFrame([(0, 0, i, float(v), 0.0, 0.0, 1.0) for i, v in enumerate((0, 400, 900))], "scene_id long, proposal_id long, point_idx long, x double, y double, z double, r double")
    with pytest.raises(Exception, match="outside the grid"):
        revoxelise(rows, ["r"], 0.02, 5)[0].collect()
