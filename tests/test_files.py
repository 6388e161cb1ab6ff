"""Sources, sinks and the prediction stream on files written to a temporary folder."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from pointlake.functions import hooks
from pointlake.operators.metrics import class_areas, semantic_summary
from pointlake.operators.projection import invert_rigid
from pointlake.sources import readers as R
from pointlake.sources import writers as K
from pointlake.streaming.predictions import run_metrics, watch_predictions
from pyspark.sql import functions as F


def test_object_files(spark, tmp_path):
    room = tmp_path / "Area_1" / "office_2" / "Annotations"
    room.mkdir(parents=True)
    (room / "chair_1.txt").write_text("1.0 2.0 3.0 10 20 30\n1.5 2.5 3.5 1 2 3\n")
    (room / "chair_10.txt").write_text("4 4 4 0 0 0\n")
    (room / "stairs_1.txt").write_text("\n-1e0 5 6 7 8 9\n")
    got = R.read_object_files(spark, str(tmp_path), ["chair", "clutter"]).toPandas().sort_values(["inst_label", "x"])
    assert got["scene_id"].unique().tolist() == ["Area_1_office_2"]
    assert got["inst_label"].tolist() == [1, 1, 2, 3]
    assert got["sem_label"].tolist() == [0, 0, 0, 1]
    assert got[["x", "y", "z"]].min().tolist() == [0, 0, 0]
    assert got["x"].tolist() == [2.0, 2.5, 5.0, 0.0]
    assert got["point_idx"].tolist() == [0, 1, 2, 3]


def test_numeric_scenes(spark, tmp_path):
    r = np.random.default_rng(0)
    arrays = {f"Area_{i}_room": r.normal(size=(n, 8)) for i, n in ((1, 5), (2, 130))}
    for name, a in arrays.items():
        np.save(tmp_path / f"{name}.npy", a)
    cols = ["x", "y", "z", "r", "g", "b", "sem_label", "inst_label"]
    got = R.read_numeric_scenes(spark, f"{tmp_path}/*.npy", cols, rows_per_batch=50).toPandas()
    for name, a in arrays.items():
        part = got[got.scene_id == name].sort_values("point_idx")
        assert part["point_idx"].tolist() == list(range(len(a)))
        np.testing.assert_array_equal(part[cols].to_numpy(), a)


def test_pickled_arrays_are_refused(spark, tmp_path):
    np.save(tmp_path / "evil.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(PySparkException):
        R.read_numeric_scenes(spark, f"{tmp_path}/*.npy", ["x"]).collect()


def test_scene_lists_and_suffixes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("s1_vh.pth", "s2_vh.pth", "s3.txt"):
        (tmp_path / "a" / n).write_text("x")
    assert sorted(r[0] for r in R.list_scenes(spark, str(tmp_path / "a"), "_vh.pth").collect()) == ["s1", "s2"]
    (tmp_path / "list.txt").write_text(" s2 \n\ns1\n")
    assert sorted(r[0] for r in R.read_scene_list(spark, str(tmp_path / "list.txt")).collect()) == ["s1", "s2"]


def test_captions(spark, tmp_path):
    (tmp_path / "view.json").write_text(json.dumps({"s1": {"A.JPG": "a red chair", "b": "x"}, "s2": {}}, indent=1))
    (tmp_path / "scene.json").write_text(json.dumps({"s1": "all"}))
    view = R.read_captions(spark, str(tmp_path / "view.json"), "view").orderBy("image").collect()
    assert [(r.scene_id, r.level, r.image, r.caption) for r in view] == [("s1", "view", "a.jpg", "a red chair"), ("s1", "view", "b", "x")]
    assert R.read_captions(spark, str(tmp_path / "scene.json"), "scene").first()["image"] is None


def test_poses(spark, tmp_path):
    folder = tmp_path / "s1" / "pose"
    folder.mkdir(parents=True)
    m = np.eye(4)
    m[:3, 3] = [1, -2.5e-1, 3]
    m[:2, :2] = [[0, -1], [1, 0]]
    np.savetxt(folder / "10.txt", m)
    row = R.read_pose_texts(spark, f"{tmp_path}/*/pose/*.txt").withColumn("inv", invert_rigid(F.col("pose"))).first()
    assert (row.scene_id, row.image) == ("s1", "10")
    np.testing.assert_allclose(np.array(row.pose).reshape(4, 4), m)
    np.testing.assert_allclose(np.array(row.inv).reshape(4, 4), np.linalg.inv(m), atol=1e-12)
    np.savetxt(folder / "11.txt", np.full((4, 4), -np.inf))  # a lost camera
    assert [r.image for r in R.read_pose_texts(spark, f"{tmp_path}/*/pose/*.txt").collect()] == ["10"]
    (folder / "12.txt").write_text("1 2 3")
    with pytest.raises(Exception, match="not a matrix"):
        R.read_pose_texts(spark, f"{tmp_path}/*/pose/*.txt").collect()
    (folder / "7.json").write_text(json.dumps({"camera_rt_matrix": m[:3].tolist(), "camera_k_matrix": [[5, 0, 2], [0, 6, 3], [0, 0, 1]]}))
    row = R.read_pose_json(spark, f"{tmp_path}/*/pose/*.json").first()
    assert (row.fx, row.fy, row.cx, row.cy) == (5, 6, 2, 3) and len(row.pose) == 12


def test_intrinsics_and_room_images(spark, tmp_path):
    for name, k in (("a", np.array([[5, 0, 2, 0.1], [0, 6, 3, 0.2], [0, 0, 1, 0], [0, 0, 0, 1]])), ("b", np.array([[5, 0, 2], [0, 6, 3], [0, 0, 1]]))):
        (tmp_path / name).mkdir()
        np.savetxt(tmp_path / name / "intrinsic_depth.txt", k)
    got = {r.scene_id: r for r in R.read_intrinsics(spark, f"{tmp_path}/*/intrinsic*_depth.txt").collect()}
    assert [(r.fx, r.fy, r.cx, r.cy) for r in got.values()] == [(5, 6, 2, 3)] * 2
    assert (got["a"].bx, got["a"].by, got["b"].bx) == (0.1, 0.2, 0.0)
    for kind, ext in (("pose", "json"), ("depth", "png"), ("rgb", "png")):
        folder = tmp_path / "img" / "area_5a" / "data" / kind
        folder.mkdir(parents=True)
        for n in (0, 1):
            (folder / f"camera_0A1b_office_12_frame_{n}_domain_{kind}.{ext}").write_text("x")
    files = R.list_room_images(spark, str(tmp_path / "img"))
    assert {(r.scene_id, r.kind) for r in files.collect()} == {("Area_5a_office_12", k) for k in ("pose", "depth", "color")}
    assert {r.image for r in files.collect()} == {f"camera_0a1b_office_12_frame_{n}" for n in (0, 1)}
    assert R.complete_scenes(files).first()["n_images"] == 2


def test_scenes_with_unequal_file_counts(spark):
    files = spark.createDataFrame([("a", k) for k in ("pose", "depth", "color")] + [("b", "pose")], "scene_id string, kind string")
    assert [r.scene_id for r in R.complete_scenes(files, strict=False).collect()] == ["a"]
    with pytest.raises(PySparkException):
        R.complete_scenes(files).collect()


def test_id_lists_are_numbered_over_file_splits(spark, tmp_path):
    n = 5000
    (tmp_path / "s1.txt").write_text("\n".join(str(i * 3) for i in range(n)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = R.read_id_lists(spark, f"{tmp_path}/*.txt")
        got = df.orderBy("point_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.point_idx, r.id) for r in got] == [(i, i * 3) for i in range(n)]


def test_id_lists_are_listed_by_folder(spark, tmp_path):
    """One path to list, however many files the glob names; other files and subfolders stay out."""
    for k in range(40):
        (tmp_path / f"s{k}.txt").write_text(f"{k}\n{k + 1}\n")
    (tmp_path / "s1.csv").write_text("7\n")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "s50.txt").write_text("7\n")
    df = R.read_id_lists(spark, f"{tmp_path}/*.txt")
    assert "InMemoryFileIndex(1 paths)" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.scene_id, r.point_idx, r.id) for r in df.collect()) == sorted((f"s{k}", i, k + i) for k in range(40) for i in range(2))
    assert [r.scene_id for r in R.read_id_lists(spark, f"{tmp_path}/mo*").collect()] == ["s50"]
    with pytest.raises(PySparkException):
        R.read_id_lists(spark, f"{tmp_path}/*.lst").collect()


def test_manifests_are_written_by_all_tasks(spark, tmp_path):
    """A file per scene: one task would write them all."""
    meta = spark.range(200).selectExpr("id div 4 AS scene_id", "id % 4 AS pred_id", "1L AS label_id", "5e-1 AS conf")
    K.write_pred_instances(meta, meta.selectExpr("scene_id", "pred_id", "0L AS point_idx"), str(tmp_path))
    files = sorted((tmp_path / "manifest").glob("scene_id=*/part-*.txt"))
    assert len({f.name[:10] for f in files}) > 4
    lines = {}
    for f in files:
        lines.setdefault(f.parent.name, []).extend(f.read_text().splitlines())
    assert lines == {f"scene_id={s}": [f"predicted_masks/{s}_00{i}.txt 1 0.5000" for i in range(4)] for s in range(50)}


def test_manifest_lines(spark, tmp_path):
    (tmp_path / "s1.txt").write_text("masks/a.txt 3 0.5000\n/abs.txt 1 0.1\n../up.txt 1 0.1\nx/../b.txt 2.0 1\nx/../../b.txt 2 1\nshort 1\n")
    got = {r.mask_path: r for r in R.read_instance_manifests(spark, f"{tmp_path}/*.txt").collect()}
    assert got["masks/a.txt"].valid and got["masks/a.txt"].label_id == 3 and got["x/../b.txt"].label_id == 2
    assert {k for k, v in got.items() if v.valid} == {"masks/a.txt", "x/../b.txt"}


def test_offsets(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"s1": [1, 2, 3]}))
    pts = spark.createDataFrame([("s1", 0, 0.5, 0.0, 0.0)], "scene_id string, point_idx bigint, x double, y double, z double")
    row = R.add_scene_offsets(pts, R.read_scene_offsets(spark, str(tmp_path / "o.json"))).first()
    assert (row.x, row.y, row.z) == (1.5, 2.0, 3.0)


def test_manifest_text(spark):
    meta = spark.createDataFrame([("s", 4, 2, 0.12345), ("s", 9, 1, 1.0)], "scene_id string, pred_id bigint, label_id int, conf double")
    lines = [r.line for r in K.pred_manifest(meta, (7, 8)).orderBy("position").collect()]
    assert lines == ["predicted_masks/s_000.txt 8 0.1235", "predicted_masks/s_001.txt 7 1.0000"] or lines[0].endswith("0.1234")


def test_scenes_with_many_captions_take_several_json_lines(spark):
    caps = spark.createDataFrame([("s", i, f"c{i}") for i in range(50)], "scene_id string, image bigint, caption string")
    lines = [json.loads(r.value) for r in K.captions_json(caps, per_line=10).collect()]
    assert len(lines) == 5
    merged = {}
    for one in lines:
        merged.update(one["s"])
    assert merged == {str(i): f"c{i}" for i in range(50)}


def test_stream_reads_new_files_once(spark, tmp_path):
    def drop(name, epoch, pred):
        rows = pd.DataFrame({"run": "r", "epoch": epoch, "scene_id": 1, "point_idx": range(4), "gt": [0, 0, 1, 1], "pred": pred}).astype({"epoch": "int32"})
        rows.to_parquet(tmp_path / "in" / name, index=False)
        return rows
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    first = drop("a.parquet", 3, [0, 0, 1, 0])
    drop("old.parquet", 1, [1, 1, 0, 0])
    watch_predictions(*args, min_epoch=2).awaitTermination()
    drop("b.parquet", 4, [0, 0, 1, 1])
    drop("c.parquet", 3, [0, 0, 1, 0])
    watch_predictions(*args, min_epoch=2, max_files=1).awaitTermination()
    got = run_metrics(spark, str(tmp_path / "out"), 2).orderBy("epoch").collect()
    assert [(r.epoch, r.n_points) for r in got] == [(3, 8), (4, 4)]
    want = semantic_summary(class_areas(spark.createDataFrame(first), 2)).first()
    assert got[0]["miou"] == pytest.approx(want["miou"]) and got[1]["miou"] == pytest.approx(1.0)


def test_step_lists_and_hooks(spark):
    df = spark.range(10)
    registry = {"add": lambda n: (lambda d: d.withColumn("id", F.col("id") + n)), "keep": lambda below: (lambda d: d.filter(F.col("id") < below))}
    steps = hooks.configured_steps(registry, [{"name": "add", "n": 5}, {"name": "keep", "below": 8}])
    assert sorted(r.id for r in hooks.run_steps(df, steps).collect()) == [5, 6, 7]
    out = hooks.map_batches(df, lambda p: p.assign(id=p["id"] * 2), "id bigint")
    assert out.agg(F.sum("id")).first()[0] == 90
