"""Augmentation and sampling: properties, and NumPy readings of the less obvious rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pointlake.functions import rng
from pointlake.operators import augment as G
from pointlake.operators import sampling as S
from pointlake.operators import voxel as V


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"scene_id": np.repeat([1, 2, 3], [400, 150, 60]), "x": r.uniform(0, 6, 610), "y": r.uniform(0, 4, 610), "z": r.uniform(0, 2, 610)})
    pdf["point_idx"] = pdf.groupby("scene_id").cumcount()
    return pdf, spark.createDataFrame(pdf)


def py_draw(seed, *keys):
    x = seed * 7919 % rng.PRIME
    for k in keys:
        x = (x * 48271 + k % rng.PRIME) % rng.PRIME
    for step in (16807, 69621):
        x = x * (x + step) % rng.PRIME
    return x / rng.PRIME


def test_shuffled_rotation_orders_are_products_of_axis_rotations(spark):
    scenes = spark.range(40).withColumnRenamed("id", "scene_id")
    got = G.affine_parameters(scenes, 9, jitter=False, flip_p=None, rotation=(0.3, 0.2, 1.0), shuffle=True).toPandas()
    seen = set()
    for _, r in got.iterrows():
        s = int(r.scene_id)
        t = [(py_draw(9 + 110 + a, s) * 2 * np.pi - np.pi) * v for a, v in enumerate((0.3, 0.2, 1.0))]
        c, n = np.cos(t), np.sin(t)
        rot = [np.array([[1, 0, 0], [0, c[0], -n[0]], [0, n[0], c[0]]]), np.array([[c[1], 0, n[1]], [0, 1, 0], [-n[1], 0, c[1]]]),
               np.array([[c[2], n[2], 0], [-n[2], c[2], 0], [0, 0, 1]])]
        orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
        k = int(py_draw(9 + 130, s) * 6)
        seen.add(k)
        a, b, d = orders[k]
        np.testing.assert_allclose(r[[f"m{i}{j}" for i in range(3) for j in range(3)]].to_numpy(float).reshape(3, 3), rot[a] @ rot[b] @ rot[d], atol=1e-12)
    assert len(seen) >= 4


def test_crop_follows_the_loop(spark, cloud):
    pdf, df = cloud
    full, limit, seed, step, big = 6, 80, 3, 1, 200
    got = G.crop(df, full, limit, seed, step, big).toPandas()
    for s, part in pdf.groupby("scene_id"):
        xyz = part[["x", "y", "z"]].to_numpy()
        room = xyz.max(0) - xyz.min(0)
        scale = np.array([full] * 3, float)
        keep, moved, t = np.ones(len(xyz), bool), xyz, 0
        while keep.sum() > limit:
            shrink = step * 2 if keep.sum() > big else step
            u = np.array([py_draw(seed + a, int(s), t) for a in range(3)])
            moved = xyz + np.minimum(scale - room + 0.001, 0) * u
            keep = (moved.min(1) >= 0) & (moved < scale).all(1)
            scale[:2] -= shrink
            t += 1
        mine = got[got.scene_id == s].sort_values("point_idx")
        assert mine["point_idx"].tolist() == part["point_idx"].to_numpy()[keep].tolist()
        np.testing.assert_allclose(mine[["x", "y", "z"]].to_numpy(), moved[keep], atol=1e-12)


def test_elastic_moves_smoothly_and_is_repeatable(cloud):
    _, df = cloud
    a = G.elastic(df, 1, 0.5, 4).toPandas().sort_values(["scene_id", "point_idx"])
    b = G.elastic(df.repartition(5), 1, 0.5, 4).toPandas().sort_values(["scene_id", "point_idx"])
    np.testing.assert_allclose(a[["x", "y", "z"]], b[["x", "y", "z"]], atol=1e-9)
    src = df.toPandas().sort_values(["scene_id", "point_idx"])
    d = a[["x", "y", "z"]].to_numpy() - src[["x", "y", "z"]].to_numpy()
    assert 0 < np.abs(d).mean() < 0.5 and np.isfinite(d).all()


def test_elastic_far_point(spark):
    """One point 10 km away: the dense grid would have 10^12 nodes.  Noise against two passes of the filter in plain loops."""
    rows = [(1, i, float(i) * 0.7, float(i) * 0.3, 0.5) for i in range(5)] + [(1, 5, -9999.5, 9999.9, 3.0), (2, 0, 0.0, 0.0, 0.0)]
    got = G.elastic(spark.createDataFrame(rows, "scene_id long, point_idx long, x double, y double, z double"), 1, 0.5, 4)
    got = {(r.scene_id, r.point_idx): np.array([r.x, r.y, r.z]) for r in got.collect()}

    def normal(seed, *keys):
        u = (py_draw(seed, *keys) * rng.PRIME + 1) / (rng.PRIME + 1)
        return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * py_draw(seed + 1, *keys))

    def blurred(seed, scene, node, size):
        lo = [n - 2 for n in node]
        block = np.zeros((5, 5, 5))
        real = np.zeros((5, 5, 5), bool)
        for at in np.ndindex(5, 5, 5):
            raw = [a + b for a, b in zip(lo, at)]
            real[at] = all(0 <= r < n for r, n in zip(raw, size))
            block[at] = normal(seed, scene, *raw) if real[at] else 0
        for axis in (0, 1, 2, 0, 1, 2):
            pad = np.pad(block, [(1, 1) if a == axis else (0, 0) for a in range(3)])
            block = sum(np.take(pad, range(d, d + 5), axis) for d in range(3)) / 3 * real
        return block[2, 2, 2]

    for scene, idx, *xyz in rows:
        size = [int(max(abs(r[2 + a]) for r in rows if r[0] == scene)) + 3 for a in range(3)]
        pos = [(c + (n - 1)) / 2 for c, n in zip(xyz, size)]
        base = [max(min(int(np.floor(p)), n - 2), 0) for p, n in zip(pos, size)]
        want = np.array(xyz)
        for bits in np.ndindex(2, 2, 2):
            weight = np.prod([p - b if bit else 1 - (p - b) for p, b, bit in zip(pos, base, bits)])
            want = want + 0.5 * weight * np.array([blurred(4 + 10 * a, scene, [b + bit for b, bit in zip(base, bits)], size) for a in range(3)])
        np.testing.assert_allclose(got[scene, idx], want, atol=1e-9)


@pytest.mark.parametrize("limit, big", [(80, 200), (10, 30), (0, 5), (300, 10)])
def test_crop_with_crowded_places(spark, limit, big):
    """Points heaped on few places leave windows in doubt: the counts of whole cells cannot settle them."""
    r = np.random.default_rng(8)
    pdf = pd.DataFrame({"scene_id": np.repeat([1, 2, 3, 4], [500, 300, 300, 20]), "x": r.uniform(0, 9, 1120).round(0), "y": r.uniform(0, 3, 1120), "z": r.uniform(0, 8, 1120)})
    pdf.loc[pdf.scene_id == 2, ["x", "y"]] = 1.5
    pdf["point_idx"] = pdf.groupby("scene_id").cumcount()
    got = G.crop(spark.createDataFrame(pdf), 6, limit, 3, 1, big).toPandas()
    for s, part in pdf.groupby("scene_id"):
        xyz = part[["x", "y", "z"]].to_numpy()
        room, scale, shrink = xyz.max(0) - xyz.min(0), np.array([6.0] * 3), 0
        keep, moved, t = np.ones(len(xyz), bool), xyz, 0
        while keep.sum() > limit:
            shrink = 2 if keep.sum() > big else 1
            moved = xyz + np.minimum(scale - room + 0.001, 0) * [py_draw(3 + a, int(s), t) for a in range(3)]
            keep = (moved.min(1) >= 0) & (moved < scale).all(1)
            scale[:2] -= shrink
            t += 1
        mine = got[got.scene_id == s].sort_values("point_idx")
        assert mine["point_idx"].tolist() == part["point_idx"].to_numpy()[keep].tolist()
        np.testing.assert_allclose(mine[["x", "y", "z"]].to_numpy(), moved[keep], atol=1e-12)


def test_gate(spark, cloud):
    pdf, df = cloud
    one = spark.range(1).withColumnRenamed("id", "scene_id")
    opened = lambda cfg: one.select(G.gate(1, cfg)).first()[0]
    assert [opened(c) for c in (None, False, True, {"enabled": False}, {}, {"p": 1.0}, {"p": 0.0})] == [False, False, True, False, True, True, False]
    off = G.when_gated(df, 1, None, lambda d: G.world_scaling(d, 2, 5, 5))
    assert off.agg(F.sum("x")).first()[0] == pytest.approx(pdf["x"].sum())


def test_sampling_counts(cloud):
    pdf, df = cloud
    sizes = pdf.groupby("scene_id").size()
    got = S.subsample(df, 3, 1).groupBy("scene_id").count().toPandas().set_index("scene_id")["count"]
    assert got.to_dict() == (sizes // 3).to_dict()
    fixed = S.sample_fixed(df.filter("scene_id < 3"), 200, 1, far=5.0).groupBy("scene_id").count().collect()
    assert {r["count"] for r in fixed} == {200}
    with pytest.raises(PySparkException):
        S.sample_fixed(df, 200, 1).collect()


def test_voxels_keep_every_point(cloud):
    pdf, df = cloud
    cells = V.with_cells(df, 0.5)
    vox = V.voxel_table(cells)
    assert vox.agg(F.sum("n_points")).first()[0] == len(pdf)
    back = V.devoxelise(V.point_voxels(cells, vox), vox.select("scene_id", "voxel_id", "n_points"))
    assert back.count() == len(pdf)
    with pytest.raises(PySparkException):
        V.pool_voxels(cells, ["x"], "unique").collect()
    merged = S.merge_four(S.split_four(df)).select("scene_id", "point_idx")
    assert sorted(merged.collect()) == sorted(df.select("scene_id", "point_idx").collect())
