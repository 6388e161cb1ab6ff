"""Clustering and radius neighbours against brute force."""

import numpy as np
import pandas as pd
import pytest

from pointlake.operators import components as C
from pointlake.operators import radius as R


def brute_labels(xyz, radius):
    n = len(xyz)
    label = np.arange(n)
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    near = d2 < radius * radius
    while True:
        new = np.where(near, label[None, :], n).min(1)
        if (new == label).all():
            return label
        label = new


def frame(spark, groups, partitions=3):
    rows = []
    for (scene, cls), xyz in groups.items():
        rows += [(scene, cls, i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["scene_id", "class_id", "point_idx", "x", "y", "z"])).repartition(partitions)


def clouds():
    r = np.random.default_rng(0)
    dense = r.normal(size=(150, 3)) * 0.02
    chain = np.c_[np.arange(90) * 0.039, np.zeros(90), np.zeros(90)]
    sparse = r.uniform(-0.4, 0.4, size=(200, 3))
    copies = np.repeat(r.uniform(0, 0.2, size=(12, 3)), 12, axis=0)
    # two crowded plates just inside and just outside the radius
    plate = np.c_[r.uniform(0, 0.02, (60, 2)), np.zeros(60)]
    return {(1, 0): dense, (1, 1): r.permutation(chain), (2, 0): sparse, (2, 1): copies,
            (3, 0): np.r_[plate, plate + [0, 0, 0.0399]], (3, 1): np.r_[plate, plate + [0, 0, 0.0401]]}


@pytest.mark.parametrize("limit,partitions", [(4096, 3), (1, 3), (16, 11)])
def test_components_equal_brute_force(spark, limit, partitions):
    groups = clouds()
    got = C.cluster_points(frame(spark, groups, partitions), 0.04, 1, direct_limit=limit).toPandas()
    assert len(got) == sum(len(v) for v in groups.values())
    for key, xyz in groups.items():
        part = got[(got.scene_id == key[0]) & (got.class_id == key[1])].sort_values("point_idx")
        want = brute_labels(xyz, 0.04)
        assert (part["label"].to_numpy() == want).all(), key
        assert (part["size"].to_numpy() == np.bincount(want)[want]).all()


def test_small_components_are_dropped(spark):
    got = C.cluster_points(frame(spark, {(1, 0): np.array([[0, 0, 0], [0.01, 0, 0], [5, 5, 5]])}), 0.04, 2).toPandas()
    assert sorted(got["point_idx"]) == [0, 1]


def test_star_rounds_with_hubs(spark):
    # a path, a star with a large hub, and a cycle; hubs are joined apart when split_rows is 0
    edges = [(1, i, i + 1) for i in range(40)] + [(2, 500, i) for i in range(300)] + [(3, i, (i + 1) % 17) for i in range(17)]
    df = spark.createDataFrame(edges, "g int, u bigint, v bigint")
    for split in (10_000_000, 0):
        out = C.star_components(df, ["g"], split_rows=split).toPandas()
        assert len(out) == 41 + 301 + 17
        assert (out["label"] == 0).all()


def test_chunks_contract_to_stars():
    edges = pd.DataFrame({"g": [1, 1, 1, 2, 2], "a": [5, 3, 9, 5, 7], "b": [3, 8, 10, 7, 4]})
    out = C.contract_chunk(edges, ["g"])
    assert sorted(map(tuple, out[["g", "u", "v"]].to_numpy().tolist())) == [(1, 5, 3), (1, 8, 3), (1, 10, 9), (2, 5, 4), (2, 7, 4)]


def test_small_chunks_keep_connectivity(spark):
    n = 200
    df = spark.createDataFrame([(1, i, i + 1, i % 5) for i in range(n)], "g int, a bigint, b bigint, piece int")
    out = C.star_components(C.contract_pieces(df, ["g"], chunk=10), ["g"]).toPandas()
    assert len(out) == n + 1 and (out["label"] == 0).all()


def test_radius_is_strict_and_includes_self(spark):
    df = frame(spark, {(1, 0): np.array([[0, 0, 0], [1, 0, 0], [1.5, 0, 0], [1.5, 0, 0]])})
    got = {(r.src, r.dst) for r in R.radius_neighbours(df, 1.0).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)}
    assert {(r.src, r.dst) for r in R.radius_neighbours(df, 1.0, cap=2).collect() if r.src == 3} == {(3, 1), (3, 2)}


def test_crowded_cells_are_joined_in_parts(spark):
    df = frame(spark, clouds())
    whole = R.radius_neighbours(df, 0.04, ["scene_id", "class_id"])
    parts = R.radius_neighbours(df, 0.04, ["scene_id", "class_id"], crowded=7)
    assert sorted(parts.collect()) == sorted(whole.collect())


def test_clouds_without_edges_and_empty_clouds(spark):
    alone = frame(spark, {(1, 0): np.array([[0, 0, 0], [5, 0, 0]]), (2, 0): np.array([[0, 0, 0]])})
    got = C.cluster_points(alone, 0.04, 1).toPandas()
    assert sorted(got["label"]) == [0, 0, 1] and (got["size"] == 1).all()
    assert C.cluster_points(alone.filter("scene_id < 0"), 0.04, 1).count() == 0
    assert R.radius_neighbours(alone.filter("scene_id < 0"), 0.04).count() == 0


@pytest.mark.parametrize(("head", "crowded"), [(3, 8), (6, 100), (1000, 100)])
def test_capped_neighbours_of_crowded_cells(spark, head, crowded):
    """Most points in one small ball: heads do not show all, so some points look again."""
    r = np.random.default_rng(4)
    xyz = np.concatenate([r.normal(0, 0.03, (150, 3)), r.uniform(-1, 1, (100, 3)), r.uniform(0.05, 0.15, (60, 3))])[r.permutation(310)]
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], "scene_id long, point_idx long, x double, y double, z double")
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(-1) < 0.1 ** 2
    want = sorted((i, int(j)) for i in range(310) for j in np.flatnonzero(near[i])[:5])
    got = R.capped_neighbours(df, 0.1, 5, head=head, crowded=crowded).collect()
    assert sorted((x["src"], x["dst"]) for x in got) == want


def test_pieces_arrive_together(spark):
    """Chunks far smaller than a task's edges still contract whole pieces."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        # 50 pieces of 20 edges, dealt in turns: a chunk of a mixed order holds no two edges of a piece
        rows = [(0, p * 100 + k, p * 100 + k + 1, p) for k in range(20) for p in range(50)]
        edges = spark.createDataFrame(rows, "g bigint, a bigint, b bigint, piece bigint")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
        stars = C.contract_pieces(edges, ["g"], 20).collect()
        assert sorted((r["u"], r["v"]) for r in stars) == [(p * 100 + k, p * 100) for p in range(50) for k in range(1, 21)]
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_pieces_settle_their_cells(spark):
    """Chains over many pieces of space, with small batches: each cell comes back once, and single points leave no open pair."""
    r = np.random.default_rng(7)
    line = np.c_[np.arange(400) * 0.035, np.zeros(400), np.arange(400) * -0.01]
    cube = r.uniform(-0.9, 0.9, size=(300, 3))
    groups = {(1, 0): r.permutation(line), (1, 1): cube, (2, 0): r.permutation(np.r_[line[:200], line[:200] + [0, 0.3, 0]])}
    df = frame(spark, groups)
    nodes = C.cell_nodes(C.with_component_cells(df, 0.04), ["scene_id", "class_id"]).cache()
    rows = C.settle_pieces(nodes, 0.04, ["scene_id", "class_id"], batch_cells=50).toPandas()
    cells = rows[rows.kind == 0]
    assert len(cells) == nodes.count() and (cells["root"] <= cells["node"]).all()
    assert len(rows[rows.kind == 2]) == 0
    got = C.cluster_points(df, 0.04, 1).toPandas()
    for key, xyz in groups.items():
        part = got[(got.scene_id == key[0]) & (got.class_id == key[1])].sort_values("point_idx")
        assert (part["label"].to_numpy() == brute_labels(xyz, 0.04)).all(), key
