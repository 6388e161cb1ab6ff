"""What the planner makes of the operators."""

import re

from pyspark.sql import functions as F

from pointlake.operators import projection as P, radius as R, voxel as V
from pointlake.plans import catalogue
from pointlake.plans.fixtures import Tables


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_only_needed_columns_are_read(spark, sf):
    text = plan(catalogue()["a8_open_vocab_iou"].run(spark, sf))
    schemas = set(re.findall(r"ReadSchema: (\S+)", text))
    assert schemas == {"struct<o_orderkey:bigint>"}


def test_filters_reach_the_scan(spark, sf):
    events = Tables(spark, sf).base("events").filter(F.col("event_type") != "click")
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,click))]" in plan(events)


def test_no_query_multiplies_tables(spark, sf):
    lazy = [n for n in catalogue() if n[0] not in "cwt" and not n.startswith(("a14", "a15", "a16", "k", "s", "r1", "j11"))]
    for name in lazy:
        text = plan(catalogue()[name].run(spark, sf), "simple")
        assert "CartesianProduct" not in text, name
        # the loss queries put two one-row results side by side
        assert text.count("BroadcastNestedLoopJoin") <= name.startswith("a17"), name


def test_capped_voxels_are_cut_before_the_shuffle(spark, sf):
    t = Tables(spark, sf)
    cells = V.with_cells(t.points, 50, ("x_mm", "y_mm", "z_mm"))
    text = plan(V.hard_voxels(cells, 3, 200), "simple")
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_confusion_counts_are_combined_before_the_shuffle(spark, sf):
    text = plan(catalogue()["a5_class_areas"].run(spark, sf), "simple")
    assert "partial_count" in text


def test_settings_grow_with_the_input():
    from pointlake.session import scale_settings
    big = scale_settings(100 << 40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000
    assert scale_settings(1 << 30, 8)["spark.sql.shuffle.partitions"] == "16"


def test_points_are_never_broadcast_to_points(spark):
    """Tables exploded from small ones look small to the planner, at any size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        pts = spark.range(60).selectExpr("0L AS scene_id", "id AS point_idx", "double(id % 7) AS x", "double(id % 5) AS y", "0D AS z")
        pairs = R.radius_pairs(pts, 1.5)
        assert "BroadcastHashJoin" not in plan(pairs, "simple")
        met = R.radius_neighbours(pts, 1.5, cap=3)
        text = plan(met, "simple")
        for line in text.splitlines():  # only parts and limits of cells may be broadcast
            assert not ("BroadcastHashJoin" in line and ("src" in line or "[point_idx" in line)), line
        pixels = spark.range(9).selectExpr("id AS scene_id", "0L AS frame", "id AS u", "id AS v", "2D AS d", "9 AS w")
        depth = spark.range(9).selectExpr("id AS scene_id", "0L AS frame", "explode(sequence(0L, 8L)) AS u").selectExpr("*", "u AS v", "2D AS depth")
        found = P.depth_consistent(pixels, depth)
        assert "BroadcastHashJoin" not in plan(found, "simple")
        assert found.count() == 9
        near = {(r.src, r.dst) for r in R.radius_neighbours(pts, 1.5).collect()}
        rows = [(r.point_idx, r.x, r.y) for r in pts.collect()]
        assert near == {(a, b) for a, ax, ay in rows for b, bx, by in rows if (ax - bx) ** 2 + (ay - by) ** 2 < 2.25}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_depth_images_are_made_by_all_tasks(spark, sf):
    """Few frames become many pixels: they are dealt out before, and the merged index reads the correspondence once."""
    assert Tables(spark, sf).depth_images.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = catalogue()["w6_merge_indexes"].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "tile" not in plan
