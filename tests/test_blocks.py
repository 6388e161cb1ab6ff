"""The balanced join, statistics, numbering and running sums, with blocks of four keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointlake.functions import blocks as B
from pointlake.functions import rng
from pointlake.plans.draws import draw


@pytest.fixture(scope="module")
def hot(spark):
    """One key with a third of the rows."""
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(np.arange(600) % 3 == 0, 7, r.integers(0, 40, 600)), "point_idx": r.permutation(600), "v": r.normal(size=600)})
    return pdf, spark.createDataFrame(pdf)


def test_attach_equals_join(spark, hot):
    pdf, df = hot
    dim = pd.DataFrame({"g": [7, 7, 1, 99], "w": [1, 2, 3, 4]})
    got = B.attach(df, spark.createDataFrame(dim), ["g"], bits=2).toPandas()
    want = pdf.merge(dim, on="g")
    cols = ["g", "point_idx", "v", "w"]
    pd.testing.assert_frame_equal(got[cols].sort_values(cols).reset_index(drop=True), want[cols].sort_values(cols).reset_index(drop=True))
    left = B.attach(df, spark.createDataFrame(dim), ["g"], how="left", bits=2)
    assert left.count() == len(pdf.merge(dim, on="g", how="left"))


def test_with_stats_equals_groupby(hot):
    pdf, df = hot
    got = B.with_stats(df, ["g"], bits=2, lo=("min", F.col("v")), hi=("max", F.col("v")), s=("sum", F.col("v")), m=("avg", F.col("v")),
                       n=("count",), first=("first", F.col("v"))).toPandas().sort_values("point_idx").reset_index(drop=True)
    pdf = pdf.sort_values("point_idx").reset_index(drop=True)
    by = pdf.groupby("g")["v"]
    for col, fn in (("lo", "min"), ("hi", "max"), ("s", "sum"), ("m", "mean"), ("n", "count"), ("first", "first")):
        np.testing.assert_allclose(got[col], by.transform(fn))


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_ordinal_and_running_sum(hot, bits):
    pdf, df = hot
    got = B.ordinal(df, ["g"], ["point_idx"], "k", B.block_of(F.col("point_idx"), bits)).toPandas()
    want = pdf.sort_values("point_idx").groupby("g").cumcount()
    assert (got.set_index("point_idx")["k"].sort_index().to_numpy() == want.reindex(pdf.sort_values("point_idx").index).to_numpy()).all()
    got = B.running_sum(df, ["g"], ["point_idx"], B.block_of(F.col("point_idx"), bits), before=F.col("v")).toPandas().set_index("point_idx")["before"].sort_index()
    srt = pdf.sort_values("point_idx")
    np.testing.assert_allclose(got, srt.groupby("g")["v"].cumsum() - srt["v"], atol=1e-9)


def test_shuffled_is_a_permutation_and_does_not_depend_on_partitions(hot):
    _, df = hot
    a = B.shuffled(df, ["g"], "point_idx", "pos", 5).toPandas().sort_values("point_idx")
    b = B.shuffled(df.repartition(7), ["g"], "point_idx", "pos", 5).toPandas().sort_values("point_idx")
    assert (a["pos"].to_numpy() == b["pos"].to_numpy()).all()
    for _, part in a.groupby("g"):
        assert sorted(part["pos"]) == list(range(len(part)))
        assert (part["pos_n"] == len(part)).all()


def test_draws_are_uniform_and_equal_in_sql(spark):
    import duckdb
    df = spark.range(20000).select("id", rng.draw(3, F.col("id")).alias("d"), rng.uniform(3, F.col("id")).alias("u"), rng.normal(3, F.col("id")).alias("z")).toPandas()
    assert df["u"].between(0, 1, inclusive="left").all()
    counts = np.histogram(df["u"], bins=20, range=(0, 1))[0]
    assert abs(counts - 1000).max() < 160
    assert abs(df["z"].mean()) < 0.03 and abs(df["z"].std() - 1) < 0.03
    sql = duckdb.sql(f"SELECT {draw(3, 'range')} FROM range(20000)").fetchall()
    assert [r[0] for r in sql] == df["d"].tolist()


def test_best_class_over_cells(spark):
    """Cells of rows and classes that are far smaller than the tables give the best class and the lowest id of ties."""
    import numpy as np
    from pointlake.functions.vectors import best_class
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(40, 4)), rng.normal(size=(50, 4))
    w[31], w[7] = w[3], 2 * w[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, v array<double>")
    classes = spark.createDataFrame([(c * 1_000_003, v.tolist()) for c, v in enumerate(w)], "class_id bigint, embedding array<double>")
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, w)]
    scores = (unit[0] @ unit[1].T).round(9)
    got = {r["vec_id"]: (r["pred"], r["score"]) for r in best_class(rows, ["vec_id"], "v", classes, class_block=4, row_block=16, cell=12).collect()}
    assert {k: p for k, (p, _) in got.items()} == {i: int(c) * 1_000_003 for i, c in enumerate(scores.argmax(1))}
    assert np.allclose([got[i][1] for i in range(40)], scores.max(1), atol=1e-9)
    copied = best_class(rows, ["vec_id"], "v", classes)  # class ids are sparse: cells follow the number of classes
    assert {r["vec_id"]: r["pred"] for r in copied.collect()} == {k: p for k, (p, _) in got.items()}
