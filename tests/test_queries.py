"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__
import check
from pointlake.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query_matches_sql(spark, con, sf, name):
    verdict, rows, _ = check.compare(spark, con, catalogue()[name], sf)
    assert verdict == "ok"
    assert rows


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    df = __spark_entry__.entry(spark)
    row = df.first()
    low, high = sorted((row["base_mean"], row["novel_mean"]))
    assert 0 < low <= row["harmonic_mean"] <= high < 1
