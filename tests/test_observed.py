"""Figures seen while rows are written equal those of a pass of their own."""

import re

import pytest
from pyspark.sql import functions as F

from segprofile.operators import filters, metrics
from segprofile.operators.observed import observed_matches, write_matching

MEASURES = {"total": "x", "m": "m"}


@pytest.fixture(scope="module")
def rows(make):
    odd = [(90, "g", "a", "b", float("nan"), 1.0, 2.0), (91, "g", "a", "b", float("inf"), 1.0, 2.0), (92, "g", None, None, None, None, None)]
    return make([(i, "g", "ab"[i % 2], "c", float(i), float(i % 5), 0.5) for i in range(80)] + odd)


def test_same_figures_and_rows(rows, spark, tmp_path):
    predicate = (F.col("c1") == "a") & (F.col("id") < 60)
    found = write_matching(rows, predicate, ["id", "x"], str(tmp_path / "m"), MEASURES, ["x", "y"])
    assert found.summary().collect() == metrics.match_summary(rows, predicate, MEASURES).collect()
    assert sorted(found.bad_values().collect()) == sorted(filters.bad_value_report(rows, ["x", "y"]).collect())
    written = spark.read.parquet(str(tmp_path / "m"))
    assert written.columns == ["id", "x"] and written.count() == found.n_matching == 30


def test_nothing_matches_and_no_rows(rows, make, tmp_path):
    none = write_matching(rows, F.col("id") < 0, ["id"], str(tmp_path / "a"), MEASURES)
    assert none.n_matching == 0 and none.summary().first()["total_n"] == 83
    empty = write_matching(make([]), F.col("id") < 5, ["id"], str(tmp_path / "b"), MEASURES, ["x"])
    assert empty.summary().collect() == metrics.match_summary(make([]), F.col("id") < 5, MEASURES).collect()


def test_one_scan_and_no_shuffle(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows, _, _ = observed_matches(lines, F.col("l_tax") > 0.01, ["l_orderkey"], {"qty": "l_quantity"}, ["l_discount"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1 and "Exchange" not in plan and "CollectMetrics" in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan
