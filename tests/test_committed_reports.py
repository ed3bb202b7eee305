"""Reports that appear whole or not at all, and the view with a folder per cluster."""

import pytest
from pyspark.sql import functions as F

from segprofile.plans import analyses
from segprofile.sources import cluster_view as cv
from segprofile.sources.report import commit_report, committed_tables, read_committed
from segprofile.spec import FeatureSpec

SPEC = FeatureSpec(key=("id",), descriptive=("id",), numeric=("x", "y"), categorical=("c1", "c2"), group_key="grp")


@pytest.fixture(scope="module")
def rows(make):
    return make([(i, "abc"[i % 3], f"v{i % 4}", f"w{i % 5}", float(i % 7), float(i * i % 11), 1.0) for i in range(60)])


def names(spark, path, version=None):
    return [(r.name, r.n_rows) for r in committed_tables(spark, path, version).orderBy("place").collect()]


def test_tables_of_a_version_belong_together(rows, spark, tmp_path):
    path = str(tmp_path / "r")
    first = commit_report({"all": rows, "none": rows.where("id < 0"), "some": rows.where("id < 7")}, path, skip_empty=True)
    assert names(spark, path) == [("all", 60), ("some", 7)]
    second = commit_report({"all": rows.where("id < 5"), "none": rows.where("id < 0")}, path, fmt="csv")
    assert names(spark, path) == [("all", 5), ("none", 0)]
    assert names(spark, path, first) == [("all", 60), ("some", 7)]
    assert read_committed(spark, path, "all").count() == 5
    assert read_committed(spark, path, "all", first).count() == 60
    assert second > first
    with pytest.raises(KeyError):
        read_committed(spark, path, "some")


def test_a_report_that_fails_halfway_leaves_the_old_one(rows, spark, tmp_path):
    path = str(tmp_path / "r")
    commit_report({"one": rows, "two": rows, "three": rows}, path)
    broken = rows.withColumn("x", F.when(F.col("id") >= 0, F.raise_error(F.lit("no"))).cast("double"))
    with pytest.raises(Exception, match="no"):
        commit_report({"one": rows.limit(1), "two": rows.limit(2), "three": broken}, path)
    assert names(spark, path) == [("one", 60), ("two", 60), ("three", 60)]
    assert read_committed(spark, path, "two").count() == 60


def test_reports_without_rows(rows, spark, tmp_path):
    path = str(tmp_path / "r")
    commit_report({"none": rows.where("id < 0")}, path, skip_empty=True)
    assert names(spark, path) == []
    with pytest.raises(ValueError):
        commit_report({}, path)


def test_whole_category_report_commits(rows, spark, tmp_path):
    found = analyses.category_report(rows, SPEC, k=4)
    commit_report(found, str(tmp_path / "c"), skip_empty=True)
    sizes = dict(names(spark, str(tmp_path / "c")))
    assert sizes["means"] == sizes["modes"] == 3 and sizes["nearest_rows"] == 12
    assert set(sizes) == set(found)


def test_given_labels_give_the_cluster_report(rows):
    found = analyses.labelled_report(rows.withColumn("cluster", (F.col("id") % 2).cast("int")), rows, SPEC, nearest=2)
    assert found["sizes"].agg(F.sum("n")).first()[0] == 60
    assert found["without_modes"].count() == 0 and found["nearest_rows"].count() == 4


def test_scaled_features_beside_the_label(rows):
    scaled = cv.scaled_rows(rows.withColumn("cluster", F.col("id") % 3), ["x", "y"])
    assert scaled.columns == [*rows.columns, "z_x", "z_y", "cluster"]
    stats = scaled.agg(F.avg("z_x"), F.stddev_pop("z_x"), F.avg("z_y"), F.stddev_pop("z_y")).first()
    assert tuple(stats) == pytest.approx((0, 1, 0, 1), abs=1e-9)
    assert scaled.where("id = 8").first()["x"] == 1.0


def test_clusters_are_replaced_one_by_one(rows, spark, tmp_path):
    path = str(tmp_path / "v")
    label = rows.withColumn("cluster", (F.col("id") % 3).cast("int"))
    cv.write_cluster_view(cv.cluster_view(label, ["x", "y"]), path)
    assert cv.read_clusters(spark, path).count() == 60
    assert sorted(r.id for r in cv.read_clusters(spark, path, [1]).collect()) == list(range(1, 60, 3))
    only = cv.cluster_view(label, ["x", "y"]).where("cluster = 1 AND id < 10")
    cv.write_cluster_view(only, path)
    counts = {r.cluster: r.n for r in cv.read_clusters(spark, path).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 20, 1: 3, 2: 20}


def test_reading_a_cluster_opens_its_folder_only(rows, spark, tmp_path):
    path = str(tmp_path / "v")
    cv.write_cluster_view(cv.cluster_view(rows.withColumn("cluster", (F.col("id") % 4).cast("int")), ["x", "y"]), path)
    one = cv.read_clusters(spark, path, [2])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan and "= 2" in plan
    assert {f.split("cluster=")[1].split("/")[0] for f in (r[0] for r in one.select(F.input_file_name()).distinct().collect())} == {"2"}
    assert cv.read_clusters(spark, path, [9]).count() == 0
