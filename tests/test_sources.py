import os

import pytest
from pyspark.sql import functions as F

from segprofile import FeatureSpec, FilterSpec, OneOf, Range
from segprofile.functions.columns import percent_label
from segprofile.functions.staging import clear_staged, stage, staging_root
from segprofile.plans import analyses
from segprofile.sources.readers import column_roles, read_table, relabel, relabel_from
from segprofile.sources.report import read_report, write_report

SPEC = FeatureSpec(
    key=("id",),
    descriptive=("id",),
    numeric=("x", "y"),
    categorical=("grp", "c1"),
    group_key="grp",
    measures=("m",),
)


@pytest.fixture(scope="module")
def rows(make):
    return make(
        [
            (i, "ab"[i % 2], "pqr"[i % 3], "k", float(i * i % 17), float(i % 5) * (1 + i % 2), float(i))
            for i in range(60)
        ]
    ).cache()


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(rows, spark, tmp_path, fmt):
    path = str(tmp_path / f"t.{fmt}")
    writer = rows.write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    back = read_table(spark, path)
    assert back.count() == 60 and set(back.columns) == set(rows.columns)
    assert back.agg(F.sum("x")).first()[0] == rows.agg(F.sum("x")).first()[0]
    assert {n: t for n, t in back.dtypes}["x"] == "double"


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/nowhere", fmt="xls")


def test_column_roles(rows):
    found = {r["name"]: (r["type"], r["role"], r["n_missing"]) for r in column_roles(rows, SPEC).collect()}
    assert found["id"] == ("bigint", "descriptive", 0)
    assert found["x"] == ("double", "numeric", 0) and found["c1"] == ("string", "categorical", 0)


def test_relabel(make, spark):
    rows = make([(1, "a", "Yes"), (2, "b", None), (3, "c", "Maybe")])
    out = relabel(rows, {"c1": "keuze", "id": "nummer"}, {"c1": {"Yes": "Ja", "No": "Nee"}})
    assert [r["keuze"] for r in out.orderBy("nummer").collect()] == ["Ja", None, "Maybe"]
    labels = spark.createDataFrame([("a", "Stad"), ("b", "Dorp")], "old string, new string")
    named = relabel_from(rows, "grp", labels, "old", "new").orderBy("id").collect()
    assert [r["grp"] for r in named] == ["Stad", "Dorp", "c"]


def test_percent_label(make):
    text = make([(1, "a", "", "", 12.3456)]).select(percent_label(F.col("x")), percent_label(F.col("x"), 1)).first()
    assert tuple(text) == ("12.35%", "12.3%")


def test_report_round_trip(rows, spark, tmp_path):
    frames = {"one": rows.limit(3), "none": rows.where("false")}
    assert write_report(frames, str(tmp_path / "a"), skip_empty=True) == ["one"]
    assert write_report(frames, str(tmp_path / "b"), fmt="csv") == ["one", "none"]
    assert read_report(spark, str(tmp_path / "a"), "one").count() == 3
    assert read_report(spark, str(tmp_path / "b"), "one", "csv").count() == 3
    with pytest.raises(Exception):
        write_report(frames, str(tmp_path / "a"))
    assert write_report(frames, str(tmp_path / "a"), mode="overwrite") == ["one", "none"]


def test_staging_uses_the_named_folder(rows, spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert staging_root(spark) == root
    staged = stage(rows)
    assert root in staged.inputFiles()[0] and staged.schema == rows.schema
    assert stage(rows.where("false")).count() == 0
    folder = staged.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and clear_staged(spark) >= 2
    assert not os.path.exists(folder) and clear_staged(spark) == 0


def test_match_report(rows, tmp_path):
    chosen = FilterSpec([Range("x", 0, 10), OneOf("c1", ["p", "q"])])
    report = analyses.match_report(rows, SPEC, chosen)
    summary = report["match_summary"].first()
    assert summary.match_n == report["matching_rows"].count() and summary.total_n == 60
    assert report["nearest_rows"].count() == 10
    assert report["histograms"].agg(F.sum("n")).first()[0] == 2 * summary.match_n
    assert len(write_report(report, str(tmp_path / "r"))) == len(report)


def test_category_report(rows):
    report = analyses.category_report(rows, SPEC, k=4)
    assert report["nearest_rows"].count() == 8
    assert {r["grp"] for r in report["modes"].collect()} == {"a", "b"}
    assert report["box_stats"].count() == 4


def test_category_report_without_the_group_key_among_the_features(rows):
    report = analyses.category_report(rows, SPEC, FilterSpec(excluded=["grp", "y"]), k=4)
    near = report["nearest_rows"]
    assert "grp" not in near.columns and near.count() == 8
    assert report["means"].columns == ["grp", "x"]


def test_cluster_report(rows):
    report = analyses.cluster_report(rows, SPEC, k=3, nearest=2)
    assert report["sizes"].agg(F.sum("n")).first()[0] == 60
    assert report["nearest_rows"].count() == 6
    assert report["points"].columns == ["id", "cluster", "pc1", "pc2"]
    empty = analyses.cluster_report(rows, SPEC, FilterSpec([OneOf("c1", [])]))
    assert empty["rows"].count() == 0 and empty["means"].count() == 0 and "nearest_rows" not in empty
