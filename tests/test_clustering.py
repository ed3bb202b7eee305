import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segprofile.operators import clustering, reduction

INF = float("inf")


def blobs(spark, per=60):
    """Four well separated groups of unequal size."""
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for b, (cx, cy) in enumerate([(0, 0), (100, 0), (0, 100), (100, 100)]):
        for _ in range(per * (4 - b)):
            rows.append((i, float(cx + rng.normal()), float(cy + rng.normal()), 7.0, f"b{b}"))
            i += 1
    return spark.createDataFrame(rows, "id long, x double, y double, z double, blob string")


def test_separated_groups_are_found(spark):
    df = blobs(spark)
    found = clustering.cluster_rows(df, ["x", "y", "z"], k=4)
    pairs = found.rows.groupBy("blob", "cluster").count().collect()
    # largest group first, so the numbering is known
    assert {(r["blob"], r["cluster"], r["count"]) for r in pairs} == {
        ("b0", 0, 240), ("b1", 1, 180), ("b2", 2, 120), ("b3", 3, 60),
    }
    assert found.rows.columns == [*df.columns, "cluster"]
    assert len(found.centers) == 4 and found.cost < 10
    sizes = clustering.cluster_sizes(found.rows).collect()
    assert [r.n for r in sizes] == [240, 180, 120, 60] and sum(r.pct for r in sizes) == pytest.approx(100)


def test_fewer_rows_than_clusters(make):
    rows = make([(i, "a", "", "", float(i), 1.0) for i in range(3)])
    found = clustering.cluster_rows(rows, ["x", "y"])
    assert found.k == 3 and found.rows.select("cluster").distinct().count() == 3


def test_no_rows(make):
    found = clustering.cluster_rows(make([]), ["x", "y"])
    assert found.k == 0 and found.rows.columns[-1] == "cluster" and found.rows.count() == 0
    assert found.centers == []


def test_repeated_points(make):
    rows = make([(i, "a", "", "", float(i % 2), 1.0) for i in range(6)])
    found = clustering.cluster_rows(rows, ["x", "y"])
    assert 1 <= found.rows.select("cluster").distinct().count() <= 2


def test_bad_values(make):
    rows = make([(i, "a", "", "", float(i), 1.0) for i in range(8)] + [(9, "a", "", "", None, 1.0)])
    with pytest.raises(clustering.BadValuesError):
        clustering.cluster_rows(rows, ["x", "y"])
    assert clustering.cluster_rows(rows, ["x", "y"], k=2, missing="drop").rows.count() == 8
    assert clustering.cluster_rows(rows, ["x", "y"], k=2, missing="impute").rows.count() == 9
    endless = rows.withColumn("x", F.when(F.col("id") == 1, F.lit(INF)).otherwise(F.col("x")))
    with pytest.raises(clustering.BadValuesError):
        clustering.cluster_rows(endless, ["x", "y"], missing="drop")
    with pytest.raises(ValueError):
        clustering.cluster_rows(rows, ["x"], missing="guess")


def test_standardize_and_impute(make):
    rows = make([(1, "a", "", "", 1.0, 4.0), (2, "a", "", "", 3.0, 4.0), (3, "a", "", "", None, 4.0)])
    z = {r.id: (r.x, r.y) for r in clustering.standardize(rows, ["x", "y"]).collect()}
    assert z == {1: (-1.0, 0.0), 2: (1.0, 0.0), 3: (None, 0.0)}
    assert [r.x for r in clustering.impute_mean(rows, ["x"]).orderBy("id").collect()] == [1.0, 3.0, 2.0]


def test_summary_and_clusters_without_modes(make):
    rows = make([(1, "a", "p", "", 1.0), (2, "a", "q", "", 3.0), (3, "b", "r", "", 5.0)])
    labelled = rows.withColumn("cluster", F.when(F.col("grp") == "a", 0).otherwise(1))
    found = {r.cluster: r for r in clustering.cluster_summary(labelled, ["x"], ["c1"], ["id"]).collect()}
    assert (found[0].x, found[0].c1, found[1].c1) == (2.0, "p", "r")
    left = clustering.clusters_without_modes(labelled, labelled.where("cluster = 0"))
    assert [r.cluster for r in left.collect()] == [1]


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id long, " + ", ".join(f"{n} double" for n in names))
    found = reduction.principal_components(df, names, ["id"])
    z = (a - a.mean(axis=0)) / a.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(values)[::-1][:3]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(3)])
    assert found.explained == pytest.approx(values[order] / values.sum())
    mine = [(r.pc1, r.pc2, r.pc3) for r in found.rows.orderBy("id").collect()]
    assert np.allclose(mine, z @ vectors)
    variance = reduction.component_variance(found).collect()
    assert [r.variance / 4 for r in variance] == pytest.approx(list(found.explained))


def test_at_most_as_many_components_as_features(make):
    rows = make([(i, "a", "", "", float(i), float(i * i)) for i in range(5)])
    assert reduction.principal_components(rows, ["x", "y"], ["id"]).rows.columns == ["id", "pc1", "pc2"]


def test_covariance(make):
    rows = make([(i, "a", "", "", float(i), float(-2 * i)) for i in range(4)])
    found = {(r.feature_a, r.feature_b): r.covariance for r in reduction.feature_covariance(rows, ["x", "y"]).collect()}
    assert found["x", "x"] == pytest.approx(5 / 3) and found["x", "y"] == pytest.approx(-10 / 3)
    assert len(found) == 3 and not math.isnan(found["y", "y"])


def test_fits_read_written_numbers_and_no_cached_table(spark, monkeypatch):
    cached, fit = [], clustering.KMeans.fit

    def watched(self, rows):
        cached.append(rows.storageLevel.useMemory)
        return fit(self, rows)

    monkeypatch.setattr(clustering.KMeans, "fit", watched)
    found = clustering.cluster_rows(blobs(spark), ["x", "y", "z"], k=4, restarts=2)
    assert cached == [False, False] and found.rows.groupBy("cluster").count().count() == 4
