import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segprofile.operators import distributions as dist
from segprofile.operators.quantiles import grouped_quantiles


def uneven(spark, n=3000):
    """Heavy tail, one hot group, one value making up a third of it, and gaps."""
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(0, 3, n))
    x[: n // 3] = 2.5
    group = np.where(rng.random(n) < 0.8, "hot", np.where(rng.random(n) < 0.5, "b", "c"))
    pdf = pd.DataFrame({"id": np.arange(n), "g": group, "x": x, "y": rng.integers(0, 5, n).astype(float)})
    pdf.loc[::17, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("order_at_once", [100_000, 50, 1])
def test_quantiles_equal_numpy(spark, order_at_once):
    pdf, df = uneven(spark)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = grouped_quantiles(df, ["g"], ["x", "y"], probs, order_at_once).collect()
    assert len(found) == 6
    for r in found:
        values = pdf.loc[pdf.g == r["g"], r["feature"]].dropna()
        assert r["n"] == len(values)
        want = np.quantile(values, probs)
        assert [r[f"q{t}"] for t in range(5)] == pytest.approx(list(want), rel=1e-12)


@pytest.mark.parametrize("n", range(1, 9))
def test_quantiles_of_few_rows(spark, n):
    values = [float(v * v) for v in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = grouped_quantiles(df, [], ["x"], [0.25, 0.5, 0.75], order_at_once=1).first()
    assert [r.q0, r.q1, r.q2] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_quantiles_with_infinite_values_end(spark):
    df = spark.createDataFrame([(float(v),) for v in range(9)] + [(math.inf,)], "x double")
    assert grouped_quantiles(df, [], ["x"], [0.5], order_at_once=1).first().q0 == 4.5


def test_probabilities_in_any_order(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    r = grouped_quantiles(df, [], ["x"], [0.9, 0.1]).first()
    assert (r.q0, r.q1) == (9.0, 1.0)


def test_fixed_bins_equal_numpy(spark):
    pdf, df = uneven(spark)
    found = dist.histogram(df, ["x", "y"], dist.fixed_bins(df, ["x", "y"], 7)).collect()
    for c in ("x", "y"):
        counts, edges = np.histogram(pdf[c].dropna(), 7)
        mine = sorted((r for r in found if r.feature == c), key=lambda r: r.bin)
        assert [r.n for r in mine] == list(counts)
        assert [r.lo for r in mine] == pytest.approx(list(edges[:-1]))


def test_auto_bins_equal_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.gamma(2.0, 3.0, 2500), "y": rng.normal(10, 1, 2500)})
    df = spark.createDataFrame(pdf)
    layout = {r.feature: r for r in dist.auto_bins(df, ["x", "y"]).collect()}
    for c in ("x", "y"):
        assert layout[c].bins == len(np.histogram_bin_edges(pdf[c], "auto")) - 1


def test_constant_column(make):
    rows = make([(i, "a", "", "", 1.0 * i, 7.0) for i in range(5)])
    layout = dist.auto_bins(rows, ["y"])
    r = dist.histogram(rows, ["y"], layout).collect()
    assert [(b.lo, b.hi, b.n) for b in r] == [(6.5, 7.5, 5)]
    assert dist.kde_curve(rows, ["y"], layout).count() == 0


def test_density_curve_equals_direct_sum(spark):
    pdf, df = uneven(spark)
    df = df.withColumn("z", F.log("x"))
    values = np.log(pdf.x.dropna().to_numpy())
    layout = dist.fixed_bins(df, ["z"], 30)
    found = sorted(dist.kde_curve(df, ["z"], layout, grid=50).collect(), key=lambda r: r.point)
    n, h = len(values), values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 50)
    kernel = np.exp(-0.5 * ((grid[:, None] - values[None, :]) / h) ** 2).sum(axis=1)
    want = kernel / (h * math.sqrt(2 * math.pi)) * (np.ptp(values) / 30)
    assert [r.x for r in found] == pytest.approx(list(grid))
    assert [r.density for r in found] == pytest.approx(list(want), rel=1e-9, abs=1e-12)
    assert n == df.where("z IS NOT NULL AND NOT isnan(z)").count()


def test_box_plot(spark):
    pdf, df = uneven(spark, 900)
    found = {(r.category, r.feature): r for r in dist.box_stats(df, "g", ["x", "y"]).collect()}
    outliers = dist.box_outliers(df, "g", ["x", "y"], ["id"])
    for (g, c), r in found.items():
        values = pdf.loc[pdf.g == g, c].dropna().to_numpy()
        q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, q2, q3))
        assert r.whisker_lo == pytest.approx(min(values[values >= lo].min(), q1))
        assert r.whisker_hi == pytest.approx(max(values[values <= hi].max(), q3))
        assert r.n_outliers == int(((values < lo) | (values > hi)).sum())
    assert outliers.count() == sum(r.n_outliers for r in found.values())


@pytest.mark.parametrize("order_at_once", [100_000, 5])
def test_quantiles_beside_infinite_values(spark, order_at_once):
    values = [float("-inf")] * 2 + [float(v) for v in range(50)] + [float("inf")] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = grouped_quantiles(df, [], ["x"], [0.0, 0.25, 0.5, 1.0], order_at_once).first()
    assert (r.n, r.q0, r.q3) == (55, float("-inf"), float("inf"))
    assert (r.q1, r.q2) == (values[13] + 0.5, values[27])


def test_quantiles_of_nothing_finite_and_of_the_widest_values(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", float("inf")), ("b", -1.7e308), ("b", 0.0), ("b", 1.7e308)], "g string, x double")
    found = {r["g"]: r for r in grouped_quantiles(df, ["g"], ["x"], [0.0, 0.5, 1.0], order_at_once=1).collect()}
    assert [found["a"][f"q{i}"] for i in range(3)] == [float("inf")] * 3
    assert [found["b"][f"q{i}"] for i in range(3)] == [-1.7e308, 0.0, 1.7e308]


def test_auto_bins_of_integers_equal_numpy(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": np.arange(1000) % 5, "y": rng.integers(-400, 900, 1000)})
    layout = {r.feature: r for r in dist.auto_bins(spark.createDataFrame(pdf), ["x", "y"]).collect()}
    for c in ("x", "y"):
        assert layout[c].bins == len(np.histogram_bin_edges(pdf[c], "auto")) - 1
