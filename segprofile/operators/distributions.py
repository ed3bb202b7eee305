"""The numbers under each distribution chart: bins, density curves, box plots."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segprofile.functions.columns import col, cols, double
from segprofile.functions.staging import stage
from segprofile.operators.quantiles import SIDE_BY_SIDE, extents, grouped_quantiles

# a Gaussian kernel is below 2e-22 of its peak this many bandwidths away
_REACH = 10
# values are summed in cells this many to the bandwidth; within half a cell of its
# centre the kernel's series to this order is exact to double precision
_CELLS_PER_BANDWIDTH = 4
_ORDER = 12


def _with_bins(extent: DataFrame, bins) -> DataFrame:
    """Bin origin, count and width; a constant column gets one bin of width 1 around it."""
    spread = F.col("max") - F.col("min")
    flat = spread == 0
    bins = F.when(flat, F.lit(1)).otherwise(bins).cast("bigint")
    return extent.withColumn("bins", bins).select(
        "*",
        F.when(flat, F.col("min") - 0.5).otherwise(F.col("min")).alias("origin"),
        F.when(flat, F.lit(1.0)).otherwise(spread / F.col("bins")).alias("width"),
    )


def fixed_bins(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """The given number of equal bins per column."""
    return stage(_with_bins(extents(df, [], columns), F.lit(bins)))


def auto_bins(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bin count from sample size, range and quartile distance.

    Width is the smaller of two rules: range / (log2 n + 1), and the quartile
    rule 2 IQR / cbrt(n), the latter never below half of range / sqrt(n). Integers
    get no bins narrower than 1.
    """
    quartiles = grouped_quantiles(df, [], columns, [0.25, 0.75])
    n, spread = F.col("n").cast("double"), F.col("max") - F.col("min")
    by_quartiles = F.greatest(2.0 * (F.col("q1") - F.col("q0")) / F.cbrt(n), spread / F.sqrt(n) / 2.0)
    width = F.least(by_quartiles, spread / (F.log2(n) + 1.0))
    whole = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)]
    if whole:
        width = F.when(F.col("feature").isin(whole), F.greatest(width, F.lit(1.0))).otherwise(width)
    laid_out = _with_bins(quartiles, F.ceil(F.try_divide(spread, width)))
    return stage(laid_out.select("feature", "n", "min", "max", "sd", "origin", "width", "bins"))


def _layout_rows(layout: DataFrame, columns: Sequence[str]) -> dict[int, Row]:
    """The layout, a row per column of the table, by the column's position."""
    found = {r["feature"]: r for r in layout.collect()}
    return {i: found[c] for i, c in enumerate(columns) if c in found}


def _side_by_side(df: DataFrame, structs: list) -> DataFrame:
    """One row per struct and row, each column read once, a few columns at a time."""
    some = [structs[i : i + SIDE_BY_SIDE] for i in range(0, len(structs), SIDE_BY_SIDE)]
    return reduce(
        lambda a, b: a.unionByName(b), [df.select(F.inline(F.array(*few))) for few in some]
    )


def _position(columns: Sequence[str]):
    return (F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature")) - 1).cast("int")


def histogram(df: DataFrame, columns: Sequence[str], layout: DataFrame) -> DataFrame:
    """Counts per bin, empty bins included: ``(feature, bin, lo, hi, n)``.

    ``layout`` comes from ``fixed_bins`` or ``auto_bins``; its few numbers become
    constants of the plan. Bins are worked out side by side in one pass and
    counted where the rows are read; only bin counts are shuffled.
    """
    layout = layout.select("feature", "origin", "width", "bins")

    def bin_of(i: int, r: Row):
        index = F.floor((double(r["feature"]) - F.lit(r["origin"])) / F.lit(r["width"]))
        inside = F.when(double(r["feature"]).isNotNull(), F.least(index, F.lit(r["bins"] - 1)))
        return F.struct(F.lit(i).alias("position"), inside.alias("bin"))

    bins = [bin_of(i, r) for i, r in _layout_rows(layout, columns).items()]
    every = layout.select(
        "*",
        _position(columns).alias("position"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"),
    )
    if bins:
        counts = (
            _side_by_side(df, bins)
            .where("bin IS NOT NULL")
            .groupBy("position", "bin")
            .agg(F.count("*").alias("n"))
        )
        every = every.join(counts, ["position", "bin"], "left")
    else:
        every = every.withColumn("n", F.lit(0).cast("bigint"))
    return every.select(
        "feature",
        "bin",
        (F.col("origin") + F.col("bin") * F.col("width")).alias("lo"),
        (F.col("origin") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n"),
    )


def kde_curve(
    df: DataFrame, columns: Sequence[str], layout: DataFrame, grid: int = 200
) -> DataFrame:
    """Gaussian density at ``grid`` points from min to max, scaled to the bin counts.

    With T = (point - c) / h and u = (value - c) / h around a cell centre c,
    exp(-(T - u)^2 / 2) = exp(-T^2 / 2) * sum over m of (T^m / m!) * u^m exp(-u^2 / 2).
    So the rows are read once into a few sums per cell, before any shuffle, and
    only cells meet grid points. A constant column has no curve.
    """
    setup = (
        layout.where((F.col("sd") > 0) & (F.col("max") > F.col("min")))
        .withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .withColumn("step", (F.col("max") - F.col("min")) / (grid - 1))
        .select("feature", _position(columns).alias("position"), "min", "width", "h", "step")
    )

    def cell_of(i: int, r: Row):
        z = (double(r["feature"]) - F.lit(r["min"])) / F.lit(r["h"])
        cell = F.rint(z * float(_CELLS_PER_BANDWIDTH))
        return F.struct(
            F.lit(i).alias("position"),
            cell.cast("bigint").alias("cell"),
            (z - cell / float(_CELLS_PER_BANDWIDTH)).alias("u"),
        )

    cells = [cell_of(i, r) for i, r in _layout_rows(setup, columns).items()]
    points = setup.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    if not cells:
        return points.select("feature", "point", F.col("min").alias("x"), F.col("h").alias("density"))
    powers = [F.exp(F.lit(-0.5) * F.col("u") * F.col("u"))]
    for _ in range(_ORDER):
        powers.append(powers[-1] * F.col("u"))
    moments = (
        _side_by_side(df, cells)
        .where("cell IS NOT NULL")
        .groupBy("position", "cell")
        .agg(*[F.sum(p).alias(f"s{m}") for m, p in enumerate(powers)])
    )

    center = F.col("cell") * F.col("h") / _CELLS_PER_BANDWIDTH
    reach = F.lit(float(_REACH)) * F.col("h")
    first = F.greatest(F.ceil((center - reach) / F.col("step")), F.lit(0).cast("bigint"))
    last = F.least(F.floor((center + reach) / F.col("step")), F.lit(grid - 1).cast("bigint"))
    series = F.col(f"s{_ORDER}") / math.factorial(_ORDER)
    for m in reversed(range(_ORDER)):
        series = series * F.col("T") + F.col(f"s{m}") / math.factorial(m)
    # the setup has one row per column of the table, hence the broadcast
    sums = (
        moments.join(F.broadcast(setup.select("position", "h", "step")), "position")
        .where(first <= last)
        .select("*", F.explode(F.sequence(first, last)).alias("point"))
        .withColumn("T", (F.col("point") * F.col("step") - center) / F.col("h"))
        .groupBy("position", F.col("point").cast("int").alias("point"))
        .agg(F.sum(F.exp(F.lit(-0.5) * F.col("T") * F.col("T")) * series).alias("kernel"))
    )
    scale = F.col("width") / (F.col("h") * math.sqrt(2.0 * math.pi))
    return points.join(sums, ["position", "point"], "left").select(
        "feature",
        "point",
        (F.col("min") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce(F.col("kernel"), F.lit(0.0)) * scale).alias("density"),
    )


def _fences(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Quartiles and the fences 1.5 quartile distances outside them, as a written table."""
    known = df.where(col(by).isNotNull())
    q = grouped_quantiles(known, [by], columns, [0.25, 0.5, 0.75])
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    return stage(
        q.select(
            col(by),
            "feature",
            "n",
            F.col("q0").alias("q1"),
            F.col("q1").alias("median"),
            F.col("q2").alias("q3"),
            (F.col("q0") - reach).alias("fence_lo"),
            (F.col("q2") + reach).alias("fence_hi"),
        )
    )


def _beside_fences(df: DataFrame, ids, by: str, columns: Sequence[str], fences: DataFrame) -> DataFrame:
    """Rows ``(ids..., x0, x1, ..., lo0, hi0, ...)``, joined once per row, by category."""
    wide = (
        fences.withColumn("position", _position(columns))
        .groupBy(col(by))
        .agg(
            *[
                F.expr(f"max(fence_{e}) FILTER (WHERE position = {i}) AS {e}{i}")
                for i in range(len(columns))
                for e in ("lo", "hi")
            ]
        )
    )
    values = [double(c).alias(f"x{i}") for i, c in enumerate(columns)]
    return df.select(*cols(ids), *values).join(wide, [by])


def box_stats(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers and outlier count per category and column.

    A whisker ends at the last value inside the fence.
    """
    fences = _fences(df, by, columns)
    spread = (
        _beside_fences(df, [by], by, columns, fences)
        .groupBy(col(by))
        .agg(
            *[
                F.expr(figure.format(i=i))
                for i in range(len(columns))
                for figure in (
                    "min(x{i}) FILTER (WHERE x{i} >= lo{i}) AS inner_lo{i}",
                    "max(x{i}) FILTER (WHERE x{i} <= hi{i}) AS inner_hi{i}",
                    "count_if(x{i} < lo{i} OR x{i} > hi{i}) AS outside{i}",
                )
            ]
        )
        .select(
            col(by),
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("feature"),
                            F.col(f"inner_lo{i}").alias("inner_lo"),
                            F.col(f"inner_hi{i}").alias("inner_hi"),
                            F.col(f"outside{i}").alias("n_outliers"),
                        )
                        for i, c in enumerate(columns)
                    ]
                )
            ),
        )
    )
    return spread.join(fences, [by, "feature"]).select(
        col(by).alias("category"),
        "feature",
        "n",
        "q1",
        "median",
        "q3",
        F.least(F.col("inner_lo"), F.col("q1")).alias("whisker_lo"),
        F.greatest(F.col("inner_hi"), F.col("q3")).alias("whisker_hi"),
        "n_outliers",
    )


def box_outliers(
    df: DataFrame, by: str, columns: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """The values beyond the fences, with the key of their row."""
    fences = _fences(df, by, columns)
    ids = list(dict.fromkeys([*key, by]))

    def beyond(i: int, c: str):
        x = F.col(f"x{i}")
        outside = (x < F.col(f"lo{i}")) | (x > F.col(f"hi{i}"))
        return F.when(outside, F.struct(F.lit(c).alias("feature"), x.alias("value")))

    found = F.inline(F.array(*[beyond(i, c) for i, c in enumerate(columns)]))
    return (
        _beside_fences(df, ids, by, columns, fences)
        .select(*cols(ids), found)
        .where("feature IS NOT NULL")
        .select(*cols(key), col(by).alias("category"), "feature", "value")
    )
