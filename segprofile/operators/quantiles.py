"""Exact grouped quantiles that never hold a group in one place.

The wanted ranks are closed in on by counting. A pass splits the interval that
holds a rank into equal cells, counts them, and keeps the cell with the rank;
its true smallest and largest value are the next interval. Once an interval
holds few enough values they are put in order. Every pass adds up before the
shuffle, and the number of values ordered at once is bounded however large or
uneven the groups are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segprofile.functions.columns import cols, double
from segprofile.functions.staging import stage

_CELLS = 4096
# features read side by side; more in one expression grow past what the JVM compiles
SIDE_BY_SIDE = 4


def extents(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(by..., feature, n, min, max, sd, low, high, least, most)`` from one pass; features without values left out."""
    infinity = F.lit(float("inf"))

    def finite(x):
        return F.when(F.abs(x) < infinity, x)

    figures = {
        "n": F.count,
        "min": F.min,
        "max": F.max,
        "sd": F.stddev_samp,
        # infinite values at either end, and the extent of the others
        "low": lambda x: F.count_if(x == -infinity),
        "high": lambda x: F.count_if(x == infinity),
        "least": lambda x: F.min(finite(x)),
        "most": lambda x: F.max(finite(x)),
    }
    wide = df.groupBy(*cols(by)).agg(
        *[f(double(c)).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in figures.items()]
    )
    return wide.select(
        *cols(by),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"), *[F.col(f"{name}{i}").alias(name) for name in figures]
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ),
    ).where("n > 0")


def _targets(extent: DataFrame, at: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The ranks on either side of each quantile, each with the interval known to hold it.

    ``before`` values lie below the interval and ``total`` in it. Ranks among the infinite
    values are known at once, so every open interval is finite.
    """
    sides = []
    for t, q in enumerate(probs):
        lower, above = f"floor({float(q)!r}D * (n - 1))", f"({float(q)!r}D * (n - 1)) % 1"
        sides.append(f"named_struct('t', {t}, 'rank', {lower}, 'weight', 1 - {above})")
        sides.append(f"named_struct('t', {t}, 'rank', {lower} + 1, 'weight', {above})")
    ranks = extent.select("*", F.expr(f"inline(array({', '.join(sides)}))")).where("weight > 0")

    def end(name: str):
        infinity = "CAST('Infinity' AS DOUBLE)"
        return F.expr(
            f"CASE WHEN rank < low THEN -{infinity} WHEN rank >= n - high THEN {infinity} ELSE {name} END"
        )

    return ranks.select(
        *cols(at),
        end("least").alias("lo"),
        end("most").alias("hi"),
        F.col("low").alias("before"),
        F.expr("n - low - high AS total"),
        F.expr("0 AS segment"),
        "t",
        "rank",
        "weight",
    )


def _located(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], targets: DataFrame, segments: int
) -> DataFrame:
    """``(by..., feature, segment, lo, hi, value)``: the values inside any open interval.

    Each feature is read once, a few features at a time.
    """
    some = [columns[i : i + SIDE_BY_SIDE] for i in range(0, len(columns), SIDE_BY_SIDE)]
    return reduce(
        lambda a, b: a.unionByName(b), [_located_few(df, by, few, targets, segments) for few in some]
    )


def _located_few(df, by, columns: Sequence[str], targets: DataFrame, segments: int) -> DataFrame:
    """Rows meet the intervals of these features at once, by group; only kept values multiply.

    Intervals of one group are equal or apart, and numbered as segments; a slot
    is a feature and a segment.
    """
    slots = [range(i * segments, (i + 1) * segments) for i in range(len(columns))]
    names = F.array(*[F.lit(c) for c in columns])
    intervals = (
        # an interval of one value is found already
        targets.where("lo < hi")
        .withColumn("slot", (F.array_position(names, F.col("feature")) - 1) * segments + F.col("segment"))
        .groupBy(*cols(by))
        .agg(
            *[
                F.expr(f"max({e}) FILTER (WHERE slot = {j}) AS {e}{j}")
                for own in slots
                for j in own
                for e in ("lo", "hi")
            ]
        )
    )
    rows = df.select(*cols(by), *[double(c).alias(f"x{i}") for i, c in enumerate(columns)])
    if by:
        # groups without an open interval drop out;
        # the targets are a written table, so their known size decides how they are joined
        rows = rows.join(intervals, list(by))
    else:
        # one row, two numbers per slot
        rows = rows.withColumns({c: F.lit(v).cast("double") for c, v in intervals.first().asDict().items()})

    def slot(i: int):
        inside = " ".join(f"WHEN x{i} BETWEEN lo{j} AND hi{j} THEN {j}" for j in slots[i])
        return F.expr(f"CASE {inside} END AS slot{i}")

    def end(e: str, i: int) -> str:
        return f"CASE slot{i} " + " ".join(f"WHEN {j} THEN {e}{j}" for j in slots[i]) + " END"

    kept = ", ".join(
        f"CASE WHEN slot{i} IS NOT NULL THEN named_struct('slot', slot{i}, 'lo', {end('lo', i)}, "
        f"'hi', {end('hi', i)}, 'value', x{i}) END"
        for i in range(len(columns))
    )
    marked = rows.select("*", *[slot(i) for i in range(len(columns))])
    found = marked.select(*cols(by), F.expr(f"inline(array({kept}))")).where("slot IS NOT NULL")
    return found.select(
        *cols(by),
        F.get(names, F.expr(f"CAST(slot DIV {segments} AS INT)")).alias("feature"),
        F.expr(f"slot % {segments} AS segment"),
        "lo",
        "hi",
        "value",
    )


def _narrowed(df, by, columns, targets: DataFrame, segments: int) -> DataFrame:
    """Each target with the cell of its interval that holds its rank."""
    at = [*by, "feature"]
    part = [*at, "segment"]
    # the smallest value is in the first cell and the largest in the last, so every pass splits;
    # a width beyond the largest double is taken at half the scale
    infinity = "CAST('Infinity' AS DOUBLE)"
    share = f"CASE WHEN hi - lo < {infinity} THEN (value - lo) / (hi - lo) ELSE (value / 2 - lo / 2) / (hi / 2 - lo / 2) END"
    place = f"least(floor({share} * {_CELLS}), {_CELLS - 1})"
    cell = F.expr(f"CASE WHEN hi > lo THEN {place} ELSE 0 END AS cell")
    cells = (
        _located(df, by, columns, targets, segments)
        .groupBy(*cols(part), cell)
        .agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
    )
    earlier = W.partitionBy(*cols(part)).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    start = F.col("before") + F.col("earlier")
    names = [*at, "lo", "hi", "before", "total", "t", "rank", "weight"]
    narrower = (
        targets.where("lo < hi")
        .drop("lo", "hi", "total")
        .join(cells, part)
        .where((F.col("rank") >= start) & (F.col("rank") < start + F.col("n")))
        .withColumnsRenamed({"first": "lo", "last": "hi", "n": "total"})
        .withColumn("before", start)
    )
    both = narrower.select(*cols(names)).unionByName(targets.where("lo >= hi").select(*cols(names)))
    open_ones = W.partitionBy(*cols(at), F.col("lo") < F.col("hi")).orderBy("before")
    return both.withColumn("segment", F.dense_rank().over(open_ones) - 1)


def _ordered(df, by, columns, targets: DataFrame, segments: int) -> DataFrame:
    """``(by..., feature, t, quantile)`` by ordering what is left in the intervals."""
    at = [*by, "feature"]
    part = [*at, "segment"]
    names = [*at, "t", "rank", "weight", "value"]
    values = targets.where("lo >= hi").withColumn("value", F.col("lo")).select(*cols(names))
    if columns:
        kept = (
            _located(df, by, columns, targets, segments)
            .groupBy(*cols(part), "value")
            .agg(F.count("*").alias("n"))
        )
        upto = W.partitionBy(*cols(part)).orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
        ranked = kept.withColumn("upto", F.sum("n").over(upto))
        end = F.col("before") + F.col("upto")
        ordered = (
            targets.where("lo < hi")
            .join(ranked, part)
            .where((F.col("rank") >= end - F.col("n")) & (F.col("rank") < end))
        )
        values = values.unionByName(ordered.select(*cols(names)))
    below, above = F.col("below"), F.col("above")
    return (
        values.groupBy(*cols(at), "t")
        .agg(
            F.min("value").alias("below"),
            F.max("value").alias("above"),
            F.max_by("weight", "rank").alias("weight"),
        )
        .select(
            *cols(at),
            "t",
            F.when(below == above, below)
            .otherwise(below + (above - below) * F.col("weight"))
            .alias("quantile"),
        )
    )


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    order_at_once: int = 100_000,
) -> DataFrame:
    """Exact quantiles, linear between neighbours, with the extent of the values.

    Output: ``(by..., feature, n, min, max, sd, q0, q1, ...)``. Missing values are
    skipped; ``by`` columns must not be missing. ``order_at_once`` is the number
    of values one task may have to put in order.
    """
    at = [*by, "feature"]
    extent = stage(extents(df, by, columns))
    targets = _targets(extent, at, probs)
    while True:
        state = targets.where("lo < hi").groupBy("feature").agg(F.max("total"), F.max("segment")).collect()
        unsettled = {r["feature"] for r in state}
        columns = [c for c in columns if c in unsettled]
        segments = max((r[2] + 1 for r in state), default=1)
        if max((r[1] for r in state), default=0) <= order_at_once:
            break
        targets = stage(_narrowed(df, by, columns, targets, segments))
    found = _ordered(df, by, columns, targets, segments)
    wide = found.groupBy(*cols(at)).agg(
        *[F.max(F.when(F.col("t") == t, F.col("quantile"))).alias(f"q{t}") for t in range(len(probs))]
    )
    return extent.drop("low", "high", "least", "most").join(wide, at)
