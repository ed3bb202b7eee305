"""Profiles: means, deviations and modes, overall and per category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segprofile.functions.columns import col, cols, difference, double, rows_from_columns, unpivot
from segprofile.functions.staging import stage


def value_counts(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], keep_missing: bool = False
) -> DataFrame:
    """Long counts ``(by..., feature, value, n)`` of all columns in one pass.

    Equal values are added up before the shuffle and spread over the whole
    ``(by, feature, value)`` key, so one large category does not land in one task.
    """
    long = unpivot(df, by, columns, "string")
    if not keep_missing:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy(*cols(by), "feature", "value").agg(F.count("*").alias("n"))


def _pick(columns: Sequence[str], order: Sequence[Column]) -> list[Column]:
    """Per feature the value that comes first in ``order``; missing values never win."""
    return [
        F.min(
            F.when(
                (F.col("feature") == c) & F.col("value").isNotNull(),
                F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("value")),
            )
        )
        .getField("value")
        .alias(c)
        for c in columns
    ]


def _modes(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    counts = value_counts(df, by, columns, keep_missing=True)
    return counts.groupBy(*cols(by)).agg(*_pick(columns, [-F.col("n")]))


def _known(df: DataFrame, by: str) -> DataFrame:
    return df.where(col(by).isNotNull())


def overall_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row: mean of every numeric and mode of every categorical column.

    On equal counts the smallest value is the mode.
    """
    means = df.agg(F.count("*").alias("_n"), *[F.avg(double(c)).alias(c) for c in numeric])
    if not categorical:
        return means.drop("_n")
    # the modes are one row of their own, read as a scalar rather than joined
    modes = _modes(df, [], categorical).select(F.struct(*cols(categorical))).scalar()
    return means.withColumn("_modes", modes).select(
        *cols(numeric), *[F.col("_modes").getField(c).alias(c) for c in categorical]
    )


def profile_long(profile: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """A one-row profile as ``(feature, kind, mean, mode)`` rows."""
    return rows_from_columns(
        profile,
        [
            F.struct(
                F.lit(c).alias("feature"),
                F.lit("mean").alias("kind"),
                col(c).alias("mean"),
                F.lit(None).cast("string").alias("mode"),
            )
            for c in sorted(numeric)
        ]
        + [
            F.struct(
                F.lit(c).alias("feature"),
                F.lit("mode").alias("kind"),
                F.lit(None).cast("double").alias("mean"),
                col(c).alias("mode"),
            )
            for c in sorted(categorical)
        ],
    )


def mean_long(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Mean of every numeric column as ``(feature, mean)`` rows."""
    wide = df.agg(*[F.avg(double(c)).alias(f"m{i}") for i, c in enumerate(numeric)])
    return rows_from_columns(
        wide,
        [
            F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"))
            for i, c in enumerate(numeric)
        ],
    )


def category_mean(df: DataFrame, by: str, numeric: Sequence[str]) -> DataFrame:
    """Mean per category; rows without a category are left out."""
    names = difference(numeric, [by])
    return _known(df, by).groupBy(col(by)).agg(*[F.avg(double(c)).alias(c) for c in names])


def category_std(df: DataFrame, by: str, numeric: Sequence[str]) -> DataFrame:
    """Sample deviation per category; null for a category of one row."""
    names = difference(numeric, [by])
    return _known(df, by).groupBy(col(by)).agg(*[F.stddev_samp(double(c)).alias(c) for c in names])


def category_std_filled(df: DataFrame, by: str, numeric: Sequence[str]) -> DataFrame:
    """Sample deviation, 0 for a column that has none in any category."""
    std = category_std(df, by, numeric)
    names = [c for c in std.columns if c != by]
    seen = std.agg(*[F.max(col(c)).alias(f"s{i}") for i, c in enumerate(names)])
    seen = std.withColumn("_seen", seen.select(F.struct("*")).scalar())
    return seen.select(
        col(by),
        *[
            F.when(F.col("_seen").getField(f"s{i}").isNull(), F.lit(0.0)).otherwise(col(c)).alias(c)
            for i, c in enumerate(names)
        ],
    )


def category_mode(df: DataFrame, by: str, categorical: Sequence[str]) -> DataFrame:
    """Most frequent value per category, the smallest one on equal counts.

    The category column, being categorical too, is its own mode.
    """
    return _modes(_known(df, by), [by], difference(categorical, [by]))


def mode_first_seen(
    df: DataFrame, by: str, categorical: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """Most frequent value per category, on equal counts the one with the smallest row key."""
    names = difference(categorical, [by])
    known = _known(df, by)
    if len(key) == 1:
        long = unpivot(known, [by, *key], names, "string")
        counts = long.groupBy(col(by), "feature", "value").agg(
            F.count("*").alias("n"), F.min(col(key[0])).alias("first")
        )
        return counts.groupBy(col(by)).agg(*_pick(names, [-F.col("n"), F.col("first")]))
    # the smallest of a several-column key costs a sort, so only tied values are looked up
    at = [by, "feature"]
    counts = value_counts(known, [by], names, keep_missing=True)
    best = counts.where(F.col("value").isNotNull()).groupBy(*cols(at)).agg(F.max("n").alias("most"))
    leaders = stage(
        counts.join(best, at, "left")
        .where(F.col("value").isNull() | (F.col("n") == F.col("most")))
        .select(*cols(at), "value")
    )
    present = leaders.where(F.col("value").isNotNull())
    tied = present.groupBy(*cols(at)).agg(F.count("*").alias("ties")).where("ties > 1")
    contenders = present.join(tied, at, "left_semi")
    if contenders.isEmpty():
        firsts = leaders.withColumn("first", F.lit(0))
    else:
        long = unpivot(known, [by, *key], names, "string")
        seen = (
            long.join(stage(contenders), [*at, "value"], "left_semi")
            .groupBy(*cols(at), "value")
            .agg(F.min(F.struct(*cols(key))).alias("first"))
        )
        firsts = leaders.join(seen, [*at, "value"], "left")
    return firsts.groupBy(col(by)).agg(*_pick(names, [F.col("first")]))


def profile_table(
    df: DataFrame,
    by: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    modes: DataFrame | None = None,
) -> DataFrame:
    """One profile per category: means joined with modes on the category.

    ``modes`` replaces the smallest-value modes, e.g. by ``mode_first_seen``.
    """
    means = category_mean(df, by, numeric)
    if modes is None:
        names = difference(categorical, [by])
        if not names:
            return means
        modes = category_mode(df, by, names)
    return means.join(modes, [by], "inner")


def category_mean_errorbars(df: DataFrame, by: str, numeric: Sequence[str]) -> DataFrame:
    """Mean with one deviation either side, per feature and category, from one pass."""
    names = difference(numeric, [by])
    wide = _known(df, by).groupBy(col(by).alias("category")).agg(
        *[
            e
            for i, c in enumerate(names)
            for e in (F.avg(double(c)).alias(f"m{i}"), F.stddev_samp(double(c)).alias(f"s{i}"))
        ]
    )
    return wide.select(
        "category",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"m{i}").alias("mean"),
                        F.col(f"s{i}").alias("std"),
                        (F.col(f"m{i}") - F.col(f"s{i}")).alias("lo"),
                        (F.col(f"m{i}") + F.col(f"s{i}")).alias("hi"),
                    )
                    for i, c in enumerate(names)
                ]
            )
        ),
    )


def category_summary_selected(
    df: DataFrame, by: str, numeric: Sequence[str], categories: Sequence
) -> DataFrame:
    """Means of the wanted categories in the given order, long. Unknown ones give no row."""
    names = difference(numeric, [by])
    wanted = df.where(col(by).isin(list(categories)))
    means = category_mean(wanted, by, names)
    position = F.array_position(F.array(*[F.lit(c) for c in categories]), col(by)).cast("int")
    long = means.select(
        position.alias("position"),
        col(by).alias("category"),
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), col(c).alias("mean")) for c in names]
            )
        ),
    )
    return long.orderBy("position", "feature")


