"""Counts and percentages of category values within each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segprofile.functions.columns import col, share
from segprofile.operators.filters import categorical_domains
from segprofile.operators.profiles import value_counts


def category_value_counts(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Rows per ``(category, feature, value)``; missing values are not counted."""
    known = df.where(col(by).isNotNull())
    return value_counts(known, [by], columns).select(
        col(by).alias("category"), "feature", "value", "n"
    )


def value_counts_pct(df: DataFrame, column: str) -> DataFrame:
    """Frequencies of one column with their share, most frequent first."""
    counts = value_counts(df, [], [column])
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("value", "n", share(F.col("n"), total).alias("pct")).orderBy(
        F.desc("n"), "value"
    )


def crosstab_labels(
    df: DataFrame, columns: Sequence[str], max_labels: int = 1000
) -> dict[str, list[str]]:
    """Values per feature, to plan a wide table or the zero cells of a dense one.

    These become columns of a plan, so there must be few of them; beyond
    ``max_labels`` the sparse long form is the one to use.
    """
    found = categorical_domains(df, columns).where(F.col("value").isNotNull())
    rows = found.limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError(f"more than {max_labels} feature values; use the sparse long form")
    labels: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        labels[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in labels.items()}


def crosstab_counts(
    df: DataFrame, by: str, column: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """Wide counts: one row per category, one column per value, zero where none."""
    if labels is None:
        labels = crosstab_labels(df, [column])[column]
    counts = category_value_counts(df, by, [column])
    return (
        counts.groupBy("category")
        .pivot("value", list(labels))
        .agg(F.sum("n"))
        .na.fill(0)
    )


def crosstab_pct(
    df: DataFrame,
    by: str,
    columns: Sequence[str],
    labels: dict[str, list[str]] | None = None,
    dense: bool = False,
) -> DataFrame:
    """Long percentages: within a category the values of one feature add up to 100.

    With ``labels`` every listed value gets a cell, 0 where nothing was counted; with
    ``dense`` every value of the feature, however many, found by a distinct of the table;
    else only observed cells are given, which is the form for features with
    very many values. The category column crossed with itself is flagged.
    """
    counts = category_value_counts(df, by, columns)
    totals = counts.groupBy("category", "feature").agg(F.sum("n").alias("total"))
    if dense and labels is None:
        values = categorical_domains(df, columns).where(F.col("value").isNotNull()).select("feature", "value")
        cells = totals.join(values, "feature").join(counts, ["category", "feature", "value"], "left")
    elif labels is None:
        cells = counts.join(totals, ["category", "feature"])
    else:
        listed = F.create_map(
            *[
                e
                for c in columns
                for e in (F.lit(c), F.array(*[F.lit(v) for v in labels[c]]).cast("array<string>"))
            ]
        )
        dense = totals.withColumn("value", F.explode(F.try_element_at(listed, F.col("feature"))))
        cells = dense.join(counts, ["category", "feature", "value"], "left")
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return cells.select(
        "category",
        "feature",
        "value",
        n.alias("n"),
        share(n, F.col("total")).alias("pct"),
        (F.col("feature") == F.lit(by)).alias("is_group_key"),
    )


def crosstab_pct_wide(
    df: DataFrame,
    by: str,
    columns: Sequence[str],
    labels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Percentage table: a row per feature and category, a column per ``feature-value``.

    The tables of all features are stacked: a cell is 0 where the row's own
    feature lacks the value and null where the column belongs to another
    feature. Columns are told apart by feature, so equal values do not mix.
    """
    if labels is None:
        labels = crosstab_labels(df, columns)
    named = [(f"{c}-{v}", c) for c in columns for v in labels[c]]
    long = crosstab_pct(df, by, columns).withColumn(
        "cell", F.concat_ws("-", F.col("feature"), F.col("value"))
    )
    wide = long.groupBy("feature", "category").pivot("cell", [n for n, _ in named]).agg(F.first("pct"))
    return wide.select(
        "feature",
        "category",
        *[
            F.when(F.col("feature") == c, F.coalesce(col(n), F.lit(0.0))).alias(n)
            for n, c in named
        ],
    )
