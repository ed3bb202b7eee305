"""Selections, projections and what the filters can be set to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segprofile.functions.columns import (
    col,
    cols,
    double,
    is_floating,
    nan_to_null,
    rows_from_columns,
    unpivot,
)
from segprofile.spec import Exact, FeatureSpec, FilterSpec


def select_rows(df: DataFrame, spec: FeatureSpec, filters: FilterSpec | None = None) -> DataFrame:
    """Matching rows: key, descriptive columns and the included features.

    One ``where`` and one ``select`` over one scan, whatever the number of
    filtered columns; the predicate is made of bare column comparisons that
    reach the file reader.
    """
    filters = filters or FilterSpec()
    kept = filters.included(spec)
    names = dict.fromkeys((*spec.key, *spec.descriptive, *kept.features))
    return nan_to_null(df.where(filters.predicate(df, spec)).select(*cols(names)))


def profile_rows(df: DataFrame, spec: FeatureSpec, filters: FilterSpec | None = None) -> DataFrame:
    """Like ``select_rows`` with the group key and the measures always present."""
    filters = filters or FilterSpec()
    kept = filters.included(spec)
    extra = (*([spec.group_key] if spec.group_key else []), *spec.measures)
    names = dict.fromkeys((*spec.key, *spec.descriptive, *kept.features, *extra))
    return nan_to_null(df.where(filters.predicate(df, spec)).select(*cols(names)))


def columns_from(df: DataFrame, first: str) -> DataFrame:
    """The columns from ``first`` to the last."""
    return df.select(*cols(df.columns[df.columns.index(first) :]))


def exclude_flagged(df: DataFrame, column: str, keep: object = "No") -> DataFrame:
    """Rows whose flag column holds the value that marks them as wanted."""
    return df.where(Exact(column, keep).predicate(df.schema[column].dataType, 1.0))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value in the given columns."""
    gone = [
        col(c).isNotNull() & ~F.isnan(col(c)) if is_floating(df.schema[c].dataType) else col(c).isNotNull()
        for c in columns
    ]
    return df.where(reduce(lambda a, b: a & b, gone)) if gone else df


def align_feature_tables(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Inner equi-join of feature tables that share a unique key."""
    return reduce(lambda a, b: a.join(b, list(key), "inner"), tables)


def numeric_domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column; a constant column takes exact input only."""
    wide = df.agg(
        *[f(double(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    return rows_from_columns(
        wide,
        [
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"lo{i}").alias("min"),
                F.col(f"hi{i}").alias("max"),
                (F.col(f"lo{i}") == F.col(f"hi{i}")).alias("is_constant"),
            )
            for i, c in enumerate(columns)
        ],
    )


def categorical_domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column, a missing value being one of them."""
    return unpivot(df, [], columns, "string").distinct()


def bad_value_counts(columns: Sequence[str]) -> list[Column]:
    """Missing, NaN and infinite values per column, as aggregates."""

    def counts(i: int, c: str):
        x = col(c).cast("double")
        yield F.count_if(x.isNull()).alias(f"null{i}")
        yield F.count_if(F.isnan(x)).alias(f"nan{i}")
        yield F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"inf{i}")

    return [e for i, c in enumerate(columns) for e in counts(i, c)]


def bad_value_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing, NaN and infinite values per column in one pass."""
    return bad_value_rows(df.agg(*bad_value_counts(columns)), columns)


def bad_value_rows(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column from a row of ``bad_value_counts``."""
    return rows_from_columns(
        wide,
        [
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"null{i}").alias("n_null"),
                F.col(f"nan{i}").alias("n_nan"),
                F.col(f"inf{i}").alias("n_infinite"),
            )
            for i, c in enumerate(columns)
        ],
    )


def has_at_least(df: DataFrame, n: int) -> bool:
    """Whether the frame has ``n`` rows, without counting further."""
    return df.limit(n).count() >= n
