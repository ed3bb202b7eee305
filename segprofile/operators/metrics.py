"""How much of the whole matches, by rows and by measure."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segprofile.functions.columns import double, rows_from_columns, share


def total_sums(predicate: Column, measures: Mapping[str, str]) -> list[Column]:
    """Totals and matching totals, as aggregates of one pass over the table."""
    matching = F.coalesce(predicate, F.lit(False))
    sums = [F.count("*").alias("total_n"), F.count_if(matching).alias("match_n")]
    for name, column in measures.items():
        sums.append(F.coalesce(F.sum(double(column)), F.lit(0.0)).alias(f"total_{name}"))
        sums.append(
            F.coalesce(F.sum(F.when(matching, double(column))), F.lit(0.0)).alias(f"match_{name}")
        )
    return sums


def _totals(df: DataFrame, predicate: Column, measures: Mapping[str, str]) -> DataFrame:
    return df.agg(*total_sums(predicate, measures))


def match_summary(df: DataFrame, predicate: Column, measures: Mapping[str, str]) -> DataFrame:
    """One row: total, matching and percentage, by count and per measure.

    ``measures`` maps the name used in the output to the column summed. The
    percentage is null where the total is zero.
    """
    return summarised(_totals(df, predicate, measures), measures)


def summarised(totals: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """The row of ``match_summary`` from a row of totals."""
    names = ["n", *measures]
    return totals.select(
        *[
            c
            for n in names
            for c in (
                F.col(f"total_{n}"),
                F.col(f"match_{n}"),
                share(F.col(f"match_{n}"), F.col(f"total_{n}")).alias(f"pct_{n}"),
            )
        ]
    )


def match_split(df: DataFrame, predicate: Column, measures: Mapping[str, str]) -> DataFrame:
    """Two slices, matching and not matching, for the count and each measure."""
    totals = _totals(df, predicate, measures)
    slices = []
    for name in ("n", *measures):
        total, match = F.col(f"total_{name}").cast("double"), F.col(f"match_{name}").cast("double")
        for part, amount in (("Matching", match), ("Not Matching", total - match)):
            slices.append(
                F.struct(
                    F.lit("count" if name == "n" else name).alias("measure"),
                    F.lit(part).alias("part"),
                    amount.alias("amount"),
                    share(amount, total).alias("pct"),
                )
            )
    return rows_from_columns(totals, slices)
