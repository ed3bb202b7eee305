"""Match metrics and bad-value counts as a by-product of writing the matching rows.

The figures of ``match_summary`` and ``bad_value_report`` are observed on the rows while one scan writes
those that match: nothing is read a second time, nothing is shuffled, and a handful of numbers reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segprofile.functions.columns import cols, nan_to_null
from segprofile.operators.filters import bad_value_counts, bad_value_rows
from segprofile.operators.metrics import summarised, total_sums


@dataclass(frozen=True)
class Matched:
    """What a write of matching rows has seen of the whole table."""

    spark: SparkSession
    figures: Mapping[str, float]
    schema: StructType
    measures: Mapping[str, str]
    checked: Sequence[str]

    @property
    def n_matching(self) -> int:
        """For guards against too few rows, without counting."""
        return int(self.figures["match_n"])

    def _row(self) -> DataFrame:
        return self.spark.createDataFrame([dict(self.figures)], self.schema)

    def summary(self) -> DataFrame:
        """The row of ``match_summary``."""
        return summarised(self._row(), self.measures)

    def bad_values(self) -> DataFrame:
        """The rows of ``bad_value_report``, over all rows whether they match or not."""
        return bad_value_rows(self._row(), self.checked)


def observed_matches(
    df: DataFrame, predicate: Column, columns: Sequence[str], measures: Mapping[str, str], checked: Sequence[str] = ()
) -> tuple[DataFrame, Observation, StructType]:
    """The matching rows, what an action on them observes, and the schema of that."""
    figures = [*total_sums(predicate, measures), *bad_value_counts(checked)]
    seen = Observation()
    flagged = df.withColumn("_matching", F.coalesce(predicate, F.lit(False))).observe(seen, *figures)
    schema = df.limit(0).agg(*figures).schema
    return nan_to_null(flagged.where("_matching").select(*cols(columns))), seen, schema


def write_matching(
    df: DataFrame,
    predicate: Column,
    columns: Sequence[str],
    path: str,
    measures: Mapping[str, str],
    checked: Sequence[str] = (),
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> Matched:
    """Write the matching rows' columns to ``path``; what it returns needs no further pass."""
    rows, seen, schema = observed_matches(df, predicate, columns, measures, checked)
    rows.write.format(fmt).mode(mode).save(path)
    found = seen.get
    figures = {f.name: found.get(f.name, 0.0 if f.dataType.simpleString() == "double" else 0) for f in schema.fields}
    return Matched(df.sparkSession, figures, schema, measures, tuple(checked))
