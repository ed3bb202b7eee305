"""Scans: files in, columns classified and relabelled."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segprofile.functions.columns import col, is_missing, is_numeric, rows_from_columns
from segprofile.spec import FeatureSpec

_FORMATS = ("parquet", "orc", "json", "csv")


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """Scan one table. The format follows the file ending unless given."""
    fmt = fmt or next((f for f in _FORMATS if path.rstrip("/").endswith("." + f)), "parquet")
    if fmt not in _FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {_FORMATS}")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", True))
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.format(fmt).load(path)


def column_roles(df: DataFrame, spec: FeatureSpec | None = None) -> DataFrame:
    """Each column's type, role and number of missing values, in one pass."""
    roles = {}
    if spec is not None:
        roles = {c: "descriptive" for c in (*spec.key, *spec.descriptive)}

    fields = df.schema.fields
    counted = df.agg(
        *[F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)]
    )
    return rows_from_columns(
        counted,
        [
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(
                    roles.get(f.name, "numeric" if is_numeric(f.dataType) else "categorical")
                ).alias("role"),
                F.col(f"m{i}").alias("n_missing"),
            )
            for i, f in enumerate(fields)
        ],
    )


def relabel(
    df: DataFrame,
    columns: Mapping[str, str] | None = None,
    values: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Translate column names and category values; what has no entry stays as it is.

    ``values`` is keyed by the old column name and meant for hand-written
    dictionaries. A dictionary kept as a table goes through ``relabel_from``.
    """
    columns, values = columns or {}, values or {}

    def translated(name: str) -> Column:
        if not values.get(name):
            return col(name)
        pairs = [F.lit(x) for pair in values[name].items() for x in pair]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), col(name)), col(name))

    return df.select(*[translated(c).alias(columns.get(c, c)) for c in df.columns])


def relabel_from(df: DataFrame, column: str, labels: DataFrame, old: str, new: str) -> DataFrame:
    """Translate one column through a table of ``(old, new)`` with one row per old value.

    A plain left equi-join: Spark broadcasts the dictionary only while its size
    is below the session's threshold.
    """
    pairs = labels.select(col(old).alias("_old"), col(new).cast("string").alias("_new"))
    joined = df.join(pairs, col(column) == F.col("_old"), "left")
    return joined.select(
        *[
            F.coalesce(F.col("_new"), col(c).cast("string")).alias(c) if c == column else col(c)
            for c in df.columns
        ]
    )
