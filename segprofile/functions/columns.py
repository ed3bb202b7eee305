"""Column helpers: quoting, type roles, missing values, shares, labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, whatever dots, slashes or spaces it holds."""
    return F.col(quoted(name))


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def is_numeric(data_type: T.DataType) -> bool:
    """Numbers are profiled by mean; booleans, text and dates by mode."""
    return isinstance(data_type, T.NumericType)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: make it null in every floating column.

    Apply it after filtering. Comparisons treat NaN as failing anyway, and a
    filter on the bare column still reaches the scan.
    """
    if not any(is_floating(f.dataType) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.nanvl(col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if is_floating(f.dataType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def double(name: str) -> Column:
    """A feature as a double with NaN read as missing."""
    return F.expr(f"nanvl(CAST({quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE))")


def is_missing(name: str, data_type: T.DataType) -> Column:
    gone = col(name).isNull()
    return gone | F.isnan(col(name)) if is_floating(data_type) else gone


def share(part: Column, total: Column) -> Column:
    """Percentage of a total; null where the total is zero or missing."""
    return F.try_divide(part.cast("double"), total.cast("double")) * 100


def percent_label(value: Column, digits: int = 2) -> Column:
    """Percentage as display text, e.g. 12.34%."""
    return F.format_string(f"%.{digits}f%%", value)


def rows_from_columns(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn one struct per feature into one row per feature.

    Lets one wide aggregate (a single pass, no row multiplication) be read as a
    long table.
    """
    return df.select(F.inline(F.array(*structs)))


def unpivot(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    data_type: str,
    feature: str = "feature",
    value: str = "value",
) -> DataFrame:
    """Long form ``(ids..., feature, value)`` with one common value type."""

    def cast(name: str) -> Column:
        return double(name) if data_type == "double" else col(name).cast(data_type)

    held = [f"_id{i}" for i in range(len(ids))]
    slim = df.select(
        *[col(c).alias(h) for c, h in zip(ids, held)], *[cast(c).alias(c) for c in columns]
    )
    long = slim.unpivot(cols(held), cols(columns), feature, value)
    return long.select(*[F.col(h).alias(c) for c, h in zip(ids, held)], feature, value)


def difference(names: Iterable[str], removed: Iterable[str]) -> list[str]:
    """Names left after a removal, in name order."""
    return sorted(set(names) - set(removed))
