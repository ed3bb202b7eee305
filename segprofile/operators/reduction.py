"""Covariance and principal components of standardised features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segprofile.functions.columns import cols, double, rows_from_columns
from segprofile.operators.clustering import standardize


def feature_covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariance of every pair of columns, each pair once, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(
        *[F.covar_samp(double(a), double(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )
    return rows_from_columns(
        wide,
        [
            F.struct(
                F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("covariance")
            )
            for i, (a, b) in enumerate(pairs)
        ],
    )


@dataclass(frozen=True)
class Components:
    """Projected rows, share of variance per component, and loadings (component by feature)."""

    rows: DataFrame
    explained: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]


def principal_components(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str], n: int = 3
) -> Components:
    """Rows on the first ``n`` components of the standardised columns, as ``pc1..pcn``.

    A component's sign is free; the loading that is largest in size is made
    positive. ``keep`` names the columns carried along.
    """
    n = min(n, len(columns))
    scaled = [f"_z{i}" for i in range(len(columns))]
    named = df.select(*cols(keep), *[double(c).alias(z) for c, z in zip(columns, scaled)])
    vectors = VectorAssembler(inputCols=scaled, outputCol="_features").transform(
        standardize(named, scaled)
    )
    model = PCA(k=n, inputCol="_features", outputCol="_pc").fit(vectors)
    loadings = model.pc.toArray().T
    signs = [1.0 if row[abs(row).argmax()] >= 0 else -1.0 for row in loadings]
    points = vector_to_array(F.col("_pc"))
    rows = model.transform(vectors).select(
        *cols(keep), *[(points[i] * F.lit(signs[i])).alias(f"pc{i + 1}") for i in range(n)]
    )
    return Components(
        rows,
        tuple(float(x) for x in model.explainedVariance.toArray()),
        tuple(tuple(float(x) * s for x in row) for row, s in zip(loadings, signs)),
    )


def component_variance(components: Components) -> DataFrame:
    """Variance of the projected rows per component and the share it explains."""
    n = len(components.explained)
    wide = components.rows.agg(*[F.var_pop(f"pc{i + 1}").alias(f"v{i}") for i in range(n)])
    return rows_from_columns(
        wide,
        [
            F.struct(
                F.lit(i + 1).alias("component"),
                F.col(f"v{i}").alias("variance"),
                F.lit(components.explained[i]).alias("explained"),
            )
            for i in range(n)
        ],
    )
