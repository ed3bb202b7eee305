"""Standardised features, k-means with restarts, and what the clusters look like."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segprofile.functions.columns import col, cols, double, share
from segprofile.functions.staging import discard, stage
from segprofile.operators.filters import drop_missing
from segprofile.operators.profiles import mode_first_seen, profile_table

#: Rows of a part of the standardised numbers: as many parts as cores between these bounds.
LEAST_ROWS, MOST_ROWS = 20_000, 500_000


class BadValuesError(ValueError):
    """The feature matrix holds missing or infinite values."""


def _means_and_deviations(df: DataFrame, columns: Sequence[str]) -> list[tuple]:
    """Per column mean and population deviation; two numbers per column reach the driver."""
    row = df.agg(
        *[
            e
            for i, c in enumerate(columns)
            for e in (F.avg(double(c)).alias(f"m{i}"), F.stddev_pop(double(c)).alias(f"s{i}"))
        ]
    ).first()
    return [(row[f"m{i}"], row[f"s{i}"]) for i in range(len(columns))]


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers replaced by the column mean."""
    means = {c: m for c, (m, _) in zip(columns, _means_and_deviations(df, columns))}
    return df.select(
        *[
            F.coalesce(double(c), F.lit(means[c]).cast("double")).alias(c) if c in means else col(c)
            for c in df.columns
        ]
    )


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation in place; a constant column becomes 0."""
    scaled = {}
    for c, (mean, deviation) in zip(columns, _means_and_deviations(df, columns)):
        mean, deviation = F.lit(mean).cast("double"), F.lit(deviation or 1.0)
        scaled[c] = ((double(c) - mean) / deviation).alias(c)
    return df.select(*[scaled.get(c, col(c)) for c in df.columns])


def mend_features(df: DataFrame, columns: Sequence[str], missing: str = "error") -> DataFrame:
    """What to do about missing numbers: ``error`` leaves them to be refused, ``drop``, ``impute``."""
    if missing == "drop":
        return drop_missing(df, columns)
    if missing == "impute":
        return impute_mean(df, columns)
    if missing == "error":
        return df
    raise ValueError(f"unknown treatment of missing values: {missing!r}")


def fit_scales(df: DataFrame, columns: Sequence[str]) -> tuple[int, list[tuple]]:
    """Row count, and mean and population deviation per column, in one guarded pass.

    Missing, NaN or infinite values anywhere in the columns are refused.
    """
    figures = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        figures += [
            F.count_if(double(c).isNull() | (F.abs(double(c)) == float("inf"))).alias(f"bad{i}"),
            F.avg(double(c)).alias(f"m{i}"),
            F.stddev_pop(double(c)).alias(f"s{i}"),
        ]
    row = df.agg(*figures).first()
    bad = [c for i, c in enumerate(columns) if row[f"bad{i}"]]
    if bad:
        raise BadValuesError(f"missing or infinite values in {bad}")
    return row["n"], [(row[f"m{i}"], row[f"s{i}"]) for i in range(len(columns))]


@dataclass(frozen=True)
class Clustering:
    """Rows with their cluster, and the model that gave it (None for an empty table)."""

    rows: DataFrame
    k: int
    cost: float
    model: KMeansModel | None
    order: tuple[int, ...] = ()

    @property
    def centers(self) -> list[tuple[float, ...]]:
        """Centres in standardised units, in cluster order."""
        if self.model is None:
            return []
        found = self.model.clusterCenters()
        return [tuple(float(x) for x in found[i]) for i in self.order]


def cluster_rows(
    df: DataFrame,
    columns: Sequence[str],
    k: int = 5,
    restarts: int = 10,
    seed: int = 42,
    missing: str = "error",
    parallelism: int = 4,
) -> Clustering:
    """k-means on the standardised columns, the cheapest of several restarts.

    There are at most as many clusters as rows.

    Clusters are numbered by size, largest first, then by centre. The
    standardised numbers, and nothing else of the table, are written once in a
    part per core. Every fit caches its own vectors from there, for its
    own time: a cached table given to it would be decoded anew, twice, in each
    step. Some restarts run side by side. A fit ends when the squared moves of all
    centres add up to no more than 1e-4.
    """
    df = mend_features(df, columns, missing)
    n, fitted = fit_scales(df, columns)
    k = min(k, n)
    if k == 0:
        empty = df.withColumn("cluster", F.lit(None).cast("int")).where(F.lit(False))
        return Clustering(empty, 0, 0.0, None)
    scaled = [f"_z{i}" for i in range(len(columns))]
    matrix = df.select(
        "*",
        *[
            ((double(c) - F.lit(m)) / F.lit(s or 1.0)).alias(z)
            for z, c, (m, s) in zip(scaled, columns, fitted)
        ],
    )
    assembler = VectorAssembler(inputCols=scaled, outputCol="_features")
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, math.ceil(n / LEAST_ROWS)), math.ceil(n / MOST_ROWS))
    numbers = stage(matrix.select(*scaled).repartition(parts))
    vectors = assembler.transform(numbers).select("_features")

    def fit(restart: int) -> KMeansModel:
        means = KMeans(
            k=k,
            seed=seed + restart,
            featuresCol="_features",
            predictionCol="_p",
            maxIter=300,
            tol=math.sqrt(1e-4 / k),
        )
        return means.fit(vectors)

    fit_one = inheritable_thread_target(df.sparkSession)(fit)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        models = list(pool.map(fit_one, range(restarts)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    # counted when asked for, so while the numbers are still there
    sizes = best.summary.clusterSizes
    discard(numbers)
    centers = [tuple(c) for c in best.clusterCenters()]
    order = sorted(range(len(centers)), key=lambda i: (-sizes[i], centers[i]))
    number = F.array(*[F.lit(order.index(i)) for i in range(len(centers))])
    rows = best.transform(assembler.transform(matrix)).select(
        *cols(df.columns), F.get(number, F.col("_p")).alias("cluster")
    )
    return Clustering(rows, len(centers), float(best.summary.trainingCost), best, tuple(order))


def cluster_sizes(rows: DataFrame, label: str = "cluster") -> DataFrame:
    """Rows per cluster with their share, largest first."""
    counts = rows.groupBy(col(label)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(col(label), "n", share(F.col("n"), total).alias("pct")).orderBy(
        F.desc("n"), col(label)
    )


def cluster_summary(
    rows: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    key: Sequence[str],
    label: str = "cluster",
) -> DataFrame:
    """Means and modes per cluster; on equal counts the value of the smallest key is the mode."""
    if not categorical:
        return profile_table(rows, label, numeric, [])
    modes = mode_first_seen(rows, label, categorical, key)
    return profile_table(rows, label, numeric, categorical, modes)


def clusters_without_modes(means: DataFrame, modes: DataFrame, label: str = "cluster") -> DataFrame:
    """Clusters found in the first summary and missing from the second."""
    return means.join(modes, label, "left_anti").select(col(label))
