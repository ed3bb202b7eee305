"""The view of clustered rows as a table with a folder per cluster.

Rows keep their columns and get their scaled features (``z_...``) and their place on the principal components
(``pc1``...). Writing replaces the clusters that the rows belong to and leaves all others alone; reading
a cluster opens its folder only. A large cluster is written by several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.functions.columns import col, cols
from segprofile.operators.clustering import standardize
from segprofile.operators.reduction import principal_components


def scaled_rows(rows: DataFrame, numeric: Sequence[str], label: str = "cluster") -> DataFrame:
    """The rows with their scaled features beside the label; scales come from all rows."""
    names = [f"z_{c}" for c in numeric]
    copied = rows.select(*[col(c) for c in rows.columns if c != label], *[col(c).cast("double").alias(z) for c, z in zip(numeric, names, strict=True)], col(label))
    return standardize(copied, names)


def cluster_view(rows: DataFrame, numeric: Sequence[str], label: str = "cluster", components: int = 3) -> DataFrame:
    """Rows, scaled features, places on the components of all rows, and the label last."""
    scaled = scaled_rows(rows, numeric, label)
    names = [f"z_{c}" for c in numeric]
    kept = [c for c in scaled.columns if c != label]
    placed = principal_components(scaled, names, [*kept, label], components).rows
    return placed.select(*cols([c for c in placed.columns if c != label]), col(label))


def write_cluster_view(view: DataFrame, path: str, label: str = "cluster") -> None:
    """Replace the clusters of ``view`` in the table at ``path``; rows without a cluster go to a folder of their own."""
    dealt = view.hint("rebalance", F.col(f"`{label}`"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(label).parquet(path)


def read_clusters(spark: SparkSession, path: str, clusters: Sequence | None = None, label: str = "cluster") -> DataFrame:
    """The rows of some clusters, or of all; other clusters' folders are not opened."""
    view = spark.read.parquet(path)
    return view if clusters is None else view.where(col(label).isin(list(clusters)))
