"""Report sinks: several named result frames under one folder.

``write_report`` writes the frames side by side. ``commit_report`` writes them under a version of their own and names
them in a manifest that is written last, so readers see all tables of a report or none: a run that fails
halfway leaves the report before it as it was. Row counts are taken while the rows are written.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from segprofile.sources.readers import read_table


def write_report(
    frames: Mapping[str, DataFrame],
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    skip_empty: bool = False,
) -> list[str]:
    """Write every frame to ``path/name`` and return the names written."""
    written = []
    for name, frame in frames.items():
        if skip_empty and frame.isEmpty():
            continue
        writer = frame.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{path.rstrip('/')}/{name}")
        written.append(name)
    return written


def read_report(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One frame of a written report."""
    return read_table(spark, f"{path.rstrip('/')}/{name}", fmt=fmt)


_MANIFESTS = "manifests"
_MANIFEST = "version string, place int, name string, folder string, format string, n_rows long"


def commit_report(frames: Mapping[str, DataFrame], path: str, fmt: str = "parquet", skip_empty: bool = False) -> str:
    """Write every frame once and commit them together; returns the version.

    Frames without rows are left out of the report with ``skip_empty``; nothing is run twice to find them.
    """
    root = path.rstrip("/")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    entries, spark = [], None
    for name, frame in frames.items():
        spark = frame.sparkSession
        seen, folder = Observation(), f"{root}/{version}/{name}"
        writer = frame.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(folder)
        n = seen.get.get("n_rows", 0)
        if n or not skip_empty:
            entries.append((version, len(entries), name, folder, fmt, n))
    if spark is None:
        raise ValueError("a report needs at least one frame")
    entries = entries or [(version, None, None, None, fmt, 0)]
    # one file, which its committer moves in place as a whole: from then on the version counts
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/{_MANIFESTS}")
    return version


def committed_tables(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """(version, place, name, folder, format, n_rows) of the tables of the last committed report, or of one version."""
    manifests = spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/{_MANIFESTS}")
    if version is None:
        version = manifests.agg(F.max("version")).first()[0]
    return manifests.where((F.col("version") == version) & F.col("name").isNotNull())


def read_committed(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """One table of the last committed report, or of one version of it."""
    found = committed_tables(spark, path, version).where(F.col("name") == name).first()
    if found is None:
        raise KeyError(f"no table {name!r} in the report at {path}")
    return read_table(spark, found.folder, fmt=found.format)
