"""Session settings the operators are happiest with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # wide tables: keep generated code for aggregates over many columns
    "spark.sql.codegen.maxFields": "400",
    "spark.sql.session.timeZone": "UTC",
    # do not record a Python stack for every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` adds to or overrides them."""
    builder = SparkSession.builder.appName("segprofile")
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
