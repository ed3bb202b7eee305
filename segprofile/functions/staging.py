"""Written intermediate tables in the cluster's shared checkpoint folder.

A result that several later passes read is written once as parquet: lineage is
cut, a lost executor costs nothing, column pruning still works on the next
read, and the planner sees the table's real size when it picks a join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_WAREHOUSE = "spark.sql.warehouse.dir"
#: Shuffle files of a written table are of no use any more; without this they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """The shared folder the session names, else a folder of the warehouse, which is shared too."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get(_WAREHOUSE).rstrip("/")
    on_one_machine = spark.sparkContext.master.split("[")[0] == "local"
    if not on_one_machine and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError(f"name a folder that all machines share in {_SETTING}: the warehouse {warehouse} is of one machine")
    return f"{warehouse}/_staged"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/segprofile-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the one written table that ``table`` reads, once nothing needs it any more."""
    name = table.inputFiles()[0].rsplit("/", 2)[1]
    path = next(p for p in _written if p.rsplit("/", 1)[1] == name)
    _written.remove(path)
    _delete(table.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables written so far, once no result that reads them is needed any more."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n
