"""Test tables as wide tables of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.operators.filters import align_feature_tables
from segprofile.sources.readers import read_table
from segprofile.spec import FeatureSpec

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
LINE_MEASURES = {"qty": "l_quantity", "price": "l_extendedprice"}
LINES = FeatureSpec(
    key=LINE_KEY,
    descriptive=("l_orderkey", "l_linenumber"),
    numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    categorical=("l_returnflag", "l_linestatus"),
    group_key="l_returnflag",
    measures=("l_quantity", "l_extendedprice"),
    percent_scaled=("l_discount",),
)
ORDERS = FeatureSpec(
    key=("o_orderkey",),
    descriptive=("o_orderkey", "o_custkey"),
    numeric=("o_totalprice",),
    categorical=("o_orderstatus", "o_orderpriority"),
    group_key="o_orderstatus",
    measures=("o_totalprice",),
)
SECTIONS = FeatureSpec(
    key=("p_partkey",),
    descriptive=("p_partkey", "p_name"),
    numeric=("p_size", "p_retailprice", "n_lines", "sum_qty", "avg_discount"),
    categorical=("p_type", "p_brand"),
    group_key="p_type",
    measures=("sum_qty",),
    row_label="p_name",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: its own features and those of its order lines, joined on the key."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice"
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.count("*").alias("n_lines"),
            F.sum("l_quantity").alias("sum_qty"),
            F.avg("l_discount").alias("avg_discount"),
        )
    )
    return align_feature_tables([part, lines], ["p_partkey"])


def nullable_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with gaps: one priority and one status read as missing, small prices too."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        "o_custkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("o_orderpriority"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("o_totalprice"),
    )
