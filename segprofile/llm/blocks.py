"""Comparing the members of a group in blocks of bounded size, however large the group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """Each member once for every pair of blocks it takes part in: adds ``block``, ``low`` and ``high``.

    A group of n members has ceil(n / size) blocks. Pairs of members of blocks i and j meet where
    (low, high) is (i, j); a row's own block tells its side. A small group is one block.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64(member, F.lit("block")), F.col("_blocks")).cast("int")
    spread = members.join(sizes, group).withColumn("block", own)
    return spread.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *members.columns, "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")
    )
