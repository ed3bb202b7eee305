"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards has a weight at each shard; a rack or region weighs the sum
of what is below it. A document goes down the tree: at each level every child draws
``-ln(u) / weight`` with u hashed from doc_id and the child's name, and the smallest draw wins.
A child wins in proportion to its weight, and a draw depends on nothing but its own child and that
child's weight. So when a weight changes, documents move only into or out of the subtrees whose
weights change. ``grow`` adds a shard in a region of its own, so all documents that move go to it.

Edge cases: null doc_id is hashed as a value of its own; null text has size 1 and the checksum of
nothing; equal rows share their shard and get different slots; an empty table gives no rows; other
columns are not looked at. A tree without weight is refused.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segprofile.functions.staging import stage
from segprofile.llm.tables import read

_PER_BUCKET = 20_000  # rows ordered together at most, about


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(n: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """Shards 0 to n - 1 of weight 1, filled rack by rack and region by region."""
    return [Shard(f"g{i // (per_rack * racks)}", f"k{i // per_rack}", i) for i in range(n)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a new region."""
    new = max(s.shard for s in tree) + 1
    return [*tree, Shard(f"new{new}", f"new{new}", new, weight)]


def _uniform(doc_id: Column, name: str) -> Column:
    """(0, 1) from 53 bits of a hash of the id and a node's name."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(2.0**53)


def _winner(doc_id: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What belongs to the child with the smallest draw; children without weight never win."""
    live = [c for c in children if c[1] > 0]
    if len(live) == 1:
        return live[0][2]
    draws = [F.struct((-F.log(_uniform(doc_id, name)) / F.lit(float(w))).alias("d"), F.lit(i).alias("i")) for i, (name, w, _) in enumerate(live)]
    first = F.least(*draws)["i"]
    out = F.when(first == 0, live[0][2])
    for i, (_, _, what) in enumerate(live[1:], 1):
        out = out.when(first == i, what)
    return out


def shard_of(doc_id: Column, tree: list[Shard]) -> Column:
    """The shard of an id: one draw among regions, one among the racks there, one among the shards there."""
    if not sum(s.weight for s in tree) > 0:
        raise ValueError("the tree has no weight")

    def below(path: str, shards: list[Shard], level: int) -> Column:
        if level == 3:
            return F.lit(shards[0].shard)
        names = dict.fromkeys(str(s[level]) for s in shards)
        parts = {n: [s for s in shards if str(s[level]) == n] for n in names}
        return _winner(doc_id, [(f"{path}/{n}", sum(s.weight for s in p), below(f"{path}/{n}", p, level + 1)) for n, p in parts.items() if sum(s.weight for s in p) > 0])

    return below("", tree, 0)


def with_shard(docs: DataFrame, tree: list[Shard], column: str = "shard") -> DataFrame:
    """All columns and the shard; no shuffle."""
    return docs.withColumn(column, shard_of(F.col("doc_id"), tree).cast("int"))


def shard_table(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row.

    Slots number a shard's rows without gaps. No shard is ordered in one task: its distinct rows
    are split by hash into buckets of about 20,000, a bucket begins where those before it
    end, and equal rows, counted before the shuffle, share one run of slots.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
        (shard_of(F.col("doc_id"), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    counted = stage(keys.groupBy(*keys.columns).agg(F.count("*").alias("n")))
    buckets = max(32, math.ceil(counted.count() / len(tree) / _PER_BUCKET))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")
    counted = counted.withColumn("bucket", bucket)
    sums = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("shard", "bucket")
        .orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        counted.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard",
            F.explode(F.sequence(F.col("offset") + F.col("earlier"), F.col("offset") + F.col("earlier") + F.col("n") - 1)).alias("slot"),
        )
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(16)
    return shard_table(read(spark, sf_dir, "documents"), tree, grow(tree))
