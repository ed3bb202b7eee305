"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a
DataFrame; all but the last return the columns of documents. Between stages the documents are written as
Parquet and read again, so a lost executor costs the running stage at most.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segprofile.functions.staging import stage  # noqa: E402
from segprofile.llm import decontamination, mixing, near_texts, sharding, toxicity  # noqa: E402
from segprofile.llm.tables import importable, read  # noqa: E402


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of the documents given; those scored 0.7 or more go."""
    return toxicity.keep_civil(spark, docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    importable(spark)
    return near_texts.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in windows of benchmark items go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the targets of their sources ask for."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy in the mix gets its shard of 16 and its slot there."""
    tree = sharding.even_tree(16)
    return sharding.shard_table(docs, tree, sharding.grow(tree))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: No SQL states a trained classifier or sampled candidates; tests/llm compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
