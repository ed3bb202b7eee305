"""Similarity of real rows to profiles, and the rows nearest to each profile.

score = (1 - d / max d) / 2 + (share of equal categories) / 2, where d is the
Euclidean distance over numeric features divided by their population deviation.
Scales and max d always come from all candidate rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segprofile.functions.columns import col, cols, double
from segprofile.functions.staging import stage

# profiles travel inside the plan as one array, so their number is bounded;
# more profiles are scored in blocks of this size
MAX_PROFILES = 1000
_BUCKETS = 64


def _scales(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Population deviation per numeric column, 1 for a constant one; a single row.

    An infinite value, from which no distance can be told, is refused when the query runs.
    """
    wide = df.agg(
        F.count("*").alias("_n"),
        *[F.stddev_pop(double(c)).alias(f"s{i}") for i, c in enumerate(numeric)],
        *[F.count_if(F.abs(double(c)) == float("inf")).alias(f"bad{i}") for i, c in enumerate(numeric)],
    )
    return wide.select(
        *[
            F.when(F.col(f"bad{i}") > 0, F.raise_error(F.lit(f"infinite values in {c}")).cast("double"))
            .when(F.col(f"s{i}") == 0, F.lit(1.0))
            .otherwise(F.col(f"s{i}"))
            .alias(f"s{i}")
            for i, c in enumerate(numeric)
        ],
        "_n",
    )


def _parameters(
    candidates: DataFrame,
    profiles: DataFrame,
    profile_id: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
) -> DataFrame:
    """Profiles with short names and the scales beside them; one row per profile."""
    table = profiles.select(
        col(profile_id).cast("string").alias("profile_id"),
        *[double(c).alias(f"m{i}") for i, c in enumerate(numeric)],
        *[col(c).cast("string").alias(f"v{i}") for i, c in enumerate(categorical)],
    )
    if numeric:
        scales = _scales(candidates, numeric).select(F.struct("*")).scalar()
        table = table.withColumn("_s", scales).select(
            "*", *[F.col("_s").getField(f"s{i}").alias(f"s{i}") for i in range(len(numeric))]
        ).drop("_s")
    return table


def _paired(candidates: DataFrame, parameters: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every candidate with every profile, as columns ``p.*``; nothing is shuffled or joined.

    The handful of profiles is read as one scalar array. What follows must fold
    the pairs in the same pass.
    """
    packed = parameters.agg(F.collect_list(F.struct("*"))).scalar()
    return candidates.select(*cols(keep), F.explode(packed).alias("p"))


def _distance(numeric: Sequence[str]) -> Column:
    def square(i: int, c: str) -> Column:
        z = (double(c) - F.col(f"p.m{i}")) / F.col(f"p.s{i}")
        return z * z

    return F.sqrt(reduce(lambda a, b: a + b, [square(i, c) for i, c in enumerate(numeric)]))


def _matches(categorical: Sequence[str]) -> Column:
    equal = [
        F.coalesce((col(c).cast("string") == F.col(f"p.v{i}")).cast("int"), F.lit(0))
        for i, c in enumerate(categorical)
    ]
    return reduce(lambda a, b: a + b, equal)


def _score(d: Column | None, max_d: Column | None, matches: Column | None, n_categories: int) -> Column:
    """Mean of the numeric and the categorical part; either alone if the other has no columns."""
    parts = []
    if d is not None:
        parts.append(1.0 - F.when(max_d > 0, d / max_d).otherwise(d))
    if matches is not None:
        parts.append(matches / F.lit(float(n_categories)))
    if not parts:
        raise ValueError("similarity needs at least one feature")
    return parts[0] if len(parts) == 1 else (parts[0] + parts[1]) / 2.0


def _features(numeric, categorical):
    d = _distance(numeric) if numeric else None
    matches = _matches(categorical) if categorical else None
    return d, matches


def similarity_scores(
    candidates: DataFrame,
    profiles: DataFrame,
    profile_id: str,
    key: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
) -> DataFrame:
    """Score of every row against every profile: ``(key..., profile_id, similarity)``.

    A missing number gives a null score; a missing category equals nothing.
    """
    features = [*numeric, *categorical]
    keep = list(dict.fromkeys([*key, *features]))
    d, matches = _features(numeric, categorical)

    def block(table: DataFrame) -> DataFrame:
        if numeric:
            far = (
                _paired(candidates, table, features)
                .select(F.col("p.profile_id").alias("profile_id"), d.alias("d"))
                .groupBy("profile_id")
                .agg(F.max("d").alias("max_d"))
            )
            table = table.join(far, "profile_id")
        score = _score(d, F.col("p.max_d"), matches, len(categorical))
        return _paired(candidates, table, keep).select(
            *cols(key), F.col("p.profile_id").alias("profile_id"), score.alias("similarity")
        )

    return _in_blocks(_parameters(candidates, profiles, profile_id, numeric, categorical), block)


def nearest_rows(
    candidates: DataFrame,
    profiles: DataFrame,
    profile_id: str,
    key: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    k: int = 10,
    label: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` best-scoring rows for every profile, ties by key, null scores last.

    Output: ``(profile_id, rank, key..., label..., similarity, features...)``.

    Two passes over the candidates and no sort of them. The first takes, per
    profile, the largest distance and the best score in each of a fixed number
    of hash buckets of the key. The k-th best of those bucket winners is a score
    that at least k rows reach, so the second pass ranks only rows at or above it.
    """
    features = [*numeric, *categorical]
    keep = list(dict.fromkeys([*key, *label, *features]))
    d, matches = _features(numeric, categorical)
    buckets = max(_BUCKETS, 4 * k)

    def bounds(table: DataFrame) -> DataFrame:
        folded = (
            _paired(candidates, table, list(dict.fromkeys([*key, *features])))
            .select(
                F.col("p.profile_id").alias("profile_id"),
                F.pmod(F.xxhash64(*cols(key)), F.lit(buckets)).alias("bucket"),
                (matches if matches is not None else F.lit(0)).alias("matches"),
                (d if d is not None else F.lit(None).cast("double")).alias("d"),
            )
            .groupBy("profile_id", "bucket", "matches")
            .agg(F.min("d").alias("near"), F.max("d").alias("far"))
        )
        # at most profiles x buckets x (categories + 1) rows from here on
        per_profile = W.partitionBy("profile_id")
        best = _score(
            F.col("near") if numeric else None,
            F.col("max_d"),
            F.col("matches") if categorical else None,
            len(categorical),
        )
        winners = (
            folded.withColumn("max_d", F.max("far").over(per_profile))
            .groupBy("profile_id", "bucket", "max_d")
            .agg(F.max(F.coalesce(best, F.lit(-1.0))).alias("best"))
        )
        place = F.row_number().over(per_profile.orderBy(F.desc("best")))
        kth = F.max(F.when(F.col("place") == k, F.col("best")))
        return (
            winners.withColumn("place", place)
            .groupBy("profile_id")
            .agg(F.max("max_d").alias("max_d"), F.coalesce(kth, F.lit(-1.0)).alias("floor"))
        )

    def block(table: DataFrame) -> DataFrame:
        table = stage(table.join(bounds(table), "profile_id"))
        score = _score(d, F.col("p.max_d"), matches, len(categorical))
        near = (
            _paired(candidates, table, keep)
            .withColumn("similarity", score)
            .where(F.coalesce(F.col("similarity"), F.lit(-1.0)) >= F.col("p.floor"))
            .withColumn("profile_id", F.col("p.profile_id"))
        )
        order = W.partitionBy("profile_id").orderBy(F.desc_nulls_last("similarity"), *cols(key))
        names = list(dict.fromkeys([*key, *label]))
        return (
            near.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select(
                "profile_id",
                "rank",
                *cols(names),
                "similarity",
                *cols([c for c in features if c not in names]),
            )
        )

    return _in_blocks(_parameters(candidates, profiles, profile_id, numeric, categorical), block)


def _in_blocks(parameters: DataFrame, block) -> DataFrame:
    """Run ``block`` once if the profiles fit one array, else once per hash block of them."""
    table = stage(parameters)
    n = table.count()
    if n <= MAX_PROFILES:
        return block(table)
    n_blocks = -(-2 * n // MAX_PROFILES)
    at = F.pmod(F.xxhash64("profile_id"), F.lit(n_blocks))
    return reduce(
        lambda a, b: a.unionByName(b), [block(table.where(at == i)) for i in range(n_blocks)]
    )


def top_rows(df: DataFrame, score: str, key: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` rows with the largest value, ties by key, missing values last."""
    return df.orderBy(F.desc_nulls_last(col(score)), *cols(key)).limit(k)
