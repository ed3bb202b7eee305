"""Mixing sources to target weights.

Words are added up per source; each source gets a target and the rate target / words. A
document is emitted floor(rate) times, and once more with probability rate - floor(rate), by a
draw that is a pure function of seed, doc_id and text: reruns agree, whatever the partitioning.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share all words
by weight. No target exceeds ``limit`` times the source's own words; what is above is shared
again by weight among the others until none is above.

Edge cases: null or blank text has size 0 and is emitted like any other document; null source is
a source of its own; an empty table gives an empty mix; a table without any word has targets 0 and
rate 0, so nothing is emitted. Repeated rows draw alike. Extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segprofile.functions.staging import stage
from segprofile.llm.tables import read, small

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"
MANY_SOURCES = 200_000  # more than these are not broadcast


def size_of(text: Column) -> Column:
    """Number of words between white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a digest of seed, id and text."""
    parts = [F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def targets(sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target, rate from rows of (source, size).

    Only totals per source are looked at. Each round is one aggregate over them that settles all
    sources now above their limit; a round that settles none ends it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    totals = stage(totals.select("source", "source_size", weight.cast("long").alias("weight")))
    everything = totals.agg(F.sum("source_size")).first()[0] or 0
    bound = F.col("source_size") * F.lit(limit)
    left, share, n_settled = everything, 0, -1
    while True:
        # settled: those whose share of the first ``left`` words per ``share`` weights is above their bound
        above = (F.lit(left) * F.col("weight") > bound * F.lit(share)) if share else F.lit(False)
        now = totals.agg(
            F.coalesce(F.sum(F.when(above, bound)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.lit(0)).alias("share"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if now.n == n_settled or not now.share:
            break
        left, share, n_settled = everything - now.taken, now.share, now.n
    free = F.lit(left).cast("double") * F.col("weight") / F.lit(max(share, 1)).cast("double")
    target = F.least(bound.cast("double"), free)
    return totals.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def copies(rate: Column, drawn: Column) -> Column:
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and draw of each document, written once: texts are read one time only."""
    return stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("drawn")))


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies) of each document."""
    sized = measured(docs)
    per_source = targets(sized).withColumnRenamed("source", "of_source")
    return sized.join(small(per_source, MANY_SOURCES), F.col("source").eqNullSafe(F.col("of_source"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies(F.col("rate"), F.col("drawn"))).alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, all its columns unchanged."""
    sizes = docs.select("source", size_of(F.col("text")).alias("size"))
    rates = targets(sizes).select(F.col("source").alias("of_source"), "rate")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    n = copies(F.col("rate"), draw(F.col("doc.doc_id"), F.col("doc.text")))
    return (
        packed.join(small(rates, MANY_SOURCES), F.col("doc.source").eqNullSafe(F.col("of_source")))
        .select("doc", F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
        .select("doc.*")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0 AS drawn
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM totals),
levels AS (
  SELECT *, 3 * source_size::DOUBLE / weight AS level,
         sum(source_size) OVER () AS everything,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighed),
free AS (
  SELECT everything - below AS words, share FROM levels
  WHERE (everything - below)::DOUBLE / share <= level ORDER BY level, source NULLS LAST LIMIT 1),
planned AS (
  SELECT source, source_size,
         least((3 * source_size)::DOUBLE, words::BIGINT::DOUBLE * weight / share::BIGINT::DOUBLE) AS target
  FROM weighed, free)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         size * (floor(target / source_size) + (drawn < target / source_size - floor(target / source_size))::INT) END::BIGINT AS taken
FROM sized JOIN planned ON sized.source IS NOT DISTINCT FROM planned.source
"""
