"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of 13 words, or all its words if there are fewer. A document
contains a window if all of the window's shingles (runs of five words; all words of a shorter
window) follow each other in it. Containment needs every shingle, so by the prefix principle one
is enough to find candidates: the rarest, by how often the shingles of the benchmark occur in the
documents. A document shingle equal to a window's prefix must lie far enough from both ends for
the window to fit (length and positional bounds), and then the words themselves are compared.

The windows are broadcast in blocks of at most ``block_rows``; more windows mean more blocks, each
joined with all documents. Documents are never shuffled: only shingles counted before the shuffle
and the few matches are.

Edge cases: null text has no words, a document without words is clean with n_words 0; an item
without words has no window; equal items each count; items that share a window all count; a null
item_id is left out of the digest but its words are hit; empty tables give no rows or clean
documents; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.functions.staging import stage
from segprofile.llm.tables import read, small
from segprofile.llm.text import words_column

WINDOW, SHINGLE = 13, 5
BLOCK_ROWS = 200_000  # windows in one broadcast: some 300 bytes each, 60 MB


def _hash(words: Column) -> Column:
    return F.xxhash64(words)


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows: window, words; members: window, item_id). A window is known by two hashes of its words."""
    items = benchmark.select("item_id", words_column(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(width - 1), F.lit(1)))
    each = items.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("words", F.col("at"), F.lit(width)).alias("words")
    )
    each = each.withColumn("window", F.sha2(F.concat_ws(" ", "words"), 256))
    each = stage(each)
    return (
        each.groupBy("window").agg(F.first("words").alias("words")),
        each.select("window", "item_id").filter(F.col("item_id").isNotNull()).distinct(),
    )


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """window, words, at (0-based), width and hash of each shingle of each window."""
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(shingle), F.lit(0)))
    return windows.select("window", "words", F.explode(at).alias("at")).select(
        "window",
        "words",
        "at",
        F.least(F.size("words"), F.lit(shingle)).alias("width"),
        _hash(F.slice("words", F.col("at") + 1, F.lit(shingle))).alias("shingle"),
    )


def _document_shingles(docs: DataFrame, widths: list[int], *carried: str) -> DataFrame:
    """Every shingle of every document: ``words``, ``pos`` (0-based), ``shingle``, ``width``, and the carried columns.

    After its last word a document has one more row, without shingle, so that it is in the result
    whatever it contains.
    """
    rows = docs.select(*carried, words_column(F.col("text")).alias("words"))
    rows = rows.select(*carried, "words", F.size("words").alias("n_words"), F.explode(F.sequence(F.lit(0), F.size("words"))).alias("pos"))

    def of(width: int) -> Column:
        fits = F.col("pos") + F.lit(width) <= F.col("n_words")
        return F.when(fits, _hash(F.slice("words", F.col("pos") + 1, F.lit(width))))

    if len(widths) == 1:
        return rows.select(*carried, "words", "n_words", "pos", F.lit(widths[0]).alias("width"), of(widths[0]).alias("shingle"))
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), of(w).alias("shingle")) for w in widths]))
    return rows.select(*carried, "words", "n_words", "pos", each.alias("s")).select(*carried, "words", "n_words", "pos", "s.width", "s.shingle")


def prefixes(docs: DataFrame, shingled: DataFrame, widths: list[int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rarest shingle of each window: window, words, at, width, shingle. Ties: hash, then place."""
    known = shingled.select("shingle", "width").distinct()
    found = _document_shingles(docs, widths).select("shingle", "width").join(small(known, block_rows * 10), ["shingle", "width"])
    counts = found.groupBy("shingle", "width").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")
    rarest = (
        shingled.join(counts, ["shingle", "width"], "left")
        .groupBy("window")
        .agg(F.first("words").alias("words"), F.first("width").alias("width"), F.min(rarity).alias("first"))
    )
    return rarest.select("window", "words", "width", "first.at", "first.shingle")


def _matches(docs: DataFrame, prefix: DataFrame, widths: list[int]) -> DataFrame:
    """_row, doc_id, n_words, start and window of each occurrence; one row without window per document."""
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    seen = _document_shingles(rows, widths, "_row", "doc_id")
    p = prefix.select("window", F.col("words").alias("window_words"), "at", F.col("width").alias("p_width"), F.col("shingle").alias("p_shingle"))
    start, length = F.col("pos") - F.col("at"), F.size("window_words")
    joined = seen.join(F.broadcast(p), (F.col("shingle") == F.col("p_shingle")) & (F.col("width") == F.col("p_width")), "left")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, length) == F.col("window_words")
    last = F.col("pos") == F.col("n_words")
    return joined.filter(last | (F.col("window").isNotNull() & fits & same)).select(
        "_row", "doc_id", "n_words", F.when(~last, start).alias("start"), F.when(~last, length).alias("length"), F.when(~last, F.col("window")).alias("window")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    windows, members = item_windows(benchmark)
    shingled = stage(window_shingles(windows))
    widths = sorted(r.width for r in shingled.select("width").distinct().collect()) or [SHINGLE]  # five at most
    prefix = stage(prefixes(docs, shingled, widths, block_rows))
    n = prefix.count()
    blocks = max(1, math.ceil(n / block_rows))
    block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    found = _matches(docs, prefix.filter(block == 0), widths)
    for i in range(1, blocks):
        found = found.union(_matches(docs, prefix.filter(block == i), widths))
    return _verdicts(found, stage(members))


def _verdicts(found: DataFrame, members: DataFrame) -> DataFrame:
    # hit words are those under the union of the occurrences, walked through from left to right
    runs = F.sort_array(F.collect_set(F.when(F.col("window").isNotNull(), F.struct("start", "length"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def covered(so_far: Column, run: Column) -> Column:
        stop = run["start"] + run["length"]
        new = F.greatest(stop - F.greatest(run["start"], so_far["end"]), F.lit(0))
        return F.struct((so_far["n"] + new).alias("n"), F.greatest(stop, so_far["end"]).alias("end"))

    per_doc = found.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.aggregate(runs, zero, covered, lambda x: x["n"]).cast("long").alias("n_hit"),
        F.collect_set("window").alias("windows"),
    )
    listed = (
        per_doc.select("_row", "doc_id", "n_words", "n_hit", F.explode_outer("windows").alias("window"))
        .join(small(members, BLOCK_ROWS), "window", "left")
        .groupBy("_row", "doc_id", "n_words", "n_hit")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return listed.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all their columns unchanged; a verdict depends on the text alone."""

    def digest(text: Column) -> Column:
        return F.md5(F.coalesce(text, F.lit("")).cast("binary"))

    keyed = docs.select(digest(F.col("text")).alias("doc_id"), "text")
    bad = stage(contamination(keyed, benchmark).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return packed.join(small(bad, 1_000_000), digest(F.col("doc.text")) == F.col("_bad"), "left_anti").select("doc.*")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS width,
         array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 11, 2))) AS i FROM items WHERE len(words) > 0)),
runs AS (
  SELECT k, i, width, array_to_string(words[i:i + width - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS i
        FROM docs, (SELECT DISTINCT width FROM windows) WHERE len(words) >= width)),
found AS (SELECT k, i, r.width, item_id FROM runs r JOIN windows USING (width, w)),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + width)) AS p FROM (SELECT DISTINCT k, i, width FROM found)) GROUP BY k),
listed AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
           FROM (SELECT DISTINCT k, item_id::VARCHAR AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words)) AS contaminated
FROM docs LEFT JOIN hit USING (k) LEFT JOIN listed USING (k)
"""
