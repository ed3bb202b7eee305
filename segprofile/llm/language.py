"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text's letters are lowered, all else is a gap; its runs of one to three characters that do not
begin in a gap are hashed into buckets. Training adds up bucket counts per language inside each task and
then over tasks; the driver gets one number per language and bucket. The matrix of smoothed log
probabilities is broadcast, its size bounded: languages x buckets is at most 2^22, buckets are
halved until that holds. Scoring adds up the matrix rows of a text's n-grams in numpy.

Edge cases: null text, or text without a letter, is ``und`` with score 0, and so is everything if
there is no training row; null lang is never learned; ties go to the smallest language; repeated rows
count as often as they occur; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.llm.tables import read
from segprofile.llm.text import remainder

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
CELLS = 1 << 22
SMOOTHING = 0.5
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_AT_ONCE = 1 << 19  # characters looked at together


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(points: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the n-grams of code points in which gaps are 0."""
    x = points.astype(np.uint32)
    out, value = [], np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            break
        value = value[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            h = value * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append(((h >> np.uint32(8)) & np.uint32(buckets - 1))[x[: len(x) - n + 1] > 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _points(text: str) -> np.ndarray:
    """Lowered code points, gaps as 0, a gap at either end."""
    p = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[p], p, np.uint32(0))


def _parts(text: str) -> Iterator[str]:
    for i in range(0, len(text), _AT_ONCE):
        yield text[i : i + _AT_ONCE]


def _counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": n[at]})
        sums.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            if lang.as_py() not in sums:
                if len(sums) == 64:  # keeps memory bounded whatever the number of languages
                    yield from rows()
                sums[lang.as_py()] = np.zeros(buckets, np.int64)
            for part in _parts(text.as_py() or ""):
                sums[lang.as_py()] += np.bincount(_grams(_points(part), buckets), minlength=buckets)
    yield from rows()


class LanguageModel:
    """langs in order, log probabilities (buckets x langs) and log priors."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.table, self.prior = langs, table, prior

    @staticmethod
    def fit(rows: DataFrame) -> LanguageModel:
        """From all rows of (text, lang) with a language."""
        rows = rows.filter(F.col("lang").isNotNull())
        seen = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        langs = sorted(seen)
        buckets = BUCKETS
        while buckets > 256 and buckets * len(langs) > CELLS:
            buckets //= 2
        n = np.zeros((buckets, len(langs)))
        sums = (
            rows.select(F.col("text").cast("string"), F.col("lang").cast("string"))
            .mapInArrow(lambda it: _counts(it, buckets), "lang string, bucket int, n long")
            .groupBy("lang", "bucket")
            .agg(F.sum("n").alias("n"))
            .toArrow()
        )
        place = {lang: i for i, lang in enumerate(langs)}
        if sums.num_rows:
            column = np.array([place[x] for x in sums.column("lang").to_pylist()])
            n[sums.column("bucket").to_numpy(), column] = sums.column("n").to_numpy()
        table = np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * buckets)) if langs else n
        prior = np.log(np.array([seen[x] for x in langs], float) / max(1, sum(seen.values())))
        return LanguageModel(langs, np.ascontiguousarray(table, np.float32), prior)

    def column(self, spark: SparkSession, text: Column) -> Column:
        """struct<lang_pred, score> of a text: the likeliest language and its probability."""
        shared = spark.sparkContext.broadcast((self.langs, self.table, self.prior))

        @F.arrow_udf("struct<lang_pred: string, score: double>")
        def predict(texts: pa.Array) -> pa.Array:
            langs, table, prior = shared.value
            names, scores = [], []
            for text in texts:
                name, score = _predict(text.as_py(), langs, table, prior)
                names.append(name)
                scores.append(score)
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

        return predict(text)


def _predict(text: str | None, langs: list[str], table: np.ndarray, prior: np.ndarray) -> tuple[str, float]:
    if not langs or text is None or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    total = prior.copy()
    for part in _parts(text):
        # counts of the n-grams that occur, times their rows of the matrix
        n = np.bincount(_grams(_points(part), len(table)), minlength=len(table))
        at = np.flatnonzero(n)
        total += n[at].astype(np.float32) @ table[at]
    best = int(np.argmax(total))
    return langs[best], float(1 / np.exp(total - total[best]).sum())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    model = LanguageModel.fit(docs.filter(~held).select("text", "lang"))
    return docs.select("doc_id", held.alias("held_out"), model.column(spark, F.col("text")).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )
