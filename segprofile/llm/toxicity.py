"""Toxicity by a counterfactually regularised linear classifier.

Features are the words of a text and their beginnings of four to six bytes, as present or absent.
How many training texts of either label hold a feature is counted over all of them; those
most associated with the label, by the likelihood ratio, are the vocabulary (at most ``VOCABULARY``).
Logistic weights are fitted on a bounded sample of labelled rows (``SAMPLE``, by hash of the id).

Counterfactuals: every sentence of a sampled text that holds an identity term is read again with the term
swapped for others of its group. The squared change of the score, averaged over these pairs, is
penalised, so the weights of identity terms of one group are pulled together and what
is left of them is shared by neutral mentions: ``COUNTERFACTUAL`` is the strength. Identity terms
that occur are in the vocabulary whatever their association.

Edge cases: null or empty text has no features and the score of the intercept; without labels the
score is 0.5, with a single label that label's share, kept off 0 and 1; null labels are not
learned; repeated rows count as often as they occur; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.functions.staging import stage
from segprofile.llm.tables import read, small
from segprofile.llm.text import remainder, words_of

VOCABULARY, SAMPLE = 4000, 20_000
LEAST_TEXTS, LEAST_RATIO = 3, 15.0
COUNTERFACTUAL, RIDGE, SWAPS = 4.0, 2e-5, 2
THRESHOLD = 0.7
_STEMS = (4, 5, 6)
_SENTENCE = re.compile(rb"[^.!?\n]+")
_FLUSH = 400_000  # distinct features a task keeps before it sends its counts on

#: Terms of a group stand for each other in a counterfactual sentence. A parameter.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"),
)


def features_of(word: bytes) -> tuple[bytes, ...]:
    """The word itself, and its beginnings marked by a star."""
    return (word, *(word[:n] + b"*" for n in _STEMS if len(word) > n))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (feature, n, n_toxic)."""
    n, toxic = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        names = list(n)
        out = pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.binary()), "n": pa.array(list(n.values()), pa.int64()), "n_toxic": pa.array([toxic[x] for x in names], pa.int64())})
        n.clear()
        toxic.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            found = {f for w in set(words_of(text.as_py() or b"")) for f in features_of(w)}
            n.update(found)
            if label.as_py():
                toxic.update(found)
            if len(n) > _FLUSH:
                yield rows()
    yield rows()


class _Hits(dict):
    """word -> places of its features in the vocabulary; remembers a bounded number of words."""

    def __init__(self, places: dict[bytes, int]):
        self.places = places

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        hit = tuple(self.places[f] for f in features_of(word) if f in self.places)
        if len(self) > 300_000:
            self.clear()
        self[word] = hit
        return hit

    def of(self, words) -> set[int]:
        return {i for w in set(words) for i in self[w]}


def _swapped(text: bytes, hits: _Hits, groups: dict[bytes, list[bytes]]) -> Iterator[tuple[list[int], list[int]]]:
    """Features lost and gained by each swap of an identity term in a sentence of the text."""
    if not any(t in groups for t in set(words_of(text))):
        return
    for sentence in _SENTENCE.findall(text):
        words = words_of(sentence)
        for term in sorted({w for w in words if w in groups}):
            others = [t for t in groups[term] if t != term]
            first = (len(sentence) + len(term)) % len(others)
            for other in (others[first:] + others[:first])[:SWAPS]:
                before, after = hits.of(words), hits.of(other if w == term else w for w in words)
                yield sorted(before - after), sorted(after - before)


def _design(batches: Iterator[pa.RecordBatch], places: dict[bytes, int], groups: dict[bytes, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (toxic, places, pairs: signed places of each swap, 1-based)."""
    hits = _Hits(places)
    for batch in batches:
        at, pairs = [], []
        for text in batch.column(0):
            body = text.as_py() or b""
            at.append(sorted(hits.of(words_of(body))))
            pairs.append([[-i - 1 for i in lost] + [i + 1 for i in gained] for lost, gained in _swapped(body, hits, groups)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.list_(pa.int32())))], ["toxic", "at", "pairs"]
        )


def _ragged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def fit_weights(labels: np.ndarray, at: pa.ListArray, pairs: pa.ListArray, size: int, counterfactual: float, ridge: float = RIDGE, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps on logistic loss, ridge and counterfactual penalty.

    Rows of the two labels count for as much in all, so few toxic texts are not outvoted. Each weight
    has a step of its own, the inverse of a bound of its curvature.
    """
    n, n_pairs, width = len(labels), max(len(pairs), 1), size + 1
    rows, cols = _ragged(at)
    rows, cols = np.append(rows, np.arange(n)), np.append(cols, np.full(n, size))  # the last place is the intercept
    p_rows, p_signed = _ragged(pairs)
    p_cols, p_sign = np.abs(p_signed) - 1, np.sign(p_signed).astype(float)
    ones = min(max(labels.mean(), 1e-6), 1 - 1e-6)
    heed = np.where(labels > 0, 0.5 / ones, 0.5 / (1 - ones))
    # a matrix without negative entries is at most the diagonal of its row sums
    many, p_many = np.bincount(rows, minlength=n), np.bincount(p_rows, minlength=n_pairs)
    loss = 0.25 * np.bincount(cols, (heed * many)[rows], width) / n
    swap = counterfactual * np.bincount(p_cols, p_many[p_rows], width) / n_pairs
    step = 1 / (np.maximum(loss, 1e-5) + swap + ridge)
    shrink = np.full(width, ridge)
    shrink[size] = 0
    w = np.zeros(width)
    look, momentum = w.copy(), 1.0
    for _ in range(steps):
        off = heed * (1 / (1 + np.exp(-np.clip(np.bincount(rows, look[cols], n), -40, 40))) - labels)
        change = np.bincount(p_rows, look[p_cols] * p_sign, n_pairs)
        slope = np.bincount(cols, off[rows], width) / n + shrink * look
        slope += counterfactual * np.bincount(p_cols, change[p_rows] * p_sign, width) / n_pairs
        new = look - step * slope
        if ((new - w) * slope).sum() > 0:  # overshot: without momentum from here
            momentum = 1.0
        faster = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        look = new + (momentum - 1) / faster * (new - w)
        w, momentum = new, faster
    return w[:size], float(w[size])


class ToxicityModel:
    def __init__(self, weights: dict[bytes, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    @staticmethod
    def fit(rows: DataFrame, groups=IDENTITY_GROUPS, counterfactual: float = COUNTERFACTUAL, sample: int = SAMPLE) -> ToxicityModel:
        """From rows of (doc_id, text, toxic): counts over all of them, weights on ``sample`` of them."""
        rows = rows.filter(F.col("toxic").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"), F.col("toxic").cast("int").alias("toxic"))
        n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not 0 < ones < n:
            share = min(max(ones / n, 1e-4), 1 - 1e-4) if n else 0.5
            return ToxicityModel({}, float(np.log(share / (1 - share))))
        swaps = {t.encode(): [x.encode() for x in g] for g in groups for t in g}
        identity = sorted({f for t in swaps for f in features_of(t)})
        counts = (
            rows.select("text", "toxic")
            .mapInArrow(_feature_counts, "feature binary, n long, n_toxic long")
            .groupBy("feature")
            .agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("a"))
        )
        chosen = stage(_associated(counts, n, ones, identity)).orderBy(F.desc("g"), "feature").limit(VOCABULARY + len(identity)).collect()
        places = {bytes(r.feature): i for i, r in enumerate(chosen)}
        kept = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, sample / n)))
        design = rows.filter(kept).select("text", "toxic").mapInArrow(lambda it: _design(it, places, swaps), "toxic int, at array<int>, pairs array<array<int>>").toArrow()
        labels = design.column("toxic").to_numpy().astype(float)
        if not len(labels):
            return ToxicityModel({}, float(np.log(ones / (n - ones))))
        at, pairs = design.column("at").combine_chunks(), design.column("pairs").combine_chunks().flatten()
        del design
        w, b = fit_weights(labels, at, pairs, len(places), counterfactual)
        return ToxicityModel({f: float(w[i]) for f, i in places.items() if w[i]}, b)

    def column(self, spark: SparkSession, text: Column) -> Column:
        """The probability of label 1."""
        shared = spark.sparkContext.broadcast((self.weights, self.intercept))
        kept: list[_Hits] = []

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            weights, intercept = shared.value
            if not kept:
                kept.append(_Hits({f: i for i, f in enumerate(weights)}))
            hits, w = kept[0], np.array(list(weights.values()), float)
            totals = np.array([intercept + w[sorted(hits.of(words_of(t.as_py() or b"")))].sum() for t in texts], float)
            return pa.array(1 / (1 + np.exp(-np.clip(totals, -40, 40))))

        return score(text.cast("binary"))


def _associated(counts: DataFrame, n: int, ones: int, identity: list[bytes]) -> DataFrame:
    """Features whose likelihood ratio against the label is large enough, and all identity features."""
    a, m = F.col("a").cast("double"), F.col("n").cast("double")

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    p = ones / n
    g = 2 * (
        term(a, m * p) + term(m - a, m * (1 - p)) + term(F.lit(float(ones)) - a, (F.lit(float(n)) - m) * p) + term(F.lit(float(n - ones)) - (m - a), (F.lit(float(n)) - m) * (1 - p))
    )
    named = F.col("feature").isin([F.lit(bytearray(x)) for x in identity]) if identity else F.lit(False)
    found = counts.select("feature", "n", F.when(named, F.lit(float("inf"))).otherwise(g).alias("g"))
    return found.filter((F.col("n") >= LEAST_TEXTS) & (F.col("g") >= LEAST_RATIO) | (F.col("g") == float("inf"))).select("feature", "g")


def fit_from_labels(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learned only from documents whose crc32(doc_id) mod 3 is not 1."""
    known = labels.select(F.col("doc_id").alias("_of"), F.col("toxic").alias("_toxic")).filter(F.col("_toxic").isNotNull())
    rows = docs.select("doc_id", "text").filter(remainder(F.col("doc_id"), 3) != 1).join(small(known, 1_000_000), F.col("doc_id") == F.col("_of"))
    return ToxicityModel.fit(rows.select("doc_id", "text", F.col("_toxic").alias("toxic")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_from_labels(spark, docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), model.column(spark, F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all their columns unchanged."""
    model = fit_from_labels(spark, docs, labels)
    return docs.filter(model.column(spark, F.col("text")) < THRESHOLD)
