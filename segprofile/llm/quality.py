"""Quality by a sparse rule ensemble.

Statistics of the text (lengths, shares of kinds of characters, repetition) feed a small random
forest; every path from a root to a node is a rule, a conjunction of comparisons. A logistic
regression with an L1 penalty weighs the rules and leaves most at zero. The rest is compiled into
one Spark column expression: no model object is needed to score.

Edge cases: null text has the statistics of the empty text; without labels, or with one label only, the
score is the share of label 1 (0.5 without any); null labels are not learned; of repeated label
rows each counts; other columns are not looked at.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.functions.staging import stage
from segprofile.llm.tables import read, small
from segprofile.llm.text import remainder

TREES, DEPTH, PENALTY = 24, 4, 0.0005
THRESHOLD = 0.3

#: Kinds of bytes.
_KINDS = ("lower", "upper", "digit", "blank", "line", "stop", "bang", "bar", "symbol", "beyond")
_KIND = np.full(256, _KINDS.index("symbol"), np.uint8)
for _kind, _bytes in {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": b" \t\r\x0b\x0c",
    "line": b"\n", "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|", "beyond": range(128, 256),
}.items():
    _KIND[list(_bytes)] = _KINDS.index(_kind)

STATISTICS = (
    "bytes", "words", "mean_word", "longest_word", "distinct_words", "distinct_triples", "repeats_next",
    "top_word", "lines", "mean_line", "distinct_lines", "ending_lines", "sentences",
    *(f"share_{k}" for k in _KINDS),
)


def statistics_of(text: bytes) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS; shares of nothing are 0."""
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=len(_KINDS))
    words = text.lower().split()
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    some, many = max(n, 1), max(len(lines), 1)
    triples = max(n - 2, 1)
    return (
        float(size),
        float(n),
        sum(map(len, words)) / some,
        float(max(map(len, words), default=0)),
        len(set(words)) / some,
        min(1.0, len(set(zip(words, words[1:], words[2:], strict=False))) / triples),
        sum(map(operator.eq, words, words[1:])) / some,
        max(Counter(words).values(), default=0) / some,
        float(len(lines)),
        sum(map(len, lines)) / many,
        len(set(lines)) / many,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / many,
        text.count(b".") / some,
        *(kinds / max(size, 1)).tolist(),
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.array([statistics_of(x.as_py() or b"") for x in batch.column(1)], float)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], ["doc_id", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _statistics, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS)
    )


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, threshold), ...


def _paths(node, so_far: Rule = ()) -> Iterator[Rule]:
    """Rules of all nodes below a tree's node."""
    if node.getClass().getSimpleName() == "LeafNode":
        return
    split = node.split()
    name, threshold = STATISTICS[split.featureIndex()], split.threshold()
    for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
        rule = (*so_far, (name, low, threshold))
        yield rule
        yield from _paths(child, rule)


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, low, threshold in rule:
        out = out & ((F.col(name) <= threshold) if low else (F.col(name) > threshold))
    return out


class RuleEnsemble:
    """Weighted rules; ``score`` is the probability of label 1 as a column over the statistics."""

    def __init__(self, intercept: float, weights: dict[Rule, float]):
        self.intercept, self.weights = intercept, weights

    @staticmethod
    def fit(rows: DataFrame, seed: int = 7) -> RuleEnsemble:
        """From all rows of statistics and ``label`` (0 or 1)."""
        n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not 0 < ones < n:
            share = min(max(ones / n, 1e-6), 1 - 1e-6) if n else 0.5
            return RuleEnsemble(float(np.log(share / (1 - share))), {})
        features = array_to_vector(F.array(*STATISTICS)).alias("features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.5, seed=seed)
        trees = forest.fit(rows.select("label", features)).trees
        rules = list(dict.fromkeys(r for t in trees for r in _paths(t._call_java("rootNode"))))
        if not rules:
            return RuleEnsemble(float(np.log(ones / (n - ones))), {})
        truth = array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features")
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=100, standardization=False)
        fitted = lasso.fit(stage(rows.select("label", truth)))
        return RuleEnsemble(float(fitted.intercept), {r: float(w) for r, w in zip(rules, fitted.coefficients, strict=True) if w})

    @property
    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stage(statistics(read(spark, sf_dir, "documents")))
    held = remainder(F.col("doc_id"), 5) == 0
    labels = read(spark, sf_dir, "labels").filter(F.col("quality").isNotNull())
    labels = labels.select(F.col("doc_id").alias("of"), F.col("quality").cast("double").alias("label"))
    known = found.filter(~held).join(small(labels, 1_000_000), F.col("doc_id") == F.col("of")).drop("of")
    score = RuleEnsemble.fit(stage(known)).score
    scored = found.select("doc_id", held.alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
