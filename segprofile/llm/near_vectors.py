"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits at the median of a projection on a random direction, again and again. A vector closer to a split
than ``margin`` goes down both sides, so two similar vectors part only if the split separates them by more
than that. Vectors of one label that share a leaf of any tree are compared, in double precision;
links are united. Directions come from a seed, medians from a bounded sample of the vectors; every vector
goes through every tree, as deep as the number of vectors of its label asks for.

A pair that shares several leaves counts in the first of them only, so numbers of links are exact for the
pairs that meet. Equal vectors are one vector with a count. A leaf of any size is compared in blocks of
bounded size; a block returns one row per member: its number of links and the smallest member it
is connected with there. Pairs are never listed.

Edge cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label or
vec_id is null, links with nothing and is its own component; vectors of different length never
link; repeated rows are other vectors that link, and so are several vectors of one vec_id; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.functions.staging import stage
from segprofile.llm.blocks import block_pairs
from segprofile.llm.components import components
from segprofile.llm.tables import read

THRESHOLD = 0.93
TREES, LEAF, SAMPLE, LEAST_IN_SAMPLE = 6, 384, 16_384, 16
BLOCK = 1024
_SEED = 20


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vector) to unit vectors as 64-bit floats; null where it links with nothing."""
    for batch in batches:
        units = []
        for vec_id, label, vector in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            x = vector.values if vector.is_valid else None
            unit = None
            if x is not None and len(x) and not x.null_count and vec_id.is_valid and label.is_valid:
                x = np.asarray(x.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    x = x / top
                    unit = (x / np.sqrt((x * x).sum())).astype("<f8").tobytes()
            units.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], ["vec_id", "label", "unit"])


class Tree:
    """Splits in heap order: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, number: int, sample: np.ndarray, depth: int):
        self.number, self.dim = number, sample.shape[1]
        self.splits: dict[int, float] = {}
        level = {0: np.arange(len(sample))}
        for _ in range(depth):
            below = {}
            for node, members in level.items():
                if len(members) < 2 * LEAST_IN_SAMPLE:
                    continue
                at = sample[members] @ self.direction(node)
                self.splits[node] = cut = float(np.median(at))
                below[2 * node + 1], below[2 * node + 2] = members[at < cut], members[at >= cut]
            level = below

    def direction(self, node: int) -> np.ndarray:
        x = np.random.default_rng((_SEED, self.number, node, self.dim)).standard_normal(self.dim)
        return x / np.linalg.norm(x)

    def leaves(self, vectors: np.ndarray, margin: float, depth: int = 64) -> Iterator[tuple[int, np.ndarray]]:
        """(node at ``depth`` or leaf above it, places of the vectors in it)."""
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, members = waiting.pop()
            if node not in self.splits or node >= (1 << depth) - 1 or not len(members):
                yield node, members
                continue
            off = vectors[members] @ self.direction(node) - self.splits[node]
            waiting += [(2 * node + 1, members[off < margin]), (2 * node + 2, members[off >= -margin])]


def fit_forest(sample: list[np.ndarray], depth: int, trees: int = TREES) -> dict[int, list[Tree]]:
    """Trees for every length of vector in the sample."""
    by_dim: dict[int, list[np.ndarray]] = {}
    for x in sample:
        by_dim.setdefault(len(x), []).append(x)
    return {dim: [Tree(t, np.stack(xs), depth) for t in range(trees)] for dim, xs in by_dim.items()}


def _leaves(batches: Iterator[pa.RecordBatch], forest: dict[int, list[Tree]], threshold: float) -> Iterator[pa.RecordBatch]:
    """(rep, label, n, unit, depth) to rep, label, n, unit and ``codes``: all its leaves at that depth, in order."""
    for batch in batches:
        units = [np.frombuffer(u.as_buffer(), "<f8") for u in batch.column(3)]
        depths = batch.column(4).to_pylist()
        codes: list[list[int]] = [[] for _ in units]
        for dim, depth in {(len(u), d) for u, d in zip(units, depths, strict=True)}:
            own = np.array([i for i, u in enumerate(units) if len(u) == dim and depths[i] == depth])
            vectors = np.stack([units[i] for i in own])
            # half the typical distance of two linked vectors along a random direction
            margin = 0.5 * math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
            for tree in forest.get(dim, ()):
                for leaf, members in tree.leaves(vectors, margin, depth):
                    for i in own[members]:
                        codes[i].append((dim << 40) + (tree.number << 32) + leaf)
        codes = [sorted(c) or [len(u) << 40] for c, u in zip(codes, units, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(codes, pa.list_(pa.int64()))], ["rep", "label", "n", "unit", "codes"])


def _met_before(a: list, b: list, leaf: int) -> np.ndarray:
    """Whether members share a leaf that comes before this one."""
    names = {c: i for i, c in enumerate(sorted({c for x in (*a, *b) for c in x if c < leaf}))}
    if not names:
        return np.zeros((len(a), len(b)), bool)
    held = []
    for side in (a, b):
        m = np.zeros((len(side), len(names)), np.float32)
        for i, x in enumerate(side):
            m[i, [names[c] for c in x if c < leaf]] = 1
        held.append(m)
    return held[0] @ held[1].T > 0


def joined(linked: np.ndarray) -> np.ndarray:
    """Smallest place that each place is connected with, from a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """A block, or a pair of blocks, of one leaf: rep, links, root of those that link."""
    leaf, low, high = (table.column(c)[0].as_py() for c in ("leaf", "low", "high"))
    rep, n, block = (table.column(c).to_numpy() for c in ("rep", "n", "block"))
    order = np.lexsort((rep, block != low))
    rep, n, block = rep[order], n[order], block[order]
    units = table.column("unit").to_pylist()
    codes = table.column("codes").to_pylist()
    vectors = np.stack([np.frombuffer(units[i], "<f8") for i in order])
    codes = [codes[i] for i in order]
    first = int((block == low).sum()) if low != high else len(rep)
    a, b = (slice(0, first), slice(first, None)) if low != high else (slice(0, first), slice(0, first))
    near = vectors[a] @ vectors[b].T >= threshold
    if low == high:
        np.fill_diagonal(near, False)
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    if len(rows):
        shift = 0 if low == high else first
        part = near[np.ix_(rows, cols)]
        counted = part & ~_met_before([codes[i] for i in rows], [codes[shift + j] for j in cols], leaf)
        links[rows] += counted @ n[shift + cols]
        if low != high:
            links[shift + cols] += counted.T @ n[rows]
        places = np.union1d(rows, shift + cols)
        square = np.zeros((len(places), len(places)), bool)
        at_rows, at_cols = np.searchsorted(places, rows), np.searchsorted(places, shift + cols)
        square[np.ix_(at_rows, at_cols)] = part
        square |= square.T
        root[places] = places[_smallest(joined(square), rep[places])]
    some = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
    return pa.table({"rep": rep[some], "links": links[some], "root": rep[root[some]]})


def _smallest(label: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """For each place the place of the smallest rep with its label."""
    order = np.lexsort((rep, label))
    firsts = np.flatnonzero(np.append(True, np.diff(label[order]) != 0))
    best = np.empty(int(label.max()) + 1, np.int64)
    best[label[order][firsts]] = order[firsts]
    return best[label]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    rows = vectors.select("vec_id", "label", "embedding").mapInArrow(_units, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit binary")
    rows = stage(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "unit"))
    # a vector of a label has a name of its own: one vec_id may stand for several
    named = rows.withColumn("rep", F.when(F.col("unit").isNotNull(), F.xxhash64("label", "unit")))
    reps = stage(named.filter(F.col("unit").isNotNull()).groupBy("label", "unit", "rep").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")))
    # every label is split as often as its own number of vectors asks for
    sizes = reps.groupBy("label").agg(F.count("*").alias("size"))
    depths = stage(sizes.select("label", F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / F.lit(leaf)))).cast("int").alias("depth")))
    n, depth = reps.count(), depths.agg(F.max("depth")).first()[0] or 0
    kept = F.pmod(F.xxhash64("unit"), F.lit(1_000_000)) < F.lit(math.ceil(1_000_000 * min(1.0, SAMPLE / max(n, 1))))
    sample = [np.frombuffer(bytes(r.unit), "<f8") for r in reps.filter(kept).select("unit").limit(2 * SAMPLE).collect()]
    forest = spark.sparkContext.broadcast(fit_forest(sample, depth))
    found = reps.join(depths, "label").select("rep", "label", "n", "unit", "depth").mapInArrow(
        lambda it: _leaves(it, forest.value, threshold), f"rep long, label {kinds['label']}, n long, unit binary, codes array<long>"
    )
    found = stage(found)
    members = found.select("rep", "n", "label", F.explode("codes").alias("leaf")).withColumn("group", F.xxhash64("label", "leaf"))
    # only ids are counted and dealt into blocks; vectors join them at the end
    pairs = block_pairs(members.select("group", "leaf", "label", "rep", "n"), "group", "rep", block)
    full = pairs.join(found.select("rep", "unit", "codes"), "rep")
    compared = stage(
        full.select("rep", "n", "leaf", "label", "block", "low", "high", "unit", "codes")
        .groupBy("label", "leaf", "low", "high")
        .applyInArrow(lambda t: _compare(t, threshold), "rep long, links long, root long")
    )
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    united = components(compared.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    whole = F.coalesce("component", "rep")
    per_rep = stage(reps.join(links, "rep", "left").join(united, F.col("rep") == F.col("node"), "left").select("rep", "first", "n", "links", whole.alias("whole")))
    smallest = per_rep.groupBy("whole").agg(F.min("first").alias("component_id"))
    per_rep = per_rep.join(smallest, "whole").select("rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    result = named.join(per_rep, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
