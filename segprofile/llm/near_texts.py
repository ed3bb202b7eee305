"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A text is its shingles of five words, each weighing tf x idf. Document frequencies are counted exactly, over
all documents and whatever their number; idf lies
between ``FLAT`` and 1, so that what many documents share counts less, and the shingles that large groups of copies
have in common still count. Texts are linked if the weighted Jaccard similarity, sum of minima over sum of
maxima, is at least 0.8; groups are the connected components of the links.

Every text gets 24 consistent weighted samples (Ioffe 2010): two texts agree in one with the probability of
their similarity. Two samples make a band; texts that agree in a band are candidates (all but one pair in 10^5 at
0.8), if at least ``AGREE`` of 24 samples agree. Candidates are verified on their whole texts.

Frequencies gather in no one place. Documents are dealt into chunks and the 64-bit shingles into buckets, both growing in
number with the input. A chunk adds up its own documents before it sends each bucket its shingles, 48 bits of each beside
the bucket, which knows the rest; a bucket answers each chunk with the shingles that more documents than one have (idf is 1 for all others), and every text carries on the
idf of those it holds.

Equal texts are one text. A band's texts, however many, are met in blocks of bounded size, and
no pairs are listed within a group of copies. A block proposes a spanning forest of its candidates, each verified: first every
block by itself, then one text of each group so far. What is still apart and connected by candidates is then
compared whole, block against block, as products of matrices of shingles inside the tasks: all candidates that are left are
among these, and only links between groups come out.

Edge cases: a null text is no copy of any; texts without words are copies if they are equal; a text of one to
four words is one shingle; a document without doc_id is not compared and has no class; rows of one doc_id are one
document; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.functions.staging import stage
from segprofile.llm.blocks import block_pairs
from segprofile.llm.components import components
from segprofile.llm.near_vectors import joined
from segprofile.llm.tables import read, small
from segprofile.llm.text import Tokens, buffer_of, mix, pieces, shingles

WIDTH, THRESHOLD = 5, 0.8
SAMPLES, BAND, AGREE = 24, 2, 11
FLAT = 0.75
CHUNK, CHUNKS = 1 << 23, 1 << 10  # bytes of text in a chunk; on small input up to so many chunks of 1/32 of that
BLOCK, TEXT_BLOCK = 1024, 192
_COLUMNS = 2048
_ELEMENTS = 1 << 16  # shingles sampled at a time
_U = np.uint64
_LOW = _U((1 << 48) - 1)
PARCEL = 20_000  # members of blocks that a task compares one after the other


# -- weights ----------------------------------------------------------------------------------


def weighted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, tf) of the distinct shingles of each text, by row and shingle."""
    rows, values = shingles(Tokens(texts), WIDTH)
    if not len(rows):
        return rows, values, np.zeros(0, np.float32)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(values) != 0)))
    return rows[first], values[first], np.diff(np.append(first, len(rows))).astype(np.float32)


def _packed(values: np.ndarray) -> bytes:
    """The lower 48 bits of each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(_U)


#: A shingle of a text, by its place among the text's distinct shingles in ascending order, and its idf.
_CARRIED = np.dtype([("at", "<u4"), ("idf", "<f4")])


class Frequencies:
    """idf by shingle, of which 48 bits name it inside a chunk; 1 for all that are not named."""

    def __init__(self, values: np.ndarray, idf: np.ndarray):
        order = np.argsort(values)
        self.values, self.idf = values[order], idf[order]

    def __getitem__(self, keys) -> np.ndarray:
        keys = np.asarray(keys).astype(_U) & _LOW
        out = np.ones(keys.shape, np.float32)
        if len(self.values):
            place = np.minimum(np.searchsorted(self.values, keys), len(self.values) - 1)
            out = np.where(self.values[place] == keys, self.idf[place], out)
        return out


def weights_of(idf, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """idf of the distinct shingles of texts in order, from what the texts carry or from ``Frequencies``."""
    if isinstance(idf, Frequencies):
        return idf[values]
    data, starts = buffer_of(idf)
    entries = np.frombuffer(data.tobytes(), _CARRIED)
    n = np.diff(starts) // _CARRIED.itemsize
    out = np.ones(len(rows), np.float32)
    out[np.repeat(np.searchsorted(rows, np.arange(len(n))), n) + entries["at"].astype(np.int64)] = entries["idf"]
    return out


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    rarity = np.log1p(n / np.maximum(df, 1)) / np.log1p(max(n, 1))
    return (FLAT + (1 - FLAT) * np.minimum(rarity, 1)).astype(np.float32)


def _dealt(table: pa.Table, buckets: int) -> pa.Table:
    """A chunk's distinct shingles by bucket: ``shingles``, those of several documents first, whose numbers are ``counts``."""
    text = table.column("text").combine_chunks()
    found = [weighted(part)[1] for _, part in pieces(text)]
    values, n = np.unique(np.concatenate([np.zeros(0, _U), *found]), return_counts=True)
    # the bucket tells apart what the lower 48 bits do not
    key = (mix(values) % _U(buckets)).astype(np.int64) * 2 + (n == 1)
    order = np.argsort(key.astype(np.uint16) if 2 * buckets < 1 << 16 else key, kind="stable")
    values, n, key = values[order], n[order], key[order]
    own = np.unique(key >> 1)
    first, single, last = (np.searchsorted(key, own * 2 + i) for i in range(3))
    return pa.table(
        {
            "bucket": pa.array(own, pa.int64()),
            "chunk": pa.array(np.full(len(own), table.column("chunk")[0].as_py() if len(own) else 0), pa.int64()),
            "shingles": pa.array([_packed(values[a:b]) for a, b in zip(first, last, strict=True)], pa.binary()),
            "counts": pa.array([n[a:b].astype("<u8").tobytes() for a, b in zip(first, single, strict=True)], pa.binary()),
        }
    )


def _counted(table: pa.Table, documents: int) -> pa.Table:
    """idf of a bucket's shingles that several documents have, for every chunk that has them."""
    shingles_, counts = (table.column(c).combine_chunks() for c in ("shingles", "counts"))
    values = _unpacked(buffer_of(shingles_)[0].tobytes())
    ends = buffer_of(shingles_)[1] // 6
    several = np.diff(buffer_of(counts)[1]) // 8
    n = np.ones(len(values), np.int64)
    places = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
    n[np.repeat(ends[:-1], several) + places] = np.frombuffer(buffer_of(counts)[0].tobytes(), "<u8").astype(np.int64)
    order = np.argsort(values, kind="stable")
    firsts = np.flatnonzero(np.append(True, np.diff(values[order]) != 0)) if len(values) else np.zeros(0, np.int64)
    df = np.empty(len(values), np.int64)
    if len(values):
        df[order] = np.repeat(np.add.reduceat(n[order], firsts), np.diff(np.append(firsts, len(values))))
    kept = np.flatnonzero(df > 1)
    values, idf = values[kept], idf_of(df[kept], documents)
    bounds = np.searchsorted(kept, ends)
    some = np.flatnonzero(np.diff(bounds))
    return pa.table(
        {
            "chunk": table.column("chunk").combine_chunks().take(pa.array(some)),
            "shingles": pa.array([_packed(values[bounds[i] : bounds[i + 1]]) for i in some], pa.binary()),
            "idf": pa.array([idf[bounds[i] : bounds[i + 1]].astype("<f4").tobytes() for i in some], pa.binary()),
        }
    )


def _frequencies(table: pa.Table) -> Frequencies:
    """From what the buckets have answered."""
    values, idf = (buffer_of(table.column(c).combine_chunks())[0].tobytes() for c in ("shingles", "idf"))
    return Frequencies(_unpacked(values), np.frombuffer(idf, "<f4"))


def _in_chunks(texts: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, doc_id, digest, text) and the buckets' answers (chunk, shingles, idf)."""
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = max(1, math.ceil(max(min(32 * size / chunk, CHUNKS), size / chunk)))
    digest = _digest(F.col("text"))
    dealt = texts.select(F.pmod(F.xxhash64("doc_id", digest), F.lit(chunks)).alias("chunk"), "doc_id", digest.alias("digest"), "text")
    sent = dealt.groupBy("chunk").applyInArrow(lambda t: _dealt(t, chunks), "bucket long, chunk long, shingles binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(lambda t: _counted(t, n), "chunk long, shingles binary, idf binary")
    return dealt, answers


def inverse_frequencies(texts: DataFrame, chunk: int = CHUNK) -> Frequencies:
    """idf of the shingles of a table small enough to gather them, as ``near_text_classes`` weighs them."""
    named = texts.select(F.monotonically_increasing_id().alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = _frequencies(_in_chunks(named, chunk)[1].toArrow())
    first = np.unique(found.values, return_index=True)[1]
    return Frequencies(found.values[first], found.idf[first])


# -- samples ----------------------------------------------------------------------------------


def samples(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES consistent weighted samples, as 32-bit hashes, of each of n texts; 0 without shingles.

    For shingle s and sample j, r and c are Gamma(2, 1) and b is uniform, all hashed from (s, j);
    t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the shingle of the smallest a, with its
    t, is the sample.
    """
    out = np.zeros((n, SAMPLES), np.uint32)
    firsts = np.flatnonzero(np.append(True, np.diff(rows) != 0)) if len(rows) else np.zeros(0, np.int64)
    bounds = np.append(firsts, len(rows))
    start = 0
    while start < len(firsts):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + _ELEMENTS, side="right")) - 1)
        a, b = bounds[start], bounds[stop]
        s, log_w = values[a:b], np.log(weights[a:b].astype(np.float32))
        begin = bounds[start:stop] - a
        counts = np.diff(np.append(begin, b - a))
        own = rows[bounds[start:stop]]
        for j in range(SAMPLES):
            x = mix(s + _U(((j + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            y = mix(x + _U(0xD1B54A32D192ED03))
            u = ((x >> _U(32)).astype(np.float32) + np.float32(0.5)) * ((x & _U(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5))
            v = ((y >> _U(43)).astype(np.float32) + np.float32(0.5)) * (((y >> _U(22)) & _U(0x1FFFFF)).astype(np.float32) + np.float32(0.5))
            r = np.maximum(np.float32(64 * np.log(2)) - np.log(u), np.float32(1e-6))
            log_c = np.log(np.maximum(np.float32(42 * np.log(2)) - np.log(v), np.float32(1e-6)))
            beta = (y & _U(0x3FFFFF)).astype(np.float32) * np.float32(2.0**-22)
            t = np.floor(log_w / r + beta)
            log_a = log_c - r * (t - beta + 1)
            least = np.minimum.reduceat(log_a, begin)
            at = np.flatnonzero(log_a == np.repeat(least, counts))
            at = at[np.searchsorted(at, begin)]  # the first of each text
            chosen = mix(s[at] ^ mix(t[at].astype(np.int64).astype(_U) + _U(j)))
            out[own, j] = (chosen >> _U(32)).astype(np.uint32)
        start = stop
    return out


def _digest(text: Column) -> Column:
    return F.md5(text)


def _signed(table: pa.Table, answers: pa.Table) -> pa.Table:
    """(doc_id, digest, samples, idf) of a chunk's texts; samples are null without words, idf is what the text carries."""
    known = _frequencies(answers)
    signs, carried = [], []
    for _, texts in pieces(table.column("text").combine_chunks()):
        rows, values, tf = weighted(texts)
        idf = known[values]
        found = samples(rows, values, tf * idf, len(texts))
        some = np.zeros(len(texts), bool)
        some[rows] = True
        signs += [x.astype("<u4").tobytes() if ok else None for x, ok in zip(found, some, strict=True)]
        named = np.flatnonzero(idf < 1)
        entries = np.empty(len(named), _CARRIED)
        entries["at"], entries["idf"] = named - np.searchsorted(rows, rows[named]), idf[named]
        bounds = np.searchsorted(rows[named], np.arange(len(texts) + 1))
        carried += [entries[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"doc_id": table.column("doc_id"), "digest": table.column("digest"), "samples": pa.array(signs, pa.binary()), "idf": pa.array(carried, pa.binary())})


# -- verification -----------------------------------------------------------------------------


def similarities(left: pa.Array, right: pa.Array, idf_left, idf_right) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts, with what each carries."""
    n = len(left)
    rows, values, weights, totals = [], [], [], np.zeros(n)
    for texts, idf in ((left, idf_left), (right, idf_right)):
        r, s, tf = weighted(texts)
        w = tf.astype(np.float64) * weights_of(idf, r, s)
        totals += np.bincount(r, w, n)
        rows.append(r), values.append(s), weights.append(w)
    r, s, w = np.concatenate(rows), np.concatenate(values), np.concatenate(weights)
    order = np.lexsort((s, r))
    r, s, w = r[order], s[order], w[order]
    both = np.flatnonzero((np.diff(r) == 0) & (np.diff(s) == 0)) if len(r) else np.zeros(0, np.int64)
    shared = np.bincount(r[both], np.minimum(w[both], w[both + 1]), n) if len(both) else np.zeros(n)
    return np.where(totals > shared, shared / np.maximum(totals - shared, 1e-300), 0.0)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, linked) of each pair; ``texts`` has (rep, text, idf) of the texts that occur in pairs."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, left in pieces(batch.column(2)):
                part = batch.slice(first, len(left))
                for i, right in pieces(part.column(3)):
                    own = part.slice(i, len(right))
                    linked = similarities(own.column(2), right, own.column(4), own.column(5)) >= threshold
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(linked)], ["a", "b", "linked"])

    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"), F.col("idf").alias("idf_a"))
    other = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"), F.col("idf").alias("idf_b"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b", "idf_a", "idf_b")
    return stage(both.mapInArrow(judge, "a long, b long, linked boolean"))


# -- candidates -------------------------------------------------------------------------------


def _propose_all(table: pa.Table) -> pa.Table:
    """Spanning forests (a < b) of the candidates between different groups, of all blocks and pairs of blocks of a parcel."""
    band, low, high, block, rep, group = (table.column(c).to_numpy() for c in ("band", "low", "high", "block", "rep", "component"))
    order = np.lexsort((rep, block, high, low, band))
    band, low, high, block, rep, group = (c[order] for c in (band, low, high, block, rep, group))
    signs = np.frombuffer(buffer_of(table.column("samples").combine_chunks())[0].tobytes(), "<u4").reshape(-1, SAMPLES)[order]
    new = np.append(True, (np.diff(band) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) if len(band) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(band)))
    # most blocks have two members
    two = starts[sizes == 2]
    apart = (group[two] != group[two + 1]) & ((low[two] == high[two]) | (block[two] != block[two + 1]))
    two = two[apart & ((signs[two] == signs[two + 1]).sum(axis=1) >= AGREE)] if len(two) else two
    ends = [(two, two + 1)]
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        own = slice(start, start + size)
        if (group[own] != group[start]).any():
            a, b = _forest(signs[own], group[own], block[own], low[start] != high[start])
            ends.append((a + start, b + start))
    a, b = (np.concatenate(side).astype(np.int64) for side in zip(*ends, strict=True))
    return pa.table({"a": np.minimum(rep[a], rep[b]), "b": np.maximum(rep[a], rep[b])})


def _forest(signs: np.ndarray, group: np.ndarray, block: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as places, of the candidates between different groups; ``across`` between the two blocks only."""
    n = len(group)
    agree = np.zeros((n, n), np.uint8)
    for j in range(SAMPLES):
        agree += signs[:, j][:, None] == signs[:, j][None, :]
    if across:
        agree[block[:, None] == block[None, :]] = 0
    agree[agree < AGREE] = 0
    found_a, found_b = [], []
    label = np.unique(group, return_inverse=True)[1]
    while True:
        # every group takes its best candidate outside itself; groups that take each other merge
        reach = np.where(label[:, None] != label[None, :], agree, 0)
        best = reach.argmax(axis=1)
        value = reach[np.arange(n), best]
        if not value.any():
            break
        order = np.lexsort((np.arange(n), -value.astype(int), label))
        firsts = order[np.flatnonzero(np.append(True, np.diff(label[order]) != 0))]
        firsts = firsts[value[firsts] > 0]
        found_a.append(firsts), found_b.append(best[firsts])
        links = label[:, None] == label[None, :]
        links[firsts, best[firsts]] = links[best[firsts], firsts] = True
        label = joined(links)
    a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
    return a, b


def _proposals(members: DataFrame, signs: DataFrame, block: int, across: bool) -> DataFrame:
    """Distinct candidate pairs from members (band, rep, component): within blocks, or ``across`` them too."""
    dealt = block_pairs(members, "band", "rep", block)
    if not across:
        dealt = dealt.filter(F.col("low") == F.col("high"))
    # blocks are small as a rule: a task takes many of them at a time, a large band's blocks apart
    parcels = max(1, math.ceil(members.count() / PARCEL))
    parcel = F.pmod(F.xxhash64("band", "low", "high"), F.lit(parcels))
    met = dealt.join(signs.select("rep", "samples"), "rep").select(parcel.alias("parcel"), "band", "low", "high", "block", "rep", "component", "samples")
    return met.groupBy("parcel").applyInArrow(_propose_all, "a long, b long").distinct()


def all_similarities(texts: pa.Array, idf) -> np.ndarray:
    """Weighted Jaccard similarity of every text with every other; ``idf`` as in ``weights_of``.

    A shingle that occurs tf times is tf features of weight idf, so a sum of minima is a product of 0/1 matrices.
    Features of one text alone add to its total only.
    """
    n = len(texts)
    parts = [(first, *weighted(part)) for first, part in pieces(texts)]
    rows = np.concatenate([first + r for first, r, _, _ in parts])
    values, tf = np.concatenate([v for _, _, v, _ in parts]), np.concatenate([t for _, _, _, t in parts])
    weights = weights_of(idf, rows, values).astype(np.float64)
    totals = np.bincount(rows, tf * weights, n)
    times = tf.astype(np.int64)
    rows, weights = np.repeat(rows, times), np.repeat(weights, times)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    keys = mix(np.repeat(values, times) + mix(nth.astype(_U)))
    order = np.argsort(keys, kind="stable")
    keys, rows, weights = keys[order], rows[order], weights[order]
    new = np.append(True, np.diff(keys) != 0) if len(keys) else np.zeros(0, bool)
    feature = np.cumsum(new) - 1
    several = np.bincount(feature)[feature] > 1 if len(feature) else new
    rows, weights = rows[several], weights[several]
    feature = np.unique(feature[several], return_inverse=True)[1]
    shared = np.zeros((n, n))
    for first in range(0, int(feature.max(initial=-1)) + 1, _COLUMNS):
        a, b = np.searchsorted(feature, [first, first + _COLUMNS])
        held = np.zeros((n, _COLUMNS))
        scaled = np.zeros((n, _COLUMNS))
        held[rows[a:b], feature[a:b] - first] = 1
        scaled[rows[a:b], feature[a:b] - first] = weights[a:b]
        shared += scaled @ held.T
    return shared / np.maximum(totals[:, None] + totals[None, :] - shared, 1e-300)


def _link(table: pa.Table, threshold: float) -> pa.Table:
    """(a, b) that unite the groups linked within a block or pair of blocks."""
    rep, group = table.column("rep").to_numpy(), table.column("component").to_numpy()
    order = np.argsort(rep)
    texts, idf = (table.column(c).combine_chunks().take(pa.array(order)) for c in ("text", "idf"))
    rep, group = rep[order], group[order]
    linked = (all_similarities(texts, idf) >= threshold) & (group[:, None] != group[None, :])
    some = np.flatnonzero(linked.any(axis=1))
    root = some[joined(linked[np.ix_(some, some)])] if len(some) else some
    moved = some != root
    return pa.table({"a": rep[some[moved]], "b": rep[root[moved]]})


def near_text_classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, text_block: int = TEXT_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group), kept of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    dealt, answers = _in_chunks(texts, chunk)
    signed = stage(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_signed, "doc_id long, digest string, samples binary, idf binary"))
    known = signed.filter(F.col("doc_id").isNotNull())
    reps = stage(known.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("samples").alias("samples")))
    # a doc_id that stands for several texts is compared by each of them under a name of its own
    with_words = reps.filter(F.col("samples").isNotNull()).select(F.xxhash64("digest", "rep").alias("rep"), F.col("rep").alias("doc_id"), "samples", "digest")
    width = 4 * BAND
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("samples", i * width + 1, width)) for i in range(SAMPLES // BAND)])
    banded = with_words.select("rep", F.explode(bands).alias("band"))
    several = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    members = stage(banded.join(several, "band").distinct())
    signs = stage(with_words.join(members.select("rep").distinct(), "rep", "left_semi"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """rep, text and idf of the texts named: documents are read once more, and only these go on."""
        named = small(stage(signs.join(wanted, "rep", "left_semi").select("rep", "doc_id")), 1_000_000)
        found = texts.join(named, "doc_id")
        found = found.filter(F.xxhash64(_digest(F.col("text")), "doc_id") == F.col("rep")).select("rep", "text").dropDuplicates(["rep"])
        carried = known.select("doc_id", "digest", "idf").join(named, "doc_id").filter(F.xxhash64("digest", "doc_id") == F.col("rep"))
        return stage(found.join(carried.select("rep", "idf").dropDuplicates(["rep"]), "rep"))

    def judged(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs)
        ids = stage(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct())
        return verified(pairs, texts_of(ids), threshold).filter("linked").select("a", "b")

    def labelled(links: DataFrame) -> DataFrame:
        """Members of the bands in which several groups are left."""
        found = members.join(components(links), F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
        apart = found.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("band")
        return stage(found.join(apart, "band"))

    links = judged(_proposals(members.withColumn("component", F.col("rep")), signs, block, across=False))
    ones = labelled(links).groupBy("band", "component").agg(F.min("rep").alias("rep")).select("band", "rep", "component")
    links = stage(links.union(judged(_proposals(ones, signs, block, across=False))))
    # what candidates connect and links do not
    rest = labelled(links)
    open_ = stage(_proposals(rest, signs, block, across=True))
    cluster = components(open_.union(links)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    rest = rest.select("rep", "component").distinct().join(cluster, "rep")
    apart = rest.groupBy("cluster").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("cluster")
    rest = stage(rest.join(apart, "cluster"))
    met = block_pairs(rest, "cluster", "rep", text_block).join(texts_of(rest.select("rep").distinct()), "rep")
    more = met.groupBy("cluster", "low", "high").applyInArrow(lambda t: _link(t, threshold), "a long, b long")
    links = stage(links.union(more))
    # from names of texts to documents; equal texts, and texts of one doc_id
    name = signs.select(F.col("rep").alias("_name"), "doc_id")
    linked = (
        links.join(name, F.col("a") == F.col("_name")).select("b", F.col("doc_id").alias("x"))
        .join(name, F.col("b") == F.col("_name")).select(F.col("x").alias("a"), F.col("doc_id").alias("b"))
    )
    same = known.join(reps.select("digest", "rep"), "digest").filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    united = components(linked.union(same))
    classes = signed.select("doc_id").join(united, F.col("doc_id") == F.col("node"), "left")
    class_id = F.coalesce("component", "doc_id")
    return classes.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text_classes(read(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, and all without doc_id; columns unchanged.

    Of rows with one doc_id, which are one document, the one with the smallest text stays.
    """
    classes = stage(near_text_classes(docs))
    gone = classes.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    left = packed.join(small(stage(gone), 2_000_000), F.col("doc.doc_id") == F.col("_gone"), "left_anti")
    repeated = stage(classes.filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again")).count().filter("count > 1").select("_again"))
    if repeated.limit(1).count() == 0:
        return left.select("doc.*")
    again = small(repeated, 2_000_000)
    once = left.join(again, F.col("doc.doc_id") == F.col("_again"), "left_semi").groupBy("doc.doc_id").agg(F.min_by("doc", "doc.text").alias("_first"), F.first("doc").alias("_any"))
    single = left.join(again, F.col("doc.doc_id") == F.col("_again"), "left_anti")
    return single.select("doc.*").union(once.select(F.coalesce("_first", "_any").alias("doc")).select("doc.*"))
