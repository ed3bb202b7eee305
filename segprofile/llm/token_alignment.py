"""Aligning two tokenizers over a corpus: which token ids end together, how often, and with whom most often.

Both tokenizers cut the same bytes. Byte offsets where tokens of both end part a text into groups; the two tokens
that end at such an offset are linked. How many links hold a pair of ids is counted over the whole corpus, by
external spill counting:

1. Texts are encoded in tasks. The links of about ``RUN_LINKS`` become records (pair, document, times), which
   are dealt by the id of the second side into ``RADIX`` parts and sorted, second side first; each part is a run of
   zstd frames in a staged table.
2. Runs of a part, in parcels of bounded size however many there are, are merged by a heap over their frames. One
   frame of each run is in memory. A merge counts each pair; parcels' counts are added up by Spark, and as all
   pairs of a second id are in one part, its maximum follows.
3. The same runs are merged again beside the counts of their part, and what each record contributes goes
   back to its document: dense sums per run and part, added up where the documents of the run are.

Of two tokens that end together the shorter is an ending of the longer. So there are at most as many pairs as the
tokens of both vocabularies have bytes, about half a million, and the counts that travel with a part are bounded by the
vocabularies, whatever the corpus. Hot tokens make no hot task: a parcel holds at most ``PARCEL`` bytes of runs.

Edge cases: texts that are null or empty, or that a tokenizer does not give back byte for byte behind a space, have no tokens:
zeros and an empty digest; doc_ids may be null or repeated, every row is a document of its own; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from segprofile.functions.staging import stage
from segprofile.llm.piece_encoding import model
from segprofile.llm.tables import read
from segprofile.llm.text import pieces

RADIX = 16
RUN_LINKS = 2_000_000
FRAME = 1 << 14  # records
PARCEL = 24 << 20  # bytes of frames
_TEXTS = 1 << 19  # bytes encoded at a time
_U = np.uint64
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}  # what PATTERN cuts alike


# -- tokens -----------------------------------------------------------------------------------


def byte_ranks(path: str) -> dict[bytes, int]:
    """Bytes and id of the tokens of a byte-level BPE file whose ids ascend as its merges do, so that ids rank the merges."""
    with open(path, encoding="utf-8") as file:
        read_ = json.load(file)
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    value = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in read_["added_tokens"]}
    vocabulary = {t: i for t, i in read_["model"]["vocab"].items() if t not in special}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in read_["model"]["merges"]]
    order = [vocabulary[m] for m in merges]
    if order != sorted(order) or len(set(order)) != len(vocabulary) - 256 or read_["pre_tokenizer"] != _PRE_TOKENIZER or read_["normalizer"]:
        raise ValueError("not a byte-level BPE whose ids rank its merges")
    return {bytes(value[c] for c in token): i for token, i in vocabulary.items()}


class Sides:
    """Both tokenizers, the bytes of their tokens and the names of their ids."""

    def __init__(self, first: str, second: str):
        self.second = SentencePieceProcessor(model_file=second)
        ranks = byte_ranks(first)
        own = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            own[i] = token
        # no token is special, so their strings are plain text
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = own, model(second).bytes
        self.sizes = tuple(np.array([len(b) for b in side], np.int64) for side in self.bytes)
        most = max(map(len, self.bytes))
        #: an id followed by what separates it: id * 3 + (0 in a side of a group, 1 end of first side, 2 end of group)
        self.names = [f"{i}{mark}" for i in range(most) for mark in ",|;"]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none where a side does not give back the bytes."""
        spaced = [f" {t}" if t else "" for t in texts]
        first = [self.first.encode_ordinary(t) for t in spaced]
        second = self.second.encode([t or "" for t in texts], num_threads=1)
        none = np.zeros(0, np.int64)
        out = []
        for text, ids in zip(spaced, zip(first, second, strict=True), strict=True):
            target = text.encode()
            same = target and all(b"".join(map(table.__getitem__, side)) == target for table, side in zip(self.bytes, ids, strict=True))
            out.append(tuple(np.array(side, np.int64) for side in ids) if same else (none, none))
        return out


@cache
def sides(first: str, second: str) -> Sides:
    """One per worker process, kept over tasks."""
    return Sides(first, second)


def aligned(known: Sides, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """Places in a and in b of the tokens that end together, and the groups as text."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), ""
    end_a, end_b = np.cumsum(known.sizes[0][a]), np.cumsum(known.sizes[1][b])
    at_a = np.flatnonzero(np.isin(end_a, end_b, assume_unique=True))
    at_b = np.searchsorted(end_b, end_a[at_a])
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[at_a], mark_b[at_b] = 1, 2
    # a group's first side comes behind the second sides of all groups before it
    names = np.empty(len(a) + len(b), np.int64)
    group_a, group_b = np.cumsum(mark_a) - mark_a, np.cumsum(mark_b >> 1) - (mark_b >> 1)
    names[np.arange(len(a)) + np.append(0, at_b + 1)[group_a]] = a * 3 + mark_a
    names[np.arange(len(b)) + (at_a + 1)[group_b]] = b * 3 + mark_b
    return at_a, at_b, "".join(map(known.names.__getitem__, names.tolist()))[:-1]


# -- runs -------------------------------------------------------------------------------------


def _packed(*columns: np.ndarray) -> bytes:
    """A zstd frame: number of records, then each column byte plane by byte plane; the first ascends and is kept as steps."""
    n = len(columns[0])
    first = np.diff(columns[0].astype("<u8"), prepend=_U(0))
    rest = [c.astype("<u4") for c in columns[1:]]
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(n, -1).T).tobytes() for c in (first, *rest)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64(n).tobytes(), *planes]))


def _unpacked(frame: bytes, columns: int = 2) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(frame)
    n, at, out = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for kind in ("<u8", *["<u4"] * columns):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def runs_of(pairs: np.ndarray, documents: np.ndarray) -> dict[int, list[bytes]]:
    """Frames per radix part of links (second id << 32 | first id) of documents in ascending order."""
    order = np.argsort(pairs, kind="stable")
    pairs, documents = pairs[order], documents[order]
    new = np.append(True, (np.diff(pairs) != 0) | (np.diff(documents) != 0)) if len(pairs) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    pairs, documents, times = pairs[at], documents[at], np.diff(np.append(at, len(new)))
    part = ((pairs >> _U(32)) % _U(RADIX)).astype(np.int64)
    out = {}
    for r in np.unique(part).tolist():
        own = np.flatnonzero(part == r)
        out[r] = [_packed(pairs[i], documents[i], times[i]) for i in np.array_split(own, math.ceil(len(own) / FRAME))]
    return out


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, run, document, times) of runs in ascending order of pairs, piece by piece, by a heap over the runs' frames."""
    frames = [iter(r) for r in runs]
    held: list[list[np.ndarray] | None] = [None] * len(runs)
    heads: list[tuple[int, int]] = []
    lasts: list[tuple[int, int]] = []

    def load(i: int) -> None:
        frame = next(frames[i], None)
        held[i] = None if frame is None else _unpacked(frame)
        if held[i] is not None:
            heapq.heappush(heads, (int(held[i][0][0]), i))
            heapq.heappush(lasts, (int(held[i][0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heads:
        # up to the smallest last pair of a frame, every frame in memory is complete
        bound = lasts[0][0]
        taken = []
        while heads and heads[0][0] <= bound:
            i = heapq.heappop(heads)[1]
            pairs, documents, times = held[i]
            n = int(np.searchsorted(pairs, _U(bound), side="right"))
            taken.append((pairs[:n], np.full(n, i), documents[:n], times[:n]))
            if n < len(pairs):
                held[i] = [pairs[n:], documents[n:], times[n:]]
                heapq.heappush(heads, (int(pairs[n]), i))
            else:
                held[i] = None
        while lasts and held[lasts[0][1]] is None:
            load(heapq.heappop(lasts)[1])
        pairs, run, documents, times = (np.concatenate(c) for c in zip(*taken, strict=True))
        order = np.argsort(pairs, kind="stable")
        yield pairs[order], run[order], documents[order], times[order]


_ENCODED = (
    "run long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part int, size long, frames array<binary>"
)


def _spill(batches: Iterator[pa.RecordBatch], first: str, second: str, run_links: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and behind those of a run its parts."""
    known = sides(first, second)
    run = TaskContext.get().partitionId() << 32
    schema = pa.schema(
        [("run", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]]
        + [("groups_sha256", pa.string()), ("part", pa.int32()), ("size", pa.int64()), ("frames", pa.list_(pa.binary()))]
    )
    rows, pairs, documents, links = [], [], [], 0

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal rows, pairs, documents, links, run
        parts = runs_of(np.concatenate([np.zeros(0, _U), *pairs]), np.concatenate([np.zeros(0, np.int64), *documents]))
        rows += [{"run": run, "part": r, "size": sum(map(len, frames)), "frames": frames} for r, frames in parts.items()]
        yield pa.RecordBatch.from_pylist(rows, schema)
        rows, pairs, documents, links, run = [], [], [], 0, run + 1

    place = 0
    for batch in batches:
        for at, part in pieces(batch.column(1), _TEXTS):
            texts = [t.as_py() for t in part]
            for doc_id, (a, b) in zip(batch.column(0).slice(at, len(part)).to_pylist(), known.encode(texts), strict=True):
                at_a, at_b, groups = aligned(known, a, b)
                n = len(at_a)
                digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                counts = {"n_a": len(a), "n_b": len(b), "n_groups": n, "n_links": n}
                rows.append({"run": run, "place": place, "doc_id": doc_id, **counts, "groups_sha256": digest})
                pairs.append(b[at_b].astype(_U) << _U(32) | a[at_a].astype(_U))
                documents.append(np.full(n, place))
                links += n
                place += 1
                if links >= run_links:
                    yield from closed()
                    place = 0
    if rows:
        yield from closed()


def _counted(table: pa.Table) -> pa.Table:
    """(part, pair, n) of a parcel of one part's runs."""
    pairs, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for keys, _, _, times in merged(table.column("frames").to_pylist()):
        at = np.flatnonzero(np.append(True, np.diff(keys) != 0))
        pairs.append(keys[at])
        counts.append(np.add.reduceat(times.astype(np.int64), at))
    pairs, counts = np.concatenate(pairs).astype(np.int64), np.concatenate(counts)
    part = np.full(len(pairs), table.column("part")[0].as_py() if table.num_rows else 0, np.int32)
    return pa.table({"part": part, "pair": pairs, "n": counts})


def _contributed(table: pa.Table, totals: pa.Table) -> pa.Table:
    """(run, best, total): for each run of a parcel, by place of the document, its links with best pairs and its sum of counts."""
    order = np.argsort(totals.column("pair").to_numpy())
    pairs, counts, best = (totals.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    runs, documents = table.column("run").to_pylist(), table.column("documents").to_numpy()
    first = np.cumsum(documents) - documents
    links, sums = np.zeros(int(documents.sum()), np.int64), np.zeros(int(documents.sum()), np.int64)
    for keys, run, document, times in merged(table.column("frames").to_pylist()):
        at = np.searchsorted(pairs, keys.astype(np.int64))
        where, times = first[run] + document, times.astype(np.int64)
        np.add.at(links, where, times * best[at])
        np.add.at(sums, where, times * counts[at])
    bounds = list(zip(first, first + documents, strict=True))
    return pa.table({"run": pa.array(runs, pa.int64()), **{c: pa.array([v[x:y].astype("<i8").tobytes() for x, y in bounds], pa.binary()) for c, v in (("best", links), ("total", sums))}})


def _returned(documents: pa.Table, shares: pa.Table) -> pa.Table:
    """The documents of a run with the sums over all parts."""
    place = documents.column("place").to_numpy()
    out = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, column in (("n_best", "best"), ("count_sum", "total")):
        total = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
        for share in shares.column(column).to_pylist():
            total += np.frombuffer(share, "<i8")
        out = out.append_column(name, pa.array(total[place]))
    return out.append_column("groups_sha256", documents.column("groups_sha256"))


class Alignment:
    """The staged runs of a corpus and what is derived from them."""

    def __init__(self, docs: DataFrame, first: str, second: str, run_links: int = RUN_LINKS, parcel: int = PARCEL):
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        encoded = stage(texts.mapInArrow(lambda it: _spill(it, first, second, run_links), _ENCODED))
        self.documents = encoded.filter("place IS NOT NULL").select("run", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        self._runs = encoded.filter("part IS NOT NULL").select("run", "part", "size", "frames")
        largest = self._runs.groupBy("part").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
        self._parcels = max(1, math.ceil(largest / parcel))

    def _dealt(self) -> DataFrame:
        return self._runs.withColumn("parcel", F.pmod(F.xxhash64("run"), F.lit(self._parcels)))

    def pair_counts(self) -> DataFrame:
        """(part, pair, a, b, n, best): links of each pair of ids, and whether no pair of b has more."""
        counted = self._dealt().groupBy("part", "parcel").applyInArrow(_counted, "part int, pair long, n long")
        totals = counted.groupBy("part", "pair").agg(F.sum("n").alias("n"))
        b = F.shiftright("pair", 32)
        ids = totals.select("part", "pair", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("a"), b.alias("b"), "n")
        return ids.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy("b"))).cast("int"))

    def scored(self) -> DataFrame:
        """Every document with n_best and count_sum."""
        totals = stage(self.pair_counts())
        sizes = self.documents.groupBy("run").agg(F.count("*").alias("documents"))
        runs = self._dealt().join(sizes, "run")
        parcels = self._dealt().select("part", "parcel").distinct()
        copies = totals.select("part", "pair", "n", "best").join(parcels, "part")
        shares = runs.groupBy("part", "parcel").cogroup(copies.groupBy("part", "parcel")).applyInArrow(_contributed, "run long, best binary, total binary")
        schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return self.documents.groupBy("run").cogroup(shares.groupBy("run")).applyInArrow(_returned, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return Alignment(read(spark, sf_dir, "documents"), *paths).scored()
