"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk of every
token, level k the k-th chunk of those that have one. A bit per chunk tells whether the token goes
on at the next level, and a directory holds the number of such bits before every block of 512. Token
i is then its chunk at i, and while its bit is set, the chunk at the bit's rank on the next level:
no other token is decoded.

A file is one segment: the ids of consecutive documents, in ascending doc_id order. Spark writes
them through its own committer and reads them as binary files, so any file system it knows will do
and a repeated task leaves no trace.

Segment, little-endian: ``DACTOK01``, documents, tokens, levels (int64 each); doc_ids (int64); a byte
each: id missing?; ends of documents in tokens (int64); per level chunks, then its chunk bytes, bitmap
(least bit first) and directory (uint32). Spark adds a line end to the file.

Edge cases: null or empty text is the end id alone; null doc_ids come first; equal doc_ids are ordered by
a hash of their text; an empty table writes no file; other columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segprofile.functions.staging import stage, staging_root
from segprofile.llm.tables import read

END_ID = 1
TOKENS_PER_FILE = 4_000_000
_MAGIC = b"DACTOK01"
_BLOCK = 512

# -- encoding ---------------------------------------------------------------------------------

#: Characters up to U+024F but for control characters and one letter whose lower case is longer. Texts of these are cut
#: into lower-cased pieces as the tokenizer's own pattern cuts them; all others go through the library's whole path.
_PLAIN = re.compile("[\t-\r -~\xa0-įı-ɏ]*")
_LETTERS = "a-zªµºß-öø-ɏ"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9²³¹¼-¾]|[^\\s{_LETTERS}0-9²³¹¼-¾]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for Python only


@cache
def _byte_names() -> dict[int, str]:
    """Byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Remembers a function's results for a bounded number of strings."""

    def __init__(self, find, most: int):
        self.find, self.most = find, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[key] = found = self.find(key)
        return found


class Encoder:
    """Ids of a text as bytes of 32-bit numbers; every piece is encoded once and remembered."""

    def __init__(self, path: str, remembered: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.names = _byte_names()
        self.pieces = _Known(self._piece, remembered)
        self.chunks = _Known(self._chunk, remembered // 4)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.names.__getitem__, piece.encode()))
        return np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        return self._plain(chunk) if _PLAIN.fullmatch(chunk) and "<|" not in chunk else self._library(chunk)

    def encode(self, text: str) -> bytes:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return self._plain(text)
        if _ODD_SPACE.search(text):
            return self._library(text)
        # no piece reaches over white space
        return b"".join(map(self.chunks.__getitem__, text.split()))


@cache
def encoder(path: str) -> Encoder:
    """One per worker process, kept over tasks."""
    return Encoder(path)


# -- the file format --------------------------------------------------------------------------


def pack(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> bytes:
    """A segment of documents whose tokens end at ``ends``."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = rest > 255
        ahead = np.concatenate([[0], np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(rest), _BLOCK)))]) if len(rest) else np.zeros(1)
        levels.append((rest & 255).astype(np.uint8).tobytes() + np.packbits(goes_on, bitorder="little").tobytes() + ahead.astype("<u4").tobytes())
        levels[-1] = np.int64(len(rest)).tobytes() + levels[-1]
        rest = rest[goes_on] >> 8
        if not len(rest):
            break
    head = np.array([len(doc_ids), len(ids), len(levels)], "<i8").tobytes()
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    missing = bytes(d is None for d in doc_ids)
    return _MAGIC + head + known + missing + np.array(ends, "<i8").tobytes() + b"".join(levels)


class Segment:
    """A segment in memory (or mapped); ``segment[i]`` is token i, ``segment.slice(a, b)`` a run."""

    def __init__(self, data):
        if bytes(data[:8]) != _MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_levels = (int(x) for x in np.frombuffer(data, "<i8", 3, 8))
        at = 32
        ids = np.frombuffer(data, "<i8", n_docs, at)
        missing = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if m else int(d) for d, m in zip(ids, missing, strict=True)]
        at += 9 * n_docs
        self.ends = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(data, "<i8", 1, at)[0])
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at + n)
            blocks = (n + _BLOCK - 1) // _BLOCK + 1
            ahead = np.frombuffer(data, "<u4", blocks, at + n + len(bits))
            self.levels.append((chunks, bits, ahead))
            at += n + len(bits) + 4 * blocks

    def _rank(self, level: int, i: int) -> int:
        """Set bits before i: the directory's number and those of part of one block."""
        _, bits, ahead = self.levels[level]
        block = i // _BLOCK
        part = np.unpackbits(bits[block * _BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * _BLOCK]
        return int(ahead[block]) + int(part.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b - 1: one rank per level, then runs of each level."""
        out = np.zeros(b - a, np.uint32)
        places = np.arange(b - a)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            goes_on = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
            if not goes_on.any():
                break
            places = places[goes_on]
            a = self._rank(level, a)
            b = a + len(places)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


# -- writing and reading ----------------------------------------------------------------------


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, per_file: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    end = np.array([end_id], "<u4").tobytes()
    docs, ends, parts, total = [], [], [], 0

    def segment() -> pa.RecordBatch:
        body = pack(docs, ends, np.frombuffer(b"".join(parts), "<u4"))
        return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts += [encode(text.as_py() or ""), end]
            total += (len(parts[-2]) >> 2) + 1
            docs.append(doc_id)
            ends.append(total)
            if total >= per_file:
                yield segment()
                docs, ends, parts, total = [], [], [], 0
    if docs:
        yield segment()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, per_file: int = TOKENS_PER_FILE) -> None:
    """Encode every text and write segments of about ``per_file`` tokens, ascending by doc_id over all files."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    bodies = (
        texts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(lambda it: _segments(it, tokenizer, end_id, per_file), "body binary")
    )
    # a text file's line is its bytes as they are; one line per file
    bodies.select(F.col("body").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            s = Segment(content.as_buffer())
            n = len(s.doc_ids)
            starts = np.concatenate([[0], s.ends[:-1]]) if n else s.ends
            sums = [zlib.crc32(s.document(k).astype("<u4").tobytes()) for k in range(n)]
            columns = [[part] * n, [file] * n, s.doc_ids, starts, s.ends - starts, sums]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "file", "doc_id", "at", "n_tokens", "ids_crc32"])


def place_of(path: Column) -> tuple[Column, Column]:
    """Writing task, and file of that task, from a name part-<task>-<uuid>-c<file>.<endings>.

    The counter is what ends the name: a group of the uuid may begin with c and a digit too.
    """
    return F.regexp_extract(path, r"part-(\d+)-[^/]*$", 1).cast("long"), F.regexp_extract(path, r"-c(\d+)(?:\.[^/]*)?$", 1).cast("long")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32 of every document in the files.

    Files begin where those before them end: files are added up inside a writing task, tasks over all.
    """
    part, file = place_of(F.col("path"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    found = stage(
        files.select(
            part.alias("part"),
            file.alias("file"),
            "content",
        ).mapInArrow(_documents, "part long, file long, doc_id long, at long, n_tokens long, ids_crc32 long")
    )
    per_file = found.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    per_part = per_file.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    parts = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(*earlier)
    begin = per_file.select("part", "file", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("of_file")).join(parts, "part")
    return found.join(begin, ["part", "file"]).select("doc_id", (F.col("of_part") + F.col("of_file") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{staging_root(spark).rstrip('/')}/segprofile-tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, folder)
