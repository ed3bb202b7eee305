"""Words, word hashes and shingles of whole texts, computed over Arrow buffers.

``words_of`` is the plain definition. ``Tokens`` gets the same words of a whole batch at
once: one classification of all bytes, one polynomial hash per word from prefix sums.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and everything beyond ASCII; A-Z count as their lower-case letters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_LOWERED = np.arange(256, dtype=np.uint64)
_LOWERED[65:91] += 32
_LOWERED += 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SLICE = 1 << 20  # bytes hashed at a time


def words_of(text: bytes) -> list[bytes]:
    """The words of one text; ``bytes.lower`` changes A-Z only."""
    return WORD.findall(text.lower())


def words_column(text: Column) -> Column:
    """The same words as a Spark array; null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_SLICE, _BASE), _powers(_SLICE, _BASE_INVERSE)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the n + 1 places where its rows begin; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, most: int = 1 << 20):
    """Slices of an array with about ``most`` bytes each, one row at least; every row in one slice."""
    sizes = np.diff(buffer_of(texts)[1])
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, texts.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < len(texts):
        yield start, texts.slice(start)


class Tokens:
    """Words of a batch of texts: ``hashes`` and ``row`` of each word in order, ``counts`` per row."""

    def __init__(self, texts: pa.Array):
        data, starts = buffer_of(texts)
        inside = np.zeros(len(data) + 1, bool)
        inside[1:] = _IN_WORD[data]
        begins = inside[1:] & ~inside[:-1]
        if len(data):  # a text's first byte begins a word of its own
            firsts = starts[:-1][starts[:-1] < starts[1:]]
            begins[firsts] = inside[1:][firsts]
        begin = np.flatnonzero(begins)
        stops = np.flatnonzero(inside[1:] & ~np.append(inside[2:], False)) + 1
        # a word that reaches the end of its text ends there
        row = np.searchsorted(starts, begin, side="right") - 1
        end = starts[row + 1].copy() if len(begin) else np.zeros(0, np.int64)
        if len(begin):
            next_stop = stops[np.searchsorted(stops, begin, side="right")]
            end = np.minimum(end, next_stop)
        self.row, self.counts = row, np.bincount(row, minlength=len(texts))
        self.hashes = _word_hashes(data, begin, end)


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        at = begin[first]
        last = max(first + 1, int(np.searchsorted(end, at + _SLICE, side="right")))
        size = int(end[last - 1] - at)
        up, down = (_UP, _DOWN) if size <= _SLICE else (_powers(size, _BASE), _powers(size, _BASE_INVERSE))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_LOWERED[data[at : at + size]] * up[:size], out=sums[1:])
        b, e = begin[first:last] - at, end[first:last] - at
        out[first:last] = mix((sums[e] - sums[b]) * down[b])
        first = last
    return out


def shingles(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``width`` words; a text with fewer, but not none, has one of all its words."""
    h, row, counts = tokens.hashes, tokens.row, tokens.counts
    first = np.cumsum(counts) - counts
    many = max(0, len(h) - width + 1)
    total = np.zeros(many, np.uint64)
    for i in range(width):
        total = mix(total * _BASE + h[i : i + many] + np.uint64(i + 1))
    whole = row[:many] == row[width - 1 : width - 1 + many] if many else np.zeros(0, bool)
    rows, values = row[:many][whole], total[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, r in enumerate(short):
            x = np.zeros(1, np.uint64)
            for i, v in enumerate(h[first[r] : first[r] + counts[r]]):
                x = mix(x * _BASE + v + np.uint64(i + 1))
            extra[k] = x[0]
        rows, values = np.concatenate([rows, short]), np.concatenate([values, extra])
    return rows, values
