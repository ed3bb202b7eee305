"""Scoring texts by a hidden Markov model of their words.

Tokens are the lower-cased words and one end per text. A state j emits a word w of the training texts with
probability m_jw / M_j, where

    m_jw = (c_w + 0.1) * (n_jw + PRIOR * q_j) / (n_w + PRIOR),

c_w is the word's count, n_jw how often it was emitted by j as expected by the last round, n_w the sum of that over
states, q_j the share of all tokens that j emits, and M_j the sum over words. Words of fewer than ``LEAST`` occurrences
tell little of states one by one: those of one of ``GROUPS`` groups, by their ending, share the n of the group. The
unseen words of a group together are one word with c = 0. So the vocabulary is that of the training texts, however
large; every state's probabilities add up to one; and a word that tells nothing of the state is as likely as its
smoothed frequency.

Texts lie in blocks of some ``BLOCK`` tokens, each with a dictionary of its own words, which is split into buckets by
hash. What the corpus says of words (counts, expected emissions) is added up per bucket, over the blocks, and goes back
to the blocks that hold the words: rows are a block's words of one bucket, packed. Buckets are as many as the bytes of
text ask for (``BUCKET``), so no task and no broadcast holds the vocabulary.

Baum-Welch: per block, expected starts, moves and emissions are added up and leave as one row per bucket; sums over
blocks give the next model. Every round reads every training text. The first model leans, state by state, to the words
that keep company with one of ``STATES`` anchors: of the ``TOP`` most frequent words those that share the fewest runs,
counted over all training texts. Training cuts texts into runs of ``RUN`` tokens that share the token at the cut, so
every move and every emission counts once. Scoring runs the forward recursion over the whole text, many texts side by
side. Both scale their states every ``STEPS`` tokens, or as often as the smallest probabilities ask for.

Edge cases: null or empty text is the end alone; an empty training set leaves every word unseen; repeated
rows are scored alike and count as often as they occur; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.functions.staging import discard, stage
from segprofile.llm.tables import read
from segprofile.llm.text import buffer_of, pieces, remainder

STATES, FIRST_ROUNDS, ROUNDS, RUN = 8, 2, 2, 1024
TOP = 256  # words whose company gives the first model
LEAST = 5  # occurrences from which on a word has states of its own
GROUPS, ENDING = 1024, 3
PRIOR = 2.0  # occurrences' worth of the states' shares in every word
ADD = 0.1  # added to every word's count
BLOCK, BUCKET = 1 << 21, 1 << 24  # tokens of a block, bytes of text for each bucket
PIECES = 64  # sums over all blocks are added up in so many tasks
STEPS = 16  # tokens after which the recursions scale their states at the latest
_UNIT = 65_535  # a word's expected emissions are their sum and 16 bits for the part of each state
_SHIFT = 32  # a word's id: bucket, then place in it
END = b""  # no word is empty
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Rows of texts (bucket is null) and of a block's words of one bucket.
ENCODED = "block long, bucket int, doc_id long, held_out boolean, symbols binary, words binary, sizes binary, n binary"
#: Rows of a block's words of one bucket, of a bucket's words (block is null), and of parts of sums (piece is not null).
COUNTED = "block long, bucket int, words binary, sizes binary, ids binary, c binary, g binary, piece int, sums binary"
LOOKED_UP = "block long, bucket int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, symbols binary, ids binary, c binary, piece int, sums binary"
#: Rows of a block's words of one bucket with the n and parts of their expected emissions, and of parts of sums.
EXPECTED = "block long, bucket int, ids binary, c binary, n binary, parts binary, piece int, sums binary"


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered, and the end."""
    return [*(text or b"").lower().split(), END]


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some texts at once: their bytes in a row, their sizes, and how many each text has."""
    data, starts = buffer_of(texts)
    data = np.frombuffer(data.tobytes().lower(), np.uint8)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = starts[:-1][starts[:-1] < starts[1:]]  # a text's first byte begins a word of its own
    begins[firsts] = inside[firsts]
    upto = np.searchsorted(np.flatnonzero(begins), starts)
    data = data[inside]
    sizes = np.diff(np.flatnonzero(begins[inside]), append=len(data))
    return data, np.insert(sizes, upto[1:], 0), np.diff(upto) + 1


def _listed(data: np.ndarray | bytes, sizes: np.ndarray) -> pa.Array:
    """Words from their bytes and their sizes."""
    ends = np.cumsum(np.concatenate([[0], sizes]), dtype=np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _group(word):
    """A word's group by its last bytes, as a column."""
    ending = F.when(F.octet_length(word) > ENDING, F.substring(word, -ENDING, ENDING)).otherwise(word)
    return F.pmod(F.crc32(ending), F.lit(GROUPS)).cast("long")


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)).cast(f.type) for f in schema], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32()}
    return pa.schema([(n, types[t]) for n, t in (column.split() for column in ddl.split(", "))])


def _squeezed(sequences: list[np.ndarray], kind: str = "<u4") -> pa.Array:
    """Each sequence's lowest bytes, then the next ones, and so on, compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    kind = np.dtype(kind)
    return pa.array([pack(np.ascontiguousarray(x, kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()) for x in sequences], pa.binary())


def _sequences(column: pa.ChunkedArray, kind: str = "<u4") -> list[np.ndarray]:
    unpack, kind = zstandard.ZstdDecompressor().decompress, np.dtype(kind)
    return [np.ascontiguousarray(np.frombuffer(unpack(x.as_buffer()), np.uint8).reshape(kind.itemsize, -1).T).view(kind)[:, 0] for x in column]


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *_sequences(column, kind)])


def _zipped(words: pa.Array, cuts: list[int]) -> dict[str, pa.Array]:
    """Columns of the words between two cuts each: their bytes and their sizes."""
    pack = zstandard.ZstdCompressor(level=1).compress
    data, ends = buffer_of(words)
    parts = list(itertools.pairwise(cuts))
    sizes = np.diff(ends)
    return {"words": pa.array([pack(data[ends[a] : ends[b]].tobytes()) for a, b in parts], pa.binary()), "sizes": _squeezed([sizes[a:b] for a, b in parts])}


def _words(words: pa.ChunkedArray, sizes: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words of some rows, and how many each row has."""
    unpack = zstandard.ZstdDecompressor().decompress
    own = _sequences(sizes)
    data = b"".join([unpack(x.as_buffer()) for x in words])
    return _listed(data, np.concatenate([np.zeros(0, "<u4"), *own])), np.array([len(x) for x in own])


def _pieces(schema: pa.Schema, sums: np.ndarray) -> pa.RecordBatch:
    """A vector as ``PIECES`` rows."""
    parts = np.array_split(np.asarray(sums, "<f8").ravel(), PIECES)
    return _batch(schema, PIECES, piece=pa.array(np.arange(PIECES)), sums=pa.array([x.tobytes() for x in parts], pa.binary()))


def _total(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the vectors of ``size`` numbers among ``rows``."""
    schema = "piece int, sums binary"

    def add(own: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), "<f8") for x in own["sums"]], axis=0)
        return pa.table({"piece": own["piece"].combine_chunks()[:1], "sums": pa.array([total.tobytes()], pa.binary())}, schema=_arrow(schema))

    parts = sorted(rows.filter("piece is not null").select("piece", "sums").groupBy("piece").applyInArrow(add, schema).collect())
    return np.concatenate([np.frombuffer(bytes(r.sums), "<f8") for r in parts]) if parts else np.zeros(size)


def _encode(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts as 32-bit places in their block's dictionary, and the dictionaries by bucket with counts in training texts."""
    block, schema = TaskContext.get().partitionId() << 32, _arrow(ENCODED)
    ids, held, parts, total = [], [], [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        data, sizes, many = (np.concatenate(x) for x in zip(*parts, strict=True))
        found = _listed(data, sizes).dictionary_encode()
        bucket = np.fromiter(map(zlib.crc32, found.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(found.dictionary)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        symbols = place[found.indices.to_numpy()]
        own = pa.repeat(pa.scalar(block, pa.int64()), len(ids))
        yield _batch(schema, len(ids), block=own, doc_id=pa.array(ids, pa.int64()), held_out=pa.array(held, pa.bool_()), symbols=_squeezed(np.split(symbols, np.cumsum(many)[:-1])))
        n = np.bincount(symbols[~np.repeat(np.array(held, bool), many)], minlength=len(order))
        present, first = np.unique(bucket[order], return_index=True)
        cuts = [*first.tolist(), len(order)]
        own = pa.repeat(pa.scalar(block, pa.int64()), len(present))
        counts = _squeezed([n[a:b] for a, b in itertools.pairwise(cuts)])
        yield _batch(schema, len(present), block=own, bucket=pa.array(present), n=counts, **_zipped(found.dictionary.take(pa.array(order)), cuts))

    for batch in batches:
        for first, texts in pieces(batch.column(2)):
            data, sizes, many = _split(texts)
            while len(many):
                upto = np.cumsum(many)
                last = min(int(np.searchsorted(upto, size - total)) + 1, len(many))  # texts up to the one that fills the block
                taken = int(upto[last - 1])
                stop = int(sizes[:taken].sum())
                parts.append((data[:stop], sizes[:taken].astype("<u4"), many[:last]))
                ids += batch.column(0).slice(first, last).to_pylist()
                held += batch.column(1).slice(first, last).to_pylist()
                first, total = first + last, total + taken
                data, sizes, many = data[stop:], sizes[taken:], many[last:]
                if total >= size:
                    yield from rows()
                    ids, held, parts, total = [], [], [], 0
                    block += 1
    if ids:
        yield from rows()


def encoded(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """From (doc_id, held_out, text): texts in blocks and the blocks' words by bucket."""
    rows = texts.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // BUCKET + 4
    return stage(rows.mapInArrow(lambda batches: _encode(batches, block, buckets), ENCODED))


def _by(rows: DataFrame, key: str, groups: int):
    """Rows by key; as many tasks as groups, so that none is merged with others."""
    return rows.repartition(min(max(groups, 1), 20_000), key).groupBy(key)


class Lexicon:
    """Counts of the training words: a written table of packed rows, and sums of it.

    ``common`` is the weight c + 0.1 of all words of ``least`` occurrences or more, ``rare`` that of the others and
    of unseen words by group. ``top`` are ids and counts of the most frequent words.
    """

    def __init__(self, texts: DataFrame, least: int = LEAST):
        self.least, schema, top = least, _arrow(COUNTED), []
        words = texts.filter("bucket is not null").select("block", "bucket", "words", "sizes", "n")
        self.buckets = words.agg(F.max("bucket")).first()[0] or 0

        def count(own: pa.Table) -> pa.Table:
            own = own.sort_by("block")
            bucket = own["bucket"][0].as_py()
            words, many = _words(own["words"], own["sizes"])
            found = words.dictionary_encode()
            place, words = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False)
            c = np.bincount(place, _joined(own["n"], "<u4"), len(words)).astype(np.int64)
            g = np.fromiter((zlib.crc32(w[-ENDING:]) % GROUPS for w in words), np.int64, len(words))
            ids = (bucket << _SHIFT) + np.arange(len(words))
            seen, few = c > 0, (c > 0) & (c < least)
            sums = [(c[c >= least] + ADD).sum(), c.sum(), seen.sum(), *np.bincount(g[few], c[few] + ADD, GROUPS)]
            cuts = np.cumsum(many)[:-1]
            per = [np.split(x[place], cuts) for x in (ids, c, g)]
            kept = found.dictionary.filter(pa.array(seen))
            rows = _batch(schema, len(many), block=own["block"].combine_chunks(), bucket=own["bucket"].combine_chunks(), ids=_squeezed(per[0], "<i8"), c=_squeezed(per[1], "<i8"), g=_squeezed(per[2], "<u2"))
            whole = _batch(schema, 1, bucket=pa.array([bucket]), ids=_squeezed([ids[seen]], "<i8"), c=_squeezed([c[seen]], "<i8"), **_zipped(kept, [0, len(kept)]))
            return pa.Table.from_batches([rows, whole, _pieces(schema, sums)])

        def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, c in zip(_sequences(batch["ids"], "<i8"), _sequences(batch["c"], "<i8"), strict=True):
                    first = np.lexsort((ids, -c))[:TOP]
                    first = first[c[first] >= least]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(c[first])], ["id", "c"])

        self.packed = stage(_by(words, "bucket", self.buckets + 1).applyInArrow(count, COUNTED))
        self.common, tokens, distinct, *rare = _total(self.packed, 3 + GROUPS)
        self.tokens, self.distinct, self.rare = int(tokens), int(distinct), np.array(rare) + ADD
        self.floor = self.tokens + ADD * (self.distinct + 1)
        dictionary = self.packed.filter("block is null and piece is null")
        top = dictionary.select("ids", "c").mapInArrow(most, "id long, c long").orderBy(F.desc("c"), "id").limit(TOP).collect()
        self.top = np.array([r.id for r in top], np.int64), np.array([r.c for r in top], np.int64)

    @property
    def table(self) -> DataFrame:
        """Rows of id, word, c."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, _ = _words(batch["words"], batch["sizes"])
                yield pa.RecordBatch.from_arrays([pa.array(_joined(batch["ids"], "<i8")), words.cast(pa.binary()), pa.array(_joined(batch["c"], "<i8"))], ["id", "word", "c"])

        return self.packed.filter("block is null and piece is null").select("words", "sizes", "ids", "c").mapInArrow(spread, "id long, word binary, c long")


def _by_block(texts: DataFrame, words: DataFrame, blocks: int, function, schema: str) -> DataFrame:
    """``function`` on each block's rows of both, the words by bucket."""
    right = _by(words.withColumnRenamed("block", "home"), "home", blocks)
    return _by(texts, "block", blocks).cogroup(right).applyInArrow(lambda own, words: function(own, words.sort_by("bucket")), schema)


def _company(texts: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """In how many runs two of the top words are together; ``place`` is a symbol's among the top ones, else ``TOP``."""
    together = np.zeros((TOP, TOP))
    runs = [place[x[i : i + RUN]] for x in texts for i in range(0, len(x), RUN)]
    for first in range(0, len(runs), 4096):
        own = runs[first : first + 4096]
        present = np.zeros((len(own), TOP + 1), np.float32)
        present[np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)] = 1
        present = present[:, :TOP]
        together += present.T @ present
    return together


class Corpus:
    """Texts with their counts looked up; rare words of the same group and count are one symbol."""

    def __init__(self, texts: DataFrame, lexicon: Lexicon):
        plain = texts.filter("bucket is null").select("block", "doc_id", "held_out", "symbols")
        self.blocks = plain.select("block").distinct().count()
        floor, least, schema = lexicon.floor, lexicon.least, _arrow(LOOKED_UP)
        order = np.argsort(lexicon.top[0])
        top = lexicon.top[0][order]

        def look_up(own: pa.Table, words: pa.Table) -> pa.Table:
            per = _sequences(words["c"], "<i8")
            c, ids, g = np.concatenate(per), _joined(words["ids"], "<i8"), _joined(words["g"], "<u2")
            common = np.flatnonzero(c >= least)
            symbol = g.astype(np.int64) * least + c
            symbol[common] = GROUPS * least + np.arange(len(common))
            base = np.log10((c + ADD) / floor)
            sequences = _sequences(own["symbols"])
            block = own["block"][0]
            rows = _batch(
                schema,
                len(sequences),
                block=pa.repeat(block, len(sequences)),
                doc_id=own["doc_id"].combine_chunks(),
                held_out=own["held_out"].combine_chunks(),
                n_tokens=pa.array([len(x) for x in sequences]),
                n_known=pa.array([int((c[x] > 0).sum()) for x in sequences]),
                base=pa.array([float(base[x].sum()) for x in sequences]),
                symbols=_squeezed([symbol[x] for x in sequences]),
            )
            cuts = np.cumsum([len(x) for x in per])[:-1]
            kept = [np.split(x, cuts) for x in (ids, c)]
            kept = [[x[own >= least] for x, own in zip(column, per, strict=True)] for column in kept]
            names = _batch(schema, len(per), block=pa.repeat(block, len(per)), bucket=words["bucket"].combine_chunks(), ids=_squeezed(kept[0], "<i8"), c=_squeezed(kept[1], "<i8"))
            at = np.minimum(np.searchsorted(top, ids), max(len(top) - 1, 0))
            place = np.where(top[at] == ids, order[at], TOP) if len(top) else np.full(len(ids), TOP)
            train = [x for x, out in zip(sequences, own["held_out"].to_pylist(), strict=True) if not out]
            return pa.Table.from_batches([rows, names, _pieces(schema, _company(train, place))])

        found = lexicon.packed.filter("block is not null").select("block", "bucket", "ids", "c", "g")
        self.table = stage(_by_block(plain, found, self.blocks, look_up, LOOKED_UP))
        self.texts = self.table.filter("bucket is null and piece is null").select("block", "doc_id", "held_out", "n_tokens", "n_known", "base", "symbols")
        self.words = self.table.filter("bucket is not null").select("block", "bucket", "ids", "c")
        self.company = _total(self.table, TOP * TOP).reshape(TOP, TOP)


def _side_by_side(texts: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, laid out by place: their first symbols, then their second ones and so on.

    The symbols, where each place begins, edges of stretches of places from 1 on, and where each sequence ends. All
    places of a stretch have equally many sequences, and so has the place before it unless the stretch is one place.
    """
    lengths = np.array([len(x) for x in texts])
    alive = len(texts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    at = np.concatenate([[0], np.cumsum(alive)])
    symbols = np.empty(at[-1], np.intp)
    for j, x in enumerate(texts):
        symbols[at[: len(x)] + j] = x
    change = np.flatnonzero(alive[1:] != alive[:-1]) + 1
    edges = np.unique(np.concatenate([np.arange(1, len(alive), steps), change, change + 1, [len(alive)]]))
    return symbols, at, edges[edges <= len(alive)], at[lengths - 1] + np.arange(len(texts))


class Model:
    """start, later (start of a run inside a text), move (from, to) and emit (state, symbol)."""

    def __init__(self, start, later, move, emit):
        self.start, self.later, self.move, self.emit = start, later, move, emit

    def _steps(self) -> int:
        """How many places states may go without being scaled: what is likeliest then stays above 1e-200."""
        peak = np.maximum(self.emit.max(axis=0), 1e-300)
        least = max(self.move.min(), (self.emit.min(axis=0) / peak).min()) * peak.min()
        return int(np.clip(200 / -np.log10(np.clip(least, 1e-300, 0.1)), 1, STEPS))

    def forward(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of symbols, by the scaled forward recursion."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        emit, steps, k = np.ascontiguousarray(self.emit.T), self._steps(), len(self.start)
        first = 0
        while first < len(order):
            last = min(len(order), first + max(1, min(1024, 1_000_000 // max(len(texts[order[first]]), 1))))
            own = order[first:last]
            symbols, at, edges, _ = _side_by_side([texts[i] for i in own], steps)
            ahead, guess, total = np.empty((steps * len(own), k)), np.empty((len(own), k)), np.zeros(len(own))
            state = self.start * emit.take(symbols[: len(own)], axis=0)
            for a, b in itertools.pairwise([0, *edges.tolist()]):
                n = int(at[a + 1] - at[a])
                if a:
                    seen = emit.take(symbols[at[a] : at[b]], axis=0, out=ahead[: (b - a) * n], mode="clip")
                    for i in range(0, len(seen), n):
                        np.matmul(state[:n], self.move, out=guess[:n])
                        state = seen[i : i + n]
                        state *= guess[:n]
                scale = state.sum(axis=1)
                total[:n] += np.log10(scale)
                state = state / scale[:, None]
            out[own] = total
            first = last
        return out

    def expected(self, texts: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, later starts, moves and emissions (symbol, state) of all texts in runs.

        A run but the last of a text ends with the first token of the next one: the move there counts, the token
        counts in the next run.
        """
        k, size = self.emit.shape
        starts, later, moves = np.zeros(k), np.zeros(k), np.zeros((k, k))
        emitted = np.zeros((size + 1) * k)  # the last symbol takes what does not count
        runs = [(x[i : i + run + 1], i == 0, i + run >= len(x)) for x in texts for i in range(0, len(x), run)]
        runs.sort(key=lambda r: -len(r[0]))
        emit, back, steps = np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T), self._steps()
        for first in range(0, len(runs), 256):
            own = runs[first : first + 256]
            is_first, is_last = np.array([r[1:] for r in own]).T
            symbols, at, edges, last = _side_by_side([r[0] for r in own], steps)
            stretches = list(itertools.pairwise(edges.tolist()))
            ahead, guess, scale = np.empty((len(symbols), k)), np.empty((len(own), k)), {}
            state = emit.take(symbols[: len(own)], axis=0, out=ahead[: len(own)], mode="clip")
            state *= np.where(is_first[:, None], self.start, self.later)
            for a, b in stretches:
                n = int(at[a + 1] - at[a])
                emit.take(symbols[at[a] : at[b]], axis=0, out=ahead[at[a] : at[b]], mode="clip")
                for i in range(at[a], at[b], n):
                    np.matmul(state[:n], self.move, out=guess[:n])
                    state = ahead[i : i + n]
                    state *= guess[:n]
                scale[a] = 1 / state.sum(axis=1, keepdims=True)
                state *= scale[a]
            counted = symbols.copy()
            counted[last[~is_last]] = size
            behind = np.repeat(1 / ahead[last].sum(axis=1, keepdims=True), k, axis=1)
            seen, after = np.empty((2, steps * len(own), k))

            def add(part: slice, posterior: np.ndarray) -> None:  # which adds up to one per token
                np.add.at(emitted, (counted[part, None] * k + np.arange(k)).ravel(), posterior.ravel())  # noqa: B023

            for a, b in reversed(stretches):
                n, part = int(at[a + 1] - at[a]), slice(at[a], at[b])
                many = len(symbols[part])
                now, then = emit.take(symbols[part], axis=0, out=seen[:many], mode="clip"), after[:many]
                now[-n:] *= scale[a]
                then[-n:] = behind[:n]
                for i in range(many - n, -1, -n):
                    now[i : i + n] *= then[i : i + n]
                    np.matmul(now[i : i + n], back, out=then[i - n : i] if i else behind[:n])
                moves += ahead[at[a - 1] : at[a - 1] + many].T @ now
                add(part, np.multiply(then, ahead[part], out=then))
            state = ahead[: len(own)] * behind
            add(slice(len(own)), state)
            starts += state[is_first].sum(axis=0)
            later += state[~is_first].sum(axis=0)
        return starts, later, moves * self.move, emitted[:-k].reshape(size, k)


class States:
    """What does not grow with words: start, later, move; every state's share, expected emissions of groups and sum over words."""

    def __init__(self, start, later, move, share, groups, norm=None):
        self.start, self.later, self.move, self.share, self.groups, self.norm = start, later, move, share, groups, norm

    @staticmethod
    def even(states: int) -> States:
        """All alike; they mostly stay."""
        even = np.full(states, 1 / states)
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return States(even, even, move, even, np.zeros((GROUPS, states)))

    def weights(self, c: np.ndarray, n: np.ndarray, prior: float = PRIOR, add: float = ADD) -> np.ndarray:
        """m (word, state) from counts and expected emissions."""
        return ((c + add) / (n.sum(axis=1) + prior))[:, None] * (n + prior * self.share)

    def model(self, c: np.ndarray, n: np.ndarray, least: int) -> Model:
        """Symbols are group * least + count for rare words, then come the words of the counts given."""
        few = self.weights(np.tile(np.arange(least), GROUPS), np.repeat(self.groups, least, axis=0))
        return Model(self.start, self.later, self.move, (np.concatenate([few, self.weights(c, n)]) / self.norm).T)

    @staticmethod
    def improved(starts, later, moves, share, groups) -> States:
        starts, later, moves, share = starts + 0.1, later + 0.1, moves + 0.1, share + 0.1
        return States(starts / starts.sum(), later / later.sum(), moves / moves.sum(axis=1, keepdims=True), share / share.sum(), groups)

    def normalise(self, sums: np.ndarray, lexicon: Lexicon) -> None:
        """Sum m over all words, from ``_sums`` of all common ones; rare and unseen ones by group."""
        grouped = self.weights(lexicon.rare, self.groups, add=0.0).sum(axis=0)
        self.norm = sums[1:] + PRIOR * sums[0] * self.share + grouped


def _sums(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What words' m add up to but for the states' shares: the factor of these, and the rest by state."""
    weight = (c + ADD) / (n.sum(axis=1) + PRIOR)
    return np.concatenate([[weight.sum()], weight @ n])


def _parts(k: int) -> list[str]:
    return [f"p{i}" for i in range(-(-k // 4))]


def _unpacked(k: int) -> list:
    """Columns of expected emissions by state from n and parts, four to a long."""
    part = [F.shiftrightunsigned(F.col(f"p{j // 4}"), 16 * (j % 4)).bitwiseAND(F.lit(_UNIT)) for j in range(k)]
    return [F.col("n") * p / F.lit(float(_UNIT)) for p in part]


def _packed(emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n and parts (word, state) of expected emissions."""
    n = emitted.sum(axis=1).astype("<f4")
    return n, np.rint(emitted / np.maximum(n, 1e-30)[:, None] * _UNIT).clip(0, _UNIT).astype("<u2")


def _emissions(n: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return n.astype(float)[:, None] * parts / _UNIT


def _columns(emitted: list[np.ndarray]) -> dict[str, pa.Array]:
    packed = [_packed(x) for x in emitted]
    return {"n": _squeezed([n for n, _ in packed], "<f4"), "parts": _squeezed([p.T.ravel() for _, p in packed], "<u2")}


def _weights(words: pa.Table, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Counts by bucket, and counts and expected emissions of all words of some rows."""
    c = _sequences(words["c"], "<i8")
    emitted = [_emissions(n, p.reshape(k, -1).T) for n, p in zip(_sequences(words["n"], "<f4"), _sequences(words["parts"], "<u2"), strict=True)]
    return c, np.concatenate([np.zeros(0, np.int64), *c]), np.concatenate([np.zeros((0, k)), *emitted])


def _round(corpus: Corpus, table: DataFrame, states: States, lexicon: Lexicon) -> tuple[DataFrame, States]:
    """Rows of ``EXPECTED`` and states after one round over the training texts."""
    k, least, schema = len(states.share), lexicon.least, _arrow(EXPECTED)
    fixed = 3 + k + GROUPS

    def expect(texts: pa.Table, words: pa.Table) -> pa.Table:
        per, c, n = _weights(words, k)
        if texts.num_rows:
            starts, later, moves, emitted = states.model(c, n, least).expected(_sequences(texts["symbols"]))
            groups = emitted[: GROUPS * least].reshape(GROUPS, least, k).sum(axis=1)
            sums = _pieces(schema, np.concatenate([[starts, later, emitted.sum(axis=0)], moves, groups]))
            emitted = emitted[GROUPS * least :]
        else:  # the words of held-out texts
            sums, emitted = schema.empty_table().to_batches(), np.zeros((len(c), k))
        own = np.split(emitted, np.cumsum([len(x) for x in per])[:-1]) if per else []
        rows = _batch(schema, len(per), block=words["home"].combine_chunks(), **{x: words[x].combine_chunks() for x in ("bucket", "ids", "c")}, **_columns(own))
        return pa.Table.from_batches([rows, *([sums] if isinstance(sums, pa.RecordBatch) else sums)], schema=schema)

    def gather(own: pa.Table) -> pa.Table:
        own = own.sort_by("block")
        per, c, n = _weights(own, k)
        ids, first, place = np.unique(_joined(own["ids"], "<i8"), return_index=True, return_inverse=True)
        emitted = np.stack([np.bincount(place, n[:, j], len(ids)) for j in range(k)], axis=1)
        emitted = _emissions(*_packed(emitted))
        cuts = np.cumsum([len(x) for x in per])[:-1]
        rows = _batch(schema, len(per), **{x: own[x].combine_chunks() for x in ("block", "bucket", "ids", "c")}, **_columns(np.split(emitted[place], cuts)))
        return pa.Table.from_batches([rows, _pieces(schema, _sums(c[first], emitted))])

    sums = stage(_by_block(corpus.texts.filter("not held_out").select("block", "symbols"), table, corpus.blocks, expect, EXPECTED))
    before = table
    table = stage(_by(sums.filter("piece is null"), "bucket", lexicon.buckets + 1).applyInArrow(gather, EXPECTED))
    totals = _total(sums, fixed * k).reshape(fixed, k)
    discard(sums)
    if before.inputFiles()[0] != corpus.words.inputFiles()[0]:
        discard(before)
    states = States.improved(totals[0], totals[1], totals[3 : 3 + k], totals[2], totals[3 + k :])
    states.normalise(_total(table, 1 + k), lexicon)
    return table.filter("piece is null").select("block", "bucket", "ids", "c", "n", "parts"), states


def _anchors(company: np.ndarray, states: int) -> np.ndarray:
    """How much each of the top words leans to each state: its company with an anchor, and that with all."""
    runs = np.diag(company)
    size = int((runs > 0).sum())
    alike = company / np.sqrt(np.maximum(np.outer(runs, runs), 1.0))
    chosen = [int(np.argmax(runs))]
    while len(chosen) < min(states, size):
        far = (1 - alike[:, chosen].max(axis=1)) * np.sqrt(runs)
        far[chosen] = -1
        chosen.append(int(np.argmax(far)))
    lean = alike[:, [chosen[j % len(chosen)] for j in range(states)]] ** 2 * (1 + 0.01 * np.arange(states))
    return lean / np.maximum(lean.sum(axis=1, keepdims=True), 1e-30)


def _fit(corpus: Corpus, lexicon: Lexicon, states: int, rounds: int) -> tuple[DataFrame, States]:
    """Rows of ``EXPECTED`` and states after the first model and ``rounds`` rounds."""
    order = np.argsort(lexicon.top[0])
    top, c = (x[order] for x in lexicon.top)
    lean = 10.0 * _anchors(corpus.company, states)[order]
    lean = _emissions(*_packed(lean))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            emitted = []
            for ids in _sequences(batch["ids"], "<i8"):
                own = np.zeros((len(ids), states))
                _, here, there = np.intersect1d(ids, top, assume_unique=True, return_indices=True)
                own[here] = lean[there]
                emitted.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(emitted).values()], [*batch.schema.names, "n", "parts"])

    table = corpus.words.mapInArrow(start, "block long, bucket int, ids binary, c binary, n binary, parts binary")
    model = States.even(states)
    others = lexicon.common - (c + ADD).sum()
    model.normalise(_sums(c, lean) + np.concatenate([[others / PRIOR], np.zeros(states)]), lexicon)
    if lexicon.tokens:
        for _ in range(rounds):
            table, model = _round(corpus, table, model, lexicon)
    return table, model


def train(spark: SparkSession, texts: DataFrame, corpus: Corpus, lexicon: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> tuple[DataFrame, States]:
    """Expected emissions per word (id, c, n, parts) and states, from all training texts in each of the rounds."""
    table, model = _fit(corpus, lexicon, states, FIRST_ROUNDS + rounds)
    parts = _parts(states)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, c, n, p in zip(*(_sequences(batch[x], kind) for x, kind in (("ids", "<i8"), ("c", "<i8"), ("n", "<f4"), ("parts", "<u2"))), strict=True):
                own = np.zeros((len(ids), 4 * len(parts)), "<u2")
                own[:, :states] = p.reshape(states, -1).T
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, c, n.astype(float), *own.view("<i8").T)], ["id", "c", "n", *parts])

    rows = table.mapInArrow(spread, "id long, c long, n double, " + ", ".join(f"{p} long" for p in parts))
    return rows.dropDuplicates(["id"]), model


def score_texts(spark: SparkSession, docs: DataFrame, held_out, states: int = STATES, rounds: int = ROUNDS, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned where not ``held_out``."""
    rows = encoded(docs.select("doc_id", held_out.alias("held_out"), "text"), block)
    lexicon = Lexicon(rows, least)
    corpus = Corpus(rows, lexicon)
    discard(rows)
    discard(lexicon.packed)
    table, model = _fit(corpus, lexicon, states, FIRST_ROUNDS + rounds)
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def score(own: pa.Table, words: pa.Table) -> pa.Table:
        _, c, n = _weights(words, states)
        likely = model.model(c, n, least).forward(_sequences(own["symbols"]))
        return pa.Table.from_arrays([own[x].combine_chunks() for x in ("doc_id", "held_out", "n_tokens", "n_known", "base")] + [pa.array(likely)], schema=_arrow(result))

    scored = _by_block(corpus.texts, table, corpus.blocks, score, result)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lexicon.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0)
