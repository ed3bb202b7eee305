"""Encoding texts as the ids of a sentencepiece BPE model and decoding them, by a table of last tokens.

The merges of such a model depend on scores and places only, so every stretch of an encoding is the encoding
of its own characters, and a row of pieces is an encoding if each two neighbours are one. Hence every prefix
of a text has exactly one last token: a piece that ends there (an Aho-Corasick automaton names them all) and
whose left neighbour, the last token of what is before it, it is compatible with. Two pieces are compatible if,
while both are put together from their characters side by side, no merge reaches over their border; that is
followed on the right edge of the one and the left edge of the other. The ids are read off the table backwards.

Texts are cut into units where no piece of the model reaches over: before white space marks, and between letters and
others, as far as the vocabulary's own pieces allow it. Characters that no piece holds stand alone and become bytes. Units
and pair tests are remembered, both up to a fixed number; nothing else is kept between texts.

Edge cases: null is encoded as empty text, which is the begin and the end id alone; a mark (U+2581) in a text is a
space and decodes as one, as in the library; a table without rows gives none; other columns are not looked at.
Models that are not BPE with byte fallback, or normalise texts, are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from segprofile.llm.tables import read
from segprofile.llm.text import pieces

MARK = "▁"
UNKNOWN_TEXT = " ⁇ "
_NORMAL, _UNKNOWN, _CONTROL, _OWN, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # fixed values: types of pieces in the model file
_BPE = 2  # fixed value: type of the model
REMEMBERED_UNITS, REMEMBERED_PAIRS = 400_000, 2_000_000


class Model:
    """Vocabulary of a model file: scores of mergeable pieces, ids, and the bytes an id stands for."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rule, made = proto.normalizer_spec, proto.trainer_spec
        plain = not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and rule.add_dummy_prefix and rule.escape_whitespaces
        own = any(p.type in (_OWN, _UNUSED) for p in proto.pieces)
        if made.model_type != _BPE or not made.byte_fallback or not plain or made.treat_whitespace_as_suffix or own:
            raise ValueError("not a plain BPE model with byte fallback and a leading space")
        self.begin, self.end = made.bos_id, made.eos_id
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == _NORMAL]
        self.ids = {p.piece: i for i, p in normal}
        self.score = {p.piece: p.score for _, p in normal}
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        as_bytes = {
            _NORMAL: lambda p: p.replace(MARK, " ").encode(),
            _BYTE: lambda p: bytes([int(p[1:-1], 16)]),
            _CONTROL: lambda p: b"",
            _UNKNOWN: lambda p: UNKNOWN_TEXT.encode(),
        }
        self.bytes = [as_bytes[kind](p) for p, kind in zip(self.pieces, self.kinds, strict=True)]


@cache
def model(path: str) -> Model:
    """One per process."""
    return Model(path)


class _Remembered(dict):
    def __init__(self, find, most: int):
        self.find, self.most = find, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = found = self.find(key)
        return found


class Encoder:
    """Ids of texts by the table of last tokens."""

    def __init__(self, vocabulary: Model):
        self.model = vocabulary
        self.tokens = list(vocabulary.ids)
        # characters of pieces that are no pieces themselves end prefixes too
        self.tokens += sorted({c for p in vocabulary.ids for c in p} - set(vocabulary.ids))
        self.lengths = [len(t) for t in self.tokens]
        self.start = len(self.tokens)  # stands for the last token where nothing is before a character
        self.automaton = ahocorasick.Automaton()
        for number, token in enumerate(self.tokens):
            self.automaton.add_word(token, number)
        self.automaton.make_automaton()
        self.cut, self.alone = self._borders()
        self.steps = _Remembered(self._steps, len(self.tokens) + 1)
        self.fits = _Remembered(self._fits, REMEMBERED_PAIRS)
        self.units: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _borders(self) -> tuple[re.Pattern, re.Pattern]:
        """Patterns of the units, and of characters that no piece holds. No piece of the model reaches over the end of a unit."""
        held = {c for t in self.tokens for c in t}
        letters = {c for c in held if c.isalpha()}
        inside = {(x, y) for t in self.tokens for x, y in zip(t, t[1:], strict=False)}
        one, other = (re.escape("".join(sorted(c))) for c in (letters, held))
        if any(y == MARK and x != MARK for x, y in inside):
            cut = "(?s:.+)"
        elif any((x in letters) != (y in letters) and x != MARK for x, y in inside):
            cut = f"{MARK}*[^{MARK}]+|{MARK}+"
        else:
            cut = f"{MARK}*[{one}]+|{MARK}*[^{MARK}{one}]+|{MARK}+"
        return re.compile(cut), re.compile(f"[^{other}]")

    def _steps(self, number: int) -> list[tuple[float, str | None, str | None]] | None:
        """How a piece is put together: (score, new left edge, new right edge) of each merge; None if it never is."""
        symbols, steps, score = list(self.tokens[number]), [], self.model.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0] if at == 0 else None, symbols[-1] if at == len(symbols) - 1 else None))
        return steps

    def _fits(self, pair: int) -> bool:
        """Whether no merge reaches over the border while two pieces are put together; equal scores go leftmost first."""
        left, right = divmod(pair, self.start + 1)
        right_steps = self.steps[right]
        if left == self.start:
            return right_steps is not None
        left_steps = self.steps[left]
        if left_steps is None or right_steps is None:
            return False
        x, y, i, j = self.tokens[left][-1], self.tokens[right][0], 0, 0
        while True:
            over = self.model.score.get(x + y)
            one = left_steps[i][0] if i < len(left_steps) else None
            other = right_steps[j][0] if j < len(right_steps) else None
            if over is not None and (one is None or over > one) and (other is None or over >= other):
                return False
            if one is None and other is None:
                return True
            if other is None or (one is not None and one >= other):
                x, i = left_steps[i][2] or x, i + 1
            else:
                y, j = right_steps[j][1] or y, j + 1

    def _last_tokens(self, run: str) -> list[int]:
        """The last token of every prefix of a run; behind characters that no piece holds everything starts anew."""
        lengths, fits, n = self.lengths, self.fits, self.start + 1
        last = [-1] * (len(run) + 1)
        last[0] = self.start
        for alone in self.alone.finditer(run):
            last[alone.end()] = self.start
        for at, token in self.automaton.iter(run):
            if last[at + 1] < 0 and fits[last[at + 1 - lengths[token]] * n + token]:
                last[at + 1] = token
        return last

    def _encoded(self, units: list[str]) -> None:
        """Remember the ids of units."""
        between = "\n" if self.alone.match("\n") else next(chr(i) for i in range(0x110000) if self.alone.match(chr(i)))
        run = between.join(units)
        last, start, tokens, lengths, ids = self._last_tokens(run), 0, self.tokens, self.lengths, self.model.ids
        for unit in units:
            at, out = start + len(unit), array("I")
            while at > start:
                token = last[at]
                if token == self.start or tokens[token] not in ids:
                    held = run[at - 1 : at]
                    out.extend([self.model.byte_id[b] for b in reversed(held.encode())])
                    at -= 1
                else:
                    out.append(ids[tokens[token]])
                    at -= lengths[token]
            out.reverse()
            self.units[unit] = out.tobytes()
            start += len(unit) + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without begin and end, as little-endian unsigned 32-bit integers."""
        cut = [self.cut.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        if len(self.units) >= REMEMBERED_UNITS:
            self.units, self.earlier = {}, self.units
        missing = set().union(*cut).difference(self.units)
        for unit in missing.intersection(self.earlier):
            self.units[unit] = self.earlier[unit]
        self._encoded(list(missing.difference(self.units)))
        return [b"".join(map(self.units.__getitem__, units)) for units in cut]


@cache
def encoder(path: str) -> Encoder:
    """One per worker process, kept over tasks."""
    return Encoder(model(path))


def _mended(vocabulary: Model, ids: Iterable[int]) -> str:
    """Text of ids with byte runs that are no UTF-8: every byte that begins no character is U+FFFD."""
    out, run = [], bytearray()

    def flush() -> None:
        while run:
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[:size]).decode())
                except UnicodeDecodeError:
                    continue
                del run[:size]
                break
            else:
                out.append("�")
                del run[:1]

    for i in ids:
        if vocabulary.kinds[i] == _BYTE:
            run += vocabulary.bytes[i]
        elif vocabulary.kinds[i] != _CONTROL or run:
            flush()
            out.append(vocabulary.bytes[i].decode())
    flush()
    return "".join(out)


def decode(vocabulary: Model, ids: bytes) -> str:
    """Text of little-endian 32-bit ids; the space that encoding put before the text goes again."""
    numbers = np.frombuffer(ids, "<u4").tolist()
    first = next((i for i in numbers if vocabulary.kinds[i] != _CONTROL), None)
    led = first is not None and vocabulary.kinds[first] == _NORMAL and vocabulary.pieces[first].startswith(MARK)
    joined = b"".join(map(vocabulary.bytes.__getitem__, numbers))
    try:
        text = joined.decode()
    except UnicodeDecodeError:
        text = _mended(vocabulary, numbers)
    return text[1:] if led else text


# -- on tables --------------------------------------------------------------------------------


def _with(column: str, kind: str, convert) -> object:
    """A function over batches that turns the last column into another, a megabyte at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = convert()
        for batch in batches:
            last = batch.num_columns - 1
            for first, part in pieces(batch.column(last)):
                rows = batch.slice(first, len(part))
                values = pa.array(made(part.to_pylist()), pa.type_for_alias(kind))
                yield pa.RecordBatch.from_arrays([*rows.columns[:last], values], [*rows.schema.names[:last], column])

    return run


def encode_texts(keys: list[Column], text: Column, docs: DataFrame, path: str) -> DataFrame:
    """The keys and ``ids``: begin, the text's ids and end as little-endian 32-bit integers in one binary value."""

    def convert():
        known = encoder(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (known.model.begin, known.model.end))
        return lambda texts: [begin + ids + end for ids in known.encode([t or "" for t in texts])]

    rows = docs.select(*keys, text.cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_with("ids", "binary", convert), f"{schema}, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode_texts`` with the decoded text in place of the ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields[:-1])

    def convert():
        known = model(path)
        return lambda values: [decode(known, ids) for ids in values]

    return encoded.mapInArrow(_with("text", "string", convert), f"{schema}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_texts([F.col("doc_id").cast("long").alias("doc_id")], F.col("text"), read(spark, sf_dir, "documents"), path)
    digests = encoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = decode_ids(digests, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
