"""Alignment and corpus-wide pair counts against a plain count in memory."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segprofile.llm import token_alignment as ta
from segprofile.llm.piece_encoding import MARK

PATHS = tuple(public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain(rows):
    """The contract by definition, token by token."""
    import sentencepiece

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if second.is_byte(i) else piece.replace(MARK, " ").encode()

    counts, found = Counter(), []
    for doc_id, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        pieces_a, pieces_b = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(pieces_a) != (" " + text).encode() or b"".join(pieces_b) != (" " + text).encode():
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(p) for p in pieces_a]).tolist(), np.cumsum([len(p) for p in pieces_b]).tolist()
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        groups = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            inside = [",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= high) for ids, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(inside))
        links = [(x, y) for x, e in zip(a, ends_a, strict=True) for y, f in zip(b, ends_b, strict=True) if e == f]
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = [(i, a, b, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), h) for i, a, b, g, ls, h in found]
    return out, counts, top


TEXTS = ["a", " two  spaces", "日本語 😀 text", "<|endoftext|> <s> </s>", "mark ▁ inside", "tab\tand\nline\r\n", "\x00", "ends with space ", "the the the the", "the the the the"]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize(("run_links", "parcel"), [(7, 300), (50, 1 << 20), (ta.RUN_LINKS, ta.PARCEL)])
def test_counts_by_definition(spark, documents, run_links, parcel):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, ""), (3, "the other of one id"), (None, "no id the the")]
    expected, counts, top = plain(rows)
    found = ta.Alignment(documents(rows), *PATHS, run_links=run_links, parcel=parcel)
    assert rows_of(found.scored()) == sorted(expected, key=str)
    pairs = {(r.a, r.b): (r.n, r.best) for r in found.pair_counts().collect()}
    assert pairs == {p: (n, int(n == top[p[1]])) for p, n in counts.items()}


def test_odd_rows(spark, odd, none):
    expected, _, _ = plain([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if len(r.text or "") < 10_000])
    some = odd.filter("text IS NULL OR length(text) < 10000")
    assert rows_of(ta.Alignment(some, *PATHS).scored()) == sorted(expected, key=str)
    long = {r for r in rows_of(ta.Alignment(odd, *PATHS, run_links=1000).scored()) if r[0] == 4}
    assert len(long) == 1 and next(iter(long))[3] > 30_000
    assert rows_of(ta.Alignment(none, *PATHS).scored()) == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r.text or "") < 3000]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ta.Alignment(small, *PATHS, run_links=2000, parcel=4000).scored()) == sorted(plain(rows)[0], key=str)
    assert ta.query(spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_merge_is_whole_and_ordered():
    rng = np.random.default_rng(5)
    runs, everything = [], []
    for i in range(9):
        pairs = np.sort(rng.integers(0, 40, 3000)).astype(np.uint64)
        documents = np.arange(3000)
        runs.append([ta._packed(pairs[a : a + 250], documents[a : a + 250], np.ones(250)) for a in range(0, 3000, 250)])
        everything += [(int(p), i, int(d)) for p, d in zip(pairs, documents, strict=True)]
    merged = [(int(p), int(r), int(d)) for chunk in ta.merged(runs) for p, r, d in zip(*chunk[:3], strict=True)]
    assert [m[0] for m in merged] == sorted(m[0] for m in merged)
    assert sorted(merged) == sorted(everything)
