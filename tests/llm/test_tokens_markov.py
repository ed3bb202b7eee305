import itertools
import math
import shutil
import sys
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segprofile.llm import hidden_markov as H
from segprofile.llm import tokens as T
from segprofile.llm.text import remainder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_random_access_and_runs():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 50_000, 3000), rng.integers(0, 256, 1500), [2**32 - 1, 65_536, 0, 255, 256]]).astype(np.uint32)
    rng.shuffle(ids)
    s = T.Segment(T.pack([None, 5, 9], [0, 1200, len(ids)], ids) + b"\n")
    assert [s[i] for i in range(len(ids))] == ids.tolist()
    for a, b in rng.integers(0, len(ids) + 1, (100, 2)):
        assert s.slice(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()
    assert s.doc_ids == [None, 5, 9] and len(s.document(0)) == 0 and s.document(1).tolist() == ids[:1200].tolist()
    with pytest.raises(IndexError):
        s[len(ids)]
    with pytest.raises(ValueError):
        T.Segment(b"something else entirely")


def test_encoder_equals_the_library():
    rng = np.random.default_rng(4)
    letters = list("abzAZ09 .,'\n\t éÉßİıǅ²½ªµ×÷Σσς漢字́​­\x1c\x85\xa0<|>😀ﬁ’") + ["'s", "'ll", "<|endoftext|>"]
    encoder, library = T.Encoder(PATH, remembered=50), Tokenizer.from_file(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_hold_every_document_in_order(spark, odd, none, tmp_path):
    T.write_tokens(odd, str(tmp_path / "a"), PATH, per_file=50)
    rows = sorted(T.read_documents(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    want = Counter((r.doc_id, *digest(library.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in odd.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


def test_files_are_in_order_whatever_the_uuid_in_their_names(spark, odd, tmp_path):
    T.write_tokens(odd, str(tmp_path / "a"), PATH, per_file=50)
    for to, uuid in (("b", "2f9c1e7a-c41d-4b6e-9d10-5a1b2c3d4e5f"), ("c", "c0ffee00-1111-4222-8333-c12345678901"), ("d", "0a0a0a0a-c412-4222-c333-444455556666")):
        (tmp_path / to).mkdir()
        for f in (tmp_path / "a").glob("part-*"):
            task, file = f.name.split("-")[1], f.name.rsplit("-", 1)[1]
            shutil.copy(f, tmp_path / to / f"part-{task}-{uuid}-{file}")
        rows = sorted(T.read_documents(spark, str(tmp_path / to)).collect(), key=lambda r: (r.start, r.n_tokens))
        assert len(rows) == 12 and [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    names = [("s3://b/part-9-c8-c7.txt/part-00003-2f9c1e7a-c41d-4b6e-9d10-5a1b2c3d4e5f-c002.txt",), ("part-00012-2f9c1e7a-941d-4b6e-9d10-ca1b2c3d4e5f-c010.txt.gz",)]
    assert [tuple(r) for r in spark.createDataFrame(names, "path string").select(*T.place_of(F.col("path"))).collect()] == [(3, 2), (12, 10)]


def digest(ids):
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def test_forward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    k, size = 3, 5
    rows = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    model = H.Model(rows(k), rows(k), rows(k, k), rows(k, size))
    texts = [rng.integers(0, size, n).astype("<u2") for n in (1, 4, 6, 2, 6)]
    for text, got in zip(texts, model.forward(texts), strict=True):
        total = 0.0
        for path in itertools.product(range(k), repeat=len(text)):
            p = model.start[path[0]] * model.emit[path[0], text[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], text[t]]
            total += p
        assert got == pytest.approx(math.log10(total))


def test_every_round_is_at_least_as_likely():
    rng = np.random.default_rng(1)
    texts = [np.where(rng.random(n) < 0.9, rng.integers(0, 4) % 2 * 3 + rng.integers(0, 3, n), rng.integers(0, 6, n)).astype("<u4") for n in rng.integers(2, 40, 60)]
    emit = np.stack([np.bincount(x, minlength=6) + 0.5 for x in texts[:2]])
    start, move = np.full(2, 0.5), np.array([[0.9, 0.1], [0.1, 0.9]])
    model, last = H.Model(start, start, move, emit / emit.sum(axis=1, keepdims=True)), -np.inf
    for _ in range(8):
        now = model.forward(texts).sum()
        assert now >= last - 1e-6
        (starts, later, moves, emitted), last = model.expected(texts, run=1000), now
        model = H.Model(starts / starts.sum(), start, moves / moves.sum(axis=1, keepdims=True), (emitted / emitted.sum(axis=0)).T)
    assert starts.sum() == pytest.approx(60) and emitted.sum() == pytest.approx(sum(map(len, texts))) and not later.any()


@pytest.mark.parametrize("run", [1, 3, 4, 1000])
def test_every_move_and_every_token_counts_once_whatever_the_runs(run):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 5, n).astype("<u4") for n in (1, 4, 5, 8, 9, 30)]
    model = H.Model(np.full(2, 0.5), np.full(2, 0.5), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2))
    starts, _, moves, emitted = model.expected(texts, run)
    assert starts.sum() == pytest.approx(len(texts)) and moves.sum() == pytest.approx(sum(len(x) - 1 for x in texts))
    assert emitted.sum(axis=1) == pytest.approx(np.bincount(np.concatenate(texts), minlength=5))


TEXTS = ["the cat sat", "The dog sat down", "a cat and a dog", "", None, "zebra quagga cat", "the the the"] * 3


def test_scores_by_definition(spark, documents):
    docs = documents([(i, t, "en", "a") for i, t in enumerate(TEXTS)])
    held = remainder(F.col("doc_id"), 10) == 0
    train = Counter()
    for i, t in enumerate(TEXTS):
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*(t or "").lower().split(), ""])
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in H.score_texts(spark, docs, held, states=2, rounds=1, least=2, block=8).collect()}
    for i, t in enumerate(TEXTS):
        tokens = [*(t or "").lower().split(), ""]
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert got[i].score < 0


def trained(spark, docs, least, states=2):
    """The words' table (id, word, c, e0, e1), the states and the lexicon."""
    texts = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    rows = H.encoded(texts, block=64)
    lexicon = H.Lexicon(rows, least)
    table, model = H.train(spark, texts, H.Corpus(rows, lexicon), lexicon, states, rounds=1)
    return lexicon.table.join(table.select("id", *[e.alias(f"e{j}") for j, e in enumerate(H._unpacked(states))]), "id", "left").na.fill(0.0).collect(), model, lexicon


def test_a_state_s_word_probabilities_add_up_to_one(spark, documents):
    docs = documents([(i, " ".join(f"w{j}" for j in range(60) if (i + j) % (j // 3 + 1) == 0), "en", "a") for i in range(20)])
    words, model, lexicon = trained(spark, docs, least=4)
    groups = {r.word: r.g for r in lexicon.table.select("word", H._group(F.col("word")).alias("g")).collect()}
    total = np.zeros(2)
    for r in words:
        n = np.array([r.e0, r.e1]) if r.c >= 4 else model.groups[groups[r.word]]
        total += model.weights(np.array([r.c]), n[None])[0] / model.norm
        assert r.c < 4 or n.sum() == pytest.approx(r.c, rel=1e-4)
    total += (model.weights(np.zeros(H.GROUPS), model.groups) / model.norm).sum(axis=0)  # unseen words
    assert total == pytest.approx(1.0) and lexicon.tokens == sum(r.c for r in words)


def test_the_vocabulary_with_evidence_has_no_end(spark, documents):
    """The 60,001st word is told apart by the company it keeps, as all are."""
    rng = np.random.default_rng(3)
    # a word but the first 200 of its side is in five texts; the first 200 are in every text of the side, its company
    company = [f"{j}" for j in range(200)] * 6
    rows = []
    for i in range(250):
        own = [*company, *map(str, range(200 + i // 2 % 25, 60_001, 25))]
        rows.append((i, " ".join("ab"[i % 2] + own[j] for j in rng.permutation(len(own))), "en", "a"))
    words, model, _ = trained(spark, documents(rows), least=5)
    found = {bytes(r.word).decode(): np.array([r.e0, r.e1]) for r in words}
    assert len(found) == 120_003
    lean = np.array([int(np.argmax(n)) for w, n in found.items() if w.startswith("a")]), np.array([int(np.argmax(n)) for w, n in found.items() if w.startswith("b")])
    assert abs(lean[0].mean() - lean[1].mean()) > 0.9 and found["a60000"].sum() == pytest.approx(5, abs=0.01)


def test_scores_of_odd_rows(spark, odd, none):
    held = remainder(F.col("doc_id"), 10) == 0
    rows = H.score_texts(spark, odd, held, states=2, rounds=1).collect()
    assert len(rows) == 12 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3, 8)} == {1}
    everything = H.score_texts(spark, odd, F.lit(True), states=2).collect()
    assert {r.train_tokens for r in everything} == {0} and {r.n_known for r in everything} == {0}
    assert H.score_texts(spark, none, held, states=2).count() == 0


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = H.query(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


def test_every_round_reads_every_training_text(spark, documents, monkeypatch):
    docs = documents([(i, f"word{i % 7} and word{i % 3}", "en", "a") for i in range(3000)])
    seen, one_round = [], H._round

    def counted(corpus, *rest):
        seen.append(corpus.texts.filter("not held_out").count())
        return one_round(corpus, *rest)

    monkeypatch.setattr(H, "_round", counted)
    H.score_texts(spark, docs, F.col("doc_id") % 10 == 0, states=2, rounds=1)
    assert len(seen) > 1 and set(seen) == {2700}


def test_tokens_of_many_texts_at_once():
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "\x0b", "A", " b", "c\x0c", "\x1c\x85\xa0 É É", *("".join(rng.choice(list("aZé \t\r\n\x00"), n)) for n in rng.integers(0, 30, 200)), None]
    texts = [None if t is None else t.encode() for t in texts]
    for first in (0, 1, 7):
        data, sizes, many = H._split(pa.array(texts, pa.binary())[first:])
        want = [H.tokens_of(t) for t in texts[first:]]
        assert H._listed(data, sizes).to_pylist() == [w for x in want for w in x] and many.tolist() == [len(x) for x in want]


def plain_round(model, texts, run):
    """What ``expected`` adds up, token by token, each scaled."""
    k, size = model.emit.shape
    starts, later, moves, emitted = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    for text in texts:
        for i in range(0, len(text), run):
            x = text[i : i + run + 1]
            ahead, scale = [], []
            for t, w in enumerate(x):
                state = (ahead[-1] @ model.move if t else model.later if i else model.start) * model.emit[:, w]
                scale.append(state.sum())
                ahead.append(state / scale[-1])
            behind = np.ones(k)
            for t in range(len(x) - 1, -1, -1):
                if t < run:
                    emitted[x[t]] += ahead[t] * behind
                if t:
                    seen = model.emit[:, x[t]] * behind / scale[t]
                    moves += np.outer(ahead[t - 1], seen) * model.move
                    behind = model.move @ seen
            (later if i else starts)[:] += ahead[0] * behind
    return starts, later, moves, emitted


@pytest.mark.parametrize("least", [1.0, 1e-9, 1e-40])
def test_a_round_equals_the_recursion_token_by_token(least):
    rng = np.random.default_rng(6)
    rows = lambda *s: (x := rng.random(s) ** 4 + 1e-6) / x.sum(axis=-1, keepdims=True)
    emit = rows(3, 9)
    emit[:, 4:] *= least
    emit[0, 6] = 0.0
    model = H.Model(rows(3), rows(3), rows(3, 3), emit)
    texts = [rng.integers(0, 9, n) for n in [*range(1, 40), *[50] * 300, 333]]
    got, want = model.expected(texts, 100), plain_round(model, texts, 100)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
    score = [sum(math.log10(s) for s in scales(model, x)) for x in texts]
    assert model.forward(texts) == pytest.approx(score, rel=1e-12)


def scales(model, x):
    state = None
    for w in x:
        state = (model.start if state is None else state @ model.move) * model.emit[:, w]
        yield state.sum()
        state = state / state.sum()


def calls(function):
    """How many functions were called in Python, which is what reading tokens one by one costs."""
    seen = []
    sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
    try:
        function()
    finally:
        sys.setprofile(None)
    return len(seen)


def test_tokens_are_read_many_at_a_time(monkeypatch):
    rng = np.random.default_rng(7)
    rows = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    model = H.Model(rows(2), rows(2), rows(2, 2), rows(2, 9))
    texts = [rng.integers(0, 9, 1000) for _ in range(20)]
    assert calls(lambda: model.expected(texts)) < 2000  # 1,000 places, forth and back
    assert calls(lambda: model.forward(texts)) < 1000
    monkeypatch.setattr(H, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text = " ".join(f"w{i}" for i in range(20_000)).encode()
    batch = pa.record_batch([pa.array([1]), pa.array([False]), pa.array([text])], ["doc_id", "held_out", "text"])
    assert calls(lambda: list(H._encode(iter([batch]), H.BLOCK, 4))) < 2000  # 20,000 words
