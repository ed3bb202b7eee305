"""Piece encoding against the library: every id, every decoded text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from segprofile.llm import piece_encoding as pe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def check(library, text):
    ids = library.encode(text)
    assert ids_of(pe.encoder(PATH).encode([text])[0]) == ids
    assert pe.decode(pe.model(PATH), np.array([1, *ids, 2], "<u4").tobytes()) == library.decode([1, *ids, 2])


ODD = ["", " ", "  ", "      " * 7, "a" * 500, "▁x ▁▁ y", "\x00a\x00", "日本語テキスト", "👩‍👩‍👧 😀\U0010ffff", "a\nb\t c\r\n", "<s> </s> <unk> <0x41>", "é́", "▁", " ▁ a", "�﻿", "trail    "]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    check(library, text)


def test_random_texts(library):
    rng = random.Random(3)
    short = [p for p in pe.model(PATH).ids if len(p) <= 3]
    for _ in range(3000):
        check(library, "".join(rng.choice(short).replace("▁", rng.choice(" ▁")) for _ in range(rng.randint(1, 12))))
        check(library, "".join(rng.choice("abehlnorst .,") for _ in range(rng.randint(1, 30))))


def test_decoding_any_ids(library):
    rng = random.Random(4)
    for _ in range(1000):
        ids = [rng.randrange(32000) if rng.random() < 0.3 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))]
        assert pe.decode(pe.model(PATH), np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_every_prefix_has_one_last_token():
    encoder = pe.encoder(PATH)
    run = "▁unbelievablyhellothere"
    last = encoder._last_tokens(run)
    for end in range(1, len(run) + 1):
        fit = set()
        for token, text in enumerate(encoder.tokens):
            if run[:end].endswith(text):
                before = end - len(text)
                if encoder.fits[last[before] * (encoder.start + 1) + token]:
                    fit.add(token)
        assert fit == {last[end]}


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pe, "REMEMBERED_UNITS", 2)
    monkeypatch.setattr(pe, "REMEMBERED_PAIRS", 3)
    encoder = pe.Encoder(pe.model(PATH))
    text = "some words come again, some words do not come again"
    for _ in range(4):
        assert [ids_of(ids) for ids in encoder.encode([text, "", "other words"])] == [library.encode(t) for t in (text, "", "other words")]


def test_units_end_where_no_piece_reaches_over(library):
    encoder = pe.encoder(PATH)
    text = "▁▁Some▁words,▁²./x9▁日本 (a)"
    assert "".join(encoder.cut.findall(text)) == text
    for left, right in zip(encoder.cut.findall(text), encoder.cut.findall(text)[1:], strict=False):
        assert not any(left[-1] + right[0] in piece for piece in encoder.model.ids)


def test_table(spark, odd, none, library):
    encoded = pe.encode_texts([F.col("doc_id")], F.col("text"), odd, PATH)
    rows = sorted((str(r.doc_id), tuple(ids_of(r.ids))) for r in encoded.collect())
    assert rows == sorted((str(r.doc_id), (1, *library.encode(r.text or ""), 2)) for r in odd.collect())
    decoded = pe.decode_ids(encoded, PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in decoded) == sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in odd.collect())
    assert pe.decode_ids(pe.encode_texts([F.col("doc_id")], F.col("text"), none, PATH), PATH).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pe.query(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = [1, *library.encode(r.text or ""), 2]
        digests = (hashlib.sha256(b).hexdigest() for b in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode()))
        assert got[r.doc_id] == (len(ids), *digests)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        pe.Model(str(tmp_path / "other.model"))
