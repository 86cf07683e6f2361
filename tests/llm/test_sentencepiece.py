"""The rebuilt tokenizers against the SentencePiece library."""

import random
import struct

import pytest
import sentencepiece
from verdance.llm.queries import MODEL_PATH
from verdance.llm.sentencepiece_codec import Encoder, build, decode_documents, decode_ids, encode_documents, parse_model, piece_bytes

PROBES = ["", " ", "  ", "a", "  a  b ", "\n\n\t x", "<s>hi</s><unk><0x0A>", "😀 ünï\x00 zz", "a" * 3000, "日本語テキスト", "‍﻿q", "foo\r\nbar   baz      ", "é ß Ø"]


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def unigram_model():
    """A small unigram model written by hand: bytes, letters and some pieces with fixed scores."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -2.0, 1)] + [(c, -4.0 - i / 10, 1) for i, c in enumerate("abcdefghij")]
    pieces += [("▁ab", -3.0, 1), ("abc", -5.5, 1), ("bcd", -5.25, 1), ("▁abcd", -6.0, 1), ("cde", -5.0, 1), ("hij", -4.5, 1), ("▁hi", -5.75, 1)]
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + (_field(3, k) if k != 1 else b"")) for p, s, k in pieces)
    trainer = _field(3, 1) + _field(4, len(pieces)) + _field(35, 1)
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 1) + _field(4, 0) + _field(5, 1)
    return out + _field(2, trainer) + _field(3, normalizer)


@pytest.fixture(params=["bpe", "unigram"])
def model(request):
    return open(MODEL_PATH, "rb").read() if request.param == "bpe" else unigram_model()


def test_parity(model):
    judge = sentencepiece.SentencePieceProcessor(model_proto=model)
    parsed = parse_model(model)
    tokenizer, table = build(parsed), piece_bytes(parsed)
    rng = random.Random(0)
    texts = PROBES + ["".join(rng.choice("abcdefghij  xé") for _ in range(rng.randrange(80))) for _ in range(300)]
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == judge.encode(text), text
        assert decode_ids(e.ids, table, parsed.add_dummy_prefix) == judge.decode(e.ids) == text


def test_words_encoded_once_make_the_same_ids(model):
    judge = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(1)
    parts = [" ", "  ", "\u2581", "a", "the", "abcd", "é", "机", "\n", "<0x0A>", "<s>", "\t", "😀", "hi"]
    texts = PROBES + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(2000)]
    encoder = Encoder(parse_model(model))
    assert encoder.by_word
    for _ in range(2):
        assert encoder.encode(texts) == [list(x) for x in judge.encode(texts)]


def test_documents(spark):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*PROBES, None, "word " * 40_000])], "doc_id long, text string, ids string")
    out = encode_documents(rows, MODEL_PATH, verify=-1)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(PROBES) + 2 and all(r.round_trip and r.parity and r.n_ids == len(r.ids) for r in got.values())
    assert got[len(PROBES)].n_ids == 0
    back = {r.doc_id: r.text for r in decode_documents(out, MODEL_PATH).collect()}
    assert [back[i] for i in range(len(PROBES))] == PROBES


def test_registered_users_check_every_text(spark, sf_dir):
    import corpus_pipeline
    from verdance.llm.queries import op10_sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for out in (op10_sentencepiece(spark, sf_dir), corpus_pipeline.encoding(spark, docs, sf_dir)):
        assert out.where("parity").count() == docs.count()
