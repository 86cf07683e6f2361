"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed here (protobuf wire format): pieces with scores and kinds, normaliser settings, model type. From
them a tokenizer is rebuilt: character map, dummy prefix and marked spaces as normalisers, then a unigram model
(scores as they are) or a BPE model (merges ranked by the score of what they make), with bytes for characters that no piece covers.
The result is verified against the SentencePiece library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_by_value

MARK = "▁"
#: A noncharacter, which no text holds.
HIDDEN = "\U0010fffe"
#: Kinds of pieces and of models in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE_MODEL = 1, 2
#: Characters encoded in one call; bounds the memory that the library's results take.
CALL_CHARS = 1 << 19
#: A word with the marked spaces before it, different words kept with their ids, and new words joined for one call of the library.
WORDS, KNOWN_WORDS, JOINED_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+"), 150_000, 100
#: Threads of the library in one Python worker; more than the cores of an executor only wait for each other.
THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + width]
            at += width
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind} is not one of this format")


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    treat_whitespace_as_suffix: bool = False


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 24:
                    model.treat_whitespace_as_suffix = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    unknown = [i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN]
    model.unk_id = unknown[0] if unknown else model.unk_id
    return model


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece; the best score first, then the smaller id, then the longer first part."""
    usable = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    found = []
    for piece, i in usable.items():
        for k in range(1, len(piece)):
            if piece[:k] in usable and piece[k:] in usable:
                found.append((-model.pieces[i][1], i, -k, piece[:k], piece[k:]))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: PieceModel):
    """The encoder of the model; kinds of pieces that the rebuilt form can't express are refused. Ids are decoded by ``decode_ids``."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in model.pieces) or model.treat_whitespace_as_suffix or not model.escape_whitespaces:
        raise ValueError("user-defined or unused pieces, suffix spaces and plain spaces are not supported")
    if model.model_type == UNIGRAM:
        # The names of control pieces and of the unknown one are no text; byte pieces are looked up by name and keep theirs.
        core = models.Unigram([(HIDDEN + p if kind in (CONTROL, UNKNOWN) else p, s) for p, s, kind in model.pieces], model.unk_id, model.byte_fallback)
    elif model.model_type == BPE_MODEL:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)},
            _merges(model),
            unk_token=model.pieces[model.unk_id][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    cuts = [pre_tokenizers.Split(Regex(pattern), "isolated") for pattern in (_word_cut(model), _byte_cut(model)) if pattern]
    if cuts:
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence(cuts)
    return tokenizer


def _word_cut(model: PieceModel) -> str | None:
    """Where no piece runs on past a space, words can be cut apart before the model sees them: the same pieces, much sooner."""
    inner = any(MARK in piece.lstrip(MARK) for piece, _, kind in model.pieces if kind == NORMAL)
    return None if inner else WORDS.pattern


def _byte_cut(model: PieceModel) -> str | None:
    """In a text, the name of a byte piece is no byte."""
    byte_names = model.model_type == UNIGRAM and model.byte_fallback and not any("<0" in piece for piece, _, kind in model.pieces if kind == NORMAL)
    return "<(?=0x[0-9A-F]{2}>)" if byte_names else None


class Encoder:
    """Ids of texts. Where words are cut apart before the model sees them and nothing else is normalised, each different word is encoded once."""

    def __init__(self, model: PieceModel):
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.tokenizer = build(model)
        self.by_word = bool(model.add_dummy_prefix and _word_cut(model)) and not (model.charsmap or model.remove_extra_whitespaces)
        if self.by_word:
            within = _byte_cut(model)
            self.tokenizer.normalizer = normalizers.Sequence([])
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(within), "isolated")] if within else [])
        # Where every marked space is a piece's own start, such pieces tell where joined words begin.
        marked = [piece.startswith(MARK) and kind == NORMAL for piece, _, kind in model.pieces]
        self.starts = np.array(marked) if self.by_word and model.model_type == BPE_MODEL and (MARK, NORMAL) in {(p, kind) for p, _, kind in model.pieces} else None
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit numbers."""
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words of one marked space and more are joined: no piece runs on past a space, so they keep their own pieces."""
        single, rest = [], words if self.starts is None else []
        for w in words if self.starts is not None else ():
            (single if w[0] == MARK and w[1:2] not in ("", MARK) else rest).append(w)
        for at in range(0, len(single), KNOWN_WORDS):
            some = single[at : at + KNOWN_WORDS]
            data = b"".join(self._library(["".join(some[k : k + JOINED_WORDS]) for k in range(0, len(some), JOINED_WORDS)]))
            cuts = [*(4 * np.flatnonzero(self.starts[np.frombuffer(data, np.int32)])).tolist(), len(data)]
            self.known.update((w, data[a:b]) for w, a, b in zip(some, cuts[:-1], cuts[1:], strict=True))
        self.known.update(zip(rest, self._library(rest), strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._library(texts)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        words = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self._learn(list({w for some in words for w in some if w not in self.known}))
        known = self.known.__getitem__
        return [b"".join(map(known, some)) for some in words]


def piece_bytes(model: PieceModel) -> list[bytes]:
    """What each id stands for in a decoded text."""
    out = []
    for piece, _, kind in model.pieces:
        if kind == BYTE:
            out.append(bytes([int(piece[3:5], 16)]))
        elif kind == CONTROL:
            out.append(b"")
        else:
            out.append(" ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode())
    return out


def joined(pieces: list[bytes], add_dummy_prefix: bool) -> str:
    """The text of some pieces, without the dummy prefix."""
    text = b"".join(pieces).decode("utf-8", "replace")
    return text[1:] if add_dummy_prefix and text.startswith(" ") else text


def decode_ids(ids: list[int], table: list[bytes], add_dummy_prefix: bool) -> str:
    """The text of some ids."""
    return joined([table[i] for i in ids], add_dummy_prefix)


def _round_trips(ids: np.ndarray, offsets: np.ndarray, texts: list[str], table: pa.Array, add_dummy_prefix: bool) -> list[bool]:
    """Whether the ids between two offsets decode to their text."""
    pieces = table.take(pa.array(ids))
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[offsets].tolist() if len(ids) else [0] * len(offsets)
    data = pieces.buffers()[2].to_pybytes() if len(ids) else b""
    return [joined([data[a:b]], add_dummy_prefix) == t for a, b, t in zip(ends, ends[1:], texts, strict=False)]


def _calls(texts: list[str]) -> Iterator[list[str]]:
    call, size = [], 0
    for t in texts:
        if call and size + len(t) > CALL_CHARS:
            yield call
            call, size = [], 0
        call.append(t)
        size += len(t)
    if call:
        yield call


def encode_batches(model_bytes: bytes, batches: Iterator[pa.RecordBatch], verify: int) -> Iterator[pa.RecordBatch]:
    """``(id, text)`` batches to ``(doc_id, ids, n_ids, round_trip, parity)``.

    ``verify``: of every call, so many texts are compared with the SentencePiece library (-1: all); the others' parity is null.
    """
    os.environ["RAYON_NUM_THREADS"] = str(THREADS)  # read when the library first starts its threads
    parsed = parse_model(model_bytes)
    encoder, table = Encoder(parsed), pa.array(piece_bytes(parsed), pa.binary())
    judge = None
    if verify:
        import sentencepiece

        judge = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    for batch in batches:
        start = 0
        for call in _calls([t or "" for t in batch.column(1).to_pylist()]):
            ids = encoder.encode_bytes(call)
            parity: list[bool | None] = [None] * len(call)
            if judge is not None:
                n = len(call) if verify < 0 else min(verify, len(call))
                parity[:n] = [a == judge.encode_as_numpy(t).astype(np.int32, copy=False).tobytes() for a, t in zip(ids, call[:n], strict=False)]
            flat = np.frombuffer(b"".join(ids), np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            lengths = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, len(call)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(lengths),
                    pa.array(_round_trips(flat, offsets, call, table, parsed.add_dummy_prefix)),
                    pa.array(parity, pa.bool_()),
                ],
                ["doc_id", "ids", "n_ids", "round_trip", "parity"],
            )
            start += len(call)


def encode_documents(docs: DataFrame, model_path: str, verify: int = -1, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids, n_ids, round_trip, parity`` of every whole text.

    ``round_trip`` tells whether decoding gives the text itself back (a normaliser may fold characters); ``parity`` whether the
    SentencePiece library gives the same ids for the whole text, for ``verify`` texts of each call (-1: all, others null). An empty or null text has no ids.
    Repeated rows are encoded alike; an empty table gives no rows; other columns are ignored. The model file is read on the driver.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(
        rows,
        lambda batches: encode_batches(model.value, batches, verify),
        "doc_id long, ids array<int>, n_ids int, round_trip boolean, parity boolean",
    )


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of every row of ids; null ids give a null text, ids outside the vocabulary none of it."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = parse_model(model.value)
        table = piece_bytes(parsed)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            known = [None if x is None else [i for i in x if i is not None and 0 <= i < len(table)] for x in rows]
            texts = [None if x is None else decode_ids(x, table, parsed.add_dummy_prefix) for x in known]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select(F.col(row_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")), decode, "doc_id long, text string")


ship_by_value(__name__)
