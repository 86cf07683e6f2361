"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal, scored as sparse dot products.

A text is a sequence of words (runs without white space). Its features are word unigrams and bigrams, and unigrams and
bigrams of word classes: the sequence of letter cases, digits and signs in a word, with marks for a word that repeats the one
before it and for a pair of words that the text has held before. Each is hashed into one table; a
feature's value is its count over the number of words (``SHORT`` at least), so a score is a mean of weights over the words plus the bias.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release_memory, ship_by_value, text_slices
from .linear import ftrl, labelled_ids, remainder, sample, sigmoid
from .textkernel import SPACE, mix, words

#: Size of the hash table; labelled rows and bytes of their texts learned from at most; bytes of text worked on at once.
TABLE_BITS, SAMPLE_ROWS, SAMPLE_BYTES, SLICE = 20, 4000, 16 << 20, 1 << 20
BIAS = 1 << TABLE_BITS
#: Counts over words are multiplied by this, so that the bias and the other weights learn at like speed.
SCALE = 8.0
#: Fewer words than this prove little either way.
SHORT = 6

CLASS = np.arange(256, dtype=np.uint8)
for _lo, _hi, _as in ((0x30, 0x39, 0x30), (0x41, 0x5A, 0x41), (0x61, 0x7A, 0x61), (0x80, 0xFF, 0x61)):
    CLASS[_lo : _hi + 1] = _as
LETTER = np.isin(CLASS, [0x30, 0x41, 0x61])


def _seen_before(pairs: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Marks each pair that its text has held before."""
    keys = mix(pairs + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Table places of four features for each word, and the bounds of each text's words."""
    _, _, surface, bounds = words(data, offsets, ~SPACE, latin=True)
    kinds = CLASS[data]
    kept = np.ones(len(data), bool)
    kept[1:] = (kinds[1:] != kinds[:-1]) | ~LETTER[data[1:]]
    if len(data):
        kept[offsets[:-1][offsets[:-1] < len(data)]] = True
    places = np.concatenate([[0], np.cumsum(kept)])
    # Small letters are not wanted here: the class of a capital must stay one. 0x41 is moved out of their range.
    shapes = np.where(kinds[kept] == 0x41, 0x5B, kinds[kept]).astype(np.uint8)
    _, _, shape, _ = words(shapes, places[offsets], ~SPACE)
    n = len(surface)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    same_text = np.zeros(n, bool)
    same_text[1:] = text[1:] == text[:-1]
    before, shape_before = np.roll(surface, 1), None
    pair = mix(before * np.uint64(3) + surface)
    doubled = same_text & (before == surface)
    again = _seen_before(pair, text) & same_text
    marked = mix(shape + doubled.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + again.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    shape_before = np.where(same_text, np.roll(marked, 1), np.uint64(0))
    before = np.where(same_text, before, np.uint64(0))
    grams = [
        mix(surface + np.uint64(1)),
        mix(before * np.uint64(5) + surface + np.uint64(2)),
        mix(marked + np.uint64(3)),
        mix(shape_before * np.uint64(5) + marked + np.uint64(4)),
    ]
    return [(g >> np.uint64(64 - TABLE_BITS)).astype(np.int64) for g in grams], bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def score_texts(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    grams, bounds = features(data, offsets)
    each = np.zeros(len(grams[0]))
    for g in grams:
        each += weights[g]
    n = np.maximum(np.diff(bounds), SHORT)
    return sigmoid(weights[BIAS] + SCALE * _sums(each, bounds) / n)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in text_slices(batch.column(1), SLICE):
            grams, bounds = features(data, offsets)
            places, values = [], []
            for i in range(len(bounds) - 1):
                n = bounds[i + 1] - bounds[i]
                at, counts = np.unique(np.concatenate([g[bounds[i] : bounds[i + 1]] for g in grams]), return_counts=True)
                places.append(at.astype(np.int32).tobytes())
                values.append((SCALE * counts / max(n, SHORT)).astype(np.float32).tobytes())
            labels = batch.column(0).slice(row, len(places))
            yield pa.RecordBatch.from_arrays([labels, pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["label", "places", "weights"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", row_id: str = "doc_id") -> np.ndarray:
    """Weights of the model; without labels of both kinds all zero but the bias, which gives the share of label 1."""
    chosen = labelled_ids(labels, "quality", row_id, remainder(row_id, 3) != 1, sample_rows)
    # Bounded by sample_rows and SAMPLE_BYTES; the texts stay where they are.
    learned = sample(docs, chosen, row_id, text, SAMPLE_BYTES)
    sent = map_arrow(learned.select("label", "text"), _rows, "label int, places binary, weights binary").toArrow()
    rows = sorted(
        zip(sent["label"].to_pylist(), (x.as_buffer() for x in sent["places"]), (x.as_buffer() for x in sent["weights"]), strict=True),
        key=lambda r: (r[0], r[1].to_pybytes(), r[2].to_pybytes()),
    )
    targets = np.array([label for label, _, _ in rows], float)
    rows = [(np.append(np.frombuffer(at, np.int32), np.int32(BIAS)), np.append(np.frombuffer(x, np.float32), np.float32(1))) for _, at, x in rows]
    del sent
    if len(set(targets)) < 2:
        weights = np.zeros(BIAS + 1)
        weights[BIAS] = np.clip(targets.sum() * 8 - 4, -4, 4) if len(targets) else 0.0
        return weights
    return ftrl(rows, targets, BIAS + 1)


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Labels are learned from at most ``sample_rows`` labelled ids, one row each, whose crc32(id) mod 3 is not 1; of several labels for an id the largest counts. An empty or null text gets the
    score of the bias; repeated rows get equal scores; an empty table gives no rows; a null id is kept.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows, text, row_id).astype(np.float32))
    release_memory()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score_texts(data, offsets, weights.value) for _, data, offsets in text_slices(batch.column(2), SLICE)]
            scores = np.concatenate([np.zeros(0), *parts]).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), (remainder(row_id, 3) == 1).alias("held_out"), F.col(text).alias("text"))
    return map_arrow(rows, score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier doesn't reject.

    An empty or null text is judged by the bias alone, repeated rows alike; a null id stays if its text is good; an empty table gives no rows. Without labels
    of both kinds all rows stay, or none if all labels are 0.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows).astype(np.float32))
    release_memory()
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score_texts(data, offsets, weights.value) for _, data, offsets in text_slices(batch.column(place), SLICE)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *parts]) >= 0.5))

    return map_arrow(docs, kept, docs.schema)


ship_by_value(__name__)
