"""Exact top-k inner products with a bit-sliced index.

Rows come in blocks. In a block every quantised attribute is stored as bit slices: bitmap ``b`` of attribute ``d`` has
a bit for each row, set if bit ``b`` of the row's value (less the block's minimum) is set. For one query
the slices are shifted by the signed digits of the query's numbers and added with bitmap full adders, which gives the slices of all
scores at once. The top k are then selected from the most significant slice downward; rows still
level at the last slice are the boundary, resolved by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, ship_by_value

#: Rows in a block, and queries sent to the executors at once (with 64 attributes 2 MB).
BLOCK_ROWS, QUERY_BLOCK = 16384, 4096
#: Scores beyond this could leave 64 bits; such a block is scored with unbounded integers instead.
SAFE = 1 << 62
LONG = (1 << 63) - 1


def quantise(vectors: pa.Array, step: float) -> list[np.ndarray | None]:
    """``floor(step * x)`` of every vector, None for one that takes no part."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = v.values if v.is_valid else None
        if x is None or not len(x) or x.null_count:
            out.append(None)
            continue
        x = np.floor(x.to_numpy(zero_copy_only=False).astype(np.float64) * step)
        out.append(x if np.isfinite(x).all() else None)
    return out


def signed_digits(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``q[d] = sum(sign * 2**shift)`` with no two neighbouring digits: attribute, shift and sign of each digit."""
    d, shifts, signs = [], [], []
    left, sign = np.abs(q).astype(np.int64), np.sign(q).astype(np.int64)
    shift = 0
    while left.any():
        digit = np.where(left & 1, 2 - (left & 3), 0)
        found = np.flatnonzero(digit)
        d.append(found)
        shifts.append(np.full(len(found), shift))
        signs.append(digit[found] * sign[found])
        left = (left - digit) >> 1
        shift += 1
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return join(d), join(shifts), join(signs)


class BitSlices:
    """The index of one block: rows ordered by id, so that the lowest bit is the smallest id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.n, self.d = self.values.shape
        shifted = self.values - self.values.min(axis=0)
        self.bits = np.array([int(x).bit_length() for x in shifted.max(axis=0)], np.int64)
        self.base = np.cumsum(self.bits) - self.bits
        self.words = -(-self.n // 64)
        slices = np.zeros((int(self.bits.sum()), self.words * 8), np.uint8)
        for d in range(self.d):
            for b in range(int(self.bits[d])):
                packed = np.packbits(((shifted[:, d] >> b) & 1).astype(np.uint8), bitorder="little")
                slices[self.base[d] + b, : len(packed)] = packed
        slices = slices.view(np.uint64)
        self.slices = np.concatenate([slices, ~slices])
        self.all = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.all[: len(packed)] = packed
        self.all = self.all.view(np.uint64)

    def _score_slices(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of each row's score less a number that is the same for all rows of the block."""
        d, shifts, signs = signed_digits(q)
        counts = self.bits[d]
        total = int(counts.sum())
        if not total:
            return []
        inner = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        # A negative digit adds the complement: -v = (2**bits - 1 - v) - (2**bits - 1).
        which = np.repeat(self.base[d] + np.where(signs < 0, len(self.slices) // 2, 0), counts) + inner
        weights = np.repeat(shifts, counts) + inner
        order = np.argsort(weights, kind="stable")
        which, weights = which[order], weights[order]
        top = int(weights[-1])
        at = np.searchsorted(weights, np.arange(top + 2))
        out, carries, w = [], [], 0
        while w <= top or carries:
            column = [self.slices[which[at[w] : at[w + 1]]]] if w <= top else []
            rows = np.concatenate([*column, *carries]) if column or carries else np.zeros((0, self.words), np.uint64)
            carries = []
            while len(rows) > 2:
                k = len(rows) // 3
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                x = a ^ b
                carries.append((a & b) | (x & c))
                rows = np.concatenate([x ^ c, rows[3 * k :]])
            if len(rows) == 2:
                carries.append((rows[:1] & rows[1:]))
                rows = rows[:1] ^ rows[1:]
            out.append(rows[0] if len(rows) else np.zeros(self.words, np.uint64))
            w += 1
        return out

    def top(self, query_id: int, q: np.ndarray, k: int) -> np.ndarray:
        """Places (in order of ids) of the k best rows but the query's own, level scores by smaller id."""
        level = self.all.copy()
        low, high = np.searchsorted(self.ids, [query_id, query_id + 1]) if query_id < LONG else (np.searchsorted(self.ids, query_id), self.n)
        for own in range(int(low), int(high)):
            level[own >> 6] &= ~np.uint64(1 << (own & 63))
        chosen = np.zeros_like(level)
        for s in reversed(self._score_slices(q)):
            ones = level & s
            n = int(np.bitwise_count(chosen).sum() + np.bitwise_count(ones).sum())
            if n > k:
                level = ones
            else:
                chosen |= ones
                level = level & ~s
                if n == k:
                    break
        places = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        sure = places(chosen)
        return np.concatenate([sure, places(level)[: max(0, k - len(sure))]]) if len(sure) < k else sure


def _wide_top(ids: np.ndarray, rows: list[np.ndarray], query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The same for numbers too large for 64-bit scores; a score beyond 64 bits is given as the nearest that fits."""
    q = [int(x) for x in q]
    scores = [(-sum(a * int(b) for a, b in zip(q, x, strict=True)), int(i)) for i, x in zip(ids, rows, strict=True) if i != query_id]
    return [(i, max(-LONG - 1, min(LONG, -s))) for s, i in sorted(scores)[:k]]


def search(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, np.ndarray]], k: int, step: float) -> Iterator[pa.RecordBatch]:
    """The best k of each block for each query."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
    for query_id, q in queries:
        by_width.setdefault(len(q), []).append((query_id, q))
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def block(width: int) -> pa.RecordBatch:
        rows = held.pop(width)
        ids = np.array([i for i, _ in rows], np.int64)
        matrix = np.array([x for _, x in rows], np.float64)
        out: list[tuple[int, int, int]] = []
        largest = max(float(np.abs(matrix).max()), 1.0)
        asked = by_width.get(width, [])
        narrow = largest * 4 * max((float(np.abs(q).sum()) for _, q in asked), default=0) < SAFE and largest < 1 << 52
        index = BitSlices(ids, matrix.astype(np.int64)) if narrow and asked else None
        for query_id, q in asked:
            if index is not None:
                q = q.astype(np.int64)
                best = index.top(query_id, q, k)
                out += zip([query_id] * len(best), index.ids[best].tolist(), (index.values[best] @ q).tolist(), strict=True)
            else:
                out += [(query_id, i, s) for i, s in _wide_top(ids, list(matrix), query_id, q, k)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), quantise(batch.column(1), step), strict=True):
            if i is not None and x is not None and len(x) in by_width:
                rows = held.setdefault(len(x), [])
                rows.append((i, x))
                if len(rows) >= BLOCK_ROWS:
                    yield block(len(x))
    for width in list(held):
        yield block(width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, step: float = 256.0, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` largest integer inner products of each query with all other rows: ``query_id, rank, vec_id, score``.

    Rows with a null id, and vectors that are null, empty or hold null or non-finite components, take no part, nor do pairs of
    different lengths. Rows with the query's id are its own. An id that occurs in several query rows asks with the smallest of its
    vectors. Level scores go to the smaller id; an empty table gives no rows; other columns are ignored. Each block of
    at most ``QUERY_BLOCK`` queries is one pass over all rows; the driver holds no more than one block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(row_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    asked = (
        vectors.where(is_query)
        .select(F.col(row_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
        .where("vec_id IS NOT NULL AND vector IS NOT NULL")
        .where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )
    found: list[DataFrame] = []

    def ask(block: list[tuple[int, np.ndarray]], whole: bool) -> None:
        sent = spark.sparkContext.broadcast(block)
        out = map_arrow(rows, lambda batches: search(batches, sent.value, k, step), "query_id long, vec_id long, score long")
        found.append(out if whole else cut(out))

    block: list[tuple[int, np.ndarray]] = []
    for r in asked.toLocalIterator():
        x = quantise(pa.array([r["vector"]]), step)[0]
        if x is not None:
            block.append((r["vec_id"], x))
        if len(block) == QUERY_BLOCK:
            ask(block, False)
            block = []
    if block or not found:
        ask(block, not found)
    each = found[0]
    for more in found[1:]:
        each = each.unionAll(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ship_by_value(__name__)
