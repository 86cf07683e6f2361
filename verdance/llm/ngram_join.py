"""Exact Jaccard join of word n-gram sets by filtering under multiple global token orders.

Two sets of similarity ``t`` have ``k`` tokens in common among the first ``n - ceil(t * n) + k`` of each, under any one order of all
tokens; here ``k`` is a twentieth of the smaller set. So candidates must share that many prefix tokens under each of several orders, and
only what passes all filters is verified:

1. one pass gives each text's set size and digest, and the tokens frequent in any slice of the corpus. Texts with equal
   sets are one class from here on. Every order has the frequent tokens last, by frequency, and the others in a random sequence of its own;
2. prefix tokens under the first order are dealt by token, those of frequent tokens by parts of their classes as well; tokens of a single
   class drop out, and so do classes left with fewer than they must share. The classes left are dealt under the other orders likewise;
3. of what a class shares only its rarest tokens are needed, as many as are sure to hold one of those in common. Classes form
   blocks by the most common of them; large ones are split into parts;
4. blocks are compared within themselves, parts of a split one also with one class that stands for all parts. Blocks that are of one
   component by then count as one unit, any other block as a unit of its own: what is linked already is not compared again, so a group of
   near copies takes time in proportion to its size;
5. units that share a token under every order are paired. They are sent in tiles: those that meet the same large unit lie together, and a component of
   many blocks is cut into tiles of its own, of which one goes first. A set is sent once for each pair of tiles, however many units it meets
   there; of the pairs of sets, those that share enough prefix tokens under every order are verified. What each comparison connects goes on
   to the connected components as a star.

No step expands the pairs of a group. Tiles grow with the root of a group beyond ``TILE_COUNT`` of them, so what is sent of a group of ``g`` classes without links
among them grows less than with its square, as ``g ** 1.5``; within a task tiles are compared piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, map_arrow, ship_by_value, text_slices
from .components import components
from .textkernel import SPACE, mix, words

#: Bytes of text worked on at once; tokens counted together while looking for frequent ones, and what frequent means: so often
#: in such a slice, and in so large a share of its texts.
SLICE, COUNTED_TOKENS, FREQUENT, FREQUENT_SHARE = 1 << 20, 4_000_000, 4, 1 / 5000
#: Frequent tokens that are broadcast at most (the most frequent), and ids that are broadcast at most; more ids are joined.
MOST_FREQUENT, BROADCAST_IDS = 1 << 20, 1_000_000
#: Classes in a block at most, on average. Pairs of blocks are compared in dense columns of so many tokens.
BLOCK, COLUMNS = 64, 8192
#: Classes in a tile, on average, until so many tiles of one key are reached (beyond, tiles and their number grow alike), and tokens in a tile.
TILE, TILE_COUNT, TILE_TOKENS = 256, 16, 1 << 21
#: Classes, and tokens, that are compared at once with as many others.
PIECE, PIECE_TOKENS = 128, 1 << 20
ORDERS = 3
#: Classes of a frequent token that are dealt together, about.
HOT = 100_000
#: Prefix tokens in common that are asked for, in hundredths of a set.
SHARED_PERCENT = 5


def token_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of all texts, ascending within each, and the texts' bounds.

    Words are runs without ASCII white space, letters A-Z made small. A text of fewer words has one token, the whole of it.
    """
    _, _, h, bounds = words(data, offsets, ~SPACE)
    counts = np.diff(bounds)
    n = len(h)
    grams = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        grams[: n - k] += h[k:] * (mix(np.array([k + 1], np.uint64)) | np.uint64(1))
    grams = mix(grams)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(counts):
        a, b = bounds[i], bounds[i + 1]
        if counts[i] >= size:
            tokens = np.unique(grams[a : b - size + 1])
        else:
            tokens = counts[i : i + 1].astype(np.uint64)
            for k in range(a, b):
                tokens = mix(tokens * np.uint64(31) + h[k : k + 1])
        out.append(tokens)
        sizes[i] = len(tokens)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    d = hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set that hold what it must share with any set like it."""
    return min(n, n - (-(-percent * n // 100)) + max(1, n * SHARED_PERCENT // 100))


def least_shared(n, percent: int):
    """Prefix tokens that a set of ``n`` tokens shares at least with any set like it, as a column."""
    smallest = F.floor((n * percent + 99) / 100)
    return F.greatest(F.lit(1), F.floor(smallest * SHARED_PERCENT / 100))


class Orders:
    """The global orders: frequent tokens last."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.counts = counts[order].astype(np.int64)
        level = np.log2(np.maximum(counts[order], 1)).astype(np.uint64) + np.uint64(1)
        self.levels = np.minimum(level, np.uint64(31))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.tokens & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def known(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the tokens are frequent, and their places among the frequent ones."""
        if not len(self.tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(tokens & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.tokens, tokens[at]), len(self.tokens) - 1)
        hit = self.tokens[place] == tokens[at]
        return at[hit], place[hit]

    def ranks(self, tokens: np.ndarray, which: int) -> np.ndarray:
        """Numbers in the sequence of the order ``which``: a bijection of tokens but for the five lowest bits of the mix."""
        rank = mix(tokens + np.uint64((which + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(5)
        at, place = self.known(tokens)
        rank[at] |= self.levels[place] << np.uint64(59)
        return rank


def prefixes(tokens: np.ndarray, bounds: np.ndarray, orders: Orders, which: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the prefix tokens of each set, the bounds, and how often each is known to occur (0: not frequent).

    A rank stands for its token: equal tokens have equal ranks.
    """
    ranks = orders.ranks(tokens, which)
    out, often, sizes = [], [], np.zeros(len(bounds) - 1, np.int64)
    at, place = orders.known(tokens)
    counts = np.zeros(len(tokens), np.int64)
    counts[at] = orders.counts[place]
    for i in np.flatnonzero(np.diff(bounds)):
        mine = ranks[bounds[i] : bounds[i + 1]]
        p = prefix_size(len(mine), percent)
        # Equal ranks of different tokens stay together, so that the prefix is one under any way of ordering them.
        cut_at = np.partition(mine, p - 1)[p - 1]
        within = np.flatnonzero(mine <= cut_at)
        mine, first = np.unique(mine[within], return_index=True)
        out.append(mine)
        often.append(counts[bounds[i] : bounds[i + 1]][within[first]])
        sizes[i] = len(mine)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return (np.concatenate(out), ends, np.concatenate(often)) if out else (np.zeros(0, np.uint64), ends, np.zeros(0, np.int64))


def _describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(0, id, n, digest, digest)`` of the texts and ``(1, token, count, null, null)`` of frequent tokens."""
    held: list[np.ndarray] = []
    total = texts = 0
    seen: set[tuple[int, int]] = set()

    def frequent() -> pa.RecordBatch:
        nonlocal total, texts
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        # In order, a token that occurs so often is the same some places on.
        least = int(max(FREQUENT, np.ceil(texts * FREQUENT_SHARE)))
        tokens = np.unique(tokens[least - 1 :][tokens[least - 1 :] == tokens[: len(tokens) - least + 1]]), tokens
        counts = np.searchsorted(tokens[1], tokens[0], "right") - np.searchsorted(tokens[1], tokens[0])
        tokens = tokens[0]
        seen.clear()
        total = texts = 0
        return _rows(1, tokens.view(np.int64), counts, None, None)

    for batch in batches:
        for row, data, offsets in text_slices(batch.column(1), SLICE):
            tokens, bounds = token_sets(data, offsets, size)
            n = np.diff(bounds)
            keys = []
            for i in range(len(n)):
                mine = tokens[bounds[i] : bounds[i + 1]]
                keys.append(digest(mine))
                if n[i] and keys[-1] not in seen:
                    seen.add(keys[-1])
                    held.append(mine)
                    total += len(mine)
                    texts += 1
            ids = batch.column(0).slice(row, len(n))
            yield _rows(0, ids, n, [k for k, _ in keys], [k for _, k in keys])
            if total >= COUNTED_TOKENS:
                yield frequent()
    if held:
        yield frequent()


def _rows(kind: int, a, n, d1, d2) -> pa.RecordBatch:
    size = len(a)
    columns = [pa.array(np.full(size, kind, np.int32)), pa.array(a, pa.int64()) if not isinstance(a, pa.Array) else a, pa.array(n, pa.int64())]
    columns += [pa.nulls(size, pa.int64()) if d is None else pa.array(d, pa.int64()) for d in (d1, d2)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "a", "n", "d1", "d2"])


def _postings(batches: Iterator[pa.RecordBatch], size: int, percent: int, orders: Orders, which: list[int]) -> Iterator[pa.RecordBatch]:
    """``(ord, token, d1, n, often)`` of every prefix token of every different set of this task's slice; ``often`` if the token is known to be hot."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for _, data, offsets in text_slices(batch.column(1), SLICE):
            tokens, bounds = token_sets(data, offsets, size)
            keys = [digest(tokens[bounds[i] : bounds[i + 1]]) if bounds[i + 1] > bounds[i] else None for i in range(len(bounds) - 1)]
            fresh = np.zeros(len(keys), bool)
            for i, k in enumerate(keys):
                if k is not None and k not in seen:
                    seen.add(k)
                    fresh[i] = True
            if len(seen) > 200_000:
                seen.clear()
            n = np.diff(bounds)
            first = np.array([k[0] if k else 0 for k in keys], np.int64)
            for w in which:
                ranks, at, often = prefixes(tokens, bounds, orders, w, percent)
                sizes = np.where(fresh, np.diff(at), 0)
                kept = np.repeat(fresh, np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(int(sizes.sum()), w, np.int32)),
                        pa.array(ranks[kept].view(np.int64)),
                        pa.array(np.repeat(first, sizes)),
                        pa.array(np.repeat(n, sizes).astype(np.int32)),
                        pa.array(often[kept], mask=often[kept] <= HOT),
                    ],
                    ["ord", "token", "d1", "n", "often"],
                )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in text_slices(batch.column(1), SLICE):
            tokens, bounds = token_sets(data, offsets, size)
            each = [tokens[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
            ids = batch.column(0).slice(row, len(each))
            yield pa.RecordBatch.from_arrays([ids, pa.array([digest(x)[0] for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], ["id", "d1", "tokens"])


class _Forest:
    """What links connect; the root of each tree is its least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[p]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.parent[b] = a


def compare(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int, orders: Orders) -> list[tuple[int, int]]:
    """What the links between ``left`` and ``right`` (or within ``left``) connect: pairs of the least id and each other one of a component.

    Verified are the pairs of suiting sizes that share enough prefix tokens under every order.
    """
    sets = left + (right or [])
    sizes = np.array([len(x) for _, x in sets])
    a, b = np.triu_indices(len(left), 1) if right is None else map(np.ravel, np.indices((len(left), len(right))))
    if right is not None:
        b = b + len(left)
    fits = (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])) & (sizes[a] > 0) & (sizes[b] > 0)
    a, b = a[fits], b[fits]
    least = np.maximum(1, np.minimum(sizes[a], sizes[b]) * SHARED_PERCENT // 100)
    tokens, bounds = np.concatenate([x for _, x in sets]), np.concatenate([[0], np.cumsum(sizes)])
    for which in range(ORDERS):
        if not len(a):
            return []
        ranks, at, _ = prefixes(tokens, bounds, orders, which, percent)
        passed = _shared([ranks[at[i] : at[i + 1]] for i in range(len(sets))], a, b) >= least
        a, b, least = a[passed], b[passed], least[passed]
    if not len(a):
        return []
    common = _shared([x for _, x in sets], a, b)
    linked = 100 * common >= percent * (sizes[a] + sizes[b] - common)
    forest = _Forest()
    for i, j in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
        forest.join(sets[i][0], sets[j][0])
    return [(root, x) for x in list(forest.parent) if (root := forest.root(x)) != x]


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs ``(a, b)``: one by one while they are few, or else all at once."""
    if len(a) <= 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    return _common(sets)[a, b]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of dense pieces of the incidence matrix over tokens of two sets or more."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    number = np.cumsum(counts > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        piece = np.zeros((len(sets), COLUMNS), np.float32)
        piece[owner[low:high], column[low:high] - start] = 1
        out += (piece @ piece.T).astype(np.int64)
    return out


def _pieces(sets: list[tuple[int, np.ndarray]]) -> list[list[tuple[int, np.ndarray]]]:
    """Runs of ``PIECE`` sets and ``PIECE_TOKENS`` tokens at most; a larger set comes alone."""
    out: list[list[tuple[int, np.ndarray]]] = []
    total = 0
    for x in sets:
        total += len(x[1])
        if not out or len(out[-1]) >= PIECE or total > PIECE_TOKENS:
            out.append([])
            total = len(x[1])
        out[-1].append(x)
    return out


def _compare_pairs(batches: Iterator[pa.RecordBatch], percent: int, orders: Orders) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair of blocks or tiles ``(p, q, side, id, tokens)``; a pair may go on in the next batch."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key: tuple[str, str] | None = None
    sides: list[list[tuple[int, np.ndarray]]] = [[], []]
    out: list[tuple[int, int]] = []

    def finish() -> None:
        if key is not None and sides[0]:
            left, right = _pieces(sides[0]), _pieces(sides[1])
            for i, piece in enumerate(left):
                if key[0] == key[1]:
                    out.extend(compare(piece, None, percent, orders))
                for other in left[i + 1 :] if key[0] == key[1] else right:
                    out.extend(compare(piece, other, percent, orders))

    for batch in batches:
        p, q, side, ids = (batch.column(i).to_pylist() for i in range(4))
        tokens = batch.column(4)
        for i in range(batch.num_rows):
            if (p[i], q[i]) != key:
                finish()
                key, sides = (p[i], q[i]), [[], []]
            sides[side[i]].append((ids[i], np.frombuffer(tokens[i].as_buffer(), np.uint64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], schema=schema)
            out = []
    finish()
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], schema=schema)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of these ids: broadcast while they are few, a plain join otherwise."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _rarest(postings: DataFrame, percent: int) -> DataFrame:
    """``(ord, token, d1, n, df)``: of the prefix tokens that a class shares with others the rarest, as many as hold one of those it must share.

    Tokens of a single class drop out, and so do classes left with fewer than they must share. Of ``m`` tokens of which ``k``
    are in common with another class, at least one is among the first ``m - k + 1`` of both, here in order of how often they occur. A hot token is
    known to be shared, and how often it occurs at least; its classes are dealt in parts.
    """
    part = F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("d1"), F.ceil(F.col("often") / HOT))).otherwise(F.lit(0))
    of_token, of_class = Window.partitionBy("ord", "token", "part"), Window.partitionBy("ord", "d1")
    sized = postings.withColumn("part", part).withColumns({"low": F.min("d1").over(of_token), "high": F.max("d1").over(of_token), "df": F.coalesce("often", F.count(F.lit(1)).over(of_token))})
    shared = sized.where("low <> high OR often IS NOT NULL").select("ord", "token", "d1", "n", "df").distinct()
    placed = shared.withColumn("place", F.row_number().over(of_class.orderBy("df", "token"))).withColumn("m", F.count(F.lit(1)).over(of_class))
    return placed.where(F.col("place") <= F.col("m") - least_shared(F.col("n"), percent) + 1).select("ord", "token", "d1", "n", "df")


def _own(rarest: DataFrame, blocks: DataFrame, orders: list[int]) -> DataFrame:
    """``block``: those of which, under every order, two classes have a token in common."""
    each = rarest.join(blocks.select("d1", "block").distinct(), "d1").groupBy("ord", "token", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1, ord)")).alias("seen")).where(F.col("seen") == sum(1 << which for which in orders)).select("block")


def _unit_pairs(rarest: DataFrame, units: DataFrame) -> DataFrame:
    """``p, q``: units that have a token of one order in common. For each token only its different units count, so pairs don't grow with classes."""
    each = rarest.join(units.select("d1", "unit").distinct(), "d1").select("token", "unit").distinct()
    return each.select("token", F.col("unit").alias("p")).join(each.select("token", F.col("unit").alias("q")), "token").where("p < q").select("p", "q").distinct()


def _units(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """``blocks`` with ``component``, ``base`` and ``unit``: blocks whose classes are all of one component are one unit, others each their own.

    ``labels`` are ids and the components that are known by now, others are their own. Parts of split blocks are parted once more, by component, as few
    classes without links would keep all of them from being one unit. ``base`` is the block within which all classes have been compared.
    """
    known = blocks.join(labels, "id", "left").withColumns({"base": F.col("block"), "component": F.coalesce("component", "id")})
    several = F.count(F.lit(1)).over(Window.partitionBy("block", "component")) > 1
    known = known.withColumn("block", F.when(F.col("split") & several, F.concat("block", F.lit("="), F.col("component").cast("string"))).otherwise(F.col("block")))
    pure = known.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    unit = F.when(F.col("low") == F.col("high"), F.concat(F.lit("="), F.col("low").cast("string"))).otherwise(F.col("block"))
    return known.join(pure, "block").withColumn("unit", unit).drop("low", "high")


def _apart(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``p, q`` and ``c, tokens, several`` of both units: the pairs but those within one block, which has been compared. ``several``: blocks, more than one."""
    of_unit = units.groupBy("unit").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("tokens"), F.min("base").alias("base"), F.max("base").alias("top"))
    side = lambda s: of_unit.select(F.col("unit").alias(s), *(F.col(x).alias(f"{x}_{s}") for x in ("c", "tokens", "base")), (F.col("base") != F.col("top")).alias(f"several_{s}"))
    return pairs.join(side("p"), "p").join(side("q"), "q").where("several_p OR several_q OR base_p <> base_q").drop("base_p", "base_q")


def _tiled(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``id, d1, n, component, unit, tile`` of the classes of units that meet others.

    A unit of several blocks has tiles of its own, by class. Another goes whole to one of the tiles that belong to the largest unit it meets, so that units that
    meet the same ones lie together.
    """
    end = lambda s, o: pairs.select(F.col(s).alias("unit"), *(F.col(f"{x}_{s}").alias(x) for x in ("c", "tokens", "several")), F.struct(f"c_{o}", o).alias("other"))
    of_unit = end("p", "q").unionAll(end("q", "p").toDF("unit", "c", "tokens", "several", "other"))
    of_unit = of_unit.groupBy("unit", "c", "tokens", "several").agg(F.max("other").alias("other"))
    host = F.col("other").getField("q")
    of_unit = of_unit.select("unit", "c", "tokens", "several", F.when(F.col("several"), F.col("unit")).otherwise(F.concat(F.lit(">"), host)).alias("key"))
    share = F.sum("c") / TILE
    tiles = F.ceil(F.greatest(F.least(share, F.sqrt(share * TILE_COUNT)), F.sum("tokens") / TILE_TOKENS))
    of_unit = of_unit.join(of_unit.groupBy("key").agg(tiles.alias("tiles")), "key").select("unit", "key", "several", "tiles")
    dealt = F.pmod(F.when(F.col("several"), F.xxhash64("d1")).otherwise(F.xxhash64("unit")), "tiles")
    return units.join(of_unit, "unit").select("id", "d1", "n", "component", "unit", F.concat_ws("/", "key", dealt.cast("string")).alias("tile"))


def _sent(members: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """``id, d1, p, q, side``: for each pair of tiles the classes whose size suits some size on the other side, and that aren't of one component with all of it."""
    end = lambda s, o: met.select(F.col(s).alias("unit"), F.col(f"tile_{s}").alias("tile"), F.col(f"tile_{o}").alias("with"), *(F.col(f"{x}_{o}").alias(x) for x in ("least", "most", "low", "high")))
    others = end("p", "q").unionAll(end("q", "p")).groupBy("unit", "tile", "with").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    suits = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent)
    linked = (F.col("low") == F.col("high")) & (F.col("low") == F.col("component"))
    sides = (F.least("tile", "with").alias("p"), F.greatest("tile", "with").alias("q"), F.when(F.col("tile") <= F.col("with"), 0).otherwise(1).alias("side"))
    return others.join(members, ["unit", "tile"]).where(suits & ~linked).select("id", "d1", *sides)


def _joined(units: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component`` after further links: a component takes the least of the components that links lead to from it."""
    of = lambda end: units.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    met = links.join(of("a"), "a").join(of("b"), "b").select("of_a", "of_b").where("of_a <> of_b").distinct()
    least = met.unionAll(met.select("of_b", "of_a")).groupBy(F.col("of_a").alias("component")).agg(F.min("of_b").alias("other"))
    return units.join(least, "component", "left").select("id", F.least("component", F.coalesce("other", "component")).alias("component")).groupBy("id").agg(F.min("component").alias("component"))


def linked_classes(docs: DataFrame, size: int, percent: int, text: str = "text", row_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, d1, d2)`` of every row, and ``(id, component)`` of the class ids that have links.

    A class is all texts with one set; its id is the smallest of theirs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    described = cut(map_arrow(rows, lambda b: _describe(b, size), "kind int, a long, n long, d1 long, d2 long"))
    meta = described.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("n"), "d1", "d2")
    frequent = described.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(MOST_FREQUENT).toArrow()
    orders = spark.sparkContext.broadcast(Orders(frequent["a"].to_numpy().view(np.uint64), frequent["n"].to_numpy()))
    classes = meta.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("id")).select("d1", "id")
    schema = "ord int, token long, d1 long, n int, often long"

    with Scratch(spark) as scratch:
        # First order, all rows: the classes that share enough prefix tokens with others. The other orders, of those classes only.
        rarest, _ = scratch.keep(_rarest(map_arrow(rows, lambda b: _postings(b, size, percent, orders.value, [0]), schema), percent))
        # Blocks: classes by the most common of those tokens, large ones in parts.
        home = rarest.groupBy("d1").agg(F.max(F.struct("df", "token"))["token"].alias("home"), F.min("n").alias("n"))
        sizes = home.groupBy("home").agg(F.count(F.lit(1)).alias("c"))
        part = F.when(F.col("c") <= BLOCK, F.lit(0)).otherwise(F.pmod(F.xxhash64("d1"), F.ceil(F.col("c") / BLOCK)))
        block = F.concat_ws("/", F.hex("home"), part.cast("string")).alias("block")
        blocks, _ = scratch.keep(home.join(sizes, "home").select("d1", "n", "home", (F.col("c") > BLOCK).alias("split"), block).join(classes, "d1"))
        few = _only(rows, blocks.select("id").distinct())
        later, _ = scratch.keep(_rarest(map_arrow(few, lambda b: _postings(b, size, percent, orders.value, list(range(1, ORDERS))), schema), percent))
        order = lambda which: later.where(F.col("ord") == which)

        def verified(asked: DataFrame) -> DataFrame:
            """Links among the sets that ``(id, d1, p, q, side)`` ask for."""
            asked, _ = scratch.keep(asked)
            sets = map_arrow(_only(rows, asked.select("id").distinct()), lambda b: _sets(b, size), "id long, d1 long, tokens binary").dropDuplicates(["id", "d1"])
            dealt = asked.join(sets, ["id", "d1"]).select("p", "q", "side", "id", "tokens").repartition("p", "q").sortWithinPartitions("p", "q", "side")
            links, _ = scratch.keep(map_arrow(dealt, lambda b: _compare_pairs(b, percent, orders.value), "a long, b long"))
            return links

        def between(labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
            """The units that known components make, their classes by tile, and what may hold further links: ``p, q``, a tile of each and what is known of both."""
            units, _ = scratch.keep(_units(blocks, labels))
            pairs = _unit_pairs(rarest, units)
            for which in range(1, ORDERS):
                pairs = pairs.join(_unit_pairs(order(which), units), ["p", "q"], "left_semi")
            pairs, _ = scratch.keep(_apart(pairs, units))
            members, _ = scratch.keep(_tiled(pairs, units))
            of_tile = [F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high")]
            ranges = members.groupBy("unit", "tile").agg(*of_tile)
            side = lambda s: ranges.select(F.col("unit").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("tile", "least", "most", "low", "high")))
            met, _ = scratch.keep(pairs.select("p", "q").join(side("p"), "p").join(side("q"), "q"))
            return units, members, met

        # Within blocks, and the parts of split ones with one class that stands for all of them.
        own = _own(rarest.unionAll(later), blocks, list(range(ORDERS)))
        split = blocks.where("split")
        own = own.unionAll(split.select("block")).distinct()
        hubs = split.groupBy("home").agg(F.min(F.struct("id", "d1", "block")).alias("hub"))
        guests = split.select("home", "block").distinct().join(hubs, "home").where("hub.block <> block").select("hub.id", "hub.d1", "block")
        within = blocks.join(own, "block").select("id", "d1", "block").unionAll(guests)
        first = verified(within.select("id", "d1", F.col("block").alias("p"), F.col("block").alias("q"), F.lit(0).alias("side")))

        # Between blocks that share a token under every order; what is linked by now counts as one. The class that stands for a home has its least id, so
        # what is linked to it has one label in all parts.
        units, members, met = between(first.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")))
        # Where components of many tiles meet, one tile of each goes first: mostly that links them, and the others needn't meet.
        many = met.groupBy("p", "q").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*met.columns)).alias("one")).where("c > 1").select("one.*")
        some = verified(_sent(members, many, percent))
        _, members, met = between(_joined(units, some))
        links = cut(first.unionAll(some).unionAll(verified(_sent(members, met, percent))))
    found = components(links, "a", "b")
    return meta, found.select(F.col("node").alias("id"), "component")


def near_duplicate_classes(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two texts link if their sets of word ``size``-grams have a Jaccard similarity of ``percent`` hundredths or more; the
    component is the smallest id that links lead to. Null and empty texts, and texts without words, have no set and no links. Rows with one id count
    as one document: its texts' links are all its own. A row with a null id has the component of its set's other rows, if any, and
    else null. An empty table gives no rows; other columns are ignored.
    """
    meta, found = linked_classes(docs, size, percent, text, row_id)
    classes = meta.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    ends = classes.join(found, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    return meta.join(ends, ["d1", "d2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns, one document of each component: the one with the smallest id.

    Rows with a null id and rows whose text is null, empty or without words stay; of rows with one id all stay or go; an empty table gives no rows.
    """
    found = cut(near_duplicate_classes(docs, size, percent))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


ship_by_value(__name__)
