"""Measurements on label rasters.

A raster is either a pixel table (``frame keys, y, x, class``), measured by joins of neighbours, or a packed mask
(``h, w, bits``), measured by numpy kernels one raster at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbours to the right of and below a pixel, and their distances: each edge once.
EDGES = ((0, 1, 1.0), (1, 0, 1.0), (1, 1, math.sqrt(2.0)), (1, -1, math.sqrt(2.0)))


def _edges(pixels: DataFrame, frame: list[str], label: str | None = None) -> DataFrame:
    """``*frame, weight, label, other``: pairs of neighbouring pixels, each once."""
    extra = [F.col(label).alias("label")] if label else []
    here = pixels.select(*frame, "y", "x", *extra)
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("weight")) for dy, dx, w in EDGES)))
    asked = here.withColumn("s", steps).select(*frame, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("s.weight").alias("weight"), *(["label"] if label else []))
    other = here.withColumnRenamed("label", "other") if label else here
    return asked.join(other, [*frame, "y", "x"])


def edge_length(pixels: DataFrame, frame: list[str], single: float = 1.0) -> DataFrame:
    """``pixels, length`` of each frame: steps of 1 along rows and columns, of the root of 2 along diagonals; a lone pixel counts ``single``."""
    n = pixels.groupBy(*frame).agg(F.count(F.lit(1)).alias("pixels"))
    sums = _edges(pixels, frame).groupBy(*frame).agg(F.sum("weight").alias("length"))
    return n.join(sums, frame, "left").withColumn("length", F.when(F.col("pixels") == 1, F.lit(single)).otherwise(F.coalesce("length", F.lit(0.0))))


def edge_length_by_label(pixels: DataFrame, frame: list[str], label: str) -> DataFrame:
    """``label, length``: an edge between two labels counts half for each, so labels add up to the whole. Labels of 0 or less don't count."""
    n = pixels.groupBy(*frame).agg(F.count(F.lit(1)).alias("__n"))
    edges = _edges(pixels, frame, label).where("label > 0 AND other > 0")
    halves = edges.select(*frame, F.explode(F.array("label", "other")).alias("label"), (F.col("weight") / 2).alias("half"))
    sums = halves.groupBy(*frame, "label").agg(F.sum("half").alias("length"))
    every = pixels.where(F.col(label) > 0).select(*frame, F.col(label).alias("label")).distinct()
    out = every.join(sums, [*frame, "label"], "left").join(n, frame)
    return out.withColumn("length", F.when(F.col("__n") == 1, F.lit(1.0)).otherwise(F.coalesce("length", F.lit(0.0)))).drop("__n")


def boundary(pixels: DataFrame, frame: list[str]) -> DataFrame:
    """Pixels that lack one of their eight neighbours."""
    around = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)))
    spread = pixels.select(*frame, "y", "x", around.alias("s")).select(*frame, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    whole = spread.groupBy(*frame, "y", "x").agg(F.count(F.lit(1)).alias("n")).where("n = 8").drop("n")
    return pixels.select(*frame, "y", "x").join(whole, [*frame, "y", "x"], "left_anti")


def lane_memory(pixels: DataFrame, plate: list[str], frame: str, lane: Column) -> DataFrame:
    """``lane, frame, seen``: pixels that a lane has had up to each of the plate's frames (a pixel once seen stays)."""
    first = pixels.groupBy(*plate, lane.alias("lane"), "y", "x").agg(F.min(frame).alias("__first"))
    new = first.groupBy(*plate, "lane", F.col("__first").alias(frame)).agg(F.count(F.lit(1)).alias("__new"))
    grid = pixels.select(*plate, frame).distinct().join(first.select(*plate, "lane").distinct(), plate)
    from .windows import series, so_far

    counted = grid.join(new, [*plate, "lane", frame], "left")
    seen = F.sum(F.coalesce("__new", F.lit(0))).over(so_far(series([*plate, "lane"], [frame])))
    return counted.select(*plate, "lane", frame, seen.alias("seen"))


def merged_classes(layers: DataFrame, frame: list[str], label: str, priority: Column) -> DataFrame:
    """One class for each pixel: that of the highest priority, of equal ones the larger class."""
    return layers.groupBy(*frame, "y", "x").agg(F.max_by(label, F.struct(priority, F.col(label))).alias(label))


def half_size(pixels: DataFrame, frame: list[str], label: str) -> DataFrame:
    """The next level of a pyramid: every second pixel of every second row."""
    return pixels.where("y % 2 = 0 AND x % 2 = 0").select(*frame, F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x"), label)


def moved(pixels: DataFrame, dx: int, dy: int, height: int, width: int) -> DataFrame:
    """The pixels shifted; those that leave the picture go."""
    return pixels.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx}).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


# ---- kernels on one raster ------------------------------------------------------------------------------------


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of the 8-connected parts of a mask, from 1 in reading order; 0 elsewhere. Union of runs of adjoining rows."""
    mask = np.asarray(mask, bool)
    labels = np.zeros(mask.shape, np.int32)
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], row, [False]]).astype(np.int8)))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            touching = [i for c, d, i in before if c <= b and d >= a]
            if touching:
                i = min(root(t) for t in touching)
                for t in touching:
                    parent[root(t)] = i
            else:
                i = len(parent)
                parent.append(i)
            labels[y, a:b] = i
            now.append((a, b, i))
        before = now
    roots = np.array([root(i) for i in range(len(parent))])
    final, order = {0: 0}, np.zeros(len(parent), np.int32)
    for i in range(1, len(parent)):
        order[i] = final.setdefault(int(roots[i]), len(final))
    return order[labels]


def skeleton(mask: np.ndarray) -> np.ndarray:
    """The mask thinned to lines one pixel wide (two alternating parallel passes after Zhang and Suen)."""
    m = np.pad(np.asarray(mask, np.uint8), 1)
    while True:
        gone = 0
        for phase in (0, 1):
            around = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            n = sum(a.astype(np.int8) for a in around)
            turns = sum(((a == 0) & (b == 1)).astype(np.int8) for a, b in zip(around, around[1:] + around[:1], strict=True))
            up, right, down, left = around[0], around[2], around[4], around[6]
            open_sides = (up * right * down == 0) & (right * down * left == 0) if phase == 0 else (up * right * left == 0) & (up * down * left == 0)
            off = (m[1:-1, 1:-1] == 1) & (n >= 2) & (n <= 6) & (turns == 1) & open_sides
            m[1:-1, 1:-1][off] = 0
            gone += int(off.sum())
        if not gone:
            return m[1:-1, 1:-1].astype(bool)


def mask_edge_length(mask: np.ndarray, single: float = 1.0) -> float:
    m = np.asarray(mask, bool)
    if m.sum() == 1:
        return single
    straight = (m[:, 1:] & m[:, :-1]).sum() + (m[1:] & m[:-1]).sum()
    slanted = (m[1:, 1:] & m[:-1, :-1]).sum() + (m[1:, :-1] & m[:-1, 1:]).sum()
    return float(straight + math.sqrt(2.0) * slanted)


def neighbours(mask: np.ndarray) -> np.ndarray:
    """How many of its eight neighbours each pixel of the mask has."""
    m = np.pad(np.asarray(mask, np.int8), 1)
    h, w = m.shape
    n = sum(m[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    return np.where(m[1:-1, 1:-1] > 0, n, 0)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with every hole (background that doesn't reach the border) filled."""
    outside = components(np.pad(~np.asarray(mask, bool), 1, constant_values=True))
    # Diagonal gaps are no way out: background counts as connected by edges only, so seal them first.
    m = np.asarray(mask, bool)
    reach = np.zeros((m.shape[0] + 2, m.shape[1] + 2), bool)
    reach[0], reach[-1], reach[:, 0], reach[:, -1] = True, True, True, True
    free = np.pad(~m, 1, constant_values=True) & (outside > 0)
    while True:
        grown = reach.copy()
        grown[1:] |= reach[:-1]
        grown[:-1] |= reach[1:]
        grown[:, 1:] |= reach[:, :-1]
        grown[:, :-1] |= reach[:, 1:]
        grown &= free
        grown |= reach
        if (grown == reach).all():
            return ~reach[1:-1, 1:-1]
        reach = grown


def owners(mask: np.ndarray, seeds: list[list[tuple[int, int]]], discount: list[float] | None = None) -> np.ndarray:
    """For each mask pixel the number (from 1) of the nearest seed group, less its discount; the first of equals; 0 elsewhere."""
    ys, xs = np.nonzero(mask)
    out = np.zeros(np.shape(mask), np.int32)
    best = np.full(len(ys), np.inf)
    owner = np.zeros(len(ys), np.int32)
    for k, points in enumerate(seeds):
        for y, x in points:
            d = np.hypot(ys - y, xs - x) - (discount[k] if discount else 0.0)
            closer = d < best
            best[closer], owner[closer] = d[closer], k + 1
    out[ys, xs] = owner
    return out


def geodesic_owners(lines: np.ndarray, seeds: list[list[tuple[int, int]]]) -> np.ndarray:
    """For each pixel of a skeleton the nearest seed group along the skeleton; the first of equals; 0 where none leads."""
    import heapq

    m = np.asarray(lines, bool)
    cost = np.full(m.shape, np.inf)
    out = np.zeros(m.shape, np.int32)
    heap = [(0.0, k + 1, y, x) for k, points in enumerate(seeds) for y, x in points if m[y, x]]
    heapq.heapify(heap)
    while heap:
        d, k, y, x = heapq.heappop(heap)
        if out[y, x]:
            continue
        cost[y, x], out[y, x] = d, k
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                v, u = y + dy, x + dx
                if (dy or dx) and 0 <= v < m.shape[0] and 0 <= u < m.shape[1] and m[v, u] and not out[v, u]:
                    heapq.heappush(heap, (d + (math.sqrt(2.0) if dy and dx else 1.0), k, v, u))
    return out


def unpack(h: int, w: int, bits: bytes) -> np.ndarray:
    """The index mask of a packed raster: one byte for each pixel, row by row."""
    return np.frombuffer(bits, np.uint8).reshape(h, w)


COMPONENT_FIELDS = "component int, area int, x int, y int, w int, h int, cx double, cy double, pixels int, length double, tips int, nodes int"


def component_table(mask: np.ndarray) -> pd.DataFrame:
    """One row for each connected part. The whole mask is thinned at once: parts that don't touch don't matter to each other."""
    labels = components(mask)
    k = int(labels.max(initial=0))
    ys, xs = np.nonzero(labels)
    own = labels[ys, xs]
    count = lambda at, weights=None: np.bincount(labels[at], weights, k + 1)[1:]
    area = count((ys, xs))
    ends = {}
    for name, v in (("x", xs), ("y", ys)):
        low, high = np.full(k + 1, np.iinfo(np.int64).max), np.full(k + 1, -1)
        np.minimum.at(low, own, v)
        np.maximum.at(high, own, v)
        ends[name] = low[1:], high[1:]
    lines = skeleton(mask)
    n = neighbours(lines)
    pixels = count(np.nonzero(lines))
    length = np.zeros(k)
    h, w = lines.shape
    for dy, dx, weight in EDGES:
        here, there = lines[: h - dy, max(0, -dx) : w - max(0, dx)], lines[dy:, max(0, dx) : w - max(0, -dx)]
        at_y, at_x = np.nonzero(here & there)
        length += weight * count((at_y, at_x + max(0, -dx)))
    return pd.DataFrame(
        {
            "component": np.arange(1, k + 1),
            "area": area,
            "x": ends["x"][0],
            "y": ends["y"][0],
            "w": ends["x"][1] - ends["x"][0] + 1,
            "h": ends["y"][1] - ends["y"][0] + 1,
            "cx": count((ys, xs), xs) / np.maximum(area, 1),
            "cy": count((ys, xs), ys) / np.maximum(area, 1),
            "pixels": pixels,
            "length": np.where(pixels == 1, 1.0, length),
            "tips": count(np.nonzero(n == 1)),
            "nodes": count(np.nonzero(n >= 3)),
        }
    )


def measure_components(rasters: DataFrame, keys: list[str], classes: list[int], least: int = 1) -> DataFrame:
    """Each connected part, of ``least`` pixels or more, of the given classes: area, box, centroid, skeleton pixels and length, tips, nodes."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema), COMPONENT_FIELDS])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                parts = component_table(np.isin(unpack(r.h, r.w, r.bits), classes))
                parts = parts[parts["area"] >= least]
                yield pd.concat([pd.DataFrame({c: [getattr(r, c)] * len(parts) for c in keys}, index=parts.index), parts], axis=1)

    return rasters.select(*keys, "h", "w", "bits").mapInPandas(measure, fields)


def packed_masks(pixels: DataFrame, keys: list[str], label: str, height: int, width: int) -> DataFrame:
    """``*keys, h, w, bits``: masks of ``height`` by ``width`` from a pixel table; the pixels of one raster meet in one task."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*keys).schema), "h int, w int, bits binary"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height, width), np.uint8)
        mask[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows[label].to_numpy()
        return pd.DataFrame([(*(rows[c].iloc[0] for c in keys), height, width, mask.tobytes())], columns=[*keys, "h", "w", "bits"])

    return pixels.select(*keys, "y", "x", label).groupBy(*keys).applyInPandas(fill, fields)


def pixel_table(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, y, x, class`` of every pixel that isn't background."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema), "y int, x int, class int"])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                mask = unpack(r.h, r.w, r.bits)
                ys, xs = np.nonzero(mask)
                yield pd.DataFrame({**{c: getattr(r, c) for c in keys}, "y": ys.astype("int32"), "x": xs.astype("int32"), "class": mask[ys, xs].astype("int32")}, index=range(len(ys)))

    return rasters.select(*keys, "h", "w", "bits").mapInPandas(spread, fields)


def changed_rasters(rasters: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], Iterator[tuple[str, np.ndarray]]]) -> DataFrame:
    """``*keys, variant, h, w, bits``: what ``kernel`` makes of each raster, one raster at a time."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema), "variant string, h int, w int, bits binary"])

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                for name, m in kernel(unpack(r.h, r.w, r.bits)):
                    m = np.ascontiguousarray(m, np.uint8)
                    yield pd.DataFrame([(*(getattr(r, c) for c in keys), name, *m.shape, m.tobytes())], columns=[*keys, "variant", "h", "w", "bits"])

    return rasters.select(*keys, "h", "w", "bits").mapInPandas(change, fields)
