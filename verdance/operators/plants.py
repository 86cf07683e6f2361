"""Plants in rasters: regions, routes and shapes, tiles, variants, registration and box identities (numpy kernels, one raster or plate at a time)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import components, mask_edge_length, neighbours, skeleton, unpack

#: Named parts of a plant, in order (fixed values).
REGIONS = ("main_root", "lateral_root", "main_root_tip", "other_tip", "node", "dilated_root_exclusive", "dilated_root", "shoot")


def dilated(mask: np.ndarray, steps: int) -> np.ndarray:
    """The mask grown by ``steps`` pixels in all eight directions: sliding maxima along rows, then columns."""
    m = np.asarray(mask, bool)
    if not steps:
        return m
    for axis in (0, 1):
        total = np.cumsum(np.pad(m, [(steps + 1, steps) if a == axis else (0, 0) for a in (0, 1)]).astype(np.int32), axis=axis)
        high, low = (np.take(total, np.arange(m.shape[axis]) + d, axis=axis) for d in (2 * steps + 1, 0))
        m = high > low
    return m


def plant_labels(occupied: np.ndarray, shoots: np.ndarray, apart: int = 6) -> np.ndarray:
    """A number from 1 for each occupied pixel, counting plants from left to right by their mean x; 0 elsewhere.

    A shoot's pixels are its plant's; all others belong to the shoot whose mean place is nearest. Without shoots, pixels
    that grow together within ``apart`` steps are one plant.
    """
    label = np.zeros(occupied.shape, np.int32)
    ys, xs = np.nonzero(occupied)
    if shoots.any():
        anchors = components(shoots)
        own = anchors[ys, xs]
        n = np.maximum(np.bincount(own, minlength=anchors.max() + 1), 1)
        best, nearest = np.full(len(ys), np.inf), np.zeros(len(ys), np.int32)
        for k, (cy, cx) in enumerate(zip(*(np.bincount(own, weights=v, minlength=len(n)) / n for v in (ys, xs)), strict=True)):
            way = (ys - cy) ** 2 + (xs - cx) ** 2 if k else best
            nearer = way < best
            best[nearer], nearest[nearer] = way[nearer], k
        label[ys, xs] = np.where(own > 0, own, nearest)
    else:
        label[ys, xs] = components(dilated(occupied, apart))[ys, xs]
    found = np.unique(label[ys, xs])
    middle = [xs[label[ys, xs] == k].mean() for k in found]
    number = np.zeros(int(found.max(initial=0)) + 1, np.int32)
    number[found[np.argsort(middle, kind="stable")]] = np.arange(1, len(found) + 1)
    return number[label]


def root_pixels(raster: np.ndarray, main: int, lateral: int, shoot: int) -> pd.DataFrame:
    """``plant, y, x, part, ends``: every pixel of a plant, what it is part of, and for pixels of the root's skeleton how many neighbours it has there."""
    kind = np.select([raster == shoot, raster == main, raster == lateral], [3, 1, 2], 0)
    label = plant_labels(kind > 0, kind == 3)
    ends = np.full(raster.shape, -1, np.int32)
    for k in range(1, int(label.max()) + 1):
        root = (label == k) & (kind < 3)
        if root.any():
            line = skeleton(root)
            ends[line] = neighbours(line)[line]
    y, x = np.nonzero(label)
    return pd.DataFrame({"plant": label[y, x], "y": y, "x": x, "part": kind[y, x], "ends": ends[y, x]})


def _around(spots: pd.DataFrame, steps: int, shape: tuple[int, int]) -> pd.DataFrame:
    """``plant, y, x`` of all pixels within ``steps`` of a plant's spots."""
    out = [pd.DataFrame({"plant": [], "y": [], "x": []}, dtype="int64")]
    for plant, own in spots.groupby("plant"):
        corner = np.maximum([own.y.min() - steps, own.x.min() - steps], 0)
        size = np.minimum([own.y.max() + steps + 1, own.x.max() + steps + 1], shape) - corner
        m = np.zeros(size, bool)
        m[own.y - corner[0], own.x - corner[1]] = True
        y, x = np.nonzero(dilated(m, steps))
        out.append(pd.DataFrame({"plant": plant, "y": y + corner[0], "x": x + corner[1]}))
    return pd.concat(out, ignore_index=True)


def region_table(px: pd.DataFrame, shape: tuple[int, int], around: int = 50, spot: int = 5) -> pd.DataFrame:
    """``plant, region, y, x`` from ``root_pixels``: ends of the skeleton are tips, forks nodes, the lowest end (on the main root if it has one) is the main tip.

    The surroundings of a root leave out what lies above the lowest pixel of its shoot.
    """
    tips = px[px.ends == 1].assign(on_main=lambda t: t.part == 1).sort_values(["plant", "on_main", "y", "x"], ascending=[True, True, True, True], kind="stable")
    lowest = tips.groupby("plant").y.transform("max") if len(tips) else tips.y
    on_main = tips.groupby("plant").on_main.transform("max") if len(tips) else tips.on_main
    lowest = tips[tips.on_main == on_main].groupby("plant").y.transform("max") if len(tips) else lowest
    main_tip = tips.loc[lowest.index][tips.loc[lowest.index].y == lowest].groupby("plant").tail(1)
    grown = _around(px[px.part < 3], around, shape)
    floor = px[px.part == 3].groupby("plant").y.max()
    grown = grown[grown.y >= grown.plant.map(floor).fillna(0)]
    root = px[px.part < 3][["plant", "y", "x"]].assign(own=True)
    outside = grown.merge(root, "left", ["plant", "y", "x"])
    named = {
        "main_root": px[px.part == 1],
        "lateral_root": px[px.part == 2],
        "main_root_tip": _around(main_tip, spot, shape),
        "other_tip": _around(tips.drop(main_tip.index), spot, shape),
        "node": _around(px[px.ends >= 3], spot, shape),
        "dilated_root_exclusive": outside[outside.own.isna()],
        "dilated_root": grown,
        "shoot": px[px.part == 3],
    }
    return pd.concat([named[r][["plant", "y", "x"]].assign(region=r) for r in REGIONS], ignore_index=True)


def region_pixels(rasters: DataFrame, keys: list[str], main: int, lateral: int, shoot: int, around: int = 50) -> DataFrame:
    """``*keys, plant_id, region, y, x``: the pixels of all regions, to be joined with a sensor's values (``rollups.region_pixels``)."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema), "plant_id string, region string, y int, x int"])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                mask = unpack(r.h, r.w, r.bits)
                out = region_table(root_pixels(mask, main, lateral, shoot), mask.shape, around)
                plant = "plant_" + out["plant"].astype("int64").astype(str)
                yield out.assign(**{c: getattr(r, c) for c in keys}, plant_id=plant, y=out.y.astype("int32"), x=out.x.astype("int32"))[[*keys, "plant_id", "region", "y", "x"]]

    return rasters.select(*keys, "h", "w", "bits").mapInPandas(spread, fields)


def main_route(lines: np.ndarray, start: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """The longest of the shortest ways along a skeleton from ``start`` (or its topmost pixel): pixels ``(y, x)`` from base to tip."""
    at = np.argwhere(lines)
    if not len(at):
        return []
    if start is None:
        source = tuple(at[0])
    else:
        source = tuple(at[((at - np.array(start)) ** 2).sum(1).argmin()])
    cost, before = {source: 0.0}, {}
    heap = [(0.0, source)]
    while heap:
        d, (y, x) = heapq.heappop(heap)
        if d > cost[y, x]:
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                v, u = y + dy, x + dx
                if (dy or dx) and 0 <= v < lines.shape[0] and 0 <= u < lines.shape[1] and lines[v, u]:
                    far = d + (math.sqrt(2.0) if dy and dx else 1.0)
                    if far < cost.get((v, u), math.inf) - 1e-12:
                        cost[v, u], before[v, u] = far, (y, x)
                        heapq.heappush(heap, (far, (v, u)))
    end = max(cost, key=lambda p: (cost[p], p))
    route = [end]
    while route[-1] != source:
        route.append(before[route[-1]])
    return [(int(y), int(x)) for y, x in reversed(route)]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of ``(x, y)`` points, anticlockwise."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)

    def half(rows):
        out: list[tuple] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def area_of(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = corners[:, 0], corners[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def shape_of(mask: np.ndarray, start: tuple[int, int] | None = None) -> dict[str, float]:
    """Area, edge pixels, lengths (route, skeleton pixels, weighted), tips, forks, hull and angles of one mask; zeros if it is empty."""
    m = np.asarray(mask, bool)
    names = ("area", "edge_pixels", "route_length", "skeleton_pixels", "weighted_length", "tips", "forks", "hull_area", "hull_w", "hull_h", "aspect", "base_tip_angle")
    if not m.any():
        return dict.fromkeys(names, 0.0)
    lines = skeleton(m)
    n = neighbours(lines)
    route = main_route(lines, start)
    steps = np.diff(np.array(route, float), axis=0) if len(route) > 1 else np.zeros((0, 2))
    ys, xs = np.nonzero(m)
    around = hull(np.column_stack([xs, ys]))
    w, h = float(np.ptp(xs) + 1), float(np.ptp(ys) + 1)
    full = np.pad(m, 1)
    inner = full[1:-1, 1:-1] & full[:-2, 1:-1] & full[2:, 1:-1] & full[1:-1, :-2] & full[1:-1, 2:]
    angle = math.degrees(math.atan2(route[-1][1] - route[0][1], route[-1][0] - route[0][0])) if len(route) > 1 else 0.0
    values = (m.sum(), (m & ~inner).sum(), np.hypot(*steps.T).sum() if len(steps) else float(lines.sum()), lines.sum(), mask_edge_length(lines), (n == 1).sum(), (n >= 3).sum(), area_of(around), w, h, h / w, angle)
    return dict(zip(names, map(float, values), strict=True))


def measure_shapes(rasters: DataFrame, keys: list[str], classes: list[int]) -> DataFrame:
    """``shape_of`` of the given classes of each raster."""
    names = list(shape_of(np.zeros((1, 1))))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema), *(f"{n} double" for n in names)])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{**{c: getattr(r, c) for c in keys}, **shape_of(np.isin(unpack(r.h, r.w, r.bits), classes))} for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return rasters.select(*keys, "h", "w", "bits").mapInPandas(measure, fields)


def combined_areas(pixels: DataFrame, groups: DataFrame, frame: list[str], plant: str) -> DataFrame:
    """``*frame, group, members, area``: pixels of touching plants counted once for their group. ``groups`` maps plants to groups by frame."""
    rows = pixels.join(groups.select(*frame, plant, "group"), [*frame, plant])
    members = rows.groupBy(*frame, "group").agg(F.countDistinct(plant).alias("members"))
    return rows.select(*frame, "group", "y", "x").distinct().groupBy(*frame, "group").agg(F.count(F.lit(1)).alias("area")).join(members, [*frame, "group"])


def tiles(rasters: DataFrame, keys: list[str], size: int, halo: int = 0) -> DataFrame:
    """Each raster in square tiles, ``halo`` pixels wider on all sides, zero beyond the edge: ``*keys, ty, tx, h, w, bits``."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema), "ty int, tx int, h int, w int, bits binary"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows, columns = -(-r.h // size), -(-r.w // size)
                full = np.pad(unpack(r.h, r.w, r.bits), ((halo, halo + rows * size - r.h), (halo, halo + columns * size - r.w)))
                side = size + 2 * halo
                out = [(*(getattr(r, c) for c in keys), ty, tx, side, side, full[ty * size : ty * size + side, tx * size : tx * size + side].tobytes()) for ty in range(rows) for tx in range(columns)]
                yield pd.DataFrame(out, columns=[*keys, "ty", "tx", "h", "w", "bits"])

    return rasters.select(*keys, "h", "w", "bits").mapInPandas(split, fields)


def stitched(parts: DataFrame, keys: list[str], size: int, halo: int = 0) -> DataFrame:
    """The tiles of each raster put together again without their halos (a raster's tiles meet in one task): ``*keys, h, w, bits``."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema), "h int, w int, bits binary"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = (int(rows[c].max()) + 1 for c in ("ty", "tx"))
        full = np.zeros((h * size, w * size), np.uint8)
        for r in rows.itertuples(index=False):
            full[r.ty * size : (r.ty + 1) * size, r.tx * size : (r.tx + 1) * size] = unpack(r.h, r.w, r.bits)[halo : halo + size, halo : halo + size]
        return pd.DataFrame([(*(rows[c].iloc[0] for c in keys), h * size, w * size, full.tobytes())], columns=[*keys, "h", "w", "bits"])

    return parts.groupBy(*keys).applyInPandas(join, fields)


def warped(plane: np.ndarray, shift: tuple[float, float] = (0.0, 0.0), scale: float = 1.0, degrees: float = 0.0, k1: float = 0.0, k2: float = 0.0) -> np.ndarray:
    """The plane moved, scaled and turned about its centre, with radial distortion undone; bilinear, zero beyond the edge."""
    h, w = plane.shape
    ys, xs = np.indices((h, w)).astype(float)
    cy, cx, a = h / 2, w / 2, math.radians(degrees)
    x, y = (xs - shift[0] - cx) / scale, (ys - shift[1] - cy) / scale
    x, y = math.cos(a) * x - math.sin(a) * y, math.sin(a) * x + math.cos(a) * y
    r2 = (x / max(cx, 1)) ** 2 + (y / max(cy, 1)) ** 2
    bend = 1 + k1 * r2 + k2 * r2**2
    x, y = x * bend + cx, y * bend + cy
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((h, w))
    for dy in (0, 1):
        for dx in (0, 1):
            u, v = x0 + dx, y0 + dy
            inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
            part = np.where(dx, x - x0, 1 - x + x0) * np.where(dy, y - y0, 1 - y + y0)
            out[inside] += part[inside] * plane[v[inside], u[inside]]
    return out


def shift_between(reference: np.ndarray, moving: np.ndarray) -> tuple[float, float, float]:
    """``(dx, dy, peak)``: how far ``moving`` lies from ``reference`` by phase correlation; the peak is 1 for a pure shift."""
    window = np.outer(np.hanning(reference.shape[0]), np.hanning(reference.shape[1]))
    a, b = (np.fft.rfft2((p - p.mean()) * window) for p in (reference.astype(float), moving.astype(float)))
    cross = b * np.conj(a)
    surface = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=reference.shape)
    y, x = np.unravel_index(int(surface.argmax()), surface.shape)
    h, w = surface.shape
    return float(x - w if x > w // 2 else x), float(y - h if y > h // 2 else y), float(surface.max())


def registered(frames: DataFrame, plate: list[str], order: str, least_peak: float = 0.1, most: float = 60.0) -> DataFrame:
    """``*plate, order, dx, dy, peak, accepted``: each frame against the last accepted one; doubtful shifts count as none.

    The chain runs through a plate, so a plate's frames are one group.
    """
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*plate, order).schema), "dx double, dy double, peak double, accepted boolean"])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        out, reference, gone = [], None, (0.0, 0.0)
        for r in rows.sort_values(order).itertuples(index=False):
            picture = unpack(r.h, r.w, r.bits)
            if reference is None:
                x, y, peak, ok = 0.0, 0.0, 1.0, True
            else:
                x, y, peak = shift_between(reference, picture)
                x, y = x + gone[0], y + gone[1]
                ok = peak >= least_peak and math.hypot(x, y) <= most
            if ok:
                reference, gone = picture, (x, y)
            out.append((*(getattr(r, c) for c in plate), getattr(r, order), x if ok else 0.0, y if ok else 0.0, peak, ok))
        return pd.DataFrame(out, columns=[*plate, order, "dx", "dy", "peak", "accepted"])

    return frames.select(*plate, order, "h", "w", "bits").groupBy(*plate).applyInPandas(chain, fields)


def last_accepted(df: DataFrame, plate: list[str], order: str) -> DataFrame:
    """``reference``: the frame against which each frame is registered."""
    before = Window.partitionBy(*plate).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reference", F.last(F.when(F.col("accepted"), F.col(order)), ignorenulls=True).over(before))


def box_tracks(boxes: DataFrame, plate: list[str], frame: str = "frame") -> DataFrame:
    """``boxes`` with ``track``: given ids if there are any, else the frame with the most boxes names them from left to right and the others follow."""
    columns = [*plate, frame, "track_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h"]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.select(*columns).schema), "track string"])

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([frame, "bbox_x", "bbox_y"]).reset_index(drop=True)
        given = rows["track_id"].fillna("").astype(str).str.strip()
        if (given != "").any():
            return rows[columns].assign(track=given.where(given != "", None))
        x, y = rows["bbox_x"] + rows["bbox_w"] / 2, rows["bbox_y"] + rows["bbox_h"] / 2
        counts = rows.groupby(frame).size()
        first = counts[counts == counts.max()].index.min()
        track: list[str | None] = [None] * len(rows)
        named = rows.index[rows[frame] == first]
        named = sorted(named, key=lambda i: (x[i], i))
        places = {}
        for k, i in enumerate(named, 1):
            track[i] = f"plant_{k:02d}"
            places[track[i]] = (x[i], y[i])
        for f in sorted(set(rows[frame]) - {first}):
            free = list(rows.index[rows[frame] == f])
            for name in sorted(places):
                if not free:
                    break
                px, py = places[name]
                best = min(free, key=lambda i: (abs(x[i] - px) + 0.15 * abs(y[i] - py), i))
                free.remove(best)
                track[best] = name
                places[name] = (x[best], y[best])
        return rows[columns].assign(track=track)

    return boxes.select(*columns).groupBy(*plate).applyInPandas(follow, fields)


def calibration(scores: DataFrame, expert: str, score: str) -> DataFrame:
    """``expert, bias, preferred, margin``: each expert's mean score against the mean of all, the best one and its lead over the second."""
    means = scores.groupBy(expert).agg(F.avg(F.coalesce(F.col(score), F.lit(0.0))).alias("mean"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("mean"), expert)  # one row for each expert
    ranked = means.withColumns({"place": F.row_number().over(order), "margin": F.col("mean") - F.coalesce(F.lead("mean").over(order), F.lit(0.0)), "base": F.avg("mean").over(Window.partitionBy(F.lit(1)))})
    return ranked.select(expert, (F.col("mean") - F.col("base")).alias("bias"), (F.col("place") == 1).alias("preferred"), F.when(F.col("place") == 1, F.col("margin")).alias("margin"))


def variants(mask: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """The mask turned and mirrored: eight variants with their names."""
    m = np.asarray(mask)
    for turn in range(4):
        yield f"turn{turn * 90}", np.rot90(m, turn)
        yield f"turn{turn * 90}_mirrored", np.fliplr(np.rot90(m, turn))


def green_shoots(rgb: np.ndarray, least_excess: int = 20, least_green: int = 40) -> np.ndarray:
    """Pixels whose green clearly exceeds red and blue."""
    r, g, b = (rgb[:, :, k].astype(int) for k in range(3))
    return (2 * g - r - b >= least_excess) & (g >= least_green) & (g > r) & (g > b)
