"""Trackers over whole plates: components followed through frames, pixels by first appearance, owned masks and remembered shoots."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plants import dilated, main_route
from .raster import EDGES, components, geodesic_owners, mask_edge_length, owners, skeleton, unpack
from .tracking import assignment


@dataclass(frozen=True)
class Gate:
    """A limit on how far a box may move: a share of the picture (``floor`` pixels at least) or what margin and boxes allow, whichever is less."""

    share: float
    floor: float
    margins: float
    earlier: float
    later: float
    least: float
    waived: float

    def limit(self, picture: float, margin: float, earlier, later):
        return np.minimum(max(self.floor, picture * self.share), np.maximum.reduce([earlier * self.earlier, later * self.later, np.full_like(later, max(margin * self.margins, self.least))]))


#: Limits on the way of the centre, on the way along x, and on the way along x from the track's first place. Boxes that overlap the track's first place
#: by the last number pass whatever the way (fixed values).
CENTRE = Gate(share=0.28, floor=0.0, margins=3.0, earlier=2.8, later=1.35, least=0.0, waived=0.03)
ASIDE = Gate(share=0.20, floor=96.0, margins=3.0, earlier=3.0, later=3.0, least=96.0, waived=0.03)
ANCHOR = Gate(share=0.25, floor=128.0, margins=4.0, earlier=4.0, later=4.0, least=128.0, waived=0.01)


@dataclass(frozen=True)
class Gates:
    """Which boxes ``(x, y, w, h)`` of a picture may be which ones of an earlier frame."""

    height: int
    width: int
    margin: float = 32.0

    def open(self, earlier: np.ndarray, later: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """A row for each earlier box, a column for each later one; ``first`` are the boxes in which the tracks of the earlier ones began."""
        a, b = np.asarray(earlier, float).reshape(-1, 1, 4), np.asarray(later, float).reshape(1, -1, 4)
        way = (a[..., :2] + a[..., 2:] / 2) - (b[..., :2] + b[..., 2:] / 2)
        overlap = np.zeros(way.shape[:2]) if first is None else overlaps(first, later)
        span_a, span_b = (np.maximum(x[..., 2:].max(axis=2), 1.0) + np.zeros(way.shape[:2]) for x in (a, b))
        wide_a, wide_b = (x[..., 2] + np.zeros(way.shape[:2]) for x in (a, b))
        moves = [(CENTRE, np.hypot(way[..., 0], way[..., 1]), math.hypot(self.width, self.height), span_a, span_b), (ASIDE, np.abs(way[..., 0]), self.width, wide_a, wide_b)]
        if first is not None:
            c = np.asarray(first, float).reshape(-1, 1, 4)
            moves.append((ANCHOR, np.abs(c[..., 0] + c[..., 2] / 2 - b[..., 0] - b[..., 2] / 2), self.width, wide_a, wide_b))
        passes = (a[..., 2:].min(axis=2) > 0) & (b[..., 2:].min(axis=2) > 0)
        for gate, moved, picture, before, after in moves:
            passes &= (moved <= gate.limit(picture, self.margin, before, after)) | (overlap >= gate.waived)
        return passes


def overlaps(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The share of each later box (columns) within each first one (rows)."""
    a, b = np.asarray(first, float).reshape(-1, 1, 4), np.asarray(later, float).reshape(1, -1, 4)
    shared = np.minimum(a[..., :2] + a[..., 2:], b[..., :2] + b[..., 2:]) - np.maximum(a[..., :2], b[..., :2])
    return np.maximum(shared, 0).prod(axis=2) / np.maximum(b[..., 2:].prod(axis=2), 1.0)


def track_components(parts: DataFrame, plate: list[str], frame: str, gates: Gates, expected: int = 0, lanes: list[float] | None = None, seeds: dict[str, tuple] | None = None) -> DataFrame:
    """Components (``component, x, y, w, h, area``) with ``track``, null for those of no plant.

    Tracks start from ``seeds`` (boxes by name), else from permanent ``lanes`` (their x), else from the frame with the most
    components (of equal ones that with the largest area, then the first), the largest ``expected`` of them, named from left to right. In every other
    frame, later ones first and then earlier ones, tracks and components are paired at the least total distance within the gates.
    """
    columns = [*plate, frame, "component", "x", "y", "w", "h", "area"]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*columns).schema), "track string"])

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([frame, "x", "y", "component"]).reset_index(drop=True)
        track: list[str | None] = [None] * len(rows)
        box = lambda i: tuple(float(rows.at[i, c]) for c in "xywh")
        by_frame = {f: list(g.index) for f, g in rows.groupby(frame, sort=True)}
        if seeds or lanes:
            start = None
            last = dict(seeds) if seeds else {f"plant_{k:02d}": (x - 16.0, 0.0, 32.0, float(gates.height)) for k, x in enumerate(lanes, 1)}
        else:
            start = max(by_frame, key=lambda f: (min(len(by_frame[f]), expected or len(by_frame[f])), sum(rows.at[i, "area"] for i in by_frame[f]), -f))
            chosen = sorted(by_frame[start], key=lambda i: (-rows.at[i, "area"], i))[: expected or None]
            last = {}
            for k, i in enumerate(sorted(chosen, key=lambda i: (rows.at[i, "x"], i)), 1):
                track[i] = f"plant_{k:02d}"
                last[track[i]] = box(i)
        began = dict(last)
        ahead = [f for f in by_frame if start is None or f > start]
        for sweep in (ahead, [] if start is None else sorted((f for f in by_frame if f < start), reverse=True)):
            now = dict(last)
            for f in sweep:
                names, free = sorted(now), by_frame[f]
                boxes = rows.loc[free, list("xywh")].to_numpy(float)
                x, y = (boxes[:, :2] + boxes[:, 2:] / 2).T
                if lanes:
                    away = np.abs(np.array(lanes)[:, None] - x[None, :])
                    nearest = np.arange(len(lanes))[:, None] == away.argmin(axis=0)[None, :]
                    cost = np.where(nearest, away - 1e-6 * rows.loc[free, "area"].to_numpy(float), np.inf)
                else:
                    before = np.array([now[n] for n in names], float)
                    far = np.hypot(before[:, :1] + before[:, 2:3] / 2 - x, before[:, 1:2] + before[:, 3:4] / 2 - y)
                    cost = np.where(gates.open(before, boxes, np.array([began[n] for n in names])), far, np.inf)
                for i, j in assignment(cost):
                    track[free[j]] = names[i]
                    now[names[i]] = box(free[j])
        return rows[columns].assign(track=track)

    return parts.select(*columns).groupBy(*plate).applyInPandas(follow, fields)


def appearance(pixels: DataFrame, plate: list[str], frame: str) -> tuple[DataFrame, DataFrame]:
    """``(vertices, edges)`` of a plate's growth: pixels by the frame in which they first appear.

    Vertices are ``*plate, first, pixels, x, y`` (mean place); an edge tells how many neighbouring pixels two such regions share. Both are aggregates
    over the pixel table, which is only joined with its neighbours.
    """
    first = pixels.groupBy(*plate, "y", "x").agg(F.min(frame).alias("first"))
    vertices = first.groupBy(*plate, "first").agg(F.count(F.lit(1)).alias("pixels"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx, _ in EDGES)))
    asked = first.withColumn("s", steps).select(*plate, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("first").alias("other"))
    met = asked.join(first, [*plate, "y", "x"]).where("first <> other")
    edges = met.groupBy(*plate, F.least("first", "other").alias("earlier"), F.greatest("first", "other").alias("later")).agg(F.count(F.lit(1)).alias("contacts"))
    return vertices, edges


def owned_masks(frames: DataFrame, plate: list[str], order: str, seeds: list[tuple[int, int]], root: int) -> DataFrame:
    """``*plate, order, plant, pixels, length``: each frame's root pixels by plant.

    In the first frame pixels belong to the seed that is nearest along the skeleton, else nearest of all; later a part that
    touches a plant's mask of the frame before stays with it, and parts that several touch are divided along the skeleton. A plate is one group.
    """
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*plate, order).schema), "plant int, pixels int, length double"])

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        for r in rows.sort_values(order).itertuples(index=False):
            mask = unpack(r.h, r.w, r.bits) == root
            lines = skeleton(mask)
            owner = np.zeros(mask.shape, np.int32)
            parts = components(mask)
            for k in range(1, int(parts.max(initial=0)) + 1):
                part = parts == k
                if before is None:
                    sources = [[(y, x)] if part[y, x] else [] for y, x in seeds]
                else:
                    sources = [[tuple(p) for p in np.argwhere((before == i + 1) & part)] for i in range(len(seeds))]
                held = [i for i, s in enumerate(sources) if s]
                if len(held) == 1:
                    owner[part] = held[0] + 1
                    continue
                if not held:
                    owner[part] = owners(part, [[s] for s in seeds])[part]
                    continue
                own_lines = np.argwhere(lines & part)
                snapped = [[tuple(own_lines[((own_lines - np.array(p)) ** 2).sum(1).argmin()]) for p in s[:: max(1, len(s) // 64)]] for s in sources]
                along = geodesic_owners(lines & part, snapped)
                groups = [[tuple(p) for p in np.argwhere(along == i + 1)] for i in range(len(seeds))]
                owner[part] = owners(part, groups)[part]
            for i in range(len(seeds)):
                mine = owner == i + 1
                out.append((*(getattr(r, c) for c in plate), getattr(r, order), i + 1, int(mine.sum()), mask_edge_length(lines & mine)))
            before = owner
        return pd.DataFrame(out, columns=[*plate, order, "plant", "pixels", "length"])

    return frames.select(*plate, order, "h", "w", "bits").groupBy(*plate).applyInPandas(follow, fields)


def remembered(current: np.ndarray, previous: np.ndarray, shift: tuple[int, int] = (0, 0)) -> np.ndarray:
    """The current mask filled up to the previous area: first with previous pixels (shifted by ``dx, dy``), nearest ones first, then by growing."""
    now, old = np.asarray(current, bool).copy(), np.asarray(previous, bool)
    missing = int(old.sum()) - int(now.sum())
    if missing <= 0:
        return now
    dx, dy = shift
    moved = np.zeros_like(old)
    ys, xs = np.nonzero(old)
    ys, xs = ys + dy, xs + dx
    inside = (ys >= 0) & (ys < old.shape[0]) & (xs >= 0) & (xs < old.shape[1])
    moved[ys[inside], xs[inside]] = True
    extra = np.argwhere(moved & ~now)
    if len(extra) > missing and now.any():
        have = np.argwhere(now)
        near = np.array([((have - p) ** 2).sum(1).min() for p in extra])
        extra = extra[np.argsort(near, kind="stable")]
    extra = extra[:missing]
    now[tuple(extra.T)] = True
    missing -= len(extra)
    while missing > 0 and now.any() and not now.all():
        ring = np.argwhere(dilated(now, 1) & ~now)[:missing]
        now[tuple(ring.T)] = True
        missing -= len(ring)
    return now


def remembered_areas(shoots: DataFrame, track: list[str], order: str, shoot: int) -> DataFrame:
    """``*track, order, observed, tracked``: shoot pixels seen and after filling from memory; a track is one group."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shoots.select(*track, order).schema), "observed int, tracked int"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        for r in rows.sort_values(order).itertuples(index=False):
            seen = unpack(r.h, r.w, r.bits) == shoot
            before = seen if before is None or before.shape != seen.shape else remembered(seen, before)
            out.append((*(getattr(r, c) for c in track), getattr(r, order), int(seen.sum()), int(before.sum())))
        return pd.DataFrame(out, columns=[*track, order, "observed", "tracked"])

    return shoots.select(*track, order, "h", "w", "bits").groupBy(*track).applyInPandas(fill, fields)


def lateral_segments(mask: np.ndarray, least: int = 3) -> list[dict[str, float]]:
    """Skeleton parts off the main route: length, place where they leave it, tip, and angle from straight down."""
    lines = skeleton(mask)
    route = main_route(lines)
    if not route:
        return []
    trunk = np.zeros_like(lines)
    trunk[tuple(np.array(route).T)] = True
    rest = components(lines & ~trunk)
    out = []
    for k in range(1, int(rest.max(initial=0)) + 1):
        part = rest == k
        if part.sum() < least:
            continue
        at = np.argwhere(part)
        far = ((at[:, None] - np.array(route)[None]) ** 2).sum(2)
        base = at[far.min(1).argmin()]
        joint = route[int(far[far.min(1).argmin()].argmin())]
        way = main_route(part, tuple(base))
        tip = way[-1]
        out.append({"length": mask_edge_length(part), "base_x": float(joint[1]), "base_y": float(joint[0]), "tip_x": float(tip[1]), "tip_y": float(tip[0]), "angle": math.degrees(math.atan2(tip[1] - joint[1], tip[0] - joint[0]))})
    return sorted(out, key=lambda s: (s["base_y"], s["base_x"], s["tip_y"], s["tip_x"]))


def predicted(images: DataFrame, keys: list[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Masks of images (``h, w, c, bits``) by a caller's model, loaded once for each worker: ``*keys, h, w, bits``."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keys).schema), "h int, w int, bits binary"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                mask = model(np.frombuffer(r.bits, np.uint8).reshape(r.h, r.w, r.c)).astype(np.uint8)
                rows.append((*(getattr(r, k) for k in keys), mask.shape[0], mask.shape[1], mask.tobytes()))
            yield pd.DataFrame(rows, columns=[*keys, "h", "w", "bits"])

    return images.select(*keys, "h", "w", "c", "bits").mapInPandas(run, fields)


def image_features(images: DataFrame, keys: list[str]) -> DataFrame:
    """Of each image (``h, w, c, bits``): megapixels, mean brightness, share of dark pixels in the top quarter, excess of green, whether it has colour."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keys).schema), "megapixels double, brightness double, dark_top double, green double, colour boolean"])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                p = np.frombuffer(r.bits, np.uint8).reshape(r.h, r.w, r.c).astype(float) / 255
                gray = p.mean(axis=2)
                spread = float((p.max(axis=2) - p.min(axis=2)).mean()) if r.c > 1 else 0.0
                green = float(np.maximum(0, p[:, :, 1] - (p[:, :, 0] + p[:, :, 2]) / 2).mean()) if r.c > 2 else 0.0
                top = gray[: max(1, r.h // 4)]
                rows.append((*(getattr(r, k) for k in keys), r.h * r.w / 1e6, float(gray.mean()), float((top < 0.2).mean()), green, spread > 0.02))
            yield pd.DataFrame(rows, columns=[*keys, "megapixels", "brightness", "dark_top", "green", "colour"])

    return images.select(*keys, "h", "w", "c", "bits").mapInPandas(describe, fields)
