"""Links of detections over time, conflict groups, and owners by a learned ranking."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box


@dataclass(frozen=True)
class TipLinks:
    """Limits of links between the tips of one frame and a later one (fixed values)."""

    distance: float = 42.0
    wider_by_gap: float = 0.45
    gap: int = 2
    angle_share: float = 0.35
    gap_cost: float = 0.06
    most: float = 1.35


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of least total cost with each row and column once at most; ``inf`` forbids a pair.

    Shortest augmenting paths with potentials; forbidden pairs get a cost over that of any whole assignment, and are left out after.
    """
    allowed = np.isfinite(cost)
    if not allowed.any():
        return []
    far = float(np.abs(cost[allowed]).sum()) + 1.0
    c = np.where(allowed, cost, far)
    turned = c.shape[0] > c.shape[1]
    c = c.T if turned else c
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0] = i
        j = 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j]:
            used[j] = True
            row = match[j]
            reduced = c[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            free = np.where(used[1:], np.inf, least[1:])
            nearest = int(np.argmin(free)) + 1
            step = free[nearest - 1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nearest
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    pairs = [(b, a) if turned else (a, b) for a, b in pairs]
    return sorted((int(a), int(b)) for a, b in pairs if allowed[a, b])


def _tip_cost(last: np.ndarray, now: np.ndarray, gap: np.ndarray, limits: TipLinks) -> np.ndarray:
    """Costs of links from the last places of tracks to tips, both rows of ``x, y, angle``; ``gap`` is how many frames ago a track was seen."""
    reach = (limits.distance * (1.0 + limits.wider_by_gap * (gap - 1)))[:, None]
    distance = np.hypot(last[:, None, 0] - now[None, :, 0], last[:, None, 1] - now[None, :, 1])
    turn = np.abs(last[:, None, 2] - now[None, :, 2]) % 360.0
    turn = np.minimum(turn, 360.0 - turn) / 180.0
    cost = (1 - limits.angle_share) * distance / reach + limits.angle_share * turn + limits.gap_cost * (gap[:, None] - 1)
    return np.where((gap[:, None] > 0) & (distance <= reach) & (cost <= limits.most), cost, np.inf)


def link_tips(tips: DataFrame, plant: list[str], frame: str = "frame", limits: TipLinks = TipLinks(), method: str = "optimal") -> DataFrame:
    """``tips`` (``x, y, angle`` and a unique ``tip_id``) with ``track``: numbered by plant in order of appearance.

    The state of one plant goes from frame to frame, so a plant is one group; ``method`` is ``optimal`` (least total cost) or ``greedy``.
    """
    columns = [*plant, frame, "tip_id", "x", "y", "angle"]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tips.select(*columns).schema), "track int"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([frame, "tip_id"]).reset_index(drop=True)
        track = np.zeros(len(rows), int)
        place = rows[["x", "y", "angle"]].to_numpy(float)
        when = rows[frame].to_numpy()
        active = np.zeros(0, int)  # the last row of each track that may go on
        for f, group in rows.groupby(frame, sort=True):
            now = group.index.to_numpy()
            active = active[f - when[active] <= limits.gap]
            cost = _tip_cost(place[active], place[now], f - when[active], limits)
            pairs = assignment(cost) if method == "optimal" else greedy(cost)
            before, after = (np.array([p[k] for p in pairs], int) for k in (0, 1))
            track[now[after]] = track[active[before]]
            new = np.setdiff1d(np.arange(len(now)), after)
            track[now[new]] = track.max(initial=0) + 1 + np.arange(len(new))
            active[before] = now[after]
            active = np.concatenate([active, now[new]])
        return rows[columns].assign(track=track)

    return tips.select(*columns).groupBy(*plant).applyInPandas(link, fields)


def greedy(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs by rising cost (then row, then column), each row and column once."""
    order = sorted((cost[i, j], i, j) for i, j in zip(*np.nonzero(np.isfinite(cost)), strict=True))
    rows, columns, out = set(), set(), []
    for _, i, j in order:
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((int(i), int(j)))
    return sorted(out)


def link_branches(branches: DataFrame, plant: list[str], frame: str = "frame", most: float = 1.5, gap: int = 2, reach: float = 45.0) -> DataFrame:
    """``branches`` (``branch_id, base_x, base_y, tip_x, tip_y``) with ``track``; cheapest links first, of bases and tips that lie near."""
    columns = [*plant, frame, "branch_id", "base_x", "base_y", "tip_x", "tip_y"]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in branches.select(*columns).schema), "track int"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([frame, "branch_id"]).reset_index(drop=True)
        track = np.zeros(len(rows), int)
        base, tip = rows[["base_x", "base_y"]].to_numpy(float), rows[["tip_x", "tip_y"]].to_numpy(float)
        when = rows[frame].to_numpy()
        last = np.zeros(0, int)  # the last row of each track, in order of their numbers
        for f, group in rows.groupby(frame, sort=True):
            now = group.index.to_numpy()
            ago = f - when[last]
            open_tracks = np.flatnonzero((ago > 0) & (ago <= gap))
            from_rows = last[open_tracks]
            far = lambda at: np.hypot(*(at[from_rows][:, None] - at[now][None]).transpose(2, 0, 1)) / reach  # noqa: E731, B023
            cost = 0.6 * far(base) + 0.4 * far(tip) / ago[open_tracks][:, None]
            pairs = greedy(np.where(cost <= most, cost, np.inf))
            before, after = (np.array([p[k] for p in pairs], int) for k in (0, 1))
            new = np.setdiff1d(np.arange(len(now)), after)
            track[now[after]] = open_tracks[before] + 1
            track[now[new]] = len(last) + 1 + np.arange(len(new))
            last[open_tracks[before]] = now[after]
            last = np.concatenate([last, now[new]])
        return rows[columns].assign(track=track)

    return branches.select(*columns).groupBy(*plant).applyInPandas(link, fields)


def touching_components(left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each box the least box that it reaches through boxes that overlap; boxes of one number in ``same`` belong together.

    Boxes enter from left to right. Each strip between two neighbouring edges remembers the box of those that cover it which ends last: if that one
    has ended, so have all others, and if not, all that still lie there are joined with it already. So no pair is written down.
    """
    n = len(left)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(i: int, j: int) -> None:
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    edges = np.unique(np.concatenate([top, bottom]))
    first, end = np.searchsorted(edges, top).tolist(), np.searchsorted(edges, bottom).tolist()
    enters, ends = left.tolist(), right.tolist()
    latest, until = [0] * len(edges), [float("-inf")] * len(edges)
    for i in np.argsort(left, kind="stable").tolist():
        x, stop, met = enters[i], ends[i], -1
        for strip in range(first[i], end[i]):
            if until[strip] > x and latest[strip] != met:
                met = latest[strip]
                join(i, met)
            if until[strip] < stop:
                latest[strip], until[strip] = i, stop
    order = np.argsort(same, kind="stable")
    for i, j in zip(order[:-1][same[order][1:] == same[order][:-1]].tolist(), order[1:][same[order][1:] == same[order][:-1]].tolist(), strict=True):
        join(i, j)
    return np.array([root(i) for i in range(n)], int)


def conflict_groups(boxes: DataFrame, frame: list[str], plant: str) -> DataFrame:
    """``*frame, plant, group, size``: plants whose boxes touch, directly or through others, in one frame; the group is its least plant.

    One task for each frame sweeps over its boxes without making pairs: time and memory grow with boxes (and the edges that a tall one crosses).
    """
    box = Box.of()
    kind = boxes.schema[plant].dataType.simpleString()
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.select(*frame).schema), f"`{plant}` {kind}, `group` {kind}, size int"])
    sides = ["__left", "__top", "__right", "__bottom"]

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[np.isfinite(rows[sides].to_numpy(float)).all(axis=1)].sort_values(plant, kind="stable")
        name = rows[plant].to_numpy()
        number = np.cumsum(np.concatenate([[False], name[1:] != name[:-1]])[: len(name)])  # of the plant, in order
        group = number[touching_components(*(rows[c].to_numpy(float) for c in sides), number)]
        once = np.flatnonzero(np.concatenate([[True], np.diff(number) > 0])[: len(name)])
        size = np.bincount(group[once], minlength=len(once))[group[once]]
        shown = once[size > 1]
        return pd.DataFrame({**{c: rows[c].iloc[shown] for c in frame}, plant: name[shown], "group": name[once[group[shown]]], "size": size[size > 1]})

    known = boxes.where(box.exists).dropna(subset=[*frame, plant]).select(*frame, plant, *(v.alias(c) for c, v in zip(sides, (box.x, box.y, box.x + box.w, box.y + box.h), strict=True)))
    return known.groupBy(*frame).applyInPandas(close, fields)


def conflict_timeline(pairs: DataFrame, plate: list[str], frame: str) -> DataFrame:
    """Touching pairs with the frame of their first touch and whether they touched in the frame before."""
    w = Window.partitionBy(*plate, "a", "b")
    before = F.lag(frame).over(w.orderBy(frame))
    return pairs.withColumns({"first_touch": F.min(frame).over(w), "touched_before": F.coalesce(before == F.col(frame) - 1, F.lit(False))})


#: What the owner ranker is told of a pixel and a crown, in the order of its weights: each feature is a product of the named quantities (fixed values).
OWNER_FEATURES = ("dx", "|dx|", "dx dx", "|dx| y", "dx y", "lane", "|lane|", "lane lane", "dy", "dy dy", "slot", "slot x", "slot y")
#: Crowns that the ranker was made for, and the least lane width as a share of the picture (fixed values).
OWNERS, LEAST_LANE = 5, 0.025


def owner_features(x: Column, y: Column, crowns: list[tuple[float, float]], width: int, height: int) -> Column:
    """``array<array<double>>``: ``OWNER_FEATURES`` of a pixel for each of five crowns, given from left to right.

    Places are shares of the picture; ``dx`` and ``dy`` lead from the crown to the pixel, ``lane`` is dx in widths of the crown's lane (half the way
    to both neighbours, of an outer one the way to the one), ``slot`` the crown's number from -1 to 1.
    """
    at = np.array(crowns, float)
    if at.shape != (OWNERS, 2) or not np.isfinite(at).all():
        raise ValueError(f"the owner ranker needs {OWNERS} finite crown points")
    at /= np.maximum([width - 1, height - 1], 1)
    lanes = np.maximum(np.gradient(at[:, 0]), LEAST_LANE)
    known = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("cx", "cy", "lane", "slot"), row, strict=True))) for row in np.column_stack([at, lanes, np.linspace(-1, 1, OWNERS)])))
    px, py = x / float(max(width - 1, 1)), y / float(max(height - 1, 1))

    def told(crown: Column) -> Column:
        dx, dy = px - crown["cx"], py - crown["cy"]
        lane = dx / crown["lane"]
        quantity = {"x": px, "y": py, "dx": dx, "dy": dy, "|dx|": F.abs(dx), "lane": lane, "|lane|": F.abs(lane), "slot": crown["slot"]}
        return F.array(*(reduce(operator.mul, (quantity[n] for n in feature.split())) for feature in OWNER_FEATURES))

    return F.transform(known, told)


def ranked_owner(features: Column, mean: list[float], scale: list[float], weights: list[float]) -> Column:
    """``struct(owner, score, margin)``: the candidate with the largest weighted sum of standardised features, and its lead over the next."""
    w = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s"), F.lit(float(v)).alias("w")) for m, s, v in zip(mean, scale, weights, strict=True)))
    score = lambda f: F.aggregate(F.zip_with(f, w, lambda x, p: (x - p["m"]) / p["s"] * p["w"]), F.lit(0.0), lambda a, b: a + b)
    scored = F.transform(features, lambda f, i: F.struct(score(f).alias("score"), (-i).alias("place")))
    order = F.sort_array(scored, asc=False)
    best, second = F.element_at(order, 1), F.try_element_at(order, F.lit(2))
    return F.struct((-best["place"]).alias("owner"), best["score"].alias("score"), (best["score"] - second["score"]).alias("margin"))


def lane_bounds(centres: Column, width: float) -> Column:
    """``array<struct(low, high)>``: lanes that meet half-way between neighbouring centres."""
    n = F.size(centres)
    middle = lambda i: (F.element_at(centres, i) + F.element_at(centres, i + 1)) / 2
    low = lambda i: F.when(i == 1, F.lit(0.0)).otherwise(middle(F.greatest(i - 1, F.lit(1))))
    high = lambda i: F.when(i == n, F.lit(float(width))).otherwise(middle(F.least(i, F.greatest(n - 1, F.lit(1)))))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(low(i).alias("low"), high(i).alias("high")))


def tip_priors(tracks: DataFrame, share: float = 0.65) -> DataFrame:
    """``frame, plant_id, x, y`` of tips of tracks (``parent, parent_share, observations``) that belong clearly to one plant."""
    return tracks.where(F.col("parent_share") >= share).select(F.col("parent").alias("plant_id"), F.explode("observations").alias("o")).select("o.frame", "plant_id", "o.x", "o.y")
