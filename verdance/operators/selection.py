"""Choices among rows: subsets of tracks, previews, slots, bands, precedence of measurements, synonyms, clustered readings."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import clean_text, number
from ..functions.text import natural_key

#: Kinds of preview images, the best first (fixed values).
PREVIEW_KINDS = ("overlay", "preview", "rgb", "raw")
#: Names by which label classes are known (fixed values).
CLASS_SYNONYMS = {
    "root": ("root", "roots", "root_binary", "total_root"),
    "primary_root": ("primary", "primary_root", "main_root", "taproot"),
    "lateral_root": ("lateral", "lateral_root", "laterals", "side_root"),
    "shoot": ("shoot", "shoots", "leaf", "leaves", "hypocotyl"),
    "seed": ("seed", "seeds", "crown"),
}


def track_subset(rows: DataFrame, combined: DataFrame, plant: str, members: str, chosen: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the chosen tracks, and combined rows all of whose members are chosen (rows without members go)."""
    wanted = F.array(*(F.lit(c) for c in chosen))
    every = F.forall(members, lambda m: F.array_contains(wanted, m)) & (F.size(members) > 0)
    return rows.where(F.array_contains(wanted, F.col(plant))), combined.where(every)


def best_preview(files: DataFrame, group: list[str], name: str) -> DataFrame:
    """``*group, preview``: of each group's files the best kind, of equal ones the first in natural order."""
    low = F.lower(F.col(name))
    rank = F.lit(len(PREVIEW_KINDS))
    for k, kind in reversed(list(enumerate(PREVIEW_KINDS))):
        rank = F.when(low.contains(kind), k).otherwise(rank)
    return files.groupBy(*group).agg(F.min_by(name, F.struct(rank, natural_key(name), F.col(name))).alias("preview"))


def plausible(parts: DataFrame, height: int, width: int, least_area: int) -> DataFrame:
    """Components that may be plants: large enough, not a speck or a long thin scratch at the edge."""
    edge = (F.col("x") <= 1) | (F.col("y") <= 1) | (F.col("x") + F.col("w") >= width - 1) | (F.col("y") + F.col("h") >= height - 1)
    thin = F.greatest("w", "h") > 12 * F.least("w", "h")
    return parts.where((F.col("area") >= least_area) & ~(edge & thin) & (F.col("w") < width * 0.95))


def slots(parts: DataFrame, frame: list[str], x: str) -> Column:
    """Place of a part among those of its frame, from left to right, from 1."""
    return F.row_number().over(Window.partitionBy(*frame).orderBy(x, "component"))


def nearest_bands(pixels: DataFrame, keys: list[str], targets: dict[str, float]) -> DataFrame:
    """For each pixel the values of the bands nearest to the target wavelengths (the lower of two equally near)."""
    return pixels.groupBy(*keys).agg(*(F.min_by("value", F.struct(F.abs(F.col("wavelength") - t), F.col("wavelength"))).alias(n) for n, t in targets.items()))


def shoot_measure(rescued: Column, model: Column, green: Column, enabled: Column, pixel_mm: Column) -> Column:
    """``struct(px, mm2, source)``: green pixels where rescue is on and found any, else rescued ones, else the model's."""
    on = F.coalesce(enabled, F.lit(False))
    px = F.when(on & (green > 0), green).when(on & (rescued > 0), rescued).otherwise(F.coalesce(model, F.lit(0)))
    source = F.when(on & (green > 0), "rgb_green_only").when(on & (rescued > 0), "rgb_rescue").otherwise("mask_class")
    return F.struct(px.cast("long").alias("px"), (px * pixel_mm * pixel_mm).alias("mm2"), source.alias("source"))


def class_named(label: Column | str) -> Column:
    """The standard name of a label class; null for names that aren't known."""
    word = F.regexp_replace(F.lower(clean_text(label)), r"[\s-]+", "_")
    out = F.lit(None).cast("string")
    for name, words in CLASS_SYNONYMS.items():
        out = F.when(word.isin(*words), name).otherwise(out)
    return out


def mask_quality(pixels: Column, total: Column, parts: Column) -> Column:
    """``struct(coverage, status)`` of a mask: nothing, nearly everything and very many parts are worth a look."""
    coverage = F.coalesce(pixels.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0))
    status = F.when(coverage == 0, "empty").when(coverage > 0.9, "overfull").when(parts > 200, "fragmented").otherwise("ok")
    return F.struct(coverage.alias("coverage"), status.alias("status"))


def in_range(value: Column, low: float, high: float) -> Column:
    """1 within a range, falling to 0 at two widths of it beyond."""
    if high <= low:
        return F.lit(1.0)
    off = F.when(value < low, low - value).when(value > high, value - high).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), 1.0 - off / (2.0 * (high - low)))


def numeric_summary(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Totals by group of whatever holds numbers."""
    return df.groupBy(group).agg(*(F.sum(number(F.col(m).cast("string"))).alias(m) for m in metrics))


def clustered_readings(readings: DataFrame, image: list[str], reach: float = 0.08) -> DataFrame:
    """``*image, text, votes, score``: the best text among readings (``text, confidence, x, y``) whose places lie together.

    Readings join the first group whose centre lies within ``reach``; a group's text is the one with the largest sum of confidence. An image's
    readings are one group.
    """
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in readings.select(*image).schema), "text string, votes int, score double"])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [rows[c].iloc[0] for c in image]
        ordered = sorted(zip(rows["text"], rows["confidence"], rows["x"], rows["y"], strict=True), key=lambda r: (-r[1], r[0]))
        groups: list[dict] = []
        for text, confidence, x, y in ordered:
            g = next((g for g in groups if abs(x - g["x"] / g["n"]) <= reach and abs(y - g["y"] / g["n"]) <= reach), None)
            if g is None:
                groups.append(g := {"n": 0, "x": 0.0, "y": 0.0, "texts": {}})
            g["n"], g["x"], g["y"] = g["n"] + 1, g["x"] + x, g["y"] + y
            total, votes = g["texts"].get(text, (0.0, 0))
            g["texts"][text] = (total + confidence, votes + 1)
        tops = [max(((total, votes, text) for text, (total, votes) in g["texts"].items()), key=lambda t: (t[0], t[2])) for g in groups]
        total, votes, text = max(tops, key=lambda t: t[0])
        return pd.DataFrame([(*keys, text, votes, min(1.0, total / votes + 0.05 * (votes - 1)))], columns=[*image, "text", "votes", "score"])

    return readings.select(*image, "text", "confidence", "x", "y").groupBy(*image).applyInPandas(choose, fields)
