"""Periods and functional components of growth curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dominant_periods(df: DataFrame, keys: list[str], place: str, value: str, timestep_hours: float, top: int = 3) -> DataFrame:
    """``*keys, rank, period_hours, amplitude``: the strongest periods of each series, by its discrete Fourier transform.

    ``place`` counts a series' rows from 0 without gaps. Series of fewer than four rows have none; equal amplitudes go to the longer period.
    A series is one group; its transform takes time in proportion to its length and the logarithm of it.
    """
    columns = [*keys, "rank", "period_hours", "amplitude"]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), "rank int, period_hours double, amplitude double"])

    def transform(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("__i")["__v"].to_numpy(float)
        if len(v) < 4:
            return pd.DataFrame(columns=columns)
        amplitude = np.abs(np.fft.rfft(v - v.mean()))[1:]
        k = np.arange(1, len(amplitude) + 1)
        best = np.lexsort((k, -np.round(amplitude, 6)))[:top]
        best = best[amplitude[best] > 1e-9]
        return pd.DataFrame({c: rows[c].iloc[0] for c in keys} | {"rank": np.arange(1, len(best) + 1), "period_hours": len(v) * timestep_hours / k[best], "amplitude": amplitude[best]}, columns=columns)

    return df.select(*keys, F.col(place).alias("__i"), F.col(value).alias("__v")).groupBy(*keys).applyInPandas(transform, fields)


def functional_components(df: DataFrame, group: list[str], track: str, place: str, value: str, degree: int = 5, components: int = 3) -> DataFrame:
    """``*group, track, component, score, explained``: principal components of the tracks' fitted polynomials, by group.

    Gaps are filled linearly; tracks need two known values and groups two tracks of one length, four places at least. A group's tracks
    come as one short array each; the largest weight of a component is positive.
    """
    series = df.groupBy(*group, track).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("values"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group, track).schema), "component int, score double, explained double"])
    columns = [*group, track, "component", "score", "explained"]

    def analyse(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(track)
        empty = pd.DataFrame(columns=columns)
        lengths = {len(v) for v in rows["values"]}
        if len(rows) < 2 or len(lengths) != 1 or (n := lengths.pop()) < 4:
            return empty
        names, curves = [], []
        for name, v in zip(rows[track], rows["values"], strict=True):
            v = np.array([np.nan if x is None else x for x in v], float)
            known = np.isfinite(v)
            if known.sum() >= 2:
                names.append(name)
                curves.append(np.interp(np.arange(n), np.flatnonzero(known), v[known]))
        if len(names) < 2:
            return empty
        basis = np.vander(np.linspace(0, 1, n), min(degree, n - 1) + 1, increasing=True)
        weights = np.linalg.lstsq(basis, np.array(curves).T, rcond=None)[0].T
        centred = weights - weights.mean(axis=0)
        _, s, vt = np.linalg.svd(centred, full_matrices=False)
        vt = vt * np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        share = s**2 / max(float((s**2).sum()), 1e-9)
        k = min(components, len(vt))
        scores = centred @ vt[:k].T
        keys = {g: rows[g].iloc[0] for g in group}
        return pd.DataFrame([{**keys, track: name, "component": j + 1, "score": float(scores[i, j]), "explained": float(share[j])} for i, name in enumerate(names) for j in range(k)], columns=columns)

    return series.groupBy(*group).applyInPandas(analyse, fields)


def timestep_hours(declared: Column, hours: Column, frames: Column) -> Column:
    """A declared timestep over 0, else hours by frames, else one hour."""
    return F.coalesce(F.when(declared > 0, declared.cast("double")), F.when((hours > 0) & (frames > 0), hours / frames), F.lit(1.0))


def stretched(df: DataFrame, keys: list[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``value`` stretched between two of its hundredths, by key, to 0..255; a flat one is 0."""
    ends = df.groupBy(*keys).agg(F.percentile(value, low).alias("__a"), F.percentile(value, high).alias("__b"))
    span = F.col("__b") - F.col("__a")
    out = F.when(span > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("__a")) / span)) * 255)).otherwise(0).cast("int")
    return df.join(ends, keys).withColumn(value, out).drop("__a", "__b")
