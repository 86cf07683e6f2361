"""Per-entity window operators over measurement series.

Every function takes the names of the entity's key columns and of the columns that order its rows (the last of them unique, so that
the result is one). All share one sort by key and order, so several of them cost a single shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order))


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def delta_filled(v: Column, w: WindowSpec) -> Column:
    """Change since the row before; 0 for the first row and next to gaps."""
    return F.coalesce(v - F.lag(v).over(w), F.lit(0.0))


def delta_from_first(v: Column, w: WindowSpec) -> Column:
    """Change since the row before; 0 for a first row that has a value; null next to gaps."""
    return F.when((F.row_number().over(w) == 1) & v.isNotNull(), F.lit(0.0)).otherwise(v - F.lag(v).over(w))


def delta(v: Column, w: WindowSpec) -> Column:
    """Change since the row before; null for the first row and next to gaps."""
    return v - F.lag(v).over(w)


def delta_known_keys(v: Column, keys: list[str], w: WindowSpec) -> Column:
    """``delta``, but null where part of the key is missing."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known, v - F.lag(v).over(w))


def elapsed_hours(ts: Column, frame: Column, timestep: Column | None, w: WindowSpec) -> Column:
    """``struct(hours, source)`` since the row before.

    By the clock if it moved on; else by frames times the timestep; else by frames at an hour each; else one hour. 0 for the first row.
    """
    clock = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), ts).cast("double") / 3.6e9
    frames = (frame - F.lag(frame).over(w)).cast("double")
    moved = F.when(frames > 0, frames).otherwise(F.lit(1.0))
    made = lambda hours, source: F.struct(hours.alias("hours"), F.lit(source).alias("source"))
    out = F.when(F.row_number().over(w) == 1, made(F.lit(0.0), "first_frame")).when(clock > 0, made(clock, "timestamp"))
    if timestep is not None:
        out = out.when(timestep > 0, made(moved * timestep, "timestep"))
    return out.when(frame.isNotNull(), made(moved, "frame_index_default_1h")).otherwise(made(F.lit(1.0), "row_order_default_1h"))


def growth_per_day(change: Column, hours: Column) -> Column:
    """Change per day; 0 where no time has passed and nothing changed, null where it did or is unknown."""
    days = F.coalesce(hours, F.lit(0.0)) / 24.0
    return F.when(days > 0, change / days).when(change == 0, F.lit(0.0))


def centre_jump(x: Column, y: Column, w: WindowSpec) -> Column:
    """Distance from the row before; 0 where either place is unknown."""
    return F.coalesce(F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)), F.lit(0.0))


def centre_jump_from_last_known(x: Column, y: Column, w: WindowSpec) -> Column:
    """Distance from the last known place; 0 without one."""
    place = F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
    last = F.last(place, ignorenulls=True).over(earlier(w))
    return F.coalesce(F.hypot(x - last["x"], y - last["y"]), F.lit(0.0))


def running_max(v: Column, w: WindowSpec) -> Column:
    return F.max(v).over(so_far(w))


def without_short_runs(df: DataFrame, value: str, keys: list[str], order: list[str], least: int, out: str) -> DataFrame:
    """``out``: ``value`` with runs of fewer than ``least`` positive rows set to 0; null counts as 0."""
    w = series(keys, order)
    positive = F.coalesce(F.col(value) > 0, F.lit(False))
    changed = (positive != F.coalesce(F.lag(positive).over(w), ~positive)).cast("int")
    marked = df.withColumn("__on", positive).withColumn("__run", F.sum(changed).over(so_far(w)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__run"))
    kept = F.when(F.col("__on") & (size >= least), F.col(value)).otherwise(F.lit(0.0))
    return marked.withColumn(out, kept).drop("__on", "__run")


def rolling_median(v: Column, w: WindowSpec, reach: int = 2) -> Column:
    """Exact median of the rows up to ``reach`` before and after; fewer at the ends."""
    return F.percentile(v, 0.5).over(w.rowsBetween(-reach, reach))


def carried_total(total: Column, primary: Column, lateral: Column, w: WindowSpec) -> Column:
    """Length that can't shrink while roots are hidden: the largest total so far, or the largest parts so far if they make more."""
    top = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.max(c).over(so_far(w)), F.lit(0.0)))
    return F.greatest(top(total), top(primary) + top(lateral))


def gated_carry(v: Column, valid: Column, w: WindowSpec) -> Column:
    """``struct(value, status)``: the largest valid value so far, and whether this row advanced it, kept it, or was frozen as invalid."""
    now = F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(valid, v)).over(so_far(w)), F.lit(0.0)))
    before = F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(valid, v)).over(earlier(w)), F.lit(0.0)))
    status = F.when(~valid, "frozen").when(now > before, "advanced").otherwise("retained")
    return F.struct(now.alias("value"), status.alias("status"))


def clean_series(df: DataFrame, value: str, valid: str, keys: list[str], order: list[str], least: int, out: str) -> DataFrame:
    """``out``: invalid rows null; else the running maximum over valid rows after short runs are taken out."""
    gated = df.withColumn("__v", F.when(F.col(valid), F.coalesce(F.col(value), F.lit(0.0))).otherwise(F.lit(0.0)))
    gated = without_short_runs(gated, "__v", keys, order, least, "__v")
    top = F.max(F.when(F.col(valid), F.col("__v"))).over(so_far(series(keys, order)))
    return gated.withColumn(out, F.when(F.col(valid), top)).drop("__v")


def speed_since_valid(v: Column, frame: Column, valid: Column, timestep_hours: float, w: WindowSpec) -> Column:
    """Change per hour since the last valid row; null for invalid rows and the first valid one."""
    last = F.last(F.when(valid & v.isNotNull(), F.struct(frame.alias("f"), v.alias("v"))), ignorenulls=True).over(earlier(w))
    hours = (frame - last["f"]).cast("double") * timestep_hours
    return F.when(valid & (hours > 0), (v - last["v"]) / hours)


def spread(keys: list[str], **aggregates: Column) -> dict[str, Column]:
    """Aggregates of a group beside each of its rows."""
    return {name: a.over(Window.partitionBy(*keys)) for name, a in aggregates.items()}


def decayed_overlay(values: Column, keep: float, threshold: float = 0.5) -> Column:
    """For an array of 0/1 values: whether ``acc = value + keep * acc`` exceeds the threshold, at each place."""
    step = lambda s, v: F.struct((v + s["acc"] * keep).alias("acc"), F.concat(s["out"], F.array(v + s["acc"] * keep > threshold)).alias("out"))
    start = F.struct(F.lit(0.0).alias("acc"), F.array().cast("array<boolean>").alias("out"))
    return F.aggregate(values, start, step, lambda s: s["out"])


def onset(df: DataFrame, value: str, frame: str, keys: list[str]) -> DataFrame:
    """``first_frame, half_frame, steepest_frame`` of each entity: first positive value, half of its maximum, largest rise (earliest)."""
    w = series(keys, [frame])
    rows = df.withColumns({"__top": F.max(value).over(Window.partitionBy(*keys)), "__rise": F.col(value) - F.lag(value).over(w)})
    half = F.when((F.col("__top") > 0) & (F.col(value) >= F.col("__top") * 0.5), F.col(frame))
    steep = F.min(F.when(F.col("__rise").isNotNull(), F.struct((-F.col("__rise")).alias("r"), F.col(frame).alias("f"))))
    return rows.groupBy(*keys).agg(F.min(F.when(F.col(value) > 0, F.col(frame))).alias("first_frame"), F.min(half).alias("half_frame"), steep["f"].alias("steepest_frame"))


def allocated_names(df: DataFrame, plate: str, acquired: str, name: str, row_id: str) -> DataFrame:
    """``plate_frame_index, allocated_name``: images of a plate numbered by time and name; equal final names get ``__captureNN``.

    Plates without an id are named after the file. Times are TIMESTAMP_NTZ, unknown ones come last and are called ``undated``.
    """
    from ..functions.text import plate_id

    clean = plate_id(plate)
    key = F.when(clean == "", F.lit("~unidentified")).otherwise(F.lower(clean))
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    extension = F.lower(F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1))
    date = F.coalesce(F.date_format(acquired, "yyyyMMdd_HHmmss"), F.lit("undated"))
    fallback = F.when(plate_id(stem) == "", F.lit("unidentified")).otherwise(plate_id(stem))
    base = F.concat(F.when(clean == "", fallback).otherwise(clean), F.lit("__"), date)
    rows = df.withColumns({"__key": key, "__base": base, "__ext": F.when(extension == "", F.lit(".png")).otherwise(extension), "__name": F.lower(name)})
    order = [F.col(acquired).asc_nulls_last(), F.col("__name"), F.col(name), F.col(row_id)]
    n = F.row_number().over(Window.partitionBy(F.lower("__base"), "__ext").orderBy(F.col("__key"), *order))
    full = F.concat("__base", F.when(n > 1, F.concat(F.lit("__capture"), F.lpad(n.cast("string"), 2, "0"))).otherwise(F.lit("")), F.col("__ext"))
    index = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return rows.withColumns({"plate_frame_index": index, "allocated_name": full}).drop("__key", "__base", "__ext", "__name")
