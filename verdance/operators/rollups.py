"""Aggregations of measurement series: summaries of plates and tracks, completeness-gated totals, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_known(v: Column, order: Column) -> Column:
    """The value of the first row, by ``order``, that has one."""
    return F.min_by(v, F.when(v.isNotNull(), order))


def last_known(v: Column, order: Column) -> Column:
    return F.max_by(v, F.when(v.isNotNull(), order))


def ordered_sum(v: Column, order: Column) -> Column:
    """The sum of the known values added in ``order``, so that its last bits are the same in every run; null without any."""
    terms = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(order.alias("at"), v.cast("double").alias("v")))))
    return F.when(F.size(terms) > 0, F.aggregate(terms, F.lit(0.0), lambda total, term: total + term["v"]))


def metric_columns(metric: str, order: Column) -> list[Column]:
    """First, final and largest value of a metric and its change from first to final."""
    v = F.col(metric)
    first, final = first_known(v, order), last_known(v, order)
    return [first.alias(f"first_{metric}"), final.alias(f"final_{metric}"), F.max(v).alias(f"max_{metric}"), (final - first).alias(f"delta_{metric}")]


def plate_summary(df: DataFrame, keys: list[str], order: Column, metrics: list[str]) -> DataFrame:
    """Frames, frames with a positive value, and ``metric_columns`` for each plate."""
    more = [c for m in metrics for c in (*metric_columns(m, order), F.count_if(F.col(m) > 0).alias(f"positive_{m}"), F.sum(m).alias(f"sum_{m}"))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), *more)


def rate_columns(rate: str, hours: str) -> list[Column]:
    """Mean, largest and least rate over rows for which time has passed; four places."""
    v = F.when(F.coalesce(F.col(hours), F.lit(0.0)) > 0, F.col(rate))
    return [F.bround(F.avg(v), 4).alias(f"mean_{rate}"), F.bround(F.max(v), 4).alias(f"max_{rate}"), F.bround(F.min(v), 4).alias(f"min_{rate}")]


def class_coverage(df: DataFrame, classes: dict[int, str]) -> DataFrame:
    """``class_id, total_pixels, frames`` over wide columns of pixel counts; ``missing`` where a class has none at all."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("class_id"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for k, c in classes.items())))
    long = df.select(pairs.alias("p")).select("p.class_id", "p.n")
    return long.groupBy("class_id").agg(F.sum("n").alias("total_pixels"), F.count_if(F.col("n") > 0).alias("frames")).withColumn("missing", F.col("frames") == 0)


def complete_rollup(df: DataFrame, keys: list[str], plant: str, valid: str, expected: int, gated: dict[str, str], always: dict[str, str]) -> DataFrame:
    """Plate totals from plants: ``gated`` sums and means only where all ``expected`` plants are valid, ``always`` sums regardless.

    Both map output names to columns; sums of nothing are null.
    """
    ok = F.coalesce(F.col(valid), F.lit(False))
    n_valid = F.countDistinct(F.when(ok, F.col(plant)))
    complete = n_valid == expected
    rows = [F.countDistinct(plant).alias("observed_owners"), n_valid.alias("valid_owners"), complete.alias("complete")]
    for name, c in gated.items():
        v = F.when(ok, F.col(c))
        rows += [F.when(complete, F.sum(v)).alias(name), F.when(complete, F.avg(v)).alias(name.replace("total_", "mean_", 1) if name.startswith("total_") else f"mean_{name}")]
    rows += [F.sum(c).alias(name) for name, c in always.items()]
    return df.groupBy(*keys).agg(*rows)


def compartments(df: DataFrame, keys: list[str], plant: str, metrics: list[str]) -> DataFrame:
    """Plants and sums per frame; the sum of nothing is 0 here."""
    return df.groupBy(*keys).agg(F.countDistinct(plant).alias("plants"), *(F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in metrics))


def describe(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """``scope, metric`` and count, mean, std, min, quartiles, max: over all rows (scope ``all``) and each group. std of one row is 0."""
    long = df.unpivot([group], metrics, "metric", "value").where("value IS NOT NULL")
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = [
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("least"),
        quartiles.alias("q"),
        F.max("value").alias("most"),
    ]
    level = F.grouping_id()
    out = long.groupingSets([["metric"], ["metric", group]], "metric", group).agg(level.alias("level"), *stats)
    q = [F.col("q")[k].alias(name) for k, name in enumerate(("q25", "median", "q75"))]
    return out.select(F.when(F.col("level") == 0, F.col(group)).otherwise("all").alias("scope"), "metric", "n", "mean", "std", "least", *q, "most")


def distinct_reasons(listed: str, order: Column) -> Column:
    """All reasons of a group's ``;``-joined lists, each once, in the order in which they first appear."""
    lists = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(listed).alias("r")))), lambda s: F.split(s["r"], ";"))
    return F.array_join(F.array_distinct(F.filter(F.flatten(lists), lambda r: r != "")), ";")


def frame_qa(df: DataFrame, frame: list[str], status: str, listed: str, order: Column) -> DataFrame:
    """Failing, doubtful and sound rows of each frame, its worst status and reasons."""
    n = lambda s: F.count_if(F.col(status) == s)
    worst = F.when(n("fail") > 0, "fail").when(n("review") > 0, "review").otherwise("ok")
    return df.groupBy(*frame).agg(n("fail").alias("fail"), n("review").alias("review"), n("ok").alias("ok"), worst.alias("status"), distinct_reasons(listed, order).alias("reasons"))


def plate_qa(frames: DataFrame, plate: list[str], status: str = "status") -> DataFrame:
    bad = F.col(status) != "ok"
    return frames.groupBy(*plate).agg(F.count(F.lit(1)).alias("frames"), F.count_if(bad).alias("frames_with_review"), F.bool_or(bad).alias("needs_review"))


def identity_state(df: DataFrame, track: list[str], order: Column, state: list[str], valid: str) -> DataFrame:
    """``first, final, final_valid``: a track's states at its first, last and last valid row."""
    s = F.struct(*state)
    return df.groupBy(*track).agg(F.min_by(s, order).alias("first"), F.max_by(s, order).alias("final"), F.max_by(s, F.when(F.coalesce(F.col(valid), F.lit(False)), order)).alias("final_valid"))


def region_pixels(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``mean, pixels, total`` of each region; the mean of no known value is null, its total 0."""
    return pixels.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("pixels"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def region_bands(pixels: DataFrame, keys: list[str], band: str, value: str, bands: list) -> DataFrame:
    """One row per region and statistic (mean, sum, population std), one column for each of ``bands``."""
    stats = pixels.groupBy(*keys, band).agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.stddev_pop(value).alias("std"))
    return stats.unpivot([*keys, band], ["mean", "sum", "std"], "statistic", "value").groupBy(*keys, "statistic").pivot(band, bands).agg(F.first("value"))


def comparison(current: DataFrame, baseline: DataFrame, keys: list[str], valid: str) -> DataFrame:
    """Valid rows by key now and before, and the difference; keys on one side count 0 on the other."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count_if(F.coalesce(F.col(valid), F.lit(False))).alias(name))
    both = n(current, "valid_now").join(n(baseline, "valid_before"), keys, "full_outer").na.fill(0, ["valid_now", "valid_before"])
    return both.withColumn("change", F.col("valid_now") - F.col("valid_before"))


def track_rollup(observations: DataFrame, track: list[str], frame: str, length: str, x: str, y: str, parent: str) -> DataFrame:
    """Birth, death, lengths, way, speeds (mean, largest, 90th and 95th hundredth) and the parent most often voted for with its share."""
    from .windows import delta, series

    w = series(track, [frame])
    step = F.hypot(delta(F.col(x), w), delta(F.col(y), w))
    rows = observations.withColumns({"__step": step, "__speed": delta(F.col(length), w) / delta(F.col(frame), w)})
    votes = observations.where(F.col(parent).isNotNull()).groupBy(*track, parent).agg(F.count(F.lit(1)).alias("votes"))
    best = F.max_by(F.struct(F.col(parent).alias("parent"), "votes"), F.struct(F.col("votes"), -F.col(parent)))
    top = votes.groupBy(*track).agg(best.alias("b"), F.sum("votes").alias("all")).select(*track, F.col("b.parent").alias("parent"), (F.col("b.votes") / F.col("all")).alias("parent_share"))
    out = rows.groupBy(*track).agg(
        F.min(frame).alias("birth"),
        F.max(frame).alias("death"),
        F.max(length).alias("max_length"),
        F.coalesce(F.sum("__step"), F.lit(0.0)).alias("way"),
        F.avg("__speed").alias("mean_speed"),
        F.max("__speed").alias("max_speed"),
        F.percentile("__speed", 0.9).alias("p90_speed"),
        F.percentile("__speed", 0.95).alias("p95_speed"),
    )
    return out.join(top, track, "left")
