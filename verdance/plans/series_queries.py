"""Queries on growth series: windows, gates, reviews and roll-ups. Each has its equivalent in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..operators import qa, rollups, windows
from .roles import FRAMES, ORDER, PLATE, TRACK, frames, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


W = "OVER (PARTITION BY series, petri, plant_id ORDER BY ts, event_id)"
FIRST = "(PARTITION BY series, petri, plant_id ORDER BY ts, event_id"


def track():
    return windows.series(TRACK, ORDER)


def r4(c, name):
    return F.round(c, 4).alias(name)


@query(
    f"""WITH {FRAMES} SELECT series, petri, count(*) AS frames, round(arg_min(total_mm, (ts, event_id)), 4) AS first_total_mm,
  round(arg_max(total_mm, (ts, event_id)), 4) AS final_total_mm, round(max(total_mm), 4) AS max_total_mm,
  round(arg_max(total_mm, (ts, event_id)) - arg_min(total_mm, (ts, event_id)), 4) AS delta_total_mm,
  count(*) FILTER (WHERE total_mm > 0) AS positive_total_mm, round(sum(total_mm), 4) AS sum_total_mm FROM frames GROUP BY ALL"""
)
def plate_summary(spark, d):
    """AGG1, AGG3: frames, first, final, largest, change, positive frames and sum by plate."""
    out = rollups.plate_summary(frames(spark, d), PLATE, F.struct(*ORDER), ["total_mm"])
    return out.select(*PLATE, "frames", *(r4(F.col(f"{k}_total_mm"), f"{k}_total_mm") for k in ("first", "final", "max", "delta")), "positive_total_mm", r4(F.col("sum_total_mm"), "sum_total_mm"))


@query(
    f"""WITH {FRAMES}, c AS (SELECT unnest([1, 2, 3]) AS class_id, unnest([CASE WHEN plant_id = 'click' THEN k ELSE 0 END, CASE WHEN plant_id = 'view' THEN k ELSE 0 END, 0]) AS n FROM frames)
SELECT class_id, CAST(sum(n) AS BIGINT) AS total_pixels, count(*) FILTER (WHERE n > 0) AS frames, count(*) FILTER (WHERE n > 0) = 0 AS missing FROM c GROUP BY class_id"""
)
def class_coverage(spark, d):
    """AGG2: pixels and frames of each class, and classes that never occur."""
    f = frames(spark, d).withColumns({"c1": F.when(F.col("plant_id") == "click", F.col("k")).otherwise(0), "c2": F.when(F.col("plant_id") == "view", F.col("k")).otherwise(0), "c3": F.lit(0)})
    return rollups.class_coverage(f, {1: "c1", 2: "c2", 3: "c3"})


@query(
    """WITH l AS (SELECT l_returnflag AS g, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS metric, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem)
SELECT CASE WHEN grouping(g) = 0 THEN g ELSE 'all' END AS scope, metric, count(v) AS n, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std, min(v) AS least,
  round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS most
FROM l GROUP BY GROUPING SETS ((metric), (metric, g))"""
)
def desc_stats_grouping_sets(spark, d):
    """AGG7: descriptive statistics over all rows and by group."""
    out = rollups.describe(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("scope", "metric", "n", *(r4(F.col(c), c) for c in ("mean", "std")), "least", *(r4(F.col(c), c) for c in ("q25", "median", "q75")), "most")


@query(
    f"""WITH {FRAMES}, v AS (SELECT *, CASE WHEN valid THEN total_mm END AS v FROM frames)
SELECT event_id, round(coalesce(v - lag(v) {W}, 0), 4) AS filled, round(CASE WHEN row_number() {W} = 1 AND v IS NOT NULL THEN 0 ELSE v - lag(v) {W} END, 4) AS from_first,
  round(v - lag(v) {W}, 4) AS plain, round(CASE WHEN plant_id IS NOT NULL THEN v - lag(v) {W} END, 4) AS known FROM v"""
)
def series_deltas(spark, d):
    """WIN1, WIN2, WIN3, WIN7: the three kinds of change, and the one for known keys."""
    v, w = F.col("v"), track()
    f = frames(spark, d).withColumn("v", F.when(F.col("valid"), F.col("total_mm")))
    return f.select(
        "event_id", r4(windows.delta_filled(v, w), "filled"), r4(windows.delta_from_first(v, w), "from_first"), r4(windows.delta(v, w), "plain"), r4(windows.delta_known_keys(v, ["plant_id"], w), "known")
    )


@query(
    f"""WITH {FRAMES}, t AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE ts END AS t, CASE WHEN k % 7 = 0 THEN NULL ELSE frame_index END AS f, CASE WHEN k % 2 = 0 THEN 2.5::DOUBLE END AS step FROM frames),
x AS (SELECT *, row_number() {W} AS n, date_diff('microsecond', lag(t) {W}, t) / 3.6e9 AS clock, CAST(f - lag(f) {W} AS DOUBLE) AS moved, total_mm - lag(total_mm) {W} AS d FROM t),
y AS (SELECT *, CASE WHEN moved > 0 THEN moved ELSE 1.0 END AS m FROM x),
z AS (SELECT event_id, n, d, CASE WHEN n = 1 THEN 0.0 WHEN clock > 0 THEN clock WHEN step > 0 THEN m * step WHEN f IS NOT NULL THEN m ELSE 1.0 END AS h,
  CASE WHEN n = 1 THEN 'first_frame' WHEN clock > 0 THEN 'timestamp' WHEN step > 0 THEN 'timestep' WHEN f IS NOT NULL THEN 'frame_index_default_1h' ELSE 'row_order_default_1h' END AS source FROM y)
SELECT event_id, round(h, 6) AS hours, source, round(CASE WHEN h > 0 THEN CASE WHEN n = 1 THEN 0 ELSE d END / (h / 24) WHEN n = 1 THEN 0 END, 4) AS per_day FROM z"""
)
def elapsed_growth(spark, d):
    """WIN4, PRJ14: hours since the row before with the rule that gave them, and growth per day."""
    f = frames(spark, d).withColumns({"t": F.when(F.col("k") % 3 != 0, F.col("ts")), "f": F.when(F.col("k") % 7 != 0, F.col("frame_index")), "step": F.when(F.col("k") % 2 == 0, F.lit(2.5))})
    w = track()
    out = f.withColumn("e", windows.elapsed_hours(F.col("t"), F.col("f"), F.col("step"), w)).withColumn("change", windows.delta_from_first(F.col("total_mm"), w))
    return out.select("event_id", F.round("e.hours", 6).alias("hours"), "e.source", r4(windows.growth_per_day(F.col("change"), F.col("e.hours")), "per_day"))


@query(
    f"""WITH {FRAMES}, c AS (SELECT *, CASE WHEN bbox_w > 0 AND bbox_h > 0 THEN bbox_x + bbox_w / 2.0::DOUBLE END AS cx, CASE WHEN bbox_w > 0 AND bbox_h > 0 THEN bbox_y + bbox_h / 2.0::DOUBLE END AS cy FROM frames),
l AS (SELECT *, last_value(CASE WHEN cx IS NOT NULL THEN cx END IGNORE NULLS) OVER {FIRST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lx,
  last_value(CASE WHEN cx IS NOT NULL THEN cy END IGNORE NULLS) OVER {FIRST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ly FROM c)
SELECT event_id, round(cx, 2) AS cx, round(coalesce(sqrt((cx - lag(cx) {W}) ** 2 + (cy - lag(cy) {W}) ** 2), 0), 4) AS jump, round(coalesce(sqrt((cx - lx) ** 2 + (cy - ly) ** 2), 0), 4) AS jump_known FROM l"""
)
def centre_jumps(spark, d):
    """PRJ12, WIN5, WIN6: box centres and how far they jump from the row before and from the last known place."""
    box, w = Box.of(), track()
    x, y = box.centre
    f = frames(spark, d).withColumns({"cx": x, "cy": y})
    return f.select("event_id", F.round("cx", 2).alias("cx"), r4(windows.centre_jump(F.col("cx"), F.col("cy"), w), "jump"), r4(windows.centre_jump_from_last_known(F.col("cx"), F.col("cy"), w), "jump_known"))


RUNS = f"""v AS (SELECT *, CASE WHEN k % 4 = 0 THEN 0 ELSE total_mm END AS v FROM frames),
g AS (SELECT *, v > 0 AS pos, CASE WHEN (v > 0) <> coalesce(lag(v > 0) {W}, NOT (v > 0)) THEN 1 ELSE 0 END AS ch FROM v),
h AS (SELECT *, sum(ch) {W} AS run FROM g), s AS (SELECT *, count(*) OVER (PARTITION BY series, petri, plant_id, run) AS n FROM h)"""


@query(
    f"""WITH {FRAMES}, {RUNS} SELECT event_id, round(CASE WHEN pos AND n >= 3 THEN v ELSE 0 END, 4) AS kept, round(max(v) OVER {FIRST} ROWS UNBOUNDED PRECEDING), 4) AS highest,
  round(median(v) OVER {FIRST} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM s"""
)
def short_runs_and_smoothing(spark, d):
    """WIN8, WIN9, WIN10: without short positive runs, running maximum, centred median of five."""
    f = frames(spark, d).withColumn("v", F.when(F.col("k") % 4 == 0, F.lit(0.0)).otherwise(F.col("total_mm")))
    f = windows.without_short_runs(f, "v", TRACK, ORDER, 3, "kept")
    return f.select("event_id", r4(F.col("kept"), "kept"), r4(windows.running_max(F.col("v"), track()), "highest"), r4(windows.rolling_median(F.col("v"), track()), "smooth"))


@query(
    f"""WITH {FRAMES}, o AS (SELECT *, CASE WHEN k % 5 = 0 THEN 0 ELSE total_mm END AS t, k % 3 <> 0 AS ok FROM frames),
c AS (SELECT event_id, ok, greatest(0, coalesce(max(t) OVER {FIRST} ROWS UNBOUNDED PRECEDING), 0)) AS top, greatest(0, max(primary_mm) OVER {FIRST} ROWS UNBOUNDED PRECEDING)) AS p,
  greatest(0, max(lateral_mm) OVER {FIRST} ROWS UNBOUNDED PRECEDING)) AS l, greatest(0, coalesce(max(CASE WHEN ok THEN t END) OVER {FIRST} ROWS UNBOUNDED PRECEDING), 0)) AS now,
  greatest(0, coalesce(max(CASE WHEN ok THEN t END) OVER {FIRST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM o)
SELECT event_id, round(greatest(top, p + l), 4) AS carried, round(now, 4) AS gated, CASE WHEN NOT ok THEN 'frozen' WHEN now > before THEN 'advanced' ELSE 'retained' END AS status FROM c"""
)
def carry_forward(spark, d):
    """WIN11, WIN12, PRJ15: lengths that can't shrink, and the largest valid length with what each row did to it."""
    w = track()
    f = frames(spark, d).withColumns({"t": F.when(F.col("k") % 5 == 0, F.lit(0.0)).otherwise(F.col("total_mm")), "ok": F.col("k") % 3 != 0})
    f = f.withColumn("g", windows.gated_carry(F.col("t"), F.col("ok"), w))
    return f.select("event_id", r4(windows.carried_total(F.col("t"), F.col("primary_mm"), F.col("lateral_mm"), w), "carried"), r4(F.col("g.value"), "gated"), "g.status")


@query(
    f"""WITH {FRAMES}, u AS (SELECT *, k % 3 <> 0 AS ok, CASE WHEN k % 3 <> 0 THEN total_mm ELSE 0 END AS v FROM frames),
g AS (SELECT *, v > 0 AS pos, CASE WHEN (v > 0) <> coalesce(lag(v > 0) {W}, NOT (v > 0)) THEN 1 ELSE 0 END AS ch FROM u),
h AS (SELECT *, sum(ch) {W} AS run FROM g), s AS (SELECT *, count(*) OVER (PARTITION BY series, petri, plant_id, run) AS n FROM h),
c AS (SELECT *, CASE WHEN pos AND n >= 2 THEN v ELSE 0 END AS kept FROM s)
SELECT event_id, round(CASE WHEN ok THEN max(CASE WHEN ok THEN kept END) OVER {FIRST} ROWS UNBOUNDED PRECEDING) END, 4) AS clean,
  round(CASE WHEN ok AND frame_index > last_value(CASE WHEN ok THEN frame_index END IGNORE NULLS) OVER {FIRST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN (total_mm - last_value(CASE WHEN ok THEN total_mm END IGNORE NULLS) OVER {FIRST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    / ((frame_index - last_value(CASE WHEN ok THEN frame_index END IGNORE NULLS) OVER {FIRST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) * 0.5::DOUBLE) END, 7) AS speed FROM c"""
)
def clean_series_and_speed(spark, d):
    """WIN13, WIN14: the gated, cleaned, monotone series, and speed since the last valid row."""
    f = frames(spark, d).withColumn("ok", F.col("k") % 3 != 0)
    f = windows.clean_series(f, "total_mm", "ok", TRACK, ORDER, 2, "clean")
    return f.select("event_id", r4(F.col("clean"), "clean"), F.round(windows.speed_since_valid(F.col("total_mm"), F.col("frame_index"), F.col("ok"), 0.5, track()), 7).alias("speed"))


@query(
    f"""WITH {FRAMES} SELECT event_id, count(*) OVER (PARTITION BY series, petri) AS rows, round(sum(total_mm) OVER (PARTITION BY series, petri), 4) AS total,
  count(DISTINCT plant_id) OVER (PARTITION BY series, petri) AS plants, CAST(row_number() OVER (PARTITION BY series, petri ORDER BY ts, event_id) - 1 AS INTEGER) AS ordinal FROM frames"""
)
def group_transforms(spark, d):
    """WIN15, WIN16, SRT5, SRT6: aggregates of the plate beside each row, distinct plants, ordinals."""
    p = Window.partitionBy(*PLATE)
    return frames(spark, d).select(
        "event_id",
        F.count(F.lit(1)).over(p).alias("rows"),
        r4(F.sum("total_mm").over(p), "total"),
        F.size(F.collect_set("plant_id").over(p)).cast("long").alias("plants"),
        (F.row_number().over(windows.series(PLATE, ORDER)) - 1).alias("ordinal"),
    )


@query(
    f"""WITH {FRAMES}, m AS (SELECT petri, frame_index AS i, CASE WHEN k % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM frames)
SELECT a.petri, a.i AS frame_index, sum(b.v * pow(0.4::DOUBLE, a.i - b.i)) > 0.5 AS kept FROM m a JOIN m b ON a.petri = b.petri AND b.i <= a.i GROUP BY ALL"""
)
def decayed_overlay(spark, d):
    """WIN17: presence that fades instead of ending at once."""
    f = frames(spark, d).select("petri", "frame_index", F.when(F.col("k") % 4 == 0, 1.0).otherwise(0.0).alias("v"))
    each = f.groupBy("petri").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "v"))), lambda s: s["v"]).alias("values"))
    return each.select("petri", F.posexplode(windows.decayed_overlay(F.col("values"), 0.4)).alias("frame_index", "kept"))


@query(
    f"""WITH {FRAMES}, r AS (SELECT *, CASE WHEN k % 3 = 0 THEN 0 ELSE total_mm END AS v FROM frames), t AS (SELECT *, max(v) OVER (PARTITION BY petri) AS top, v - lag(v) OVER (PARTITION BY petri ORDER BY frame_index) AS rise FROM r)
SELECT petri, min(frame_index) FILTER (WHERE v > 0) AS first_frame, min(frame_index) FILTER (WHERE top > 0 AND v >= top * 0.5) AS half_frame, arg_min(frame_index, (-rise, frame_index)) FILTER (WHERE rise IS NOT NULL) AS steepest_frame FROM t GROUP BY petri"""
)
def growth_onset(spark, d):
    """WIN21, AGG20: first frame, half of the maximum, steepest rise."""
    f = frames(spark, d).withColumn("v", F.when(F.col("k") % 3 == 0, F.lit(0.0)).otherwise(F.col("total_mm")))
    return windows.onset(f, "v", "frame_index", ["petri"])


@query(
    r"""WITH n AS (SELECT p_partkey, p_brand AS plate, CASE WHEN p_size % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(p_size % 4 AS INTEGER) END AS taken, 'IMG ' || CAST(p_size AS VARCHAR) || '.JPG' AS name FROM part),
c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(plate), '\s+', '_', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._-') AS id FROM n),
b AS (SELECT *, id || '__' || coalesce(strftime(taken, '%Y%m%d_%H%M%S'), 'undated') AS base FROM c)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY lower(id) ORDER BY taken NULLS LAST, lower(name), name, p_partkey) AS INTEGER) AS plate_frame_index,
  base || CASE WHEN row_number() OVER (PARTITION BY lower(base) ORDER BY taken NULLS LAST, lower(name), name, p_partkey) > 1
    THEN '__capture' || lpad(CAST(row_number() OVER (PARTITION BY lower(base) ORDER BY taken NULLS LAST, lower(name), name, p_partkey) AS VARCHAR), 2, '0') ELSE '' END || '.jpg' AS allocated_name FROM b"""
)
def allocate_names(spark, d):
    """WIN20, STR12, SRT14: plate images numbered in time, their final names made unique."""
    p = table(spark, d, "part")
    taken = F.when(F.col("p_size") % 3 != 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, p_size % 4)"))
    rows = p.select("p_partkey", F.col("p_brand").alias("plate"), taken.alias("taken"), F.concat(F.lit("IMG "), F.col("p_size").cast("string"), F.lit(".JPG")).alias("name"))
    out = windows.allocated_names(rows, "plate", "taken", "name", "p_partkey")
    return out.select("p_partkey", "plate_frame_index", "allocated_name")


@query(f"WITH {FRAMES} SELECT event_id, round(CASE WHEN valid THEN total_mm END, 4) AS total_mm, round(total_mm, 4) AS total_mm_diagnostic_pre_qa FROM frames")
def quality_gate(spark, d):
    """PRJ10, S16: metrics of invalid rows go, and are kept aside."""
    out = qa.quality_gate(frames(spark, d), ["total_mm", "not_there"], "valid")
    return out.select("event_id", r4(F.col("total_mm"), "total_mm"), r4(F.col("total_mm_diagnostic_pre_qa"), "total_mm_diagnostic_pre_qa"))


REVIEW_SQL = """concat_ws(';', CASE WHEN NOT ok THEN 'invalid_ownership_measurement' END, CASE WHEN NOT root THEN 'root_missing' END, CASE WHEN NOT shoot THEN 'shoot_missing' END, CASE WHEN conflict THEN 'seedling_conflict' END,
  CASE WHEN drop_mm > 15 THEN 'large_negative_root_length_drop' WHEN drop_mm > 5 THEN 'negative_root_length_drop' END, CASE WHEN j1 > 750 THEN 'large_root_bbox_jump' WHEN j1 > 350 THEN 'root_bbox_jump' END,
  CASE WHEN j2 > 600 THEN 'large_shoot_bbox_jump' WHEN j2 > 250 THEN 'shoot_bbox_jump' END, CASE WHEN j3 > 750 THEN 'large_seedling_bbox_jump' WHEN j3 > 350 THEN 'seedling_bbox_jump' END)"""


@query(
    f"""WITH {FRAMES}, x AS (SELECT event_id, valid AS ok, k % 10 <> 0 AS root, k % 4 <> 0 AS shoot, k % 9 = 0 AS conflict, coalesce(-(total_mm - lag(total_mm) {W}), 0) AS drop_mm, k * 10.0 AS j1, k * 8.0 AS j2, k * 7.6 AS j3 FROM frames),
r AS (SELECT event_id, {REVIEW_SQL} AS reasons FROM x)
SELECT event_id, CASE WHEN regexp_matches(reasons, '(^|;)(invalid_ownership_measurement|root_missing|large_negative_root_length_drop|large_root_bbox_jump|large_shoot_bbox_jump|large_seedling_bbox_jump)(;|$)') THEN 'fail' WHEN reasons <> '' THEN 'review' ELSE 'ok' END AS status,
  CASE WHEN reasons = '' THEN 0 ELSE CAST(len(string_split(reasons, ';')) AS INTEGER) END AS reason_count, reasons FROM r"""
)
def ownership_frame_review(spark, d):
    """QA2: reasons and status of each plant in each frame."""
    k = F.col("k")
    drop = -windows.delta(F.col("total_mm"), track())
    f = frames(spark, d).withColumn("drop_mm", drop)
    out = f.withColumn("r", qa.frame_review(F.col("valid"), k % 10 != 0, k % 4 != 0, k % 9 == 0, F.col("drop_mm"), k * 10.0, k * 8.0, k * 7.6, F.lit(None).cast("string"), F.lit(None).cast("double")))
    return out.select("event_id", "r.*")


TRACK_STATS = f"""t AS (SELECT *, -(total_mm - lag(total_mm) {W}) AS dropped FROM frames),
s AS (SELECT series, petri, plant_id, least(1.0, count(*) / 20.0) AS observed, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS okf, avg(CASE WHEN k % 10 <> 0 THEN 1.0 ELSE 0.0 END) AS rootf, avg(CASE WHEN k % 4 <> 0 THEN 1.0 ELSE 0.0 END) AS shootf,
  avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END) AS conflictf, coalesce(max(dropped), 0) / 10 AS dr, max(k) * 8.0 AS jump FROM t GROUP BY ALL),
c AS (SELECT *, round_even(greatest(0, least(100, 100.0 * (0.25 * observed + 0.30 * okf + 0.20 * rootf + 0.10 * shootf + 0.15 * (1.0 - conflictf)) - least(20.0, greatest(0.0, dr) * 2.0) - least(15.0, greatest(0.0, jump - 250.0) / 25.0))), 3) AS score FROM s)"""


@query(
    f"""WITH {FRAMES}, {TRACK_STATS}, r AS (SELECT *, concat_ws(';', CASE WHEN score < 45 THEN 'very_low_stability_score' WHEN score < 70 THEN 'low_stability_score' END, CASE WHEN observed < 0.4 THEN 'very_low_frame_coverage' WHEN observed < 0.7 THEN 'low_frame_coverage' END,
  CASE WHEN okf < 0.5 THEN 'many_invalid_ownership_frames' WHEN okf < 0.75 THEN 'some_invalid_ownership_frames' END, CASE WHEN rootf < 0.4 THEN 'root_missing_most_frames' WHEN rootf < 0.75 THEN 'root_missing_many_frames' END,
  CASE WHEN shootf < 0.2 THEN 'shoot_missing_most_frames' WHEN shootf < 0.5 THEN 'shoot_missing_many_frames' END, CASE WHEN conflictf > 0.5 THEN 'severe_seedling_conflicts' WHEN conflictf > 0.2 THEN 'seedling_conflicts' END,
  CASE WHEN dr > 15 THEN 'large_negative_root_length_drop' WHEN dr > 5 THEN 'negative_root_length_drop' END, CASE WHEN jump > 750 THEN 'large_root_bbox_jump' WHEN jump > 350 THEN 'root_bbox_jump' END, CASE WHEN jump > 600 THEN 'large_shoot_bbox_jump' WHEN jump > 250 THEN 'shoot_bbox_jump' END) AS reasons FROM c)
SELECT series, petri, plant_id, round(score, 2) AS score, CASE WHEN reasons = '' THEN 'ok' WHEN score < 45 OR observed < 0.4 OR okf < 0.5 OR rootf < 0.4 OR shootf < 0.2 OR conflictf > 0.5 OR dr > 15 OR jump > 750 OR jump > 600 THEN 'fail' ELSE 'review' END AS status, reasons FROM r"""
)
def track_review(spark, d):
    """QA3, QA4, AGG8: shares of frames, stability score, reasons and status of each track."""
    f = frames(spark, d).withColumn("dropped", -windows.delta(F.col("total_mm"), track()))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = f.groupBy(*TRACK).agg(
        F.least(F.lit(1.0), F.count(F.lit(1)) / 20.0).alias("observed"),
        share(F.col("valid")).alias("okf"),
        share(F.col("k") % 10 != 0).alias("rootf"),
        share(F.col("k") % 4 != 0).alias("shootf"),
        share(F.col("k") % 3 == 0).alias("conflictf"),
        (F.coalesce(F.max("dropped"), F.lit(0.0)) / 10).alias("dr"),
        (F.max("k") * 8.0).alias("jump"),
    )
    c = [F.col(x) for x in ("observed", "okf", "rootf", "shootf", "conflictf", "dr", "jump")]
    s = s.withColumn("score", qa.stability_score(*c))
    s = s.withColumn("r", qa.track_review(F.col("score"), *c, F.col("jump")))
    return s.select(*TRACK, F.round("score", 2).alias("score"), "r.status", "r.reasons")


@query(
    f"""WITH {FRAMES}, p AS (SELECT *, lag(total_mm) OVER (PARTITION BY series, petri ORDER BY ts, event_id) AS before, k % 6 = 0 AS green, CASE WHEN k % 8 = 0 THEN 0 ELSE k END AS px, CAST(k % 5 AS DOUBLE) AS shoot FROM frames),
c AS (SELECT *, total_mm - before AS ch, before IS NOT NULL AND before > 0 AS known FROM p),
v AS (SELECT event_id, [CASE WHEN px <= 0 OR total_mm <= 0 THEN 'no selected root pixels or zero total root length' END, CASE WHEN known AND ch < -greatest(20, before * 0.25) THEN 'large negative total-root length drop' END,
  CASE WHEN known AND ch >= -greatest(20, before * 0.25) AND ch < -greatest(8, before * 0.12) THEN 'moderate negative total-root length drop' END, CASE WHEN green AND k % 12 = 0 THEN 'RGB crown-green detector abstained; retained model shoot mask' END,
  CASE WHEN green AND k > 0 AND shoot <= 0 THEN 'model shoot pixels rejected as non-green and no green shoot pixels remained' END, CASE WHEN green AND shoot <= 0 THEN 'no RGB green-only shoot pixels detected' END,
  CASE WHEN green AND k >= 18 THEN 'many disconnected RGB green shoot components' END, CASE WHEN NOT green AND shoot <= 0 THEN 'no shoot pixels detected' END] AS rs FROM c)
SELECT event_id, CASE WHEN rs[1] IS NOT NULL OR rs[2] IS NOT NULL THEN 'fail' ELSE 'review' END AS status, array_to_string(list_filter(rs, lambda x: x IS NOT NULL), '; ') AS reason FROM v WHERE len(list_filter(rs, lambda x: x IS NOT NULL)) > 0"""
)
def mask_total_review(spark, d):
    """QA1, FLT2: whole-plate frames that deserve a look, and why."""
    w = windows.series(PLATE, ORDER)
    k = F.col("k")
    f = frames(spark, d).withColumn("before", F.lag("total_mm").over(w))
    px = F.when(k % 8 == 0, 0.0).otherwise(k.cast("double"))
    r = qa.total_review(F.col("total_mm"), F.col("before"), F.lit(None).cast("double"), px, (k % 5).cast("double"), k.cast("double"), k.cast("double"), k % 6 == 0, k % 12 == 0, k.cast("double"))
    return f.select("event_id", r.alias("r")).where("r.status IS NOT NULL").select("event_id", "r.status", "r.reason")


@query(
    f"""WITH {FRAMES}, x AS (SELECT *, CASE WHEN k < 60 THEN 0 ELSE k END AS area, CASE WHEN k % 2 = 0 THEN 0.0 ELSE primary_mm / 100 END AS len, k % 30 AS sh FROM frames),
y AS (SELECT event_id, valid, area >= 20 OR len > 0 AS root, sh >= 10 AS shoot, count(*) OVER t AS n, sum(CASE WHEN area >= 20 OR len > 0 THEN 1 ELSE 0 END) OVER t AS rf, max(area) OVER t AS ma, max(len) OVER t AS ml FROM x WINDOW t AS (PARTITION BY series, petri, plant_id)),
z AS (SELECT *, n > 1 AND NOT (rf >= greatest(2, ceil(n * 0.15)) OR ma >= 150 OR ml >= 5) AS only_shoot FROM y)
SELECT event_id, CASE WHEN only_shoot THEN 'no_root_evidence_across_timeseries' WHEN root OR shoot THEN 'seedling_evidence_present' ELSE 'no_seedling_evidence' END AS presence_status, valid AND (root OR shoot) AND NOT only_shoot AS valid_after_gate FROM z"""
)
def presence_gate(spark, d):
    """FLT7: rows without evidence of a plant, and shoots without a root, aren't valid."""
    k = F.col("k")
    area = F.when(k < 60, 0.0).otherwise(k.cast("double"))
    length = F.when(k % 2 == 0, 0.0).otherwise(F.col("primary_mm") / 100)
    out = qa.presence_gate(frames(spark, d), TRACK, F.col("valid"), area, length, (k % 30).cast("double"), 20, 10)
    return out.select("event_id", "presence_status", "valid_after_gate")


@query(
    f"""WITH {FRAMES} SELECT event_id, round(CASE WHEN min(k) OVER p = max(k) OVER p THEN total_mm ELSE primary_mm END, 4) AS clean FROM frames WINDOW p AS (PARTITION BY series, petri, strftime(ts, '%Y-%m-%d'), plant_id)"""
)
def endpoint_promotion(spark, d):
    """PRJ24: raw metrics stand for cleaned ones in groups of one frame."""
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = qa.endpoint_promotion(f, ["series", "petri", "day", "plant_id"], "k", "total_mm", "primary_mm")
    return out.select("event_id", r4(F.col("primary_mm"), "clean"))


@query(
    f"""WITH {FRAMES}, g AS (SELECT petri, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, count(DISTINCT plant_id) AS plants, abs(sum(total_mm) - max(total_mm)) AS off FROM frames GROUP BY ALL)
SELECT petri, day, rows, plants, round(off, 4) AS length_off FROM g WHERE rows <> 3 OR plants <> 3 OR off > 1e-6"""
)
def conservation_faults(spark, d):
    """QA6, S17: frames whose plants don't add up to the plate."""
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = qa.conservation_faults(f, ["petri", "day"], "plant_id", 3, "total_mm", "total_mm", "primary_mm", "lateral_mm")
    return out.select("petri", "day", "rows", "plants", r4(F.col("length_off"), "length_off"))


@query(
    f"""WITH {FRAMES} SELECT series, petri, plant_id, arg_min(frame_index, (ts, event_id)) AS first_frame, arg_max(frame_index, (ts, event_id)) AS final_frame, arg_max(frame_index, (ts, event_id)) FILTER (WHERE k % 3 <> 0) AS final_valid_frame,
  round(arg_max(total_mm, (ts, event_id)) FILTER (WHERE k % 3 <> 0), 4) AS final_valid_mm FROM frames GROUP BY ALL"""
)
def identity_state(spark, d):
    """AGG9, PRJ23: a track's state at its first, last and last valid row."""
    f = frames(spark, d).withColumn("ok", F.col("k") % 3 != 0)
    out = rollups.identity_state(f, TRACK, F.struct(*ORDER), ["frame_index", "total_mm"], "ok")
    return out.select(*TRACK, F.col("first.frame_index").alias("first_frame"), F.col("final.frame_index").alias("final_frame"), F.col("final_valid.frame_index").alias("final_valid_frame"), r4(F.col("final_valid.total_mm"), "final_valid_mm"))


@query(
    f"""WITH {FRAMES}, s AS (SELECT petri, strftime(ts, '%Y-%m-%d') AS day, (ts, event_id) AS o, CASE WHEN k % 10 = 0 THEN 'fail' WHEN k % 4 = 0 THEN 'review' ELSE 'ok' END AS st, concat_ws(';', CASE WHEN k % 10 = 0 THEN 'a' END, CASE WHEN k % 4 = 0 THEN 'b' END) AS rs FROM frames),
e AS (SELECT petri, day, r, min((o, i)) AS o FROM (SELECT petri, day, o, unnest(string_split(rs, ';')) AS r, generate_subscripts(string_split(rs, ';'), 1) AS i FROM s) WHERE r <> '' GROUP BY ALL),
l AS (SELECT petri, day, string_agg(r, ';' ORDER BY o) AS reasons FROM e GROUP BY ALL)
SELECT s.petri, s.day, count(*) FILTER (WHERE st = 'fail') AS fail, count(*) FILTER (WHERE st = 'review') AS review, count(*) FILTER (WHERE st = 'ok') AS ok,
  CASE WHEN bool_or(st = 'fail') THEN 'fail' WHEN bool_or(st = 'review') THEN 'review' ELSE 'ok' END AS status, coalesce(any_value(l.reasons), '') AS reasons FROM s LEFT JOIN l ON s.petri = l.petri AND s.day = l.day GROUP BY s.petri, s.day"""
)
def frame_qa(spark, d):
    """AGG10: counts of states, worst state and reasons in order of appearance, by frame."""
    k = F.col("k")
    f = frames(spark, d).select(
        "petri", F.date_format("ts", "yyyy-MM-dd").alias("day"), *ORDER, F.when(k % 10 == 0, "fail").when(k % 4 == 0, "review").otherwise("ok").alias("st"), F.concat_ws(";", F.when(k % 10 == 0, "a"), F.when(k % 4 == 0, "b")).alias("rs")
    )
    return rollups.frame_qa(f, ["petri", "day"], "st", "rs", F.struct(*ORDER))


@query(
    f"""WITH {FRAMES}, d AS (SELECT petri, strftime(ts, '%Y-%m-%d') AS day, bool_or(k % 10 = 0 OR k % 4 = 0) AS bad FROM frames GROUP BY ALL)
SELECT petri, count(*) AS frames, count(*) FILTER (WHERE bad) AS frames_with_review, bool_or(bad) AS needs_review FROM d GROUP BY petri"""
)
def plate_qa(spark, d):
    """AGG10, AGG14: frames in need of review by plate."""
    return rollups.plate_qa(frame_qa(spark, d), ["petri"])


@query(
    f"""WITH {FRAMES} SELECT petri, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT plant_id) AS observed_owners, count(DISTINCT plant_id) FILTER (WHERE valid) AS valid_owners, count(DISTINCT plant_id) FILTER (WHERE valid) = 2 AS complete,
  round(CASE WHEN count(DISTINCT plant_id) FILTER (WHERE valid) = 2 THEN sum(total_mm) FILTER (WHERE valid) END, 7) AS total_root, round(CASE WHEN count(DISTINCT plant_id) FILTER (WHERE valid) = 2 THEN avg(total_mm) FILTER (WHERE valid) END, 7) AS mean_root,
  round(sum(total_mm), 7) AS plate_root FROM frames GROUP BY ALL"""
)
def timelapse_complete(spark, d):
    """AGG6, AGG13: plate totals only of complete frames, and those that don't depend on owners always."""
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = rollups.complete_rollup(f, ["petri", "day"], "plant_id", "valid", 2, {"total_root": "total_mm"}, {"plate_root": "total_mm"})
    return out.select("petri", "day", "observed_owners", "valid_owners", "complete", *(F.round(c, 7).alias(c) for c in ("total_root", "mean_root", "plate_root")))


@query(
    f"""WITH {FRAMES}, g AS (SELECT petri, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT plant_id) AS plants, coalesce(sum(total_mm), 0) AS total_mm FROM frames GROUP BY ALL)
SELECT petri, day, plants, round(total_mm, 4) AS total_mm, round(total_mm - lag(total_mm) OVER (PARTITION BY petri ORDER BY day), 4) AS change FROM g"""
)
def compartment_timelapse(spark, d):
    """AGG5, AGG11, AGG15: plants and totals by frame, and their change."""
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = rollups.compartments(f, ["petri", "day"], "plant_id", ["total_mm"])
    return out.select("petri", "day", "plants", r4(F.col("total_mm"), "total_mm"), r4(windows.delta(F.col("total_mm"), windows.series(["petri"], ["day"])), "change"))


@query(
    f"""WITH {FRAMES}, r AS (SELECT *, (total_mm - lag(total_mm) {W}) / 7 AS rate, k % 5 AS h FROM frames)
SELECT series, petri, plant_id, round_even(avg(rate) FILTER (WHERE h > 0), 4) AS mean_rate, round_even(max(rate) FILTER (WHERE h > 0), 4) AS max_rate, round_even(min(rate) FILTER (WHERE h > 0), 4) AS min_rate FROM r GROUP BY ALL"""
)
def rate_summary(spark, d):
    """AGG8: mean, largest and least rate over rows for which time has passed."""
    f = frames(spark, d).withColumns({"rate": windows.delta(F.col("total_mm"), track()) / 7, "h": F.col("k") % 5})
    return f.groupBy(*TRACK).agg(*rollups.rate_columns("rate", "h"))


@query(
    f"""WITH {FRAMES} SELECT event_id, CAST(CASE WHEN bbox_w > 0 AND bbox_h > 0 AND k % 2 = 0 THEN least(bbox_x, k) WHEN bbox_w > 0 AND bbox_h > 0 THEN bbox_x WHEN k % 2 = 0 THEN k ELSE 0 END AS INTEGER) AS x,
  CAST(CASE WHEN bbox_w > 0 AND bbox_h > 0 AND k % 2 = 0 THEN greatest(bbox_x + bbox_w, k + 3) - least(bbox_x, k) WHEN bbox_w > 0 AND bbox_h > 0 THEN bbox_w WHEN k % 2 = 0 THEN 3 ELSE 0 END AS INTEGER) AS w FROM frames"""
)
def seedling_bbox_union(spark, d):
    """PRJ13, FLT6: the box around root and shoot."""
    n = lambda c: F.col(c).cast("double")
    k = n("k")
    root = Box(n("bbox_x"), n("bbox_y"), n("bbox_w"), n("bbox_h"))
    shoot = Box(k, k, F.when(F.col("k") % 2 == 0, 3.0).otherwise(0.0), F.lit(2.0))
    x, _, w, _ = root.union(shoot)
    return frames(spark, d).select("event_id", x.alias("x"), w.alias("w"))


@query(
    f"""WITH {FRAMES}, p AS (SELECT event_id, primary_mm AS p, CASE WHEN k % 3 = 0 THEN 0 ELSE lateral_mm END AS l, CAST(k % 4 AS DOUBLE) AS a FROM frames)
SELECT event_id, round(coalesce(p / nullif(p + l, 0), 0), 4) AS primary_fraction, round(coalesce(l / nullif(p + l, 0), 0), 4) AS lateral_fraction, round((p + l) / nullif(a, 0), 4) AS per_shoot_area FROM p"""
)
def timelapse_fractions(spark, d):
    """PRJ5, PRJ7, S11: fractions (0 where there is no whole) and ratios (null there)."""
    f = frames(spark, d).withColumns({"l": F.when(F.col("k") % 3 == 0, 0.0).otherwise(F.col("lateral_mm")), "a": (F.col("k") % 4).cast("double")})
    whole = F.col("primary_mm") + F.col("l")
    share = lambda c: F.coalesce(c / F.nullif(whole, F.lit(0.0)), F.lit(0.0))
    return f.select("event_id", r4(share(F.col("primary_mm")), "primary_fraction"), r4(share(F.col("l")), "lateral_fraction"), r4(whole / F.nullif(F.col("a"), F.lit(0.0)), "per_shoot_area"))


@query(
    """WITH q AS (SELECT d.doc_id, least(1.0, greatest(0.0, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN (d.n_chars % 101) / 100.0 END, CASE WHEN d.doc_id % 3 = 1 THEN 1 - (d.n_chars % 51) / 50.0 END, (d.n_chars % 11) / 10.0))) AS c, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, round(c, 4) AS confidence, round(CASE WHEN done THEN (1 - c) * 0.5 ELSE 1 - c END, 4) AS priority, CASE WHEN done THEN 'manual' WHEN c >= 0.8 THEN 'accepted' WHEN c < 0.2 THEN 'skipped_low_confidence' ELSE 'staged' END AS status FROM q"""
)
def hitl_queue(spark, d):
    """QA8, SRT12, HIT1, HIT2, SET10: confidence, priority and state of labelling candidates."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", F.lit(True).alias("done"))
    n, i = F.col("n_chars"), F.col("doc_id")
    p = qa.candidate_priority(F.when(i % 3 == 0, (n % 101) / 100.0), F.when(i % 3 == 1, (n % 51) / 50.0), (n % 11) / 10.0, F.col("done"))
    rows = docs.join(labels, "doc_id", "left").withColumn("p", p)
    return rows.select("doc_id", r4(F.col("p.confidence"), "confidence"), r4(F.col("p.priority"), "priority"), qa.pseudo_label_status(F.col("p.confidence"), F.col("done"), 0.8, 0.2).alias("status"))
