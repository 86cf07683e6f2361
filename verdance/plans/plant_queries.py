"""Queries on plants, groups, tracks and sensors, with SQL where there is an equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, plants, raster, reshape, rollups, signal, trackers, tracking
from ..sources import files, sinks
from .roles import FRAMES, PIXELS, frames, pixels, table
from .table_queries import packed

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


GROWTH = "p AS (SELECT DISTINCT l_suppkey % 10 AS plate, l_linenumber AS frame, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x FROM lineitem), f AS (SELECT plate, y, x, min(frame) AS first FROM p GROUP BY ALL)"


def _growth(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("plate"), F.col("l_linenumber").alias("frame"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x"))


@query(f"WITH {GROWTH} SELECT plate, first, count(*) AS pixels, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM f GROUP BY ALL")
def appearance_regions(spark, d):
    """TRK9, D16: pixels by the frame in which they first appear."""
    v, _ = trackers.appearance(_growth(spark, d), ["plate"], "frame")
    return v.select("plate", "first", "pixels", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    f"""WITH {GROWTH} SELECT a.plate, least(a.first, b.first) AS earlier, greatest(a.first, b.first) AS later, count(*) AS contacts FROM f a, (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) s(dy, dx) JOIN f b ON b.plate = a.plate AND b.y = a.y + s.dy AND b.x = a.x + s.dx WHERE a.first <> b.first GROUP BY ALL"""
)
def appearance_edges(spark, d):
    """TRK9: contacts between those regions."""
    return trackers.appearance(_growth(spark, d), ["plate"], "frame")[1]


@query(
    """WITH p AS (SELECT DISTINCT l_suppkey AS frame, l_linenumber AS plant, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x FROM lineitem), g AS (SELECT *, plant % 3 AS "group" FROM p)
SELECT frame, "group", count(DISTINCT (y, x)) AS area, count(DISTINCT plant) AS members FROM g GROUP BY ALL"""
)
def combined_group_areas(spark, d):
    """AGG19: pixels of touching plants counted once for their group."""
    px = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), F.col("l_linenumber").alias("plant"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x"))
    groups = px.select("frame", "plant").distinct().withColumn("group", F.col("plant") % 3)
    return plants.combined_areas(px, groups, ["frame"], "plant")


@query(
    """WITH m AS (SELECT l_shipdate::VARCHAR AS d, l_returnflag || l_linestatus AS expert, l_discount * 10 / 3 AS iou FROM lineitem), a AS (SELECT expert, avg(iou) AS mean FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, expert) AS place, mean - coalesce(lead(mean) OVER (ORDER BY mean DESC, expert), 0) AS margin FROM a)
SELECT expert, round(mean - (SELECT avg(mean) FROM a), 8) AS bias, place = 1 AS preferred, round(CASE WHEN place = 1 THEN margin END, 8) AS margin FROM r"""
)
def expert_calibration(spark, d):
    """AGG23: mean scores of experts against all, the best and its lead."""
    s = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("expert"), (F.col("l_discount") * 10 / 3).alias("iou"))
    return plants.calibration(s, "expert", "iou").select("expert", F.round("bias", 8).alias("bias"), "preferred", F.round("margin", 8).alias("margin"))


@query(
    f"""WITH {FRAMES}, x AS (SELECT CAST(ts AS DATE) - DATE '2024-01-01' AS day, k % 5 AS plant, bbox_x AS x, bbox_y AS y, bbox_w AS w, bbox_h AS h, event_id FROM frames WHERE bbox_w > 0 AND bbox_h > 0),
p AS (SELECT DISTINCT a.day, a.plant AS a, b.plant AS b FROM x a JOIN x b ON a.day = b.day AND a.plant < b.plant WHERE a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h)
SELECT day, a, b, min(day) OVER (PARTITION BY a, b) AS first_touch, coalesce(lag(day) OVER (PARTITION BY a, b ORDER BY day) = day - 1, false) AS touched_before FROM p"""
)
def conflict_timeline(spark, d):
    """TRK8: touching pairs with their first touch and whether they touched just before."""
    f = frames(spark, d).withColumn("day", F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")).withColumn("plant", F.col("k") % 5)
    pairs = joins.touching_pairs(f, ["day"], "plant", 16).distinct()
    return tracking.conflict_timeline(pairs.withColumn("plate", F.lit(1)), ["plate"], "day").drop("plate")


@query(
    f"""WITH {FRAMES}, o AS (SELECT petri, event_id AS f, total_mm / 7 AS len, CAST(bbox_x AS DOUBLE) AS x, CAST(bbox_y AS DOUBLE) AS y, k % 4 AS parent FROM frames),
s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step, (len - lag(len) OVER w) / (f - lag(f) OVER w) AS speed FROM o WINDOW w AS (PARTITION BY petri ORDER BY f)),
v AS (SELECT petri, parent, count(*) AS n FROM o GROUP BY ALL), t AS (SELECT petri, arg_max(parent, (n, -parent)) AS parent, max(n) / CAST(sum(n) AS DOUBLE) AS share FROM v GROUP BY 1)
SELECT s.petri, min(f) AS birth, max(f) AS death, round(max(len), 6) AS max_length, round(coalesce(sum(step), 0), 6) AS way, round(avg(speed), 6) AS mean_speed, round(max(speed), 6) AS max_speed, round(quantile_cont(speed, 0.9), 6) AS p90_speed, round(quantile_cont(speed, 0.95), 6) AS p95_speed,
  any_value(t.parent) AS parent, round(any_value(t.share), 6) AS parent_share FROM s JOIN t ON s.petri = t.petri GROUP BY s.petri"""
)
def track_rollup(spark, d):
    """AGG21, AGG22: birth, death, way, speeds and parent of tracks."""
    f = frames(spark, d).select("petri", F.col("event_id").alias("f"), (F.col("total_mm") / 7).alias("len"), F.col("bbox_x").cast("double").alias("x"), F.col("bbox_y").cast("double").alias("y"), (F.col("k") % 4).alias("parent"))
    out = rollups.track_rollup(f, ["petri"], "f", "len", "x", "y", "parent")
    return out.select("petri", "birth", "death", "parent", *(F.round(c, 6).alias(c) for c in ("max_length", "way", "mean_speed", "max_speed", "p90_speed", "p95_speed", "parent_share")))


@query(
    f"""WITH {FRAMES}, n AS (SELECT petri, count(*) FILTER (WHERE k % 3 <> 0) AS v FROM frames WHERE plant_id <> 'view' GROUP BY 1), b AS (SELECT petri, count(*) FILTER (WHERE k % 5 <> 0) AS v FROM frames WHERE plant_id <> 'click' GROUP BY 1)
SELECT coalesce(n.petri, b.petri) AS petri, coalesce(n.v, 0) AS valid_now, coalesce(b.v, 0) AS valid_before, coalesce(n.v, 0) - coalesce(b.v, 0) AS change FROM n FULL JOIN b ON n.petri = b.petri"""
)
def baseline_comparison(spark, d):
    """AGG12: valid rows now and before."""
    f = frames(spark, d)
    now = f.where("plant_id <> 'view'").withColumn("ok", F.col("k") % 3 != 0)
    before = f.where("plant_id <> 'click'").withColumn("ok", F.col("k") % 5 != 0)
    return rollups.comparison(now, before, ["petri"], "ok")


@query(
    """WITH e AS (SELECT l_suppkey AS k, quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(CASE WHEN b > a THEN round_even(greatest(0, least(1, (l_extendedprice - a) / (b - a))) * 255, 0) ELSE 0 END AS INTEGER) AS v FROM lineitem JOIN e ON l_suppkey = k"""
)
def stretched_values(spark, d):
    """SIG4, SRC8, SEN5: values stretched between two hundredths to a byte."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_extendedprice").alias("v"))
    return signal.stretched(li, ["l_suppkey"], "v")


@query(
    f"""WITH {FRAMES} SELECT event_id, last_value(CASE WHEN valid THEN frame_index END IGNORE NULLS) OVER (PARTITION BY petri ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reference FROM frames"""
)
def registration_reference(spark, d):
    """SEN8: the last accepted frame before each frame."""
    return plants.last_accepted(frames(spark, d).withColumnRenamed("valid", "accepted"), ["petri"], "frame_index").select("event_id", "reference")


@query(
    """WITH c AS (SELECT c_custkey, [c_custkey % 10 + 1.0, c_custkey % 10 + 21.0, c_custkey % 10 + 60.0]::DOUBLE[] AS l FROM customer)
SELECT c_custkey, unnest([1, 2, 3]) AS lane, unnest([0.0::DOUBLE, (l[1] + l[2]) / 2, (l[2] + l[3]) / 2]) AS low, unnest([(l[1] + l[2]) / 2, (l[2] + l[3]) / 2, 100.0::DOUBLE]) AS high FROM c"""
)
def lane_bounds(spark, d):
    """TRK11: lanes that meet half-way between their centres."""
    x = (F.col("c_custkey") % 10).cast("double")
    lanes = tracking.lane_bounds(F.array(x + 1.0, x + 21.0, x + 60.0), 100.0)
    return table(spark, d, "customer").select("c_custkey", F.posexplode(lanes).alias("i", "b")).select("c_custkey", (F.col("i") + 1).alias("lane"), "b.low", "b.high")


@query("SELECT user_id % 5 AS plant_id, event_id % 50 AS frame, CAST(event_id AS DOUBLE) AS x, value AS y FROM events WHERE (user_id % 10) / 10.0 >= 0.65")
def tip_priors(spark, d):
    """SUP5: tips of tracks that clearly belong to one plant."""
    o = F.array(F.struct((F.col("event_id") % 50).alias("frame"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y")))
    t = table(spark, d, "events").select((F.col("user_id") % 5).alias("parent"), ((F.col("user_id") % 10) / 10.0).alias("parent_share"), o.alias("observations"))
    return tracking.tip_priors(t)


@query("SELECT * FROM (SELECT count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e FROM events) s, LATERAL (SELECT '{\"rows\":' || n || ',\"errors\":' || e || '}' AS report) r".replace("SELECT * FROM", "SELECT report FROM"))
def run_report(spark, d):
    """SNK9, SNK19: figures of a run as one JSON document."""
    return sinks.report(table(spark, d, "events"), rows=F.count(F.lit(1)), errors=F.count_if(F.col("event_type") == "error"))


@query(
    """SELECT event_id, '[' || event_id || ',' || user_id || ']' AS path, '{"a":' || user_id || '}' AS tag FROM events"""
)
def csv_ready_rows(spark, d):
    """SNK1, SNK8: nested cells as JSON, columns in order."""
    e = table(spark, d, "events").select("event_id", F.array("event_id", "user_id").alias("path"), F.struct(F.col("user_id").alias("a")).alias("tag"), F.array(F.lit(1)).alias("path_points"))
    return reshape.csv_ready(e)


@query(
    r"""WITH f AS (SELECT 'x/' || CASE p_partkey % 3 WHEN 0 THEN 'petri_' || p_size WHEN 1 THEN 'other' ELSE 'dish-' || p_size END || '/frame_' || (p_partkey % 20) || '.png' AS path, p_partkey FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN CAST(regexp_extract(path, '(\d+)/frame', 1) AS VARCHAR) END AS dish, CAST(p_partkey % 20 AS INTEGER) AS frame FROM f"""
)
def path_metadata(spark, d):
    """STR2, STR3, STR4, SRC13: dish and frame from a path."""
    k = F.col("p_partkey") % 3
    dish = F.when(k == 0, F.concat(F.lit("petri_"), F.col("p_size").cast("string"))).when(k == 1, "other").otherwise(F.concat(F.lit("dish-"), F.col("p_size").cast("string")))
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("x/"), dish, F.lit("/frame_"), (F.col("p_partkey") % 20).cast("string"), F.lit(".png")))
    return files.with_path_metadata(p, "path").select("p_partkey", "dish", "frame")


@query(
    """WITH f AS (SELECT p_partkey, 's' || (p_size % 4) AS series, CAST(p_partkey % 300 AS INTEGER) AS frame FROM part) SELECT series, frame, 'a/' || series || '_f' || frame || '.png' AS path, count(*) OVER (PARTITION BY series, frame) > 1 AS duplicate FROM f"""
)
def series_files(spark, d):
    """SRC14: files of series by a pattern, with frames that occur twice."""
    p = table(spark, d, "part").select(F.concat(F.lit("a/s"), (F.col("p_size") % 4).cast("string"), F.lit("_f"), (F.col("p_partkey") % 300).cast("string"), F.lit(".png")).alias("path"))
    return files.series_files(p, "path", r"^(s\d)_f(\d+)\.png$")


@query(
    """WITH a AS (SELECT 'i/' || (p_partkey % 500) || '_root.png' AS p FROM part WHERE p_size > 20), b AS (SELECT 'm/' || p_partkey || '_fluor.tar' AS p FROM part WHERE p_size <= 30),
x AS (SELECT regexp_extract(p, '(\\d+)', 1) AS key, min(p) AS root_path FROM a GROUP BY 1), y AS (SELECT regexp_extract(p, '(\\d+)', 1) AS key, min(p) AS other_path FROM b GROUP BY 1) SELECT x.key, root_path, other_path FROM x JOIN y ON x.key = y.key""".replace("\\\\", "\\")
)
def paired_files(spark, d):
    """SRC15, SRC16, JON12: files of two listings with one key."""
    p = table(spark, d, "part")
    a = p.where("p_size > 20").select(F.concat(F.lit("i/"), (F.col("p_partkey") % 500).cast("string"), F.lit("_root.png")).alias("path"))
    b = p.where("p_size <= 30").select(F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit("_fluor.tar")).alias("path"))
    return files.paired(a, b, "path", r"(\d+)(?=[^/]*$)")


@query(f"WITH {PIXELS} SELECT frame, CAST(y + 3 AS INTEGER) AS y, CAST(x - 2 AS INTEGER) AS x, class FROM pixels WHERE y + 3 < 64 AND x - 2 >= 0")
def moved_pixels(spark, d):
    """ANN1, SUP25: a shifted mask."""
    return raster.moved(pixels(spark, d), -2, 3, 64, 64)


@query()
def shape_measures(spark, d):
    """RST6, RST9: areas, lengths, hull and angles of each raster's first class."""
    return plants.measure_shapes(packed(spark, d), ["frame"], [1])


@query()
def plant_region_sizes(spark, d):
    """SEN1: pixels of each plant's named regions."""
    px = plants.region_pixels(packed(spark, d), ["frame"], 1, 2, 9, 4)  # these rasters have no shoots
    return px.groupBy("frame", "plant_id", "region").agg(F.count(F.lit(1)).alias("pixels"))


@query()
def followed_components(spark, d):
    """TRK1, TRK3, TRK5: components of a plate's rasters followed through frames."""
    parts = raster.measure_components(packed(spark, d), ["frame"], [1, 2, 3], 4)
    rows = parts.select((F.col("frame") % 5).alias("plate"), "frame", "component", "x", "y", "w", "h", "area")
    return trackers.track_components(rows, ["plate"], "frame", trackers.Gates(64, 64), 5)


@query()
def followed_boxes(spark, d):
    """TRK10, SRC18: boxes without ids named and followed."""
    f = frames(spark, d)
    return plants.box_tracks(f.select("petri", F.dayofmonth("ts").alias("frame"), F.lit(None).cast("string").alias("track_id"), "bbox_x", "bbox_y", "bbox_w", "bbox_h"), ["petri"])


@query()
def registered_frames(spark, d):
    """SEN7, SEN9: shifts of a plate's rasters against the last accepted one."""
    return plants.registered(packed(spark, d).withColumn("plate", F.col("frame") % 5), ["plate"], "frame")
