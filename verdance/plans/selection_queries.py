"""Queries on choices among rows, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title
from ..operators import raster, reshape, selection
from .roles import FRAMES, frames, table
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


CHOSEN = ("click", "view", "error")


def _combined(spark, d):
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return f.groupBy("petri", "day").agg(F.array_sort(F.collect_set("plant_id")).alias("members"))


@query(f"WITH {FRAMES} SELECT event_id, plant_id FROM frames WHERE plant_id IN ('click', 'view', 'error')")
def track_subset_rows(spark, d):
    """FLT1: rows of chosen tracks."""
    return selection.track_subset(frames(spark, d), _combined(spark, d), "plant_id", "members", CHOSEN)[0].select("event_id", "plant_id")


@query(f"WITH {FRAMES} SELECT petri, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT plant_id) AS n FROM frames GROUP BY ALL HAVING bool_and(plant_id IN ('click', 'view', 'error'))")
def track_subset_groups(spark, d):
    """FLT1: combined rows all of whose members are chosen."""
    return selection.track_subset(frames(spark, d), _combined(spark, d), "plant_id", "members", CHOSEN)[1].select("petri", "day", F.size("members").cast("long").alias("n"))


@query(
    """WITH n AS (SELECT p_brand, 'img' || p_partkey || CASE p_size % 5 WHEN 0 THEN '_RAW' WHEN 1 THEN '_preview' WHEN 2 THEN '_rgb' WHEN 3 THEN '' ELSE '_Overlay' END || '.png' AS f, p_partkey, CASE p_size % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 0 END AS r FROM part) SELECT p_brand, arg_min(f, (r, p_partkey)) AS preview FROM n GROUP BY 1"""
)
def best_previews(spark, d):
    """SRT10: the best preview of each group."""
    k = F.col("p_size") % 5
    name = F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.when(k == 0, "_RAW").when(k == 1, "_preview").when(k == 2, "_rgb").when(k == 3, "").otherwise("_Overlay"), F.lit(".png"))
    return selection.best_preview(table(spark, d, "part").withColumn("f", name), ["p_brand"], "f")


@query("SELECT l_orderkey, arg_min(l_extendedprice, (abs(l_quantity - 40), l_quantity, l_linenumber, l_extendedprice)) IS NOT NULL AS any_red, count(DISTINCT l_quantity) AS bands FROM lineitem GROUP BY 1")
def nearest_band_presence(spark, d):
    """SEN5: bands nearest to given wavelengths (presence: several lines may share a wavelength here)."""
    px = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("wavelength"), F.col("l_extendedprice").alias("value"))
    near = selection.nearest_bands(px, ["l_orderkey"], {"red": 40.0, "green": 20.0})
    n = px.groupBy("l_orderkey").agg(F.countDistinct("wavelength").alias("bands"))
    return near.join(n, "l_orderkey").select("l_orderkey", F.col("red").isNotNull().alias("any_red"), "bands")


@query(
    """WITH b AS (SELECT l_orderkey, l_quantity AS wavelength, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL)
SELECT l_orderkey, arg_min(value, (abs(wavelength - 40), wavelength)) AS red, arg_min(value, (abs(wavelength - 20), wavelength)) AS green FROM b GROUP BY 1"""
)
def nearest_bands(spark, d):
    """SEN5: values of the bands nearest to given wavelengths."""
    px = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_quantity").alias("wavelength")).agg(F.max("l_extendedprice").alias("value"))
    return selection.nearest_bands(px, ["l_orderkey"], {"red": 40.0, "green": 20.0})


@query(
    f"""WITH {FRAMES} SELECT event_id, CAST(CASE WHEN valid AND k % 4 > 0 THEN k % 4 WHEN valid AND k % 3 > 0 THEN k % 3 ELSE k END AS BIGINT) AS px, round(CASE WHEN valid AND k % 4 > 0 THEN k % 4 WHEN valid AND k % 3 > 0 THEN k % 3 ELSE k END * 0.0625, 4) AS mm2,
  CASE WHEN valid AND k % 4 > 0 THEN 'rgb_green_only' WHEN valid AND k % 3 > 0 THEN 'rgb_rescue' ELSE 'mask_class' END AS source FROM frames"""
)
def shoot_precedence(spark, d):
    """PRJ16, PRJ17: which shoot measurement counts, and where it comes from."""
    k = F.col("k")
    m = selection.shoot_measure(k % 3, k, k % 4, F.col("valid"), F.lit(0.25))
    return frames(spark, d).select("event_id", m.alias("m")).select("event_id", "m.px", F.round("m.mm2", 4).alias("mm2"), "m.source")


@query(
    """WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Main Root' WHEN 1 THEN 'laterals' WHEN 2 THEN 'LEAF' WHEN 3 THEN 'taproot' ELSE 'unknown thing' END AS w, 'total_root__' || p_type AS m FROM part)
SELECT p_partkey, CASE w WHEN 'Main Root' THEN 'primary_root' WHEN 'laterals' THEN 'lateral_root' WHEN 'LEAF' THEN 'shoot' WHEN 'taproot' THEN 'primary_root' END AS class, 'Total Root ' || upper(left(m[13:], 1)) || lower(m[14:]) AS title FROM t"""
)
def class_names(spark, d):
    """HIT7, PRJ26: standard names of label classes, headings of metrics."""
    k = F.col("p_size") % 5
    w = F.when(k == 0, "Main Root").when(k == 1, "laterals").when(k == 2, "LEAF").when(k == 3, "taproot").otherwise("unknown thing")
    return table(spark, d, "part").select("p_partkey", selection.class_named(w).alias("class"), title(F.concat(F.lit("total_root__"), "p_type")).alias("title"))


@query(
    """SELECT l_suppkey, round(count(*) / 4096.0::DOUBLE, 6) AS coverage, CASE WHEN count(*) / 4096.0 > 0.9 THEN 'overfull' WHEN count(DISTINCT l_orderkey) > 200 THEN 'fragmented' ELSE 'ok' END AS status FROM lineitem GROUP BY 1"""
)
def mask_quality(spark, d):
    """QA7, AGG16: coverage and state of masks."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("parts"))
    q = selection.mask_quality(F.col("n"), F.lit(4096), F.col("parts"))
    return s.select("l_suppkey", q.alias("q")).select("l_suppkey", F.round("q.coverage", 6).alias("coverage"), "q.status")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, 1 - CASE WHEN l_quantity < 20 THEN 20 - l_quantity WHEN l_quantity > 30 THEN l_quantity - 30 ELSE 0 END / 20.0::DOUBLE), 6) AS score FROM lineitem")
def range_scores(spark, d):
    """QA9, §2.11: scores that fall beyond a range."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(selection.in_range(F.col("l_quantity"), 20.0, 30.0), 6).alias("score"))


@query("SELECT event_type, round(sum(value), 4) AS value FROM events GROUP BY 1")
def metric_discovery(spark, d):
    """PRJ21, PRJ22: columns that hold numbers, found in one pass, and their totals."""
    e = table(spark, d, "events").select("event_type", "value", "props")
    names = reshape.metric_names(e, ["event_type"])
    return selection.numeric_summary(e, "event_type", names).select("event_type", *(F.round(n, 4).alias(n) for n in names))


@query()
def plausible_components(spark, d):
    """FLT4, TRK20: components that may be plants, with their place from left to right."""
    parts = raster.measure_components(packed(spark, d), ["frame"], [1, 2, 3])
    kept = selection.plausible(parts, 64, 64, 3)
    return kept.withColumn("slot", selection.slots(kept, ["frame"], "cx"))


@query()
def clustered_readings(spark, d):
    """STR11: the best text among readings that lie together."""
    e = table(spark, d, "events").select("user_id", F.concat(F.lit("P"), (F.col("event_id") % 4).cast("string")).alias("text"), (F.col("value") % 1).alias("confidence"), ((F.col("event_id") % 10) / 10.0).alias("x"), ((F.col("event_id") % 7) / 7.0).alias("y"))
    return selection.clustered_readings(e, ["user_id"])
