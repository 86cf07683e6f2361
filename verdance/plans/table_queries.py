"""Queries on joins, reshapes, identities, rasters and scores, each with its equivalent in DuckDB's SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, text
from ..operators import evaluation, joins, raster, reshape, rollups, signal, tracking
from .roles import FRAMES, ORDER, PIXELS, TRACK, frames, pixels, table

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


def r4(c, name):
    return F.round(c, 4).alias(name)


# ---- joins -----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {FRAMES}, l AS (SELECT petri, event_id, ts FROM frames WHERE plant_id = 'purchase'), r AS (SELECT petri, event_id AS seen, total_mm, ts FROM frames WHERE plant_id = 'view'),
j AS (SELECT l.event_id, arg_max(r.seen, (r.ts, r.seen)) AS seen, arg_max(r.total_mm, (r.ts, r.seen)) AS total_mm FROM l JOIN r ON l.petri = r.petri AND r.ts <= l.ts GROUP BY l.event_id)
SELECT l.event_id, j.seen, round(j.total_mm, 4) AS total_mm FROM l LEFT JOIN j USING (event_id)"""
)
def asof_latest(spark, d):
    """JON5: the last view of the same plate at or before each purchase."""
    f = frames(spark, d)
    left = f.where("plant_id = 'purchase'").select("petri", "event_id", "ts")
    right = f.where("plant_id = 'view'").select("petri", F.col("event_id").alias("seen"), "total_mm", "ts")
    return joins.as_of(left, right, ["petri"], "ts", ["seen", "total_mm"], "seen").select("event_id", "seen", r4(F.col("total_mm"), "total_mm"))


@query(f"WITH {FRAMES}, m AS (SELECT petri, max(ts) AS t FROM frames WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY petri) SELECT f.petri, f.event_id FROM frames f JOIN m ON f.petri = m.petri AND f.ts = m.t")
def rows_at_or_before(spark, d):
    """FLT8, FLT9: each plate's rows at its last time up to a given one."""
    return joins.at_or_before(frames(spark, d), ["petri"], "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("petri", "event_id")


BASE = f"""{FRAMES}, b AS (SELECT petri, event_id, k % 7 <> 0 AS ok, total_mm FROM frames), c AS (SELECT petri, event_id, k % 7 <> 0 AND event_id % 211 <> 0 AS ok, total_mm + 1 AS total_mm FROM frames),
g AS (SELECT c.petri, count(*) AS regressed_rows FROM c JOIN b ON c.petri = b.petri AND c.event_id = b.event_id WHERE b.ok AND NOT c.ok GROUP BY c.petri)"""


def _versions(spark, d):
    f = frames(spark, d)
    ok = F.col("k") % 7 != 0
    base = f.select("petri", "event_id", ok.alias("ok"), "total_mm")
    now = f.select("petri", "event_id", (ok & (F.col("event_id") % 211 != 0)).alias("ok"), (F.col("total_mm") + 1).alias("total_mm"))
    return now, base


@query(
    f"""WITH {BASE} SELECT petri, event_id, round(total_mm, 4) AS total_mm, 'current' AS source FROM c WHERE petri NOT IN (SELECT petri FROM g)
UNION ALL SELECT petri, event_id, round(total_mm, 4), 'baseline' FROM b WHERE petri IN (SELECT petri FROM g)"""
)
def baseline_rollback(spark, d):
    """JON1, SET2: plates that lost validity come whole from the baseline."""
    rows, _ = joins.rollback(*_versions(spark, d), "petri", ["petri", "event_id"], "ok")
    return rows.select("petri", "event_id", r4(F.col("total_mm"), "total_mm"), "source")


@query(f"WITH {BASE} SELECT petri, regressed_rows FROM g")
def rollback_audit(spark, d):
    """JON1: regressed rows by plate."""
    return joins.rollback(*_versions(spark, d), "petri", ["petri", "event_id"], "ok")[1]


@query(
    f"""WITH {FRAMES}, a AS (SELECT DISTINCT petri, strftime(ts, '%Y-%m-%d') AS day FROM frames WHERE plant_id = 'click'), b AS (SELECT DISTINCT petri, strftime(ts, '%Y-%m-%d') AS day FROM frames WHERE plant_id = 'view')
SELECT coalesce(a.petri, b.petri) AS petri, coalesce(a.day, b.day) AS day, CASE WHEN b.petri IS NULL THEN 'left_only' WHEN a.petri IS NULL THEN 'right_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.petri = b.petri AND a.day = b.day"""
)
def outer_audit(spark, d):
    """JON2: keys of either side, with the sides that have them."""
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return joins.outer_audit(f.where("plant_id = 'click'"), f.where("plant_id = 'view'"), ["petri", "day"])


@query(
    f"""WITH {FRAMES}, x AS (SELECT petri, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM frames WHERE plant_id = 'click' GROUP BY ALL), y AS (SELECT petri, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM frames WHERE plant_id = 'view' GROUP BY ALL)
SELECT coalesce(x.petri, y.petri) AS petri, coalesce(x.day, y.day) AS day, coalesce(x.n, 0) AS n_left, coalesce(y.n, 0) AS n_right FROM x FULL JOIN y ON x.petri = y.petri AND x.day = y.day WHERE coalesce(x.n, 0) <> 1 OR coalesce(y.n, 0) <> 1"""
)
def one_to_one_faults(spark, d):
    """JON1, SET4: keys that aren't exactly once on each side."""
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return joins.one_to_one_faults(f.where("plant_id = 'click'"), f.where("plant_id = 'view'"), ["petri", "day"])


@query("SELECT o.o_orderkey, round(coalesce(l.v, o.o_totalprice), 4) AS o_totalprice FROM orders o LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) l ON o.o_orderkey = l.l_orderkey")
def accepted_map_join(spark, d):
    """JON3: values overruled by the sum of accepted rows."""
    li = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"))
    out = joins.accepted_lookup(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), li, ["o_orderkey"], "o_totalprice")
    return out.select("o_orderkey", r4(F.col("o_totalprice"), "o_totalprice"))


@query(
    f"""WITH {FRAMES}, o AS (SELECT petri, strftime(ts, '%Y-%m-%d') AS day, plant_id, sum(CASE WHEN k % 3 = 0 THEN NULL ELSE total_mm END) AS v FROM frames GROUP BY ALL), p AS (SELECT *, count(*) OVER (PARTITION BY petri, day) AS n FROM o),
w AS (SELECT petri, strftime(ts, '%Y-%m-%d') AS day, sum(total_mm) AS whole FROM frames GROUP BY ALL) SELECT p.petri, p.day, plant_id, round(coalesce(v, whole / n), 7) AS total_mm FROM p JOIN w ON p.petri = w.petri AND p.day = w.day"""
)
def share_of_whole(spark, d):
    """JON4: a plant's own value or an equal share of the plate's."""
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    own = f.withColumn("total_mm", F.when(F.col("k") % 3 != 0, F.col("total_mm")))
    whole = f.groupBy("petri", "day").agg(F.sum("total_mm").alias("total_mm"))
    return joins.share_of_whole(own, whole, ["petri", "day"], "plant_id", "total_mm").select("petri", "day", "plant_id", F.round("total_mm", 7).alias("total_mm"))


@query(
    f"""WITH {FRAMES}, t AS (SELECT series, petri, plant_id, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS seen FROM frames WHERE petri IN (SELECT petri FROM frames WHERE k = 7) GROUP BY ALL), e AS (SELECT series, petri, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS expected_frames FROM frames GROUP BY ALL)
SELECT t.series, t.petri, plant_id, seen, expected_frames, round(least(1.0, seen / CAST(expected_frames AS DOUBLE)), 4) AS observed FROM t JOIN e ON t.petri = e.petri AND t.series = e.series"""
)
def semi_plates_expected_frames(spark, d):
    """JON6, JON7: tracks of selected plates with the frames that their plate has."""
    from ..operators.qa import shares

    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    chosen = f.join(f.where("k = 7").select("petri").distinct(), "petri", "left_semi")
    tracks = chosen.groupBy(*TRACK).agg(F.countDistinct("day").alias("seen"))
    out = joins.expected_frames(tracks, f, ["series", "petri"], "day")
    return out.withColumns(shares(F.col("expected_frames"), observed=F.col("seen"))).withColumn("observed", F.round("observed", 4))


@query(
    f"""WITH {FRAMES}, m AS (SELECT petri, plant_id, quantile_cont(CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(bbox_x AS DOUBLE) END, 0.5) AS m FROM frames GROUP BY ALL HAVING count(CASE WHEN k % 9 = 0 THEN NULL ELSE bbox_x END) > 0),
f AS (SELECT petri, list(m ORDER BY m) AS l FROM m GROUP BY petri), c AS (SELECT petri, CASE WHEN len(l) = 5 THEN l ELSE [9.7, 29.1, 48.5, 67.9, 87.3]::DOUBLE[] END AS l FROM f)
SELECT petri, generate_subscripts(l, 1) AS lane, round(unnest(l), 4) AS centre FROM c"""
)
def lane_centres(spark, d):
    """JON8, AGG4, AGG24: medians of each lane or evenly spaced centres."""
    f = frames(spark, d).withColumn("cx", F.when(F.col("k") % 9 != 0, F.col("bbox_x").cast("double")))
    out = joins.lane_centres(f, ["petri"], "plant_id", "cx", 5, 97.0)
    return out.select("petri", F.posexplode("lane_centres").alias("i", "c")).select("petri", (F.col("i") + 1).cast("long").alias("lane"), r4(F.col("c"), "centre"))


@query(
    f"""WITH {FRAMES}, x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, bbox_x AS x, bbox_y AS y, bbox_w AS w, bbox_h AS h FROM frames WHERE bbox_w > 0 AND bbox_h > 0)
SELECT a.day, a.event_id AS a, b.event_id AS b FROM x a JOIN x b ON a.day = b.day AND a.event_id < b.event_id WHERE a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"""
)
def touching_pairs(spark, d):
    """JON10, FLT5: boxes that meet in one frame."""
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return joins.touching_pairs(f, ["day"], "event_id", cell=16)


@query(
    f"""WITH RECURSIVE {FRAMES}, x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, bbox_x AS x, bbox_y AS y, bbox_w AS w, bbox_h AS h FROM frames WHERE bbox_w > 0 AND bbox_h > 0),
p AS (SELECT a.day, a.event_id AS a, b.event_id AS b FROM x a JOIN x b ON a.day = b.day AND a.event_id < b.event_id WHERE a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h),
e AS (SELECT day, a, b FROM p UNION SELECT day, b, a FROM p), t(day, a, b) AS (SELECT day, a, a FROM e UNION SELECT t.day, t.a, e.b FROM t JOIN e ON t.day = e.day AND t.b = e.a)
SELECT day, a AS event_id, min(b) AS "group", CAST(count(*) AS INTEGER) AS size FROM t GROUP BY day, a"""
)
def conflict_groups(spark, d):
    """TRK8, SET11: groups of boxes that touch directly or through others."""
    f = frames(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return tracking.conflict_groups(f.select("day", "event_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h"), ["day"], "event_id")


@query(
    """WITH c AS (SELECT c_custkey, [c_custkey * 3, c_custkey * 2, c_custkey + 7] AS l FROM customer), t AS (SELECT c_custkey, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM c),
h AS (SELECT c_custkey, arg_min(p, i) AS p FROM t WHERE p IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1) SELECT c.c_custkey, CAST(h.p AS VARCHAR) AS path FROM c LEFT JOIN h USING (c_custkey)"""
)
def first_existing_file(spark, d):
    """JON11: of ordered candidates the first that exists."""
    k = F.col("c_custkey")
    wanted = table(spark, d, "customer").select("c_custkey", F.transform(F.array(k * 3, k * 2, k + 7), lambda x: x.cast("string")).alias("candidates"))
    files = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("path"))
    return joins.first_existing_file(wanted, "c_custkey", "candidates", files, "path")


@query(
    """WITH i AS (SELECT p_partkey AS path, p_name AS name, p_brand AS v FROM part WHERE p_partkey % 3 = 0), p AS (SELECT path, min(v) AS v FROM i GROUP BY 1), n AS (SELECT lower(name) AS name, min(v) AS v FROM i GROUP BY 1 HAVING count(*) = 1)
SELECT x.p_partkey, coalesce(p.v, n.v) AS plate FROM part x LEFT JOIN p ON p.path = x.p_partkey LEFT JOIN n ON n.name = lower(x.p_name)"""
)
def identity_lookup(spark, d):
    """JON13: identity by path, else by a name that only one has."""
    p = table(spark, d, "part")
    images = p.select("p_partkey", F.col("p_partkey").alias("path"), F.col("p_name").alias("name"))
    known = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("name"), F.col("p_brand").alias("plate"))
    return joins.identity_lookup(images, known, "path", "name", "plate").select("p_partkey", "plate")


# ---- reshapes ----------------------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT l_orderkey AS round, l_suppkey AS plate, l_linenumber AS plant_id, l_quantity AS a, CASE WHEN l_tax > 0.04 THEN l_tax END AS b FROM lineitem),
v AS (SELECT round, plate, plant_id, 'root_length' AS parameter, a AS value FROM w UNION ALL SELECT round, plate, plant_id, 'root_angle', b FROM w WHERE b IS NOT NULL),
p AS (SELECT DISTINCT round, plate, plant_id, unnest(['root_angle', 'leaf_count']) AS parameter FROM w)
SELECT * FROM v UNION ALL SELECT p.*, NULL FROM p ANTI JOIN v USING (round, plate, plant_id, parameter)"""
)
def long_traits(spark, d):
    """SET5, SRT8, PRJ8: wide rows as entity, parameter and value, with placeholders for parameters without one."""
    li = table(spark, d, "lineitem").withColumn("b", F.when(F.col("l_tax") > 0.04, F.col("l_tax")))
    keys = {"round": F.col("l_orderkey"), "plate": F.col("l_suppkey"), "plant_id": F.col("l_linenumber")}
    return reshape.long_traits(li, keys, {"l_quantity": "root_length", "b": "root_angle", "none_such": "x"}, ["root_angle", "leaf_count"])


@query(
    """WITH p AS (SELECT l_suppkey AS plant, l_returnflag AS region, l_linenumber AS band, l_quantity AS v FROM lineitem),
s AS (SELECT plant, region, band, unnest(['mean', 'sum', 'std']) AS statistic, unnest([avg(v), sum(v), stddev_pop(v)]) AS v FROM p GROUP BY plant, region, band)
SELECT plant, region, statistic, round(max(v) FILTER (WHERE band = 1), 4) AS "b1", round(max(v) FILTER (WHERE band = 2), 4) AS "b2", round(max(v) FILTER (WHERE band = 3), 4) AS "b3" FROM s GROUP BY ALL"""
)
def band_pivot(spark, d):
    """AGG18, SET6, SEN3: statistics of regions with a column for each band."""
    px = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plant"), F.col("l_returnflag").alias("region"), F.col("l_linenumber").alias("band"), F.col("l_quantity").alias("v"))
    out = rollups.region_bands(px, ["plant", "region"], "band", "v", [1, 2, 3])
    # Regions without any of the three bands keep their row.
    return out.select("plant", "region", "statistic", *(F.round(F.col(f"`{b}`"), 4).alias(f"b{b}") for b in (1, 2, 3)))


@query("SELECT l_suppkey AS plant, l_linestatus AS region, round(avg(CASE WHEN l_tax > 0 THEN l_discount END), 4) AS mean, count(CASE WHEN l_tax > 0 THEN l_discount END) AS pixels, round(coalesce(sum(CASE WHEN l_tax > 0 THEN l_discount END), 0), 4) AS total FROM lineitem GROUP BY ALL")
def region_pixels(spark, d):
    """AGG17, SEN2: mean, pixels and total of regions."""
    px = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plant"), F.col("l_linestatus").alias("region"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("v"))
    return rollups.region_pixels(px, ["plant", "region"], "v").select("plant", "region", r4(F.col("mean"), "mean"), "pixels", r4(F.col("total"), "total"))


@query("WITH k AS (SELECT event_id, unnest(['kind', 'plate']) AS key, unnest([event_type, CAST(user_id AS VARCHAR)]) AS value FROM events) SELECT event_id, key, value FROM k")
def metadata_kv(spark, d):
    """SET7, SNK3: a map as rows of key and value."""
    m = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("plate"), F.col("user_id").cast("string"))
    return reshape.exploded_map(table(spark, d, "events"), ["event_id"], m)


@query(
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), x AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) - coalesce(b.n, 0) AS v FROM a FULL JOIN b ON a.k = b.k)
SELECT k, CASE WHEN v > 0 THEN 'left' ELSE 'right' END AS side, abs(v) AS n FROM x WHERE v <> 0"""
)
def key_difference(spark, d):
    """SET4: keys that two tables don't have in common, with their numbers."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return reshape.key_difference(a, b, ["k"]).groupBy("k", "side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_measurements(spark, d):
    """SET1, SET3, SRC2: tables with different columns in one."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return reshape.union_all([a, b])


@query(
    f"""WITH {FRAMES}, r AS (SELECT series, CAST(k AS VARCHAR) AS petri, frame_index, plant_id, event_id, count(*) OVER (PARTITION BY frame_index, k, plant_id) > 1 AS twice FROM frames)
SELECT event_id, CASE WHEN bool_or(twice) OVER (PARTITION BY petri) THEN series || '::' || petri ELSE petri END AS plate FROM r"""
)
def plate_labels(spark, d):
    """PRJ19, PRJ20: plate labels that tell series apart where they must."""
    f = frames(spark, d).withColumn("petri", F.col("k").cast("string"))
    return f.select("event_id", reshape.plate_labels(f, "series", "petri", "frame_index", "plant_id").alias("plate"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 3")
def top_rows_per_plate(spark, d):
    """FLT10, SRT7, SRT9, SRT11: the first rows of each group."""
    return reshape.top_n(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "place")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def keep_first(spark, d):
    """SRC3, SRT7: the first row of each key."""
    return reshape.keep_first(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@query(
    """WITH k AS (SELECT DISTINCT lower('P' || p_size || '_' || p_brand) AS s FROM part), t AS (SELECT s, regexp_extract_all(s, '(\\d+|\\D+)', 1) AS l FROM k),
o AS (SELECT s, list_transform(l, lambda x: {'t': CASE WHEN regexp_matches(x, '^\\d+$') THEN 0 ELSE 1 END, 'n': CASE WHEN regexp_matches(x, '^\\d+$') THEN CAST(x AS BIGINT) ELSE 0 END, 's': CASE WHEN regexp_matches(x, '^\\d+$') THEN '' ELSE x END}) AS key FROM t)
SELECT s AS name, row_number() OVER (ORDER BY key) AS rank FROM o""".replace("\\\\", "\\")
)
def natural_sort_rank(spark, d):
    """SRT1, SRT2, SRT3, S9: names in natural order (a list of distinct names, hence one window)."""
    from pyspark.sql import Window

    names = table(spark, d, "part").select(F.lower(F.concat(F.lit("P"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_brand"))).alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(text.natural_key("name"))).cast("long").alias("rank"))


@query(
    r"""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y%m%d%H%M%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H.%M.%S') WHEN 2 THEN 'x' || strftime(ts, '%Y') ELSE '1999_01_01_00_00_00' END AS token, date_trunc('second', ts) AS ts FROM events)
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN ts END AS parsed FROM t"""
)
def parse_timestamp_token(spark, d):
    """STR1, STR7, SRC19: times in names; other tokens have none."""
    ts = F.col("ts")
    kind = F.col("event_id") % 4
    token = (
        F.when(kind == 0, F.date_format(ts, "yyyyMMddHHmmss"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH.mm.ss"))
        .when(kind == 2, F.concat(F.lit("x"), F.date_format(ts, "yyyy")))
        .otherwise("1999_01_01_00_00_00")
    )
    return table(spark, d, "events").select("event_id", text.timestamp_token(token).alias("parsed"))


@query(
    r"""WITH n AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(trim(url), '\s+', '_', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g') AS s, regexp_replace(url, '/+$', '') AS u FROM pages),
t AS (SELECT *, list_last(string_split(u, '/')) AS tail FROM n), c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(tail), '\s+', '_', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._-') AS code FROM t)
SELECT page_id, left(trim(s, '._-'), 96) AS plate_id, left(code, 96) AS payload, CASE WHEN code <> '' THEN 'qr' END AS source, CASE WHEN code <> '' THEN true ELSE false END AS accepted FROM c"""
)
def plate_identity(spark, d):
    """STR6, STR10: safe ids, ids in codes, and the identity with the best evidence."""
    p = table(spark, d, "pages")
    none = F.lit(None).cast("string")
    who = text.identity(F.col("url"), none, F.lit(""), none, F.lit(None).cast("double"))
    return p.select("page_id", "url", who.alias("i")).select("page_id", text.plate_id("url").alias("plate_id"), text.code_payload("url").alias("payload"), F.col("i.source").alias("source"), F.col("i.accepted").alias("accepted"))


@query(
    """WITH g AS (SELECT DISTINCT c_nationkey AS k FROM customer), h AS (SELECT k, CAST(CAST('0x' || substr(sha1('split:' || CAST(k AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS h FROM g), e AS (SELECT min(h) AS low, max(h) AS high, count(*) AS n FROM h)
SELECT c_custkey, CASE WHEN low >= 0.2 AND n > 1 THEN h = low WHEN high < 0.2 AND n > 1 THEN h <> high ELSE h < 0.2 END AS held_out FROM customer JOIN h ON c_nationkey = k, e"""
)
def grouped_split(spark, d):
    """STR20, HIT4: a split by the hash of the group."""
    return reshape.grouped_split(table(spark, d, "customer"), "c_nationkey", 0.2, "split").select("c_custkey", "held_out")


@query(
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '3, 1;3 300' WHEN 1 THEN '' WHEN 2 THEN 'x,7' WHEN 3 THEN '0,256' ELSE CAST(p_size AS VARCHAR) END AS c FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '3,1' WHEN 1 THEN '1,2' WHEN 2 THEN '7' WHEN 3 THEN '1,2' ELSE CASE WHEN CAST(c AS INTEGER) BETWEEN 1 AND 255 THEN c ELSE '1,2' END END AS ids,
  CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN NULL WHEN 3 THEN 2 ELSE CASE WHEN CAST(c AS INTEGER) BETWEEN 1 AND 255 THEN NULL ELSE 2 END END AS lateral FROM t"""
)
def class_id_lists(spark, d):
    """PRJ1, PRJ2, PRJ3, SET8: class numbers in texts and their roles."""
    k = F.col("p_partkey") % 5
    c = F.when(k == 0, "3, 1;3 300").when(k == 1, "").when(k == 2, "x,7").when(k == 3, "0,256").otherwise(F.col("p_size").cast("string"))
    ids = coerce.class_ids(c, (1, 2))
    return table(spark, d, "part").select("p_partkey", F.array_join(ids, ",").alias("ids"), coerce.class_roles(ids)["lateral"].alias("lateral"))


@query(
    r"""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'on' WHEN 2 THEN '1.0' WHEN 3 THEN 'off' WHEN 4 THEN NULL ELSE 'NaN' END AS w FROM events)
SELECT event_id, coalesce(lower(trim(w)) IN ('1', 'true', 'yes', 'y'), false) AS validity, coalesce(lower(trim(w)) IN ('1', 'true', 'yes', 'on', 'enabled'), false) AS review, coalesce(lower(trim(w)) IN ('1', 'true', 'yes', 'y', 'on'), false) AS trait,
  CASE WHEN lower(trim(w)) IN ('true', '1', '1.0', 'yes', 'y', 'on') THEN true WHEN lower(trim(w)) IN ('false', '0', '0.0', 'no', 'n', 'off') THEN false ELSE true END AS cell, CASE WHEN event_id % 6 = 2 THEN 1.0::DOUBLE END AS number FROM t"""
)
def coercions(spark, d):
    """S1, S2, S6, PRJ18, STR5, STR17: words as booleans by four rules, and numbers."""
    k = F.col("event_id") % 6
    w = F.when(k == 0, " Yes ").when(k == 1, "on").when(k == 2, "1.0").when(k == 3, "off").when(k == 4, F.lit(None)).otherwise("NaN")
    e = table(spark, d, "events").select("event_id", w.alias("w"))
    return e.select("event_id", *(coerce.flag("w", r).alias(r) for r in ("validity", "review", "trait")), coerce.flag("w", "cell", True).alias("cell"), coerce.number("w").alias("number"))


# ---- scores --------------------------------------------------------------------------------------------------------


CONFUSION = "c AS (SELECT l_returnflag AS g, CAST(l_linenumber % 3 AS INTEGER) AS truth, CAST(l_suppkey % 3 AS INTEGER) AS predicted, count(*) AS n FROM lineitem GROUP BY ALL)"


def _confusion(spark, d):
    return evaluation.confusion(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g"), ["g"], (F.col("l_linenumber") % 3).cast("int"), (F.col("l_suppkey") % 3).cast("int"))


@query(
    f"""WITH {CONFUSION}, k AS (SELECT DISTINCT g, truth AS class FROM c UNION SELECT DISTINCT g, predicted FROM c),
s AS (SELECT k.g, k.class, coalesce(sum(n) FILTER (WHERE truth = class AND predicted = class), 0) AS tp, coalesce(sum(n) FILTER (WHERE truth <> class AND predicted = class), 0) AS fp, coalesce(sum(n) FILTER (WHERE truth = class AND predicted <> class), 0) AS fn FROM k JOIN c ON k.g = c.g GROUP BY ALL)
SELECT g, class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS dice, round(coalesce(tp / nullif(CAST(tp + fp + fn AS DOUBLE), 0), 0), 6) AS iou FROM s"""
)
def confusion_dice_iou(spark, d):
    """EVL1, EVL2, EVL3, EVL4, EVL5, EVL8: scores of each class from a confusion table."""
    out = evaluation.class_scores(_confusion(spark, d), ["g"])
    return out.select("g", "class", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "dice", "iou")))


@query(
    f"""WITH {CONFUSION}, k AS (SELECT DISTINCT g, truth AS class FROM c UNION SELECT DISTINCT g, predicted FROM c),
s AS (SELECT k.g, k.class, coalesce(sum(n) FILTER (WHERE truth = class AND predicted = class), 0) AS tp, coalesce(sum(n) FILTER (WHERE truth <> class AND predicted = class), 0) AS fp, coalesce(sum(n) FILTER (WHERE truth = class AND predicted <> class), 0) AS fn FROM k JOIN c ON k.g = c.g GROUP BY ALL)
SELECT g, round(avg(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)), 6) AS macro_dice, round(avg(tp / CAST(tp + fp + fn AS DOUBLE)), 6) AS macro_iou, count(*) AS classes FROM s GROUP BY g"""
)
def macro_scores(spark, d):
    """EVL8, EVL10: means over classes."""
    out = evaluation.macro(evaluation.class_scores(_confusion(spark, d), ["g"]), ["g"])
    return out.select("g", *(F.round(c, 6).alias(c) for c in ("macro_dice", "macro_iou")), "classes")


@query(
    """SELECT l_returnflag, round(avg(abs(l_quantity - l_extendedprice / 2000) / (l_extendedprice / 2000)) FILTER (WHERE l_extendedprice / 2000 > 0), 6) AS mape,
  round(sum(abs(l_quantity - l_extendedprice / 2000)) / greatest(sum(l_extendedprice / 2000), 1e-9), 6) AS wape, count(*) AS rows FROM lineitem GROUP BY 1"""
)
def mape_wape(spark, d):
    """EVL6: relative errors by row and in total."""
    li = table(spark, d, "lineitem").withColumn("t", F.col("l_extendedprice") / 2000)
    return evaluation.length_errors(li, ["l_returnflag"], "l_quantity", "t").select("l_returnflag", F.round("mape", 6).alias("mape"), F.round("wape", 6).alias("wape"), "rows")


@query(
    """WITH c AS (SELECT l_suppkey AS k, (l_orderkey % 10) / 10.0::DOUBLE AS m, l_quantity AS lane, l_quantity * 0.9 AS ranked, l_extendedprice / 2000 AS truth, (l_partkey % 7) / 7.0::DOUBLE AS dl, (l_partkey % 11) / 11.0::DOUBLE AS dr FROM lineitem), t AS (SELECT unnest([0.0, 0.3, 0.6, 2.0]::DOUBLE[]) AS threshold),
r AS (SELECT threshold, c.*, CASE WHEN m >= threshold THEN ranked ELSE lane END AS p, CASE WHEN m >= threshold THEN dr ELSE dl END AS d FROM c, t),
w AS (SELECT threshold, min(x) AS worst FROM (SELECT threshold, k, avg(d) - avg(dl) AS x FROM r GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT threshold, avg(d) AS dice, avg(abs(p - truth) / truth) FILTER (WHERE truth > 0) AS mape, sum(abs(p - truth)) / greatest(sum(truth), 1e-9) AS wape, avg(abs(lane - truth) / truth) FILTER (WHERE truth > 0) AS lm, sum(abs(lane - truth)) / greatest(sum(truth), 1e-9) AS lw FROM r GROUP BY 1),
b AS (SELECT s.*, worst, mape <= lm + 0.01 AND wape <= lw + 0.01 AND worst >= -0.02 AS feasible FROM s JOIN w USING (threshold))
SELECT threshold, round(dice, 5) AS dice, round(mape, 5) AS mape, round(wape, 5) AS wape, round(worst, 5) AS worst_dice_change, feasible, row_number() OVER (ORDER BY feasible DESC, dice DESC, mape, wape, threshold) = 1 AS chosen FROM b"""
)
def threshold_sweep(spark, d):
    """EVL6, EVL9: errors for each threshold of the gate, and the threshold to choose."""
    c = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("case"),
        ((F.col("l_orderkey") % 10) / 10.0).alias("m"),
        F.col("l_quantity").alias("lane"),
        (F.col("l_quantity") * 0.9).alias("ranked"),
        (F.col("l_extendedprice") / 2000).alias("truth"),
        ((F.col("l_partkey") % 7) / 7.0).alias("dl"),
        ((F.col("l_partkey") % 11) / 11.0).alias("dr"),
    )
    out = evaluation.threshold_sweep(c, "case", "m", "lane", "ranked", "truth", "dl", "dr", [0.0, 0.3, 0.6, 2.0])
    return out.select("threshold", *(F.round(x, 5).alias(x) for x in ("dice", "mape", "wape", "worst_dice_change")), "feasible", "chosen")


CROWNS = [(6.0, 4.0), (18.0, 5.0), (31.0, 4.0), (45.0, 6.0), (57.0, 5.0)]


def _ranker_sql() -> str:
    cx, cy = [x / 63 for x, _ in CROWNS], [y / 63 for _, y in CROWNS]
    scores = []
    for k in range(5):
        left = cx[max(k, 1)] - cx[max(k, 1) - 1]
        right = cx[min(k, 3) + 1] - cx[min(k, 3)]
        scale = max((left + right) * 0.5, 0.025)
        slot = -1.0 + 2.0 * k / 4
        dx, dy = f"(px - {cx[k]!r}::DOUBLE)", f"(py - {cy[k]!r}::DOUBLE)"
        lane = f"({dx} / {scale!r}::DOUBLE)"
        terms = [dx, f"abs({dx})", f"{dx} * {dx}", f"abs({dx}) * py", f"{dx} * py", lane, f"abs({lane})", f"{lane} * {lane}", dy, f"{dy} * {dy}", f"{slot!r}::DOUBLE", f"px * {slot!r}::DOUBLE", f"py * {slot!r}::DOUBLE"]
        scores.append(" + ".join(f"(({t}) - 0.1::DOUBLE) / 0.5::DOUBLE * {(-1) ** i * (i + 1) / 10!r}::DOUBLE" for i, t in enumerate(terms)))
    listed = ", ".join(f"{{'s': {s}, 'k': {k}}}" for k, s in enumerate(scores))
    return f"""WITH {PIXELS}, q AS (SELECT *, x / 63.0::DOUBLE AS px, y / 63.0::DOUBLE AS py FROM pixels), u AS (SELECT frame, y, x, unnest([{listed}]) AS c FROM q),
o AS (SELECT frame, y, x, c.k AS owner, c.s AS score, row_number() OVER w AS n, c.s - lead(c.s) OVER w AS margin FROM u WINDOW w AS (PARTITION BY frame, y, x ORDER BY c.s DESC, c.k))
SELECT frame, y, x, owner, round(score, 6) AS score, round(margin, 6) AS margin FROM o WHERE n = 1"""


@query(_ranker_sql())
def ranker_argmax_margin(spark, d):
    """TRK18: the best of five owners for each pixel and its lead."""
    f = tracking.owner_features(F.col("x").cast("double"), F.col("y").cast("double"), CROWNS, 64, 64)
    weights = [(-1) ** i * (i + 1) / 10 for i in range(13)]
    out = pixels(spark, d).withColumn("r", tracking.ranked_owner(f, [0.1] * 13, [0.5] * 13, weights))
    return out.select("frame", "y", "x", F.col("r.owner").alias("owner"), F.round("r.score", 6).alias("score"), F.round("r.margin", 6).alias("margin"))


# ---- rasters -------------------------------------------------------------------------------------------------------


EDGES = """e AS (SELECT a.frame, a.class AS l, b.class AS o, s.w FROM pixels a, (VALUES (0, 1, 1.0::DOUBLE), (1, 0, 1.0::DOUBLE), (1, 1, sqrt(2.0::DOUBLE)), (1, -1, sqrt(2.0::DOUBLE))) s(dy, dx, w) JOIN pixels b ON b.frame = a.frame AND b.y = a.y + s.dy AND b.x = a.x + s.dx)"""


@query(f"WITH {PIXELS}, {EDGES}, n AS (SELECT frame, count(*) AS pixels FROM pixels GROUP BY 1), s AS (SELECT frame, sum(w) AS v FROM e GROUP BY 1) SELECT n.frame, pixels, round(CASE WHEN pixels = 1 THEN 1 ELSE coalesce(v, 0) END, 4) AS length FROM n LEFT JOIN s ON n.frame = s.frame")
def edge_length(spark, d):
    """RST2, S18: pixels and weighted edge length of each raster."""
    return raster.edge_length(pixels(spark, d), ["frame"]).select("frame", "pixels", r4(F.col("length"), "length"))


@query(f"WITH {PIXELS}, {EDGES}, h AS (SELECT frame, unnest([l, o]) AS label, w / 2 AS v FROM e), s AS (SELECT frame, label, sum(v) AS v FROM h GROUP BY ALL), k AS (SELECT DISTINCT frame, class AS label FROM pixels) SELECT k.frame, k.label, round(coalesce(v, 0), 4) AS length FROM k LEFT JOIN s ON k.frame = s.frame AND k.label = s.label")
def edge_length_by_label(spark, d):
    """RST3: edge lengths by label; edges between labels count half for each."""
    return raster.edge_length_by_label(pixels(spark, d), ["frame"], "class").select("frame", "label", r4(F.col("length"), "length"))


@query(f"WITH {PIXELS}, n AS (SELECT a.frame, a.y, a.x, count(b.y) AS c FROM pixels a LEFT JOIN pixels b ON a.frame = b.frame AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL) SELECT frame, y, x FROM n WHERE c < 9")
def boundary(spark, d):
    """EVL7: pixels at the edge of the mask."""
    return raster.boundary(pixels(spark, d), ["frame"])


@query(
    f"""WITH p AS (SELECT DISTINCT l_suppkey % 10 AS plate, l_linenumber AS frame, CAST((l_partkey % 64) // 16 AS INTEGER) AS lane, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x FROM lineitem),
f AS (SELECT plate, lane, y, x, min(frame) AS first FROM p GROUP BY ALL), g AS (SELECT DISTINCT p.plate, p.frame, f.lane FROM p JOIN f ON p.plate = f.plate)
SELECT g.plate, g.lane, g.frame, count(f.y) AS seen FROM g LEFT JOIN f ON f.plate = g.plate AND f.lane = g.lane AND f.first <= g.frame GROUP BY ALL"""
)
def lane_trace_memory(spark, d):
    """WIN19, RST10: pixels that each lane has had so far."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("plate"), F.col("l_linenumber").alias("frame"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x"))
    return raster.lane_memory(li, ["plate"], "frame", F.floor(F.col("x") / 16).cast("int"))


@query(f"WITH {PIXELS} SELECT frame, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, class FROM pixels WHERE y % 2 = 0 AND x % 2 = 0")
def half_size(spark, d):
    """SNK16, SUP25: the next level of the pyramid."""
    return raster.half_size(pixels(spark, d), ["frame"], "class")


@query("SELECT l_suppkey AS frame, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x, arg_max(CAST(1 + l_linenumber % 3 AS INTEGER), (CASE 1 + l_linenumber % 3 WHEN 2 THEN 9 ELSE 1 END, l_linenumber % 3)) AS class FROM lineitem GROUP BY ALL")
def merged_classes(spark, d):
    """SUP14: one class for each pixel by priority."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x"), (1 + F.col("l_linenumber") % 3).cast("int").alias("class"))
    return raster.merged_classes(li, ["frame"], "class", F.when(F.col("class") == 2, 9).otherwise(1))


def packed(spark, d) -> DataFrame:
    """The rasters of ``pixels`` as packed masks: one byte for each pixel."""
    return raster.packed_masks(pixels(spark, d), ["frame"], "class", 64, 64)


@query()
def component_measures(spark, d):
    """RST1, RST4, RST5, RST8, FLT3: connected parts with area, box, skeleton, tips and nodes (numpy in the tests is the oracle)."""
    return raster.measure_components(packed(spark, d), ["frame"], [1, 2, 3], 2)


@query(
    f"""WITH {FRAMES}, s AS (SELECT petri, plant_id, CAST(row_number() OVER (PARTITION BY petri, plant_id ORDER BY ts, event_id) - 1 AS INTEGER) AS i, total_mm AS v FROM frames), c AS (SELECT petri, plant_id, i, v - avg(v) OVER (PARTITION BY petri, plant_id) AS v, count(*) OVER (PARTITION BY petri, plant_id) AS n FROM s),
k AS (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM c WHERE n >= 4), a AS (SELECT petri, plant_id, n, k, sqrt(sum(v * cos(2 * pi() * k * i / n)) ** 2 + sum(v * sin(2 * pi() * k * i / n)) ** 2) AS amp FROM k GROUP BY ALL),
r AS (SELECT petri, plant_id, n * 0.5 / k AS period, amp, row_number() OVER (PARTITION BY petri, plant_id ORDER BY round(amp, 6) DESC, k) AS rank FROM a WHERE amp > 1e-9) SELECT petri, plant_id, CAST(rank AS INTEGER) AS rank, round(CAST(period AS DOUBLE), 4) AS period_hours, round(amp, 3) AS amplitude FROM r WHERE rank <= 3"""
)
def dominant_periods(spark, d):
    """SIG1, SRT9: the strongest periods of each series."""
    from ..operators.windows import series

    f = frames(spark, d)
    f = f.withColumn("i", F.row_number().over(series(["petri", "plant_id"], ORDER)) - 1)
    return signal.dominant_periods(f, ["petri", "plant_id"], "i", "total_mm", 0.5).select("petri", "plant_id", "rank", r4(F.col("period_hours"), "period_hours"), F.round("amplitude", 3).alias("amplitude"))


@query()
def growth_components(spark, d):
    """SIG2: functional components of whole tracks on the frames of their plates, by series; gaps are the operator's to fill."""
    f = frames(spark, d).withColumn("track", F.concat_ws("/", "petri", "plant_id"))
    ends = f.groupBy("series").agg(F.max("frame_index").alias("last"))
    grid = f.select("series", "track").distinct().join(ends, "series").select("series", "track", F.explode(F.sequence(F.lit(0), "last")).alias("frame_index"))
    rows = grid.join(f.select("series", "track", "frame_index", "total_mm"), ["series", "track", "frame_index"], "left")
    return signal.functional_components(rows, ["series"], "track", "frame_index", "total_mm")


@query()
def tip_links(spark, d):
    """TRK6, JON9: tips of one plate linked from frame to frame at the least total cost."""
    f = frames(spark, d)
    tips = f.select("petri", F.dayofmonth("ts").alias("frame"), F.col("event_id").alias("tip_id"), F.col("bbox_x").cast("double").alias("x"), F.col("bbox_y").cast("double").alias("y"), (F.col("k") * 3.6).cast("double").alias("angle"))
    return tracking.link_tips(tips, ["petri"])


@query()
def branch_links(spark, d):
    """TRK7, SRT13: branches linked cheapest first."""
    f = frames(spark, d)
    n = lambda c: F.col(c).cast("double")
    rows = f.select("petri", F.dayofmonth("ts").alias("frame"), F.col("event_id").alias("branch_id"), n("bbox_x").alias("base_x"), n("bbox_y").alias("base_y"), (n("bbox_x") + n("k") / 10).alias("tip_x"), (n("bbox_y") + 10).alias("tip_y"))
    return tracking.link_branches(rows, ["petri"])
