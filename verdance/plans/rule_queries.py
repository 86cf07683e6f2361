"""Queries on rules for names, flags, keys and exports, each with its equivalent in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, text
from ..operators import evaluation, exports, joins, plants, qa, raster, reshape, rollups, signal, windows
from ..sources import files, sinks
from .roles import FRAMES, ORDER, PIXELS, TRACK, frames, pixels, table
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


# ---- names --------------------------------------------------------------------------------------------------------

#: Paths made from orders: structured names, plain names, generic words, folders (the same in SQL).
NAMES = """names AS (SELECT o_orderkey, CASE o_orderkey % 8
  WHEN 0 THEN 'runs/A' || (o_custkey % 50) || ' B2_2024-01-' || lpad(CAST(1 + o_custkey % 28 AS VARCHAR), 2, '0') || '_10-20-30_' || (o_orderkey % 1000) || '.png'
  WHEN 1 THEN 'runs/dish ' || (o_custkey % 90 + 10) || ' greiner.tif'
  WHEN 2 THEN 'plates/C' || (o_custkey % 9) || '/frame_' || (o_custkey % 100) || '.png'
  WHEN 3 THEN 'images/img_' || (o_custkey % 100) || '.png'
  WHEN 4 THEN 'x/plate,' || (o_custkey % 1000) || ';NPEC AGAR.png'
  WHEN 5 THEN 'x/IMG camera ' || (o_custkey % 100000) || '.jpg'
  WHEN 6 THEN 'x/' || o_orderstatus || 'Q ' || lower(o_orderpriority) || '.png'
  ELSE 'x/20240102030405 K' || (o_custkey % 30) || '.png' END AS path FROM orders)"""


def _names(spark, d):
    o = table(spark, d, "orders")
    s = lambda c: c.cast("string")
    n, k = F.col("o_custkey"), F.col("o_orderkey")
    option = [
        F.concat(F.lit("runs/A"), s(n % 50), F.lit(" B2_2024-01-"), F.lpad(s(1 + n % 28), 2, "0"), F.lit("_10-20-30_"), s(k % 1000), F.lit(".png")),
        F.concat(F.lit("runs/dish "), s(n % 90 + 10), F.lit(" greiner.tif")),
        F.concat(F.lit("plates/C"), s(n % 9), F.lit("/frame_"), s(n % 100), F.lit(".png")),
        F.concat(F.lit("images/img_"), s(n % 100), F.lit(".png")),
        F.concat(F.lit("x/plate,"), s(n % 1000), F.lit(";NPEC AGAR.png")),
        F.concat(F.lit("x/IMG camera "), s(n % 100000), F.lit(".jpg")),
        F.concat(F.lit("x/"), F.col("o_orderstatus"), F.lit("Q "), F.lower("o_orderpriority"), F.lit(".png")),
        F.concat(F.lit("x/20240102030405 K"), s(n % 30), F.lit(".png")),
    ]
    path = F.coalesce(*(F.when(k % 8 == i, p) for i, p in enumerate(option)))
    return o.select("o_orderkey", path.alias("path"))


_DATE = r"20\d{2}[._-]\d{2}[._-]\d{2}[ T._-]\d{2}[._:-]\d{2}[._:-]\d{2}|20\d{12}"
_GENERIC = "'agar', 'camera', 'control', 'date', 'dish', 'greiner', 'lucifer', 'npec', 'petri', 'plate', 'time'"


def _tokens_sql(c: str) -> str:
    safe = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(p), '\s+', '_', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._-')"
    return (
        rf"list_filter(list_transform(regexp_split_to_array({c}, '[\s,;:/|]+'), lambda p: {safe}), lambda p: length(p) BETWEEN 2 AND 24 AND NOT list_contains([{_GENERIC}], trim(lower(p), '._-')) "
        rf"AND NOT regexp_matches(p, '(^|\D)({_DATE})(\D|$)') AND CASE WHEN regexp_full_match(p, '\d+') THEN length(p) BETWEEN 2 AND 4 WHEN NOT regexp_matches(p, '\d') THEN length(p) <= 12 AND upper(p) = p ELSE true END)"
    )


_WORDS = lambda c: f"array_to_string(list_slice({_tokens_sql(c)}, 1, 4), '_')"


@query(
    rf"""WITH {NAMES}, s AS (SELECT *, regexp_replace(list_last(string_split(path, '/')), '(.)\.[^.]*$', '\1') AS stem, string_split(path, '/')[-2] AS folder FROM names),
t AS (SELECT *, trim(regexp_extract(stem, '^(.*?)({_DATE})[_-]\d{{1,7}}$', 1), '._- ') AS head, regexp_replace(regexp_replace(stem, '({_DATE})', ' ', 'g'), '(?i)(frame|image|img|capture|seq)[_-]*\d+', ' ', 'g') AS rest FROM s),
w AS (SELECT *, {_WORDS("head")} AS a, {_WORDS("rest")} AS b, CASE WHEN lower(folder) NOT IN ('images', 'image', 'input', 'inputs', 'jpeg', 'jpg', 'png', 'raw', 'rgb', 'stabilized', 'stabilized_input') THEN {_WORDS("folder")} ELSE '' END AS c FROM t)
SELECT o_orderkey, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c <> '' THEN c END AS plate_id, CASE WHEN a <> '' OR b <> '' THEN 'filename' WHEN c <> '' THEN 'folder' END AS source,
  CASE WHEN a <> '' THEN 0.94 WHEN b <> '' THEN 0.56 WHEN c <> '' THEN 0.48 END::DOUBLE AS confidence, CASE WHEN a <> '' THEN true ELSE false END AS accepted FROM w"""
)
def file_identities(spark, d):
    """STR8, STR9, STR10, STR13: identities from file names alone, over a listing of paths."""
    none = F.lit(None).cast("string")
    who = text.identity(none, none, F.col("path"), none, F.lit(None).cast("double"))
    return _names(spark, d).withColumn("i", who).select("o_orderkey", *(F.col(f"i.{c}").alias(c) for c in ("plate_id", "source", "confidence", "accepted")))


@query(
    f"""WITH {NAMES} SELECT o_orderkey, CASE WHEN contains(upper(path), 'ROOT2') THEN 'ROOT2' ELSE 'ROOT1' END AS root_type, CASE WHEN contains(upper(path), 'FC2') THEN 'FC2' ELSE 'FC1' END AS channel,
CASE WHEN contains(lower(path), 'rootpainter') OR contains(lower(path), 'minirhizotron') THEN 'minirhizotron_public' WHEN contains(lower(path), 'potato') THEN 'potato_rgb' WHEN contains(lower(path), 'rgb') OR contains(lower(path), 'lucifer') THEN 'plate_rgb_lucifer'
  WHEN contains(lower(path), 'bw') OR contains(lower(path), 'hades') THEN 'plate_bw_hades' ELSE 'generic_root' END AS family,
CASE lower(regexp_extract(path, '\\.([^./]*)$', 1)) WHEN 'hdr' THEN 'envi' WHEN 'tar' THEN 'fluorescence_archive' ELSE 'image' END AS kind FROM (SELECT o_orderkey, path || CASE o_orderkey % 5 WHEN 0 THEN '/root2_fc2.hdr' WHEN 1 THEN '/RGB.tar' WHEN 2 THEN '/potato.npyx' WHEN 3 THEN '/bw.png' ELSE '' END AS path FROM names)""".replace("\\\\", "\\")
)
def path_kinds(spark, d):
    """STR14, STR16, SRC10: what a path tells of root type, channel, corpus family and reader."""
    more = F.coalesce(*(F.when(F.col("o_orderkey") % 5 == i, s) for i, s in enumerate(["/root2_fc2.hdr", "/RGB.tar", "/potato.npyx", "/bw.png"])), F.lit(""))
    p = _names(spark, d).withColumn("path", F.concat("path", more))
    return p.select("o_orderkey", text.root_type("path").alias("root_type"), text.fluorescence_channel("path").alias("channel"), text.corpus_family("path").alias("family"), text.sensor_kind("path").alias("kind"))


@query(
    r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 40) || '-' || p_size WHEN 1 THEN ' ' || p_brand || ' / ' || p_size ELSE '--' END AS sample FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(trim(sample), '\d+-\d+') THEN split_part(trim(sample), '-', 1) WHEN trim(regexp_replace(lower(trim(sample)), '[^a-z0-9]+', '-', 'g'), '-') <> '' THEN trim(regexp_replace(lower(trim(sample)), '[^a-z0-9]+', '-', 'g'), '-') ELSE 'unknown' END AS plate FROM s"""
)
def sample_plates(spark, d):
    """STR15: the plate group of a sample id."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    sample = F.when(k % 3 == 0, F.concat((k % 40).cast("string"), F.lit("-"), size)).when(k % 3 == 1, F.concat(F.lit(" "), "p_brand", F.lit(" / "), size)).otherwise("--")
    return table(spark, d, "part").select("p_partkey", text.plate_group(sample).alias("plate"))


@query(
    f"""WITH {FRAMES} SELECT petri, sha256('v1' || '{{"a":1}}' || string_agg(event_id || '|' || plant_id || '|' || petri || ':' || bbox_x || ':' || bbox_y, ';' ORDER BY ts, event_id)) AS fingerprint FROM frames GROUP BY petri"""
)
def plate_fingerprints(spark, d):
    """STR19: a fingerprint of each plate's settings, frames and files."""
    signature = text.file_signature(F.col("petri"), F.col("bbox_x"), F.col("bbox_y"))
    return text.plate_fingerprint(frames(spark, d), ["petri"], [F.col("ts"), F.col("event_id")], [F.col("event_id").cast("string"), F.col("plant_id"), signature], "v1", F.lit('{"a":1}'))


@query("""WITH r AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 0.5) / count(*) OVER () AS place FROM customer) SELECT c_custkey, CASE WHEN place <= 0.7 THEN 'train' WHEN place <= 0.7::DOUBLE + 0.2::DOUBLE THEN 'val' ELSE 'test' END AS split FROM r""")
def splits_by_position(spark, d):
    """STR16: training, validation and test rows by their place in an order."""
    return reshape.position_split(table(spark, d, "customer"), ["c_mktsegment", "c_custkey"], 0.7, 0.2).select("c_custkey", "split")


# ---- keys, order and numbers --------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT CASE WHEN c_nationkey > 4 THEN c_nationkey END AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT CASE WHEN s_nationkey > 9 THEN s_nationkey END AS k, count(*) AS m FROM supplier GROUP BY 1)
SELECT a.k, n, m FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k"""
)
def null_keys_meet(spark, d):
    """S3: groups and joins that keep missing keys."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    a = c.groupBy(F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = s.groupBy(F.when(F.col("s_nationkey") > 9, F.col("s_nationkey")).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return joins.null_safe(a, b, ["k"], "left")


@query(
    f"""WITH {FRAMES}, k AS (SELECT event_id, ts, total_mm, CASE WHEN k % 3 > 0 THEN petri END AS petri FROM frames) SELECT event_id, round(CASE WHEN petri IS NOT NULL THEN total_mm - lag(total_mm) OVER (PARTITION BY petri ORDER BY ts, event_id) END, 4) AS change FROM k"""
)
def changes_of_known_keys(spark, d):
    """S4: changes that leave out rows whose key is missing."""
    f = frames(spark, d).withColumn("petri", F.when(F.col("k") % 3 > 0, F.col("petri")))
    change = windows.delta_known_keys(F.col("total_mm"), ["petri"], windows.series(["petri"], ORDER))
    return f.select("event_id", F.round(change, 4).alias("change"))


@query(
    f"""WITH {FRAMES}, v AS (SELECT *, CASE WHEN k % 2 = 0 THEN total_mm END AS v FROM frames) SELECT petri, round(arg_min(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL), 4) AS first_v, round(arg_max(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL), 4) AS final_v,
round(max(v), 4) AS most, sum(v) IS NULL AS nothing FROM v GROUP BY petri"""
)
def first_and_last_known(spark, d):
    """S5, S13: first and last known values in row order; sums of nothing stay missing."""
    f = frames(spark, d).withColumn("v", F.when(F.col("k") % 2 == 0, F.col("total_mm")))
    order = F.struct("ts", "event_id")
    out = f.groupBy("petri").agg(*rollups.metric_columns("v", order), F.sum("v").isNull().alias("nothing"))
    return out.select("petri", F.round("first_v", 4).alias("first_v"), F.round("final_v", 4).alias("final_v"), F.round("max_v", 4).alias("most"), "nothing")


@query(
    f"""WITH {FRAMES}, v AS (SELECT *, CASE WHEN k % 4 > 0 THEN ts END AS t, CASE WHEN k % 5 > 0 THEN frame_index END AS f FROM frames) SELECT event_id, CAST(row_number() OVER (PARTITION BY petri ORDER BY t NULLS LAST, coalesce(f, 1e12), event_id) AS INTEGER) AS place,
CAST(row_number() OVER (PARTITION BY petri ORDER BY t NULLS LAST, coalesce(f, -1), event_id) AS INTEGER) AS early_place FROM v"""
)
def missing_times_last(spark, d):
    """S8, S10: a stable order in which missing times come last and missing frames last or first."""
    f = frames(spark, d).withColumns({"t": F.when(F.col("k") % 4 > 0, F.col("ts")), "f": F.when(F.col("k") % 5 > 0, F.col("frame_index").cast("double"))})
    late = f.withColumn("n", coerce.number_or("f", 1e12)).withColumn("m", coerce.number_or("f", -1))
    place = lambda frame: F.row_number().over(windows.series(["petri"], ["t", frame, "event_id"]))
    return late.select("event_id", place("n").alias("place"), place("m").alias("early_place"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS whole, CASE WHEN l_tax > 0.04 THEN l_tax WHEN l_discount > 0 THEN l_discount ELSE 0.25 END AS size FROM lineitem""")
def rounding_and_pixel_sizes(spark, d):
    """S12, PRJ4: halves rounded to even, and the first pixel size over 0."""
    li = table(spark, d, "lineitem")
    size = coerce.pixel_size([F.when(F.col("l_tax") > 0.04, F.col("l_tax")), F.col("l_discount")], 0.25)
    return li.select("l_orderkey", "l_linenumber", coerce.whole_or(F.col("l_quantity") / 2, 0).alias("whole"), size.alias("size"))


@query(
    """WITH g AS (SELECT l_suppkey, l_returnflag AS c, count(*) FILTER (WHERE l_linenumber <= 3 AND l_tax > 0.06) AS i, count(*) FILTER (WHERE l_linenumber <= 3 OR l_tax > 0.06) AS u FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2)
SELECT l_suppkey, c, round(i::DOUBLE / nullif(u, 0), 6) AS iou, round(i::DOUBLE / greatest(1, u), 6) AS share FROM g"""
)
def empty_classes(spark, d):
    """S19: an overlap of nothing is missing in one convention and 0 in the other."""
    a, b = F.col("l_linenumber") <= 3, F.col("l_tax") > 0.06
    g = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_suppkey", F.col("l_returnflag").alias("c")).agg(F.count_if(a & b).alias("i"), F.count_if(a | b).alias("u"))
    return g.select("l_suppkey", "c", F.round(evaluation.overlap_or_null(F.col("i"), F.col("u")), 6).alias("iou"), F.round(F.col("i") / F.greatest(F.lit(1), "u"), 6).alias("share"))


@query(
    """SELECT c_custkey, CASE WHEN regexp_full_match(t, '[0-9a-f]{6}') THEN '#' || t WHEN regexp_full_match(t, '[0-9a-f]{3}') THEN '#' || regexp_replace(t, '(.)', '\\1\\1', 'g') ELSE '#ffffff' END AS hex, CASE WHEN length(n) > 12 THEN left(n, 12) || '… [' || (length(n) - 12) || ' more characters]' ELSE n END AS note
FROM (SELECT c_custkey, lower(CASE c_custkey % 3 WHEN 0 THEN printf('%06X', c_custkey * 37 % 16777216) WHEN 1 THEN printf('%03x', c_custkey % 4096) ELSE 'zz' END) AS t, repeat(c_mktsegment, CAST(c_custkey % 3 AS INTEGER)) AS n FROM customer)""".replace("\\\\", "\\")
)
def colours_and_cut_texts(spark, d):
    """PRJ27, SNK5: colours in one form, and texts cut for spreadsheets with a note."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" #"), F.lpad(F.hex(k * 37 % 16777216), 6, "0"))).when(k % 3 == 1, F.lower(F.lpad(F.hex(k % 4096), 3, "0"))).otherwise("zz")
    return table(spark, d, "customer").select("c_custkey", coerce.colour_hex(raw).alias("hex"), coerce.shortened(F.repeat("c_mktsegment", (k % 3).cast("int")), 12).alias("note"))


@query(
    f"""WITH {FRAMES}, v AS (SELECT event_id, petri, CASE WHEN k % 4 > 0 THEN total_mm END AS a, CASE WHEN k % 4 = 0 THEN total_mm END AS b, CASE k % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'review' ELSE 'ok' END AS s, bbox_x FROM frames)
SELECT event_id, round(coalesce(a, b), 4) AS total, CAST(row_number() OVER (PARTITION BY petri ORDER BY CASE s WHEN 'fail' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, bbox_x, event_id) AS INTEGER) AS place FROM v"""
)
def review_order(spark, d):
    """SRT4, PRJ9: values from before the quality gate, and failures first."""
    k = F.col("k")
    f = frames(spark, d).select("event_id", "petri", "bbox_x", F.when(k % 4 > 0, F.col("total_mm")).alias("v"), F.when(k % 4 == 0, F.col("total_mm")).alias("v_diagnostic_pre_qa"), F.when(k % 3 == 0, "fail").when(k % 3 == 1, "review").otherwise("ok").alias("s"))
    f = f.withColumns({"total": coerce.backfilled_number(f, ["none_such", "v"]), "rank": qa.review_rank(F.col("s"))})
    return f.select("event_id", F.round("total", 4).alias("total"), F.row_number().over(windows.series(["petri"], ["rank", "bbox_x", "event_id"])).alias("place"))


@query(
    """WITH l AS (SELECT l_suppkey AS p, list(DISTINCT l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'A') AS a, list(DISTINCT l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT p, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(r, [])))), ',') AS lines FROM l"""
)
def merged_priors(spark, d):
    """SET9: two maps of lists become one, each entry once."""
    li = table(spark, d, "lineitem")
    lists = li.groupBy(F.col("l_suppkey").alias("p")).agg(*(F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == v, F.col("l_linenumber")))).alias(v) for v in ("A", "R")))
    both = reshape.merged_lists(F.create_map(F.lit("x"), "A"), F.create_map(F.lit("x"), "R"))
    return lists.select("p", F.array_join(F.sort_array(both["x"]), ",").alias("lines"))


@query(
    f"""WITH {FRAMES} SELECT petri, round(CASE WHEN max(k) > 90 THEN max(k) / 10.0 WHEN epoch(max(ts)) - epoch(min(ts)) > 0 AND max(frame_index) > 0 THEN (epoch(max(ts)) - epoch(min(ts))) / 3600 / max(frame_index) ELSE 1 END, 4) AS hours FROM frames GROUP BY petri"""
)
def timesteps(spark, d):
    """SIG3: a plate's timestep as declared, else from its time and frames."""
    g = frames(spark, d).groupBy("petri").agg(F.max("k").alias("k"), (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 3.6e9).alias("hours"), F.max("frame_index").alias("n"))
    return g.select("petri", F.round(signal.timestep_hours(F.when(F.col("k") > 90, F.col("k") / 10), F.col("hours"), F.col("n")), 4).alias("hours"))


@query("""SELECT s_suppkey, '<plant label="' || replace(replace(s_name, '&', '&amp;'), '<', '&lt;') || '"><root><geometry><polyline><point x="' || s_suppkey || '" y="' || s_nationkey || '"/><point x="1.5" y="2"/></polyline></geometry></root></plant>' AS rsml FROM supplier""")
def root_markup(spark, d):
    """SNK10: root systems as markup."""
    s = table(spark, d, "supplier")
    points = F.array(F.array(F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")), F.array(F.lit(1.5), F.lit(2.0)))
    out = sinks.rsml(s.withColumn("points", points), "s_name", "points")
    return out.join(s.select("s_suppkey", F.col("s_name").alias("plant")), "plant").select("s_suppkey", "rsml")


@query("""SELECT CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS place, c_nationkey AS nation, c_custkey AS keeper, coalesce(c_mktsegment, 'none') AS c_mktsegment, 7 AS lanes FROM customer QUALIFY place = 1""")
def manifest_rows(spark, d):
    """SRC3, SRC17: a manifest with its required columns, defaults and the first row of each key."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("keeper"), "c_mktsegment")
    return files.manifest(c, ["nation", "keeper"], {"c_mktsegment": "none", "lanes": 7}, ["nation"]).select(F.lit(1).alias("place"), "nation", "keeper", "c_mktsegment", "lanes")


# ---- exports ------------------------------------------------------------------------------------------------------


def _mask_totals(spark, d):
    f = frames(spark, d)
    return f.select(
        F.col("series").alias("Series"), F.col("petri").alias("PetriDish"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
        F.when(F.col("k") % 7 > 0, F.col("frame_index").cast("string")).otherwise("none").alias("FrameIndex"), F.col("event_id").alias("SourceFile"), F.col("event_id").alias("OutputMaskPath"),
        F.when(F.col("k") % 9 > 0, F.col("total_mm").cast("string")).otherwise("nan").alias("total_root_length_mm"), F.col("primary_mm").alias("primary_root_length_mm"),
        F.col("k").alias("shoot_seed_pixels_class_2"), F.lit(0.5).alias("pixel_size_mm"), F.col("bbox_x").alias("measured_mask_pixels"),
    )


_MASK_TOTALS = f"""{FRAMES}, m AS (SELECT series, petri, ts, event_id, CASE WHEN k % 7 > 0 THEN frame_index ELSE -1 END AS f, CASE WHEN k % 9 > 0 THEN total_mm ELSE 0 END AS t, primary_mm AS p, CAST(k AS DOUBLE) AS shoot, bbox_x FROM frames)"""


@query(
    f"""WITH {_MASK_TOTALS} SELECT event_id, CAST(f AS INTEGER) AS "FrameIndex", round(t, 4) AS total, round(coalesce(t - lag(t) OVER w, 0), 4) AS delta_total, round(coalesce(p - lag(p) OVER w, 0), 4) AS delta_primary, shoot AS shoot_area_px, shoot * 0.25 AS shoot_area_mm2,
CAST(bbox_x AS DOUBLE) AS root_pixels, 0.0::DOUBLE AS weighted, 1 AS plants FROM m WINDOW w AS (PARTITION BY series, petri ORDER BY ts, f, event_id)"""
)
def mask_total_tables(spark, d):
    """PRJ25: a whole-mask table normalised: parsed numbers, stand-ins, zeros and changes."""
    out = exports.mask_total_timeline(_mask_totals(spark, d))
    r = lambda c, n: F.round(c, 4).alias(n)
    return out.select(
        F.col("SourceFile").alias("event_id"), "FrameIndex", r("total_root_length_mm", "total"), r("delta_total_root_length_mm", "delta_total"), r("delta_primary_root_length_mm", "delta_primary"),
        "shoot_area_px", "shoot_area_mm2", F.col("total_root_pixels_selected_classes").alias("root_pixels"), F.col("total_root_length_weighted_mm").alias("weighted"), F.col("plants_detected").alias("plants"),
    )


def _mode_sql(mode: str, c: str) -> str:
    return f"SELECT '{mode}' AS mode, 'frames' AS part, petri, count(*) AS n, round(sum({c}), 2) AS length FROM m GROUP BY petri"


@query(f"WITH {_MASK_TOTALS}, x AS (SELECT petri, CASE WHEN t > 0 THEN t END AS t, p FROM m) " + " UNION ALL ".join(_mode_sql(m, c).replace("FROM m", "FROM x") for m, c in (("total", "t"), ("primary", "p"))))
def metric_modes(spark, d):
    """PRJ6, SNK2: the metric that a mode selects, through the tables of a whole-mask export."""
    rows = _mask_totals(spark, d).withColumn("total_root_length_mm", coerce.number("total_root_length_mm"))
    out = None
    for mode in ("no such mode", " Primary "):
        detail = exports.mask_total_bundle(rows, mode, ["PetriDish"], F.struct("Timestamp", "SourceFile"))["detail"]
        length = rollups.ordered_sum(F.col("selected_root_length_mm"), F.col("SourceFile"))
        part = detail.groupBy(F.col("selected_root_metric_mode").alias("mode"), F.lit("frames").alias("part"), F.col("PetriDish").alias("petri")).agg(F.count(F.lit(1)).alias("n"), coerce.rounded(length, 2).alias("length"))
        out = part if out is None else out.unionByName(part)
    return out


def _masters(spark, d):
    f = frames(spark, d)
    c = F.col
    return f.select(
        c("series").alias("Series"), c("petri").alias("PetriDish"), "plant_id", c("ts").alias("Timestamp"), c("frame_index").alias("FrameIndex"), "event_id", c("valid").alias("ownership_measurement_valid"),
        c("total_mm").alias("total_root_length_mm_raw"), c("primary_mm").alias("primary_root_length_mm_clean"), c("lateral_mm").alias("lateral_total_length_mm"), c("k").alias("shoot_area_mm2"), c("k").alias("shoot_area_px"),
        "bbox_x", "bbox_y", "bbox_w", "bbox_h", (1 + c("k") % 2).alias("conflict_group_size"),
    )


_DETAIL = f"""{FRAMES}, g AS (SELECT *, CASE WHEN valid THEN total_mm END AS t, CASE WHEN valid THEN primary_mm END AS p, CASE WHEN valid THEN lateral_mm END AS l, CASE WHEN valid THEN CAST(k AS DOUBLE) END AS a,
  CASE WHEN bbox_w > 0 AND bbox_h > 0 THEN bbox_x + bbox_w / 2.0 END AS cx, CASE WHEN bbox_w > 0 AND bbox_h > 0 THEN bbox_y + bbox_h / 2.0 END AS cy FROM frames),
e AS (SELECT *, row_number() OVER w AS n, t - lag(t) OVER w AS dt, p - lag(p) OVER w AS dp, coalesce(sqrt(power(cx - lag(cx) OVER w, 2) + power(cy - lag(cy) OVER w, 2)), 0) AS jump,
  (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h, greatest(frame_index - lag(frame_index) OVER w, 1) AS fh FROM g WINDOW w AS (PARTITION BY series, petri, plant_id ORDER BY ts, event_id)),
x AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN h > 0 THEN h ELSE fh END AS hours, CASE WHEN n = 1 AND t IS NOT NULL THEN 0 ELSE dt END AS change, CASE WHEN n = 1 AND p IS NOT NULL THEN 0 ELSE dp END AS change_p FROM e)"""


@query(
    f"""WITH {_DETAIL} SELECT event_id, valid AS ownership_valid, round(t, 4) AS total, round(total_mm, 4) AS diagnostic_total, round(p + l, 4) AS parts, round(p, 4) AS selected, round(p / nullif(p + l, 0), 6) AS primary_fraction, round(p / nullif(a, 0), 6) AS per_shoot,
total_mm > 0 AS root_present, coalesce(a > 0, false) AS shoot_present, 1 + k % 2 > 1 AS conflict, round(change, 4) AS delta_total, round(hours, 6) AS hours, round(CASE WHEN hours > 0 THEN change_p / (hours / 24) WHEN change_p = 0 THEN 0 END, 2) AS rate, round(jump, 4) AS jump FROM x"""
)
def ownership_details(spark, d):
    """PRJ11, PRJ6: the detail table of owned measurements: derived, gated, with changes, rates, presence and conflicts."""
    out = exports.ownership_detail(_masters(spark, d), ["Series", "PetriDish", "plant_id"], ["Timestamp", "event_id"], "primary")
    r = lambda c, n, places=4: F.round(c, places).alias(n)
    return out.select(
        "event_id", "ownership_valid", r("ownership_total_root_length_mm", "total"), r("diagnostic_ownership_total_root_length_mm", "diagnostic_total"), r("ownership_primary_plus_lateral_root_length_mm", "parts"),
        r("ownership_selected_root_length_mm", "selected"), r("ownership_primary_fraction_of_root_length", "primary_fraction", 6), r("ownership_selected_root_length_mm_per_shoot_area_mm2", "per_shoot", 6),
        F.col("ownership_root_present").alias("root_present"), F.col("ownership_shoot_present").alias("shoot_present"), F.col("ownership_conflict").alias("conflict"), r("delta_ownership_total_root_length_mm", "delta_total"),
        r("ownership_elapsed_hours", "hours", 6), r("rate_ownership_selected_root_length_mm_per_day", "rate", 2), r("ownership_bbox_center_jump_px", "jump"),
    )


@query(
    f"""WITH {_DETAIL}, r AS (SELECT *, NOT valid OR 1 + k % 2 > 1 OR k <= 0 AS bad FROM x) SELECT series AS "Series", petri AS "PetriDish", plant_id, count(*) AS frames, round(max(p), 4) AS most, round(arg_min(p, (ts, event_id)) FILTER (WHERE p IS NOT NULL), 4) AS first_p,
count(*) FILTER (WHERE valid) AS valid_rows FROM r GROUP BY series, petri, plant_id"""
)
def ownership_tables(spark, d):
    """SNK4: the tables of an ownership export: tracks with their first and largest values."""
    detail = exports.ownership_detail(_masters(spark, d), ["Series", "PetriDish", "plant_id"], ["Timestamp", "event_id"], "primary")
    tables = exports.ownership_bundle(detail, ["Series", "PetriDish", "plant_id"], ["PetriDish"], "FrameIndex", F.struct("Timestamp", "event_id"))
    valid = detail.groupBy("Series", "PetriDish", "plant_id").agg(F.count_if("ownership_valid").alias("valid_rows"))
    t = tables["track_summary"].join(valid, ["Series", "PetriDish", "plant_id"])
    name = "ownership_selected_root_length_mm"
    return t.select("Series", "PetriDish", "plant_id", "frames", F.round(f"max_{name}", 4).alias("most"), F.round(f"first_{name}", 4).alias("first_p"), "valid_rows")


@query(
    f"""WITH {PIXELS}, a AS (SELECT frame, class, y, x FROM pixels WHERE (y + x) % 5 > 0), b AS (SELECT frame, class, y, x FROM pixels WHERE (y * x) % 3 > 0),
j AS (SELECT coalesce(a.frame, b.frame) AS frame, coalesce(a.class, b.class) AS class, count(b.y) AS baseline_pixels, count(a.y) AS current_pixels, count(*) FILTER (WHERE b.y IS NULL) AS added_pixels, count(*) FILTER (WHERE a.y IS NULL) AS removed_pixels
  FROM a FULL JOIN b ON a.frame = b.frame AND a.class = b.class AND a.y = b.y AND a.x = b.x GROUP BY ALL)
SELECT *, added_pixels + removed_pixels AS changed_positions FROM j WHERE baseline_pixels > 0 AND current_pixels > 0"""
)
def relabelled_pixels(spark, d):
    """JON15: what hand labelling added to and removed from a baseline, by raster and class."""
    px = pixels(spark, d)
    return exports.changed_pixels(px.where("(y + x) % 5 > 0"), px.where("(y * x) % 3 > 0"), ["frame", "class"])


# ---- rasters ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {PIXELS}, t AS (SELECT frame, class, unnest([{{'n': 'turn0', 'y': y, 'x': x}}, {{'n': 'turn90', 'y': 63 - x, 'x': y}}, {{'n': 'turn180', 'y': 63 - y, 'x': 63 - x}}, {{'n': 'turn270', 'y': x, 'x': 63 - y}}]) AS t FROM pixels),
v AS (SELECT frame, class, t.n AS variant, t.y AS y, t.x AS x FROM t UNION ALL SELECT frame, class, t.n || '_mirrored', t.y, 63 - t.x FROM t)
SELECT frame, variant, CAST(sum(y * class) AS BIGINT) AS y, CAST(sum(x * class) AS BIGINT) AS x, count(*) AS pixels FROM v GROUP BY frame, variant"""
)
def mask_variants(spark, d):
    """HIT3: every raster turned and mirrored."""
    out = raster.pixel_table(raster.changed_rasters(packed(spark, d), ["frame"], plants.variants), ["frame", "variant"])
    weighted = lambda c: F.sum(F.col(c) * F.col("class")).alias(c)
    return out.groupBy("frame", "variant").agg(weighted("y"), weighted("x"), F.count(F.lit(1)).alias("pixels"))


@query(f"WITH {PIXELS} SELECT frame, y, x, class FROM pixels")
def tiles_and_back(spark, d):
    """RST15: rasters in tiles with halos, put together again."""
    return raster.pixel_table(plants.stitched(plants.tiles(packed(spark, d), ["frame"], 16, 3), ["frame"], 16, 3), ["frame"])


def _moved(mask):
    yield "moved", plants.warped(mask.astype(float), (3.0, -2.0)).round()


@query(f"WITH {PIXELS} SELECT frame, y - 2 AS y, x + 3 AS x, class FROM pixels WHERE y >= 2 AND x <= 60")
def corrected_planes(spark, d):
    """SEN4: an optical correction by whole pixels."""
    return raster.pixel_table(raster.changed_rasters(packed(spark, d), ["frame"], _moved), ["frame"])


#: Seeds of three owners and the head start of each.
SEEDS, HEAD_START = [[(5, 10)], [(5, 32), (40, 30)], [(8, 55)]], [0.0, 1.5, 0.0]


def _owned(mask):
    yield "owners", raster.owners(mask > 0, SEEDS, HEAD_START)


@query(
    f"""WITH {PIXELS}, s(k, sy, sx, d) AS (VALUES (1, 5, 10, 0.0::DOUBLE), (2, 5, 32, 1.5::DOUBLE), (2, 40, 30, 1.5::DOUBLE), (3, 8, 55, 0.0::DOUBLE)),
r AS (SELECT frame, y, x, k, row_number() OVER (PARTITION BY frame, y, x ORDER BY sqrt(power((y - sy)::DOUBLE, 2) + power((x - sx)::DOUBLE, 2)) - d, k) AS n FROM pixels, s) SELECT frame, y, x, k AS class FROM r WHERE n = 1"""
)
def nearest_owners(spark, d):
    """TRK13: pixels to the nearest seed less its head start."""
    return raster.pixel_table(raster.changed_rasters(packed(spark, d), ["frame"], _owned), ["frame"])


def _filled(mask):
    yield "filled", raster.filled(mask > 0)


@query(
    f"""WITH RECURSIVE {PIXELS}, f AS (SELECT DISTINCT frame FROM pixels), free AS (SELECT a.frame, a.y, a.x FROM (SELECT frame, y, x FROM f, (SELECT unnest(range(-1, 65)) AS y), (SELECT unnest(range(-1, 65)) AS x)) a LEFT JOIN pixels p ON p.frame = a.frame AND p.y = a.y AND p.x = a.x WHERE p.frame IS NULL),
r AS (SELECT frame, -1::BIGINT AS y, -1::BIGINT AS x FROM f UNION SELECT free.frame, free.y, free.x FROM r, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx), free WHERE free.frame = r.frame AND free.y = r.y + dy AND free.x = r.x + dx)
SELECT frame, 4096 - count(*) FILTER (WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63) AS area FROM r GROUP BY frame"""
)
def filled_areas(spark, d):
    """RST14: areas of masks whose holes are filled."""
    out = raster.pixel_table(raster.changed_rasters(packed(spark, d), ["frame"], _filled), ["frame"])
    return out.groupBy("frame").agg(F.count(F.lit(1)).alias("area"))


__all__ = ["QUERIES", "SQL", "TRACK"]
