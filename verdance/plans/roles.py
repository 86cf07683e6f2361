"""Roles that the given tables play: growth series from events, pixels and plates from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event: one plate for each user, one plant for each kind of event, frames in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("series"),
        F.col("user_id").cast("string").alias("petri"),
        F.col("event_type").alias("plant_id"),
        "ts",
        "event_id",
        (F.row_number().over(w) - 1).alias("frame_index"),
        F.col("value").alias("primary_mm"),
        (F.col("value") / 2).alias("lateral_mm"),
        (F.col("value") * 1.5).alias("total_mm"),
        (F.col("event_type") != "error").alias("valid"),
        (F.col("event_id") % 97).cast("int").alias("bbox_x"),
        (F.col("event_id") % 89).cast("int").alias("bbox_y"),
        (F.col("event_id") % 7).cast("int").alias("bbox_w"),
        (F.col("event_id") % 5).cast("int").alias("bbox_h"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


FRAMES = """frames AS (
  SELECT 'S' || CAST(user_id % 10 AS VARCHAR) AS series, CAST(user_id AS VARCHAR) AS petri, event_type AS plant_id, ts, event_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_index,
    value AS primary_mm, value / 2 AS lateral_mm, value * 1.5 AS total_mm, event_type <> 'error' AS valid,
    CAST(event_id % 97 AS INTEGER) AS bbox_x, CAST(event_id % 89 AS INTEGER) AS bbox_y, CAST(event_id % 7 AS INTEGER) AS bbox_w,
    CAST(event_id % 5 AS INTEGER) AS bbox_h, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

PLATE = ["series", "petri"]
TRACK = ["series", "petri", "plant_id"]
ORDER = ["ts", "event_id"]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster for each supplier: order lines are its pixels, on a square of 64 by 64, with three classes."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("frame"),
        (F.col("l_orderkey") % 64).cast("int").alias("y"),
        (F.col("l_partkey") % 64).cast("int").alias("x"),
        (F.lit(1) + F.col("l_linenumber") % 3).cast("int").alias("class"),
    ).groupBy("frame", "y", "x").agg(F.max("class").alias("class"))


PIXELS = """pixels AS (
  SELECT l_suppkey AS frame, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x, max(CAST(1 + l_linenumber % 3 AS INTEGER)) AS class
  FROM lineitem GROUP BY ALL)"""
