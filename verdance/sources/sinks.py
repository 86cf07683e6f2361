"""Writers: one folder for each table of a bundle, reports as JSON, root systems as RSML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import shortened
from ..operators.reshape import csv_ready


def bundle(tables: dict[str, DataFrame], folder: str, kind: str = "parquet", text_limit: int | None = None) -> None:
    """Every table below ``folder``; CSV gets nested cells as JSON and, with ``text_limit``, long texts cut."""
    for name, df in tables.items():
        if kind == "csv":
            df = csv_ready(df, drop=[])
            if text_limit:
                df = df.withColumns({c: shortened(c, text_limit) for c, t in df.dtypes if t == "string"})
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def report(df: DataFrame, **figures: Column) -> DataFrame:
    """One row, ``report``: the named aggregates as a JSON document."""
    return df.agg(F.to_json(F.struct(*(c.alias(n) for n, c in figures.items()))).alias("report"))


def rsml(tracks: DataFrame, plant: str, points: str) -> DataFrame:
    """``plant, rsml``: one scene element for each plant, with a polyline for each row of ``points`` (``array<array<double>>``)."""
    short = lambda c: F.regexp_replace(F.round(c, 3).cast("string"), r"\.0$", "")
    point = lambda p: F.concat(F.lit('<point x="'), short(F.element_at(p, 1)), F.lit('" y="'), short(F.element_at(p, 2)), F.lit('"/>'))
    line = F.concat(F.lit("<root><geometry><polyline>"), F.array_join(F.transform(F.col(points), point), ""), F.lit("</polyline></geometry></root>"))
    each = tracks.select(F.col(plant).alias("plant"), line.alias("line")).groupBy("plant").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("plant").cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    return each.select("plant", F.concat(F.lit('<plant label="'), name, F.lit('">'), F.array_join("lines", ""), F.lit("</plant>")).alias("rsml"))
