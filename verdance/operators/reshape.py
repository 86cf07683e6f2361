"""Reshapes between wide and long tables, set operations, ordinals and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import clean_text, number


def long_traits(df: DataFrame, keys: dict[str, Column], parameters: dict[str, str], placeholders: list[str] = ()) -> DataFrame:
    """``*keys, parameter, value``: one row for each parameter that has a value, and one with null for every placeholder parameter.

    ``parameters`` maps columns to parameter names; values that are no numbers are left out.
    """
    present = [c for c in parameters if c in df.columns]
    wide = df.select(*(c.alias(k) for k, c in keys.items()), *(number(c).alias(f"__{c}") for c in present))
    names = F.create_map(*(x for c in present for x in (F.lit(f"__{c}"), F.lit(parameters[c]))))
    rows = wide.unpivot(list(keys), [f"__{c}" for c in present], "__c", "value").where("value IS NOT NULL").select(*keys, names[F.col("__c")].alias("parameter"), "value")
    if placeholders:
        empty = wide.select(*keys).distinct().withColumn("parameter", F.explode(F.array(*map(F.lit, placeholders)))).withColumn("value", F.lit(None).cast("double"))
        rows = rows.unionByName(empty.join(rows.select(*keys, "parameter").distinct(), [*keys, "parameter"], "left_anti"))
    return rows


def plate_labels(df: DataFrame, series: str, petri: str, frame: str, plant: str) -> Column:
    """The petri's name; with the series before it if any plant would be in one frame twice without."""
    from ..functions.coerce import plate_value

    n = F.count(F.lit(1)).over(Window.partitionBy(frame, petri, plant))
    clash = F.max(n > 1).over(Window.partitionBy(petri))
    s, p = clean_text(series), plate_value(petri)
    both = F.concat_ws("::", F.when(s != "", s), F.when(p != "", p))
    return F.when(clash & (s != ""), both).when(p != "", p).when(s != "", s).otherwise("Unknown")


def metadata_rows(values: dict[str, object], spark) -> DataFrame:
    """``key, value`` rows of a dictionary, by key."""
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted(values.items())], "key string, value string")


def exploded_map(df: DataFrame, keys: list[str], m: Column) -> DataFrame:
    return df.select(*keys, F.explode(m).alias("key", "value"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, with their number of occurrences, that the tables don't have in common: ``*keys, side``."""
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionAll(y.exceptAll(x).withColumn("side", F.lit("right")))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``place``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def grouped_split(df: DataFrame, group: str, fraction: float, salt: str) -> DataFrame:
    """``held_out`` by a hash of the group, so that no group is on both sides; neither side is ever empty (if there are two groups)."""
    from ..functions.text import hash_fraction

    groups = df.select(group).distinct().withColumn("__h", hash_fraction(F.col(group), salt))
    ends = groups.agg(F.min("__h").alias("__low"), F.max("__h").alias("__high"), F.count(F.lit(1)).alias("__groups"))
    out = F.col("__h") < fraction
    none, every = F.col("__low") >= fraction, F.col("__high") < fraction
    several = F.col("__groups") > 1
    held = F.when(none & several, F.col("__h") == F.col("__low")).when(every & several, F.col("__h") != F.col("__high")).otherwise(out)
    # One row of totals, joined to the groups.
    return df.join(groups.join(F.broadcast(ends)).select(group, held.alias("held_out")), group)


def position_split(df: DataFrame, order: list[str], train: float, validation: float) -> DataFrame:
    """``df`` with ``split``: train, val or test by a row's place in an order over all rows, counted from the middle of each row.

    Rows are ranked within ranges of the first column of the order, and ranges are counted from before: no task sees more than one range.
    """
    parts = df.repartitionByRange(F.col(order[0])).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each partition.
    before = counts.withColumns({"__before": F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"), "__all": F.sum("__n").over(Window.partitionBy())}).drop("__n")
    ranked = parts.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    place = (F.col("__before") + F.col("__row") - 0.5) / F.col("__all")
    split = F.when((F.col("__all") <= 1) | (place <= train), "train").when(place <= train + validation, "val").otherwise("test")
    return ranked.join(F.broadcast(before), "__part").withColumn("split", split).drop("__part", "__row", "__before", "__all")


def merged_lists(a: Column, b: Column) -> Column:
    """Union of two maps of lists; lists under one key are joined, each entry once."""
    empty = F.array()
    return F.map_zip_with(a, b, lambda k, x, y: F.array_union(F.coalesce(x, empty), F.coalesce(y, empty)))


def csv_ready(df: DataFrame, drop: list[str] = ("path_points",)) -> DataFrame:
    """Columns in alphabetic order, nested ones as JSON."""
    nested = lambda c: df.schema[c].dataType.typeName() in ("array", "struct", "map")
    return df.select(*((F.to_json(c) if nested(c) else F.col(c)).alias(c) for c in sorted(set(df.columns) - set(drop))))


def metric_names(df: DataFrame, blocked: list[str]) -> list[str]:
    """Columns that hold a number in at least one row: one pass over the table."""
    candidates = [c for c in df.columns if c not in blocked and df.schema[c].dataType.typeName() not in ("array", "struct", "map", "binary")]
    if not candidates:
        return []
    counts = df.agg(*(F.count(number(F.col(c).cast("string"))).alias(c) for c in candidates)).first()
    return [c for c in candidates if counts[c]]


def prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *(c for c in df.columns if c.startswith(prefix) and c not in keys))
