"""Queries on small tables made like larger ones: busy plates, ties, crowded frames."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from verdance.functions import coerce
from verdance.operators import joins, rollups, tracking
from verdance.plans import catalog

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def compare(spark, tmp_path):
    """Runs a query on events ``(event_id, ts, user_id, event_type, value, k)`` and gives its rows and those of its SQL."""

    def run(name, events):
        rows = [(*row[:5], f'{{"k": {row[5]}}}') for row in events]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        c = duckdb.connect()
        c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), c.sql(catalog.oracle_sql()[name]).df()
        columns = sorted(want.columns)
        plain = lambda df: sorted(tuple(map(str, row)) for row in df[columns].itertuples(index=False))
        return plain(got), plain(want)

    return run


def test_frames_within_a_second_keep_their_order(spark, compare):
    at = lambda ms: START + dt.timedelta(milliseconds=ms)
    events = [(1, at(100), 1, "view", 5.0, 1), (2, at(900), 1, "view", 7.5, 14), (3, at(950), 1, "view", 9.0, 3)]
    got, want = compare("mask_total_tables", events)
    assert got == want
    texts = spark.createDataFrame([("2024-01-01 00:00:00.25",), ("2024-01-01T00:00:00.000001",), ("2024-01-01 00:00:00",), ("2024-01-01",), ("x",)], "t string")
    parsed = [r[0] for r in texts.select(coerce.timestamp("t")).collect()]
    assert parsed == [at(250), START + dt.timedelta(microseconds=1), START, START, None]


def test_sums_are_rounded_like_sql(spark, compare):
    rng = random.Random(2)
    events = [(i, START + dt.timedelta(seconds=i), i % 40, "view", rng.randrange(56000) / 100, 1) for i in range(2400)]
    got, want = compare("metric_modes", events)
    assert got == want and len(got) == 80
    values = spark.createDataFrame([(1.005, 1), (1.015, 1), (2.675, 1), (-0.125, 1), (2.5, 1)], "v double, k int")
    want = [float(r[0]) for r in duckdb.sql("select round(v, 2) from (values (1.005::double), (1.015), (2.675), (-0.125), (2.5)) t(v)").fetchall()]
    assert [r[0] for r in values.select(coerce.rounded(F.col("v"), 2)).collect()] == want
    terms = spark.createDataFrame([(1, 1e16), (2, 1.0), (3, -1e16), (4, None)], "at int, v double").orderBy(F.desc("at"))
    assert terms.agg(rollups.ordered_sum(F.col("v"), F.col("at"))).first()[0] == 0.0
    assert terms.where("v is null").agg(rollups.ordered_sum(F.col("v"), F.col("at"))).first()[0] is None


def test_groups_of_touching_boxes_against_brute_force(spark):
    rng = random.Random(3)
    columns, everything = "frame int, plant string, bbox_x double, bbox_y double, bbox_w double, bbox_h double", []
    for frame in range(12):
        step = rng.choice([1.0, 0.25])
        for _ in range(40):
            x, y, w, h = (rng.randrange(round(most / step)) * step for most in (60, 60, 9, 14))
            everything.append((frame, rng.choice([f"p{rng.randrange(60):02}", None, f"q{rng.randrange(10**6)}"]), x, y, w, h))
    want = set()
    for frame in range(12):
        known = [r for r in everything if r[0] == frame and r[1] is not None and r[4] > 0 and r[5] > 0]
        label = {r[1]: r[1] for r in known}
        pairs = [(a[1], b[1]) for a in known for b in known if a[1] < b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]]
        for _ in label:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        sizes = [*label.values()]
        want |= {(frame, p, g, sizes.count(g)) for p, g in label.items() if sizes.count(g) > 1}
    boxes = spark.createDataFrame(everything, columns)
    got = [tuple(r) for r in tracking.conflict_groups(boxes, ["frame"], "plant").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert tracking.conflict_groups(boxes.limit(0), ["frame"], "plant").count() == 0


def test_a_crowded_frame_makes_no_pairs():
    n = 100_000
    i = np.arange(n)
    x, y = (i % 97).astype(float), (i % 89).astype(float)
    assert not tracking.touching_components(x, y, x + 6, y + 4, i).any()


def test_crowded_frames_make_no_join(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 2, 2)], "frame int, plant int, bbox_x int, bbox_y int, bbox_w int, bbox_h int")
    assert "Join" not in tracking.conflict_groups(boxes, ["frame"], "plant")._jdf.queryExecution().toString()


def _boxes(rng, n, whole):
    """Random boxes in three frames; plants repeat, and some boxes lack a value or have no size."""
    at = lambda most: rng.randrange(most) if whole else rng.randrange(4 * most) / 4
    rows = [[f"f{rng.randrange(3)}", f"p{rng.randrange(n)}", float(at(60) - 9), float(at(50)), float(at(9)), float(at(14))] for _ in range(n)]
    for k in range(1, 6):
        rows[k][k] = None
    rows[6][4] = rows[7][2] = float("nan")
    return [tuple(r) for r in rows]


def _meeting(rows):
    """Pairs by plain Python; NaN is over all numbers, as in SQL."""
    over = lambda v: float("inf") if v != v else v
    known = [r for r in rows if None not in r and r[2] == r[2] and over(r[4]) > 0 and r[5] > 0]
    close = lambda a, b, k: a[k] < over(b[k] + b[k + 2]) and b[k] < over(a[k] + a[k + 2])
    return sorted((a[0], a[1], b[1]) for a in known for b in known if a[0] == b[0] and a[1] < b[1] and close(a, b, 2) and close(a, b, 3))


@pytest.mark.parametrize("part", [7, 60, 1 << 16])
def test_touching_pairs_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(joins, "PART", part)
    monkeypatch.setattr(joins, "ROWS", 5)
    monkeypatch.setattr(joins, "OTHERS", 11)
    rng = random.Random(part)
    for cell, whole in ((16, True), (200, False)):
        rows = [r for r in _boxes(rng, 240, whole) if cell == 200 or r[4] == r[4]]
        boxes = spark.createDataFrame(rows, "frame string, plant string, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
        got = sorted(tuple(r) for r in joins.touching_pairs(boxes, ["frame"], "plant", cell).collect())
        assert got == _meeting(rows) and len(got) > 100
        assert joins.touching_pairs(boxes.limit(0), ["frame"], "plant", cell).count() == 0


def test_touching_pairs_of_a_busy_day_against_sql(compare):
    events = [(i, START + dt.timedelta(seconds=i), i % 40, "view", 1.0, 1) for i in range(6000)]
    got, want = compare("touching_pairs", events)
    assert got == want and len(got) > 15_000


def test_touching_boxes_are_swept_and_not_joined(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 2, 2)], "frame int, plant int, bbox_x int, bbox_y int, bbox_w int, bbox_h int")
    assert "Join Inner" not in joins.touching_pairs(boxes, ["frame"], "plant")._jdf.queryExecution().optimizedPlan().toString()


def test_a_crowded_cell_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART", 50)
    boxes = spark.range(0, 400, 1, 1).selectExpr("1 frame", "id plant", "cast(id % 8 as int) bbox_x", "cast(id % 9 as int) bbox_y", "3 bbox_w", "3 bbox_h")
    pairs = joins.touching_pairs(boxes, ["frame"], "plant").withColumn("task", F.spark_partition_id())
    assert pairs.select("task").distinct().count() > 1
    rows = [(1, i, i % 8, i % 9, 3, 3) for i in range(400)]
    assert sorted(tuple(r)[:3] for r in pairs.collect()) == _meeting(rows)
