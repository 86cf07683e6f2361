"""Kernels and expressions against plain Python."""

import io
import itertools
import json
import math
import random
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from verdance.functions import coerce, geometry, text
from verdance.operators import evaluation, exports, joins, qa, raster, reshape, signal, tracking, windows
from verdance.sources import files, sinks
from verdance.streaming import carry


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        cost = np.where(rng.random((n, m)) < 0.7, rng.random((n, m)), np.inf)
        pairs = tracking.assignment(cost)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
        best = (0, 0.0)
        for k in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    c = sum(cost[i, j] for i, j in zip(rows, cols))
                    if np.isfinite(c) and (k > best[0] or (k == best[0] and c < best[1] - 1e-12)):
                        best = (k, c)
        assert len(pairs) == best[0]
        assert math.isclose(sum(cost[i, j] for i, j in pairs), best[1], abs_tol=1e-9)


def _flood(mask):
    seen, parts = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        parts += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                seen[a, b] = parts
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return seen


def test_components_and_skeleton():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((12, 15)) < 0.4
        assert (raster.components(mask) == _flood(mask)).all()
    bar = np.zeros((9, 20), bool)
    bar[3:6, 2:18] = True
    lines = raster.skeleton(bar)
    assert lines.sum() and (lines <= bar).all() and raster.components(lines).max() == 1
    assert not raster.skeleton(np.zeros((4, 4))).any()
    assert raster.mask_edge_length(np.eye(4, dtype=bool)) == 3 * math.sqrt(2)
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert raster.mask_edge_length(one) == 1.0 and raster.mask_edge_length(one, 0.0) == 0.0


def test_filled_and_owners():
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[2:5, 2:5] = False
    assert raster.filled(ring).sum() == 25
    line = np.zeros((3, 10), bool)
    line[1] = True
    assert raster.geodesic_owners(line, [[(1, 0)], [(1, 9)]])[1].tolist() == [1] * 5 + [2] * 5
    assert raster.owners(line, [[(1, 0)], [(1, 9)]])[1].tolist() == [1] * 5 + [2] * 5


def test_measured_components(spark):
    mask = np.zeros((12, 12), np.uint8)
    mask[2:8, 4] = 1
    mask[10, 10] = 2
    rows = spark.createDataFrame([("a", 12, 12, bytearray(mask.tobytes()))], "frame string, h int, w int, bits binary")
    out = {r.area: r for r in raster.measure_components(rows, ["frame"], [1, 2]).collect()}
    assert out[6].length == 5.0 and out[6].tips == 2 and (out[6].x, out[6].y, out[6].w, out[6].h) == (4, 2, 1, 6)
    assert out[1].length == 1.0
    assert raster.measure_components(rows, ["frame"], [1, 2], 2).count() == 1
    pixels = raster.pixel_table(rows, ["frame"]).where("class = 1")
    r = raster.edge_length(pixels, ["frame"]).first()
    assert (r.pixels, r.length) == (6, 5.0)


def test_hausdorff(spark):
    a = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "k int, y int, x int")
    b = spark.createDataFrame([(1, 3, 0)], "k int, y int, x int")
    assert math.isclose(evaluation.hausdorff(a, b, ["k"]).first().hausdorff, math.sqrt(10))


def _png(mask, how):
    h, w = mask.shape
    raw, before = b"", np.zeros(w, int)
    for row in mask.astype(int):
        left = np.concatenate([[0], row[:-1]])
        corner = np.concatenate([[0], before[:-1]])
        if how == 4:
            p = left + before - corner
            d = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
            guess = np.choose(d.argmin(axis=0), [left, before, corner])
        else:
            guess = [np.zeros(w, int), left, before, (left + before) // 2][how]
        raw += bytes([how]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_and_rasters(spark, tmp_path):
    mask = np.random.default_rng(2).integers(0, 256, (9, 7), dtype=np.uint8)
    for how in range(5):
        assert (files.png_gray(_png(mask, how)) == mask).all()
    (tmp_path / "a.png").write_bytes(_png(mask, 2))
    (tmp_path / "b.png").write_bytes(b"nothing")
    rows = {r.path[-5:]: r for r in files.rasters(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.png"].bits) == mask.tobytes() and rows["b.png"].error


def test_envi(spark, tmp_path):
    cube = np.arange(2 * 3 * 4, dtype="<i2").reshape(2, 3, 4)
    for interleave, data in (("bip", cube), ("bil", cube.transpose(0, 2, 1)), ("bsq", cube.transpose(2, 0, 1))):
        assert (files.envi_cube(np.ascontiguousarray(data).tobytes(), 3, 2, 4, 2, interleave) == cube).all()
    head = "ENVI\nsamples = 3\nlines = 2\nbands = 4\ndata type = 2\ninterleave = bil\nbyte order = 0\nwavelength = {450.0,\n 550, 650, x}\n"
    df = spark.createDataFrame([("c", bytearray(np.ascontiguousarray(cube.transpose(0, 2, 1)).tobytes()), head)], "path string, content binary, text string")
    df = df.select("path", "content", files.envi_header(F.col("text")).alias("header"))
    assert df.first().header.wavelengths == [450.0, 550.0, 650.0]
    out = files.envi_pixels(df)
    assert out.count() == 24 and out.where("y = 1 AND x = 2 AND band = 3").first().value == 23.0


def test_archives(spark):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as t:
        body = json.dumps({"a": 1}).encode()
        info = tarfile.TarInfo("x/meta.json")
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    df = spark.createDataFrame([("p", bytearray(data.getvalue()))], "path string, content binary")
    assert [(r.member, json.loads(r.content)) for r in files.archive_members(df).collect()] == [("x/meta.json", {"a": 1})]


def test_measurement_files(spark, tmp_path):
    (tmp_path / "petri_03").mkdir()
    (tmp_path / "petri_03" / "frame_7.csv").write_text("﻿length,Unnamed: 0,plant\n1.5,0,a\n,1,b\n")
    (tmp_path / "plate_B").mkdir()
    (tmp_path / "plate_B" / "20240102_030405.csv").write_text("plant,area\nc,9\n")
    rows = files.measurements(spark, str(tmp_path)).collect()
    by = {r.plant: r for r in rows}
    assert set(by) == {"a", "b", "c"} and by["a"].length == "1.5" and by["b"].length is None and by["c"].area == "9"
    assert (by["a"].dish, by["a"].frame, by["c"].dish, str(by["c"].taken)) == ("03", 7, "B", "2024-01-02 03:04:05")


def test_manifest(spark):
    df = spark.createDataFrame([("p", 1, None), ("p", 1, "z"), ("q", 2, "y")], "plate string, frame int, group string")
    out = files.manifest(df, ["plate", "frame"], {"group": "none", "extra": 0}, ["plate", "frame"])
    assert sorted((r.plate, r.group, r.extra) for r in out.collect()) == [("p", "none", 0), ("q", "y", 0)]
    try:
        files.manifest(df, ["missing"], {}, ["plate"])
        raise AssertionError
    except ValueError:
        pass


def test_bundle_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], "x" * 50)], "plant string, path array<int>, note string")
    sinks.bundle({"detail": df}, str(tmp_path), "csv", 20)
    row = spark.read.option("header", True).csv(f"{tmp_path}/detail").first()
    assert row.path == "[1,2]" and row.note.startswith("x" * 20 + "…")
    assert json.loads(sinks.report(df, n=F.count(F.lit(1))).first().report) == {"n": 1}
    tracks = spark.createDataFrame([("a<b", [[0.0, 1.0], [2.5, 3.0]])], "plant string, points array<array<double>>")
    assert '<plant label="a&lt;b"><root><geometry><polyline><point x="0" y="1"/><point x="2.5" y="3"/>' in sinks.rsml(tracks, "plant", "points").first().rsml


def test_identity_rules(spark):
    df = spark.createDataFrame([(1, "PLATE: https://x.org/a/AB-12/", "", "IMG_7.png", None, None), (2, "", "", "C3_20240102_030405.png", None, None), (3, "", "", "img.png", "K9", 0.8), (4, "", "", "img.png", "K9", 0.4)], "i int, qr string, bar string, name string, ocr string, conf double")
    out = {r.i: r.w for r in df.select("i", text.identity(F.col("qr"), F.col("bar"), F.col("name"), F.col("ocr"), F.col("conf")).alias("w")).collect()}
    assert (out[1].plate_id, out[1].source, out[1].accepted) == ("AB-12", "qr", True)
    assert (out[3].plate_id, out[3].accepted) == ("K9", True) and out[4].accepted is False


def test_geometry(spark):
    row = spark.range(1).select(
        geometry.path_length(F.expr("array(array(0d, 0d), array(3d, 4d), array(3d, 5d))")).alias("way"),
        geometry.angle_between(F.lit(350.0), F.lit(10.0)).alias("turn"),
        geometry.evenly(F.lit(0.0), F.lit(1.0), 3).alias("even"),
        coerce.colour_hex(F.lit("#AbC")).alias("hex"),
        coerce.colour_rgb(F.lit("#0a10ff")).alias("rgb"),
        tracking.lane_bounds(F.array(F.lit(2.0), F.lit(6.0)), 10.0).alias("lanes"),
    ).first()
    assert (row.way, row.turn, row.even, row.hex, tuple(row.rgb)) == (6.0, 20.0, [0.0, 0.5, 1.0], "#aabbcc", (10, 16, 255))
    assert [tuple(b) for b in row.lanes] == [(0.0, 4.0), (4.0, 10.0)]


def test_asof_keeps_rows_and_null_keys(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", 0)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 3, "x", 1), ("a", 5, "y", 2), (None, 1, "z", 3), ("a", None, "w", 4)], "k string, t int, v string, o int")
    out = {r.i: r.v for r in joins.as_of(left, right, ["k"], "t", ["v"], "o").collect()}
    assert out == {1: "y", 2: "z", 3: None}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "series string, petri string, plant_id string, ts timestamp_ntz, event_id long, v double")
    w = windows.series(["petri"], ["ts", "event_id"])
    assert empty.select(windows.delta_filled(F.col("v"), w)).count() == 0
    assert windows.without_short_runs(empty, "v", ["petri"], ["ts"], 3, "o").count() == 0
    assert qa.quality_gate(empty, ["v"]).count() == 0
    assert reshape.metric_names(empty, []) == []


def test_periods_match_fft(spark):
    rng = random.Random(3)
    v = [math.sin(2 * math.pi * i / 6) + 0.3 * math.cos(2 * math.pi * i / 4) + rng.random() * 0.01 for i in range(24)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, i int, v double")
    out = signal.dominant_periods(df, ["k"], "i", "v", 0.5).orderBy("rank").collect()
    amplitude = np.abs(np.fft.rfft(np.array(v) - np.mean(v)))
    best = np.argsort(amplitude)[::-1][:3]
    assert [round(r.amplitude, 6) for r in out] == [round(float(amplitude[k]), 6) for k in best]
    assert [r.period_hours for r in out] == [24 * 0.5 / k for k in best]


def test_fpca_separates_two_shapes(spark):
    rows = [(f"t{i}", x, (x if i % 2 else -x) * 1.0) for i in range(4) for x in range(8)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, t string, i int, v double")
    out = signal.functional_components(df, ["g"], "t", "i", "v").where("component = 1").collect()
    assert all(r.explained > 0.999 for r in out) and len({r.score > 0 for r in out if r.t in ("t0", "t2")}) == 1
    assert signal.functional_components(df.where("t = 't0'"), ["g"], "t", "i", "v").count() == 0


def test_growth_components_take_whole_tracks(spark, sf_dir):
    from verdance.plans import catalog
    from verdance.plans.roles import frames

    f = frames(spark, sf_dir).where("total_mm IS NOT NULL").groupBy("series", "petri", "plant_id").count().where("count >= 2")
    out = catalog.queries()["growth_components"](spark, sf_dir)
    assert {r.track for r in out.select("track").distinct().collect()} == {f"{r.petri}/{r.plant_id}" for r in f.collect()}


def test_tips_keep_their_tracks(spark):
    rows = [(1, f, 10 * f + n, 20.0 * n + f, 5.0 * f, 0.0) for f in range(4) for n in range(3) if not (f == 2 and n == 1)]
    df = spark.createDataFrame(rows, "plant int, frame int, tip_id int, x double, y double, angle double")
    for method in ("optimal", "greedy"):
        out = tracking.link_tips(df, ["plant"], method=method).toPandas()
        assert out.groupby(out.tip_id % 10)["track"].nunique().tolist() == [1, 1, 1]


def test_streaming_carry(spark, tmp_path):
    schema = "plant string, frame int, v double, ok boolean"
    spark.createDataFrame([("a", 0, 1.0, True), ("a", 1, 5.0, False), ("a", 2, 3.0, True), ("a", 3, 2.0, True)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = carry.carried(stream, ["plant"], "frame", "v", "ok").writeStream.format("memory").queryName("carried").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("carried").orderBy("frame").toPandas()
    assert out["carried"].tolist() == [1.0, 1.0, 3.0, 3.0] and out["status"].tolist() == ["advanced", "frozen", "advanced", "retained"]


def test_position_split(spark):
    df = reshape.position_split(spark.range(10), ["id"], 0.7, 0.2)
    assert [r.split for r in df.orderBy("id").collect()] == ["train"] * 7 + ["val"] * 2 + ["test"]
    assert reshape.position_split(spark.range(1), ["id"], 0.2, 0.2).first().split == "train" and reshape.position_split(spark.range(0), ["id"], 0.2, 0.2).count() == 0


def test_required_columns_and_modes(spark):
    df = spark.createDataFrame([("p", "2024-01-01 00:00:00", "x", "3.5", None, None)], "PetriDish string, Timestamp string, FrameIndex string, total_root_length_mm string, mean_root_length_mm string, plants_detected string")
    row = exports.timeline(df).first()
    assert (row.FrameIndex, row.total_root_length_weighted_mm, row.plants_detected, row.mean_root_length_mm) == (-1, 3.5, 0.0, None)
    for kind in (exports.mask_total_timeline, exports.master):
        with pytest.raises(ValueError):
            kind(df.drop("PetriDish"))
    assert exports.metric_mode(" Lateral ") == "lateral" and exports.metric_mode(None) == exports.metric_mode("x") == "total"


def test_ownership_without_validity_is_invalid(spark):
    df = spark.createDataFrame([("a", 0, 99.0, 500, 2)], "plant_id string, FrameIndex int, primary_root_length_mm_clean double, shoot_area_px long, conflict_group_size int")
    row = exports.ownership_detail(df, ["plant_id"], ["FrameIndex"]).first()
    assert row.ownership_primary_root_length_mm is None and row.diagnostic_ownership_primary_root_length_mm == 99.0 and row.diagnostic_ownership_shoot_area_px == 500
    reasons = row.ownership_frame_review_reasons.split(";")
    assert row.ownership_frame_review_status == "fail" and {"invalid_ownership_measurement", "seedling_conflict"} <= set(reasons) and not row.ownership_validity_known


def test_export_tables(spark):
    rows = spark.createDataFrame([("p", "2024-01-01 00:00:00", 0, 10.0, 7.0, "ok"), ("p", "2024-01-01 01:00:00", 1, 16.0, 9.0, "fail")], "PetriDish string, Timestamp string, FrameIndex int, total_root_length_mm double, primary_root_length_mm double, mask_total_review_status string")
    out = exports.mask_total_bundle(rows, "primary", ["PetriDish"], F.col("FrameIndex"))
    assert set(out) == {"detail", "summary", "timelapse", "frames_needing_review", "metadata"}
    assert out["summary"].first().final_selected_root_length_mm == 9.0 and out["frames_needing_review"].count() == 1
    assert {(r.key, r.value) for r in out["metadata"].collect()} == {("rows", "2"), ("plates", "1"), ("root_metric_mode", "primary")}
