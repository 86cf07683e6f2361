"""Plant kernels on hand-made rasters."""

import math

import numpy as np
from pyspark.sql import functions as F
from verdance.operators import plants, rollups


def pack(spark, *masks):
    return spark.createDataFrame([(i, m.shape[0], m.shape[1], bytearray(m.astype(np.uint8).tobytes())) for i, m in enumerate(masks)], "frame int, h int, w int, bits binary")


def test_dilated():
    m = np.zeros((9, 9), bool)
    m[4, 4] = True
    assert plants.dilated(m, 2).sum() == 25 and plants.dilated(m, 0).sum() == 1 and plants.dilated(m, 30).all()


def test_two_plants_and_their_signal(spark):
    mask = np.zeros((40, 60), np.uint8)
    for x in (15, 45):
        mask[5:9, x - 2 : x + 3] = 3
        mask[9:35, x] = 1
    mask[20, 46:52] = 2
    out = plants.region_table(plants.root_pixels(mask, 1, 2, 3), mask.shape)
    held = {k: set(zip(g.y, g.x, strict=True)) for k, g in out.groupby(["plant", "region"])}
    assert {k for k, _ in held} == {1, 2} and len(held[1, "main_root"]) == 26 and len(held[2, "lateral_root"]) == 6
    assert (34, 15) in held[1, "main_root_tip"] and min(y for y, _ in held[1, "dilated_root_exclusive"]) == 8
    assert len(out) == len(out.drop_duplicates()) and held[1, "shoot"] == {(y, x) for y in range(5, 9) for x in range(13, 18)}
    # Whatever is near a plant and not of it, by looking at every pair of pixels.
    root = {(y, x) for y, x in held[2, "main_root"] | held[2, "lateral_root"]}
    near = {(y, x) for y in range(8, 40) for x in range(60) if any(max(abs(y - a), abs(x - b)) <= 50 for a, b in root)}
    assert held[2, "dilated_root"] == near and held[2, "dilated_root_exclusive"] == near - root
    px = plants.region_pixels(pack(spark, mask), ["frame"], 1, 2, 3)
    signal = px.withColumn("v", F.when(F.col("region") == "main_root", 3.0).otherwise(6.0))
    rows = {(r.plant_id, r.region): r for r in rollups.region_pixels(signal, ["plant_id", "region"], "v").collect()}
    assert rows["plant_1", "main_root"].total == 78.0 and rows["plant_2", "lateral_root"].pixels == 6


def test_shapes(spark):
    line = np.zeros((20, 20), np.uint8)
    line[3:13, 5] = 1
    s = plants.shape_of(line)
    assert (s["area"], s["route_length"], s["tips"], s["forks"], s["aspect"], s["base_tip_angle"]) == (10, 9, 2, 0, 10, 0)
    square = np.zeros((9, 9), bool)
    square[2:7, 2:7] = True
    assert plants.shape_of(square)["hull_area"] == 16 and plants.shape_of(square)["edge_pixels"] == 16
    assert set(plants.shape_of(np.zeros((3, 3))).values()) == {0.0}
    rows = plants.measure_shapes(pack(spark, line, np.zeros((4, 4))), ["frame"], [1]).orderBy("frame").collect()
    assert [r.weighted_length for r in rows] == [9.0, 0.0]


def test_tiles_come_together_again(spark):
    m = np.random.default_rng(0).integers(0, 4, (16, 24)).astype(np.uint8)
    parts = plants.tiles(pack(spark, m), ["frame"], 8, 3)
    assert parts.count() == 6 and parts.first().h == 14
    back = plants.stitched(parts, ["frame"], 8, 3).first()
    assert bytes(back.bits) == m.tobytes()


def test_registration(spark):
    rng = np.random.default_rng(1)
    base = (rng.random((64, 64)) * 255).astype(np.uint8)
    a, b = np.roll(base, (3, -5), (0, 1)), np.roll(base, (6, 2), (0, 1))
    assert plants.shift_between(base, a)[:2] == (-5.0, 3.0)
    noise = (rng.random((64, 64)) * 255).astype(np.uint8)
    frames = pack(spark, base, a, noise, b).withColumn("plate", F.lit("p"))
    out = plants.registered(frames, ["plate"], "frame", 0.2).orderBy("frame").collect()
    assert [(r.dx, r.dy, r.accepted) for r in out] == [(0, 0, True), (-5, 3, True), (0, 0, False), (2, 6, True)]
    refs = plants.last_accepted(plants.registered(frames, ["plate"], "frame", 0.2), ["plate"], "frame").orderBy("frame").collect()
    assert [r.reference for r in refs] == [None, 0, 1, 1]


def test_warp():
    m = np.zeros((11, 11))
    m[5, 5] = 1
    assert plants.warped(m, shift=(2, -1))[4, 7] == 1 and np.allclose(plants.warped(m), m)
    assert math.isclose(plants.warped(np.ones((11, 11)), degrees=90)[5, 5], 1)


def test_box_tracks(spark):
    rows = [("p", f, None, x + f, 0, 4, 4) for f in range(3) for x in (10, 40, 70) if not (f == 2 and x == 70)]
    df = spark.createDataFrame(rows, "plate string, frame int, track_id string, bbox_x int, bbox_y int, bbox_w int, bbox_h int")
    out = plants.box_tracks(df, ["plate"]).toPandas()
    assert out[out.bbox_x < 20].track.unique().tolist() == ["plant_01"] and out[out.bbox_x > 60].track.unique().tolist() == ["plant_03"]
    named = df.withColumn("track_id", F.lit("k"))
    assert plants.box_tracks(named, ["plate"]).where("track = 'k'").count() == df.count()


def test_groups_and_calibration(spark):
    px = spark.createDataFrame([(0, "a", 1, 1), (0, "a", 1, 2), (0, "b", 1, 2), (0, "b", 1, 3)], "frame int, plant string, y int, x int")
    groups = spark.createDataFrame([(0, "a", "a"), (0, "b", "a")], "frame int, plant string, group string")
    r = plants.combined_areas(px, groups, ["frame"], "plant").first()
    assert (r.area, r.members) == (3, 2)
    scores = spark.createDataFrame([("x", 0.8), ("x", 0.6), ("y", 0.5)], "expert string, iou double")
    out = {r.expert: r for r in plants.calibration(scores, "expert", "iou").collect()}
    assert out["x"].preferred and math.isclose(out["x"].margin, 0.2) and math.isclose(out["y"].bias, -0.1)


def test_variants_and_green():
    m = np.arange(6).reshape(2, 3)
    assert len({v.tobytes() + str(v.shape).encode() for _, v in plants.variants(m)}) == 8
    rgb = np.zeros((1, 2, 3), np.uint8)
    rgb[0, 0] = (40, 120, 30)
    rgb[0, 1] = (120, 120, 120)
    assert plants.green_shoots(rgb).tolist() == [[True, False]]
