"""Trackers on small hand-made plates."""

import numpy as np
from pyspark.sql import functions as F
from verdance.operators import raster, trackers


def pack(spark, masks, plate="p"):
    return spark.createDataFrame([(plate, i, m.shape[0], m.shape[1], bytearray(m.astype(np.uint8).tobytes())) for i, m in enumerate(masks)], "plate string, frame int, h int, w int, bits binary")


def plates(frames=4):
    out = []
    for f in range(frames):
        m = np.zeros((80, 120), np.uint8)
        for x in (20, 60, 100):
            if not (f == 1 and x == 60):
                m[5 : 20 + 10 * f, x + f : x + f + 3] = 1
        out.append(m)
    return out


def test_components_followed(spark):
    parts = raster.measure_components(pack(spark, plates()), ["plate", "frame"], [1])
    for more in ({}, {"expected": 3}, {"lanes": [20.0, 60.0, 100.0]}, {"seeds": {"a": (18, 5, 6, 20), "b": (58, 5, 6, 20), "c": (98, 5, 6, 20)}}):
        out = trackers.track_components(parts, ["plate"], "frame", trackers.Gates(80, 120), **more).toPandas()
        assert len(out) == 11 and out.track.notna().all()
        assert out.groupby((out.x - out.frame) // 40).track.nunique().tolist() == [1, 1, 1]


def test_gates():
    g = trackers.Gates(1000, 1000)
    assert g.open([(0, 0, 10, 10)], [(50, 0, 10, 10), (400, 0, 10, 10)]).tolist() == [[True, False]]
    assert not g.open([(0, 0, 0, 10)], [(0, 0, 5, 5)]).any() and g.open(np.zeros((0, 4)), [(0, 0, 1, 1)]).shape == (0, 1)
    # Far from where the track was last seen, but on its first place.
    assert g.open([(500, 0, 10, 10)], [(0, 0, 10, 10)], [(5, 5, 10, 10)]).all() and not g.open([(500, 0, 10, 10)], [(0, 0, 10, 10)], [(300, 0, 10, 10)]).any()


def test_appearance(spark):
    px = raster.pixel_table(pack(spark, plates()), ["plate", "frame"])
    vertices, edges = trackers.appearance(px, ["plate"], "frame")
    masks = plates()
    first = np.full(masks[0].shape, 99)
    for f in reversed(range(4)):
        first[masks[f] > 0] = f
    assert {r["first"]: r.pixels for r in vertices.collect()} == {f: int((first == f).sum()) for f in range(4)}
    assert edges.where("earlier = 0 AND later = 1").first().contacts > 0


def test_owned(spark):
    masks = plates()
    masks[3][70:73, 22:105] = 1  # all three grow together
    masks[3][40:73, 63:66] = masks[3][40:73, 103:106] = masks[3][40:73, 23:26] = 1
    out = trackers.owned_masks(pack(spark, masks), ["plate"], "frame", [(5, 20), (5, 60), (5, 100)], 1).toPandas()
    total = out.groupby("frame").pixels.sum().tolist()
    assert total == [int((m == 1).sum()) for m in masks] and (out[out.frame == 3].pixels > 100).all()
    assert out[(out.frame == 1) & (out.plant == 2)].pixels.item() == 0


def test_memory(spark):
    a = np.zeros((10, 10), bool)
    a[2:6, 2:6] = True
    b = np.zeros((10, 10), bool)
    b[2:4, 2:4] = True
    assert trackers.remembered(b, a).sum() == 16 and (trackers.remembered(b, a) == a).all()
    assert trackers.remembered(a, b).sum() == 16 and trackers.remembered(b, a, (20, 0)).sum() == 16
    out = trackers.remembered_areas(pack(spark, [a * 4, b * 4, np.zeros((10, 10))]), ["plate"], "frame", 4).orderBy("frame").collect()
    assert [(r.observed, r.tracked) for r in out] == [(16, 16), (4, 16), (0, 16)]


def test_laterals():
    m = np.zeros((40, 40), bool)
    m[2:38, 20] = True
    m[10, 21:30] = True
    m[20, 8:20] = True
    out = trackers.lateral_segments(m)
    assert len(out) == 2 and out[0]["tip_x"] == 29 and out[1]["tip_x"] == 8 and out[0]["angle"] > 0 > out[1]["angle"]
    assert trackers.lateral_segments(np.zeros((4, 4), bool)) == []


def test_hook_and_features(spark):
    image = np.zeros((8, 8, 3), np.uint8)
    image[:, :4, 1] = 200
    df = spark.createDataFrame([(1, 8, 8, 3, bytearray(image.tobytes()))], "i int, h int, w int, c int, bits binary")
    out = trackers.predicted(df, ["i"], lambda: lambda p: p[:, :, 1] > 100).first()
    assert sum(bytes(out.bits)) == 32
    r = trackers.image_features(df, ["i"]).first()
    assert r.colour and r.green > 0.3 and 0.4 < r.dark_top < 0.6
    assert trackers.image_features(df.where(F.lit(False)), ["i"]).count() == 0


def test_readings_and_slots(spark):
    from verdance.operators import selection

    rows = [("i", "A1", 0.9, 0.1, 0.1), ("i", "A1", 0.8, 0.12, 0.1), ("i", "B2", 0.95, 0.8, 0.8), ("i", "A7", 0.3, 0.1, 0.11)]
    r = selection.clustered_readings(spark.createDataFrame(rows, "image string, text string, confidence double, x double, y double"), ["image"]).first()
    assert (r.text, r.votes) == ("A1", 2) and 0.89 < r.score <= 1
    parts = spark.createDataFrame([(0, 1, 50.0), (0, 2, 10.0)], "frame int, component int, cx double")
    assert [x.s for x in parts.withColumn("s", selection.slots(parts, ["frame"], "cx")).orderBy("component").collect()] == [2, 1]
