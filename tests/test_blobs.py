"""Pixel-table operators against the array kernels, and outlines against filled polygons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from posespark.functions import images
from posespark.operators import blobs, patches


def _table(spark, frames):
    rows = [("v", k, *image.shape, int(y), int(x), int(image[y, x])) for k, image in enumerate(frames) for y, x in np.ndindex(image.shape)]
    return spark.createDataFrame(rows, "video string, frame_index int, height int, width int, y int, x int, value int").repartition(4)


def test_levels_equal_the_kernel(spark):
    rng = np.random.default_rng(3)
    frames = [np.where(rng.random((12, 15)) < 0.4, rng.integers(20, 60, (12, 15)), rng.integers(120, 200, (12, 15))).astype(np.uint8) for _ in range(4)]
    frames[1][:5] = 0  # masked out
    frames.append(np.full((3, 4), 9, np.uint8))
    got = {r["frame_index"]: r["level"] for r in blobs.otsu_levels(_table(spark, frames)).collect()}
    assert got == {k: images.otsu(f[f > 0]) for k, f in enumerate(frames)}


def test_central_blobs_equal_the_kernel(spark):
    rng = np.random.default_rng(5)
    frames = [np.where(rng.random((20, 26)) < share, 50, 200).astype(np.uint8) for share in (0.2, 0.35, 0.5)]
    spiral = np.full((20, 26), 200, np.uint8)
    for a in range(0, 10, 3):
        spiral[a, a : 26 - a] = spiral[19 - a, a : 26 - a] = spiral[a : 20 - a, a] = 50
    frames += [spiral, np.where(spiral == 50, 0, 200).astype(np.uint8), np.full((20, 26), 200, np.uint8)]
    pixels = _table(spark, frames)
    levels = pixels.select("video", "frame_index").distinct().withColumn("level", F.lit(100))
    sizes = pixels.select("video", "frame_index", "height", "width").distinct()
    got = {r["frame_index"]: r for r in blobs.central_blob(blobs.dark_pixels(pixels, levels), sizes).collect()}
    assert set(got) == {0, 1, 2, 3}  # of zeros and of bright pixels there is no blob
    for k, row in got.items():
        mask, _ = images.segment_foreground(frames[k], level=100, closing=1, dilation=1)
        ys, xs = np.nonzero(mask)
        assert (row["n_pixels"], row["y0"], row["y1"], row["x0"], row["x1"]) == (mask.sum(), ys.min(), ys.max(), xs.min(), xs.max())


def test_outline_of_a_straight_body(spark):
    points = [{"x": 10.0 + i, "y": 20.0} for i in range(31)]
    rows = spark.createDataFrame([("v", 0, points), ("v", 1, [points[0]] * 31)], "video string, t int, s array<struct<x:double,y:double>>")
    half = F.array_repeat(F.lit(3.0), 31)
    spans = blobs.outline_spans(rows, "s", half, ["video", "t"])
    seen = {t: {(r["y"], x) for r in spans.collect() if r["t"] == t for x in range(r["x0"], r["x1"] + 1)} for t in (0, 1)}
    disc = {(20 + a, 10 + b) for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9}
    assert seen[1] == disc  # joints in one place have no quads
    assert seen[0] == {(y, x) for y in range(17, 24) for x in range(10, 41)} | disc | {(y, x + 30) for y, x in disc}
    assert {r["t"]: r["n_pixels"] for r in blobs.span_area(spans, ["video", "t"]).collect()} == {t: len(s) for t, s in seen.items()}


def test_a_body_drawn_from_itself(spark):
    """Every pixel of a patch looks itself up where both postures are the same; values are those of the image."""
    rng = np.random.default_rng(9)
    image = rng.integers(1, 255, (40, 60)).astype(np.uint8)
    points = [{"x": 10.0 + i, "y": 20.0 + (i % 3)} for i in range(40)]
    rows = spark.createDataFrame([("v", 0, points)], "video string, frame_index int, s array<struct<x:double,y:double>>")
    key = ["video", "frame_index"]
    width = F.array_repeat(F.lit(8.0), 40)
    own = patches.body_patches(rows, "s", width, key)
    pixels = patches.patch_pixels(own.join(patches.body_patches(rows, "s", width, key, name="from_"), [*key, "place"]), key)
    found = pixels.collect()
    assert len({r["place"] for r in found}) == 40 and all((r["y"], r["x"]) == (r["source_y"], r["source_x"]) for r in found)
    drawn = patches.draw_patches(pixels, _table(spark, [image]), key, key).collect()
    inside = {(r["y"], r["x"]) for r in found if 0 <= r["y"] < 40 and 0 <= r["x"] < 60}
    assert {(r["y"], r["x"]) for r in drawn} == inside and all(abs(r["value"] - int(image[r["y"], r["x"]])) <= 1 for r in drawn)


def test_a_body_moved_and_overlaid(spark):
    """A body two rows lower looks up two rows higher; patches over a pixel are averaged in their order, and the order may be turned."""
    rows = spark.createDataFrame([("v", 0, [{"x": 5.0 + i, "y": 10.0} for i in range(20)], [{"x": 5.0 + i, "y": 12.0} for i in range(20)])], "video string, frame_index int, s array<struct<x:double,y:double>>, m array<struct<x:double,y:double>>")
    key, width = ["video", "frame_index"], F.array_repeat(F.lit(4.0), 20)
    pair = patches.body_patches(rows, "m", width, key).join(patches.body_patches(rows, "s", width, key, name="from_"), [*key, "place"])
    assert {(r["y"] - r["source_y"], r["x"] - r["source_x"]) for r in patches.patch_pixels(pair, key).collect()} == {(2, 0)}
    head, tail = ({r["place"]: r["x0"] for r in patches.body_patches(rows, "s", width, key, on_top).collect()} for on_top in (True, False))
    assert head[0] == tail[0] == 4.0 and head[1] == tail[1] and [head[p] for p in range(2, 21)] == [tail[p] for p in range(20, 1, -1)] == [float(x) for x in range(23, 4, -1)]
    pixels = spark.createDataFrame([("v", 0, 2, 1, 1, 0, 0), ("v", 0, 5, 1, 1, 0, 1), ("v", 0, 3, 1, 1, 0, 2), ("v", 0, 9, 1, 1, 7, 7)], "video string, frame_index int, place int, y int, x int, source_y int, source_x int")
    source = spark.createDataFrame([("v", 0, 0, 0, 100), ("v", 0, 0, 1, 50), ("v", 0, 0, 2, 0)], "video string, frame_index int, y int, x int, value int")
    assert patches.draw_patches(pixels, source, key, key).first()["value"] == 75
