from __future__ import annotations

from math import pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from posespark.functions import images
from posespark.functions.arrow import skeleton_to_theta
from posespark.operators import imaging, models, sampling
from posespark.plans import commands
from posespark.sources.toy import toy_features, toy_frames

RNG = np.random.default_rng(0)
NOISE = RNG.integers(0, 255, (10, 10)).astype(np.uint8)
SQUARE = np.zeros((10, 10), np.uint8)
SQUARE[3:8, 3:8] = 1


@pytest.mark.parametrize(("image", "template", "score", "place"), [
    (np.zeros((10, 10), np.uint8), np.zeros((5, 10), np.uint8), 1, (0, 0)), (np.ones((10, 10), np.uint8), np.ones((10, 10), np.uint8), 1, (0, 0)),
    (NOISE, NOISE, 1, (0, 0)), (NOISE, 255 - NOISE, 1, (0, 0)), (np.ones((10, 10), np.uint8), NOISE, 0, (0, 0)), (SQUARE, SQUARE[3:10, 3:10], 1, (3, 3)),
])
def test_similarity(image, template, score, place):
    got, at = images.similarity(image, template)
    assert got == pytest.approx(score, abs=1e-6) and at == place


@pytest.mark.parametrize(("padding", "rows", "columns"), [(0, slice(3, 8), slice(2, 5)), (1, slice(2, 9), slice(1, 6)), (9, slice(0, 10), slice(0, 10))])
def test_bounding_box(padding, rows, columns):
    image = np.full((10, 10), 9, np.uint8)
    image[3:8, 2:5] = 0
    assert images.bounding_box(image, 9, padding) == (rows, columns)
    assert images.bounding_box(np.full((10, 10), 9, np.uint8), 9) == (slice(0, 10), slice(0, 10))


def test_components_and_morphology():
    mask = np.zeros((12, 12), bool)
    mask[1:3, 1:3] = mask[3, 3] = mask[8:11, 8:11] = True
    labels = images.components(mask)
    assert labels.max() == 2 and labels[1, 1] == labels[3, 3] != labels[9, 9]
    assert images.dilate(mask, 3).sum() > mask.sum() > images.erode(mask, 3).sum()
    assert (images.close(mask, 3) >= mask).all()


def test_segmentation_finds_the_central_blob():
    image = np.full((60, 60), 200, np.uint8)
    image[25:35, 20:40] = 50
    image[0:4, 0:4] = 50
    clean, background, box = images.preprocess(image)
    assert background == 200 and clean[1, 1] == 200 and clean[30, 30] == 50
    assert box[0] <= 25 and box[2] <= 20 and box[1] >= 34
    small, (x, y) = images.crop(clean, box, 32, background)
    assert small.shape == (32, 32) and (small == 50).sum() == 200
    ys, xs = np.nonzero(small == 50)
    assert (ys.min() + y, xs.min() + x) == (25, 20)
    with pytest.raises(ValueError):
        images.crop(clean, box, 31, background)


def _masked_frame():
    """A frame of zeros with a bright window that holds a dark body of 400 pixels."""
    image = np.zeros((100, 100), np.uint8)
    image[20:80, 20:80] = 200
    image[45:55, 30:70] = 50
    return image


def test_masked_pixels_are_no_foreground():
    image = _masked_frame()
    mask, background = images.segment_foreground(image)
    assert mask.sum() == 616 and mask[50, 50] and not (mask & (image == 0)).any() and background == 200
    ys, xs = np.nonzero(mask)
    assert (ys.min(), ys.max(), xs.min(), xs.max()) == (43, 56, 28, 71)
    lighter = np.where(image == 0, 0, 250 - image).astype(np.uint8)
    mask, background = images.segment_foreground(lighter, lighter=True)
    assert mask.sum() == 616 and background == 50
    assert images.segment_foreground(image, level=40)[0].sum() == 0
    assert images.segment_foreground(np.zeros((20, 30), np.uint8)) == (pytest.approx(np.zeros((20, 30))), 0)


def test_crops_of_masked_frames(spark):
    frame = _masked_frame()
    df = spark.createDataFrame([("v", 0, 100, 100, bytearray(frame.tobytes()))], "video string, frame_index int, height int, width int, pixels binary")
    row = imaging.crop_frames(df, 60).first()
    image = np.frombuffer(row["image"], np.uint8).reshape(60, 60)
    assert row["background"] == 200 and (image == 50).sum() == 400 and (image == 0).sum() == 0
    ys, xs = np.nonzero(image == 50)
    assert (ys.min() + row["offset_y"], xs.min() + row["offset_x"]) == (45, 30)


def test_a_blob_outside_the_centre_is_taken_where_no_other_is():
    image = np.full((40, 40), 200, np.uint8)
    image[0:3, 0:3] = image[36:40, 30:40] = 50
    assert images.segment_foreground(image, level=100, dilation=1)[0].sum() == 9


def test_resize():
    assert images.resize(np.full((10, 20), 7, np.uint8), 0.5).tolist() == np.full((5, 10), 7).tolist()


@pytest.fixture(scope="module")
def toy(spark):
    features = toy_features(spark, 60).cache()
    return features, imaging.crop_frames(toy_frames(features), 80).cache()


def test_labels_redrawn_from_themselves_are_alike(toy):
    features, crops = toy
    scores = commands.calibrate(features, crops, 80, 50, frames=8)
    row = commands.calibration_means(scores).first()
    assert row["n"] == 8 and row["mean_score"] > 0.8


def test_prediction_resolves_flips(toy):
    """A model that gives the true angles, turned in every third frame."""
    features, crops = toy
    few = crops.filter("frame_index < 30")
    truth = features.select("video", "frame_index", skeleton_to_theta(F.col("skeleton"), 50).alias("truth"))
    marked = features.withColumn("skeleton", F.when(F.col("frame_index") < 20, F.col("skeleton")).otherwise(F.transform("skeleton", lambda p: F.struct(F.lit(float("nan")).alias("x"), p["y"].alias("y")))))
    known = few.join(truth, ["video", "frame_index"])
    model = F.when(F.col("frame_index") % 3 == 0, F.transform(F.reverse("truth"), lambda a: a + pi)).otherwise(F.col("truth"))
    stages = commands.predict(known, marked, model, 80, 50, 30.0, threshold=0.5)
    out = stages["resolved"].collect()
    found = [r for r in out if r["k"] is not None]
    assert len(out) == 30 and len(found) >= 25
    assert all(r["k"] == (1 if r["t"] % 3 == 0 else 0) for r in found)


def test_the_model_runs_once(toy):
    """What is resolved starts from the cut candidates: neither model nor drawing is in its plan."""
    features, crops = toy
    few = crops.filter("frame_index < 12")
    model = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i * 0.0 + F.length("image") * 0.0)
    stages = commands.predict(few, features, model, 80, 50, 30.0, threshold=0.0)
    plan = stages["resolved"]._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "image" not in plan
    labels = {r["t"]: r for r in stages["original"].collect()}
    assert len(labels) == features.count() and len(labels[0]["theta"]) == 50


def test_rescored_angles(toy):
    """The true angles, filled and smoothed, are drawn again for the frame of their tick; nothing is drawn without angles or frame."""
    features, crops = toy
    some = features.filter("frame_index < 24").withColumn("timestamp", F.col("frame_index").cast("bigint") + 7)
    truth = some.select("video", F.col("frame_index").alias("t"), skeleton_to_theta(F.col("skeleton"), 50).alias("theta"))
    resolved = truth.withColumn("theta", F.when(~F.col("t").isin(9, 10), F.col("theta")))
    processed = commands.post_process(resolved)
    extra = processed.filter("t = 5").withColumn("t", F.lit(99))
    out = {r["t"]: r for r in commands.rescore(processed.unionByName(extra), some, crops, 80, 50).collect()}
    assert len(out) == 25 and out[99]["score_interp"] is None
    assert all(out[t]["score_interp"] > (0.3 if t in (9, 10) else 0.7) for t in range(24))  # 9 and 10 are filled
    assert all(out[t]["score_smooth"] > 0 and len(out[t]["skeleton_smooth"]) == 50 for t in range(24))


def test_missing_angles_score_nan(toy):
    features, crops = toy
    lost = crops.filter("frame_index < 2").select("video", F.col("frame_index").alias("t"), F.lit(0).alias("k"), F.array(*[F.lit(float("nan"))] * 50).alias("theta"))
    rows = commands.score(lost, features, crops, 80, 50).collect()
    assert len(rows) == 2 and all(np.isnan(r["score"]) and np.isnan(r["skeleton"][0]["x"]) for r in rows)


def test_evaluation_of_a_turned_model(toy):
    features, crops = toy
    model = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i * 0.0)
    out = commands.evaluate(features, crops.filter("frame_index < 5"), model, 50).collect()
    assert len(out) == 5 and all(0 <= r["distance"] <= pi and r["k"] in (0, 1) for r in out)


def test_synthetic_samples(spark, toy):
    features, crops = toy
    mixture = ([1.0], [list(np.linspace(0, 1, 50))], [(0.001 * np.eye(50)).tolist()])
    make = lambda: {r["id"]: (bytes(r["image"]), r["label0"]) for r in commands.generate(features, crops, mixture, 4, 80, 50).collect()}
    first, again = make(), make()
    assert first == again and sorted(first) == [0, 1, 2, 3] and all(len(i) == 6400 for i, _ in first.values())
    assert len({i for i, _ in first.values()}) == 4


def test_postures_do_not_depend_on_partitions(spark):
    args = ([0.3, 0.7], [[0.0] * 3, [5.0] * 3], [np.eye(3).tolist()] * 2)
    a = {r["id"]: r["theta"] for r in models.sample_postures(spark, 50, *args, seed=1).collect()}
    assert len(a) == 50 and a == {r["id"]: r["theta"] for r in models.sample_postures(spark, 50, *args, seed=1).repartition(3).collect()}


def test_mixture(spark):
    rng = np.random.default_rng(2)
    rows = [([float(x) for x in rng.normal(c, 0.1, 2)],) for c in (0, 4) for _ in range(100)]
    points = spark.createDataFrame(rows, "v array<double>").cache()
    # of several starts, as a fit can end where both means lie between the groups
    scores = models.information_criterion(points, "v", [2], seeds=range(4), max_iter=20)
    best = min(scores, key=lambda s: s[2])
    fitted = models.fit_mixture(points, "v", 2, seed=best[1]).collect()
    assert sorted(round(r["mean"][0]) for r in fitted) == [0, 4] and sum(r["weight"] for r in fitted) == pytest.approx(1)


def test_a_sweep_equals_fits_one_by_one(spark):
    """All models in the same passes: each as a plain EM from the same start gives it, likelihood by SQL from the fitted table."""
    import duckdb

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (80, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([float("nan"), 1.0],)], "v array<double>").repartition(3)
    fitted = models_sweep(df)
    assert set(fitted) == {(1, 0), (1, 5), (3, 0), (3, 5)} and all(m.steps <= 40 for m in fitted.values())
    for (k, seed), model in fitted.items():
        alone = models_sweep(df, [k], [seed])[k, seed]
        assert alone.likelihood == pytest.approx(model.likelihood) and alone.means == pytest.approx(model.means)
        con = duckdb.connect()
        con.execute("CREATE TABLE p AS SELECT * FROM (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in x.tolist()) + ") AS t(a, b)")
        values = ", ".join(f"({w!r}::DOUBLE, {m[0]!r}::DOUBLE, {m[1]!r}::DOUBLE, {v[0][0]!r}::DOUBLE, {v[0][1]!r}::DOUBLE, {v[1][1]!r}::DOUBLE)" for w, m, v in zip(model.weights.tolist(), model.means.tolist(), model.covariances.tolist()))
        likelihood = con.execute(f"""WITH c AS (SELECT *, s * u - r * r AS det FROM (VALUES {values}) AS t(w, ma, mb, s, r, u)), d AS (SELECT a, b, sum(w / (2 * pi() * sqrt(det)) *
            exp(-0.5 * (u * (a - ma) * (a - ma) - 2 * r * (a - ma) * (b - mb) + s * (b - mb) * (b - mb)) / det)) AS f FROM p, c GROUP BY a, b) SELECT sum(ln(f)) FROM d""").fetchone()[0]
        assert likelihood == pytest.approx(model.likelihood, abs=0.2)
        if k == 1:
            assert model.means[0] == pytest.approx(x.mean(axis=0)) and model.covariances[0] == pytest.approx(np.cov(x.T, bias=True), abs=1e-4)
    assert min(fitted[3, s].criterion() for s in (0, 5)) < fitted[1, 0].criterion()
    assert models_sweep(df.limit(0)) == {}


def models_sweep(df, ks=(1, 3), seeds=(0, 5)):
    return models.sweep_mixtures(df, "v", ks, seeds, max_iter=40)


def test_spread_of_criteria(spark):
    rows = spark.createDataFrame([(2, 0, 1.0), (2, 1, 3.0), (2, 2, float("nan")), (3, 0, 5.0)], "k int, seed int, aic double")
    out = {r["k"]: tuple(r)[1:] for r in models.criterion_spread(rows).collect()}
    assert out == {2: (2, 2.0, 1.0), 3: (1, 5.0, 0.0)}


def test_registry_of_models(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.2), ("c", 3, 0.4), ("d", 4, 0.9)], "name string, epoch int, val_loss double")
    out = {r["name"]: (r["is_best"], r["is_last"], r["keep"]) for r in sampling.model_registry(rows, 2).collect()}
    assert out == {"a": (False, False, False), "b": (True, False, True), "c": (True, False, True), "d": (False, True, True)}


def test_samples(spark):
    rows = spark.createDataFrame([(f"v{i % 3}", i) for i in range(90)], "video string, frame_index int")
    out = sampling.two_stage_sample(rows, 10, 1).collect()
    assert len(set(map(tuple, out))) == 10 and {r["video"] for r in out} == {"v0", "v1", "v2"}
    ties = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.5), ("d", 2.0)], "name string, val_loss double")
    assert [r["name"] for r in sampling.best_models(ties, 2).collect()] == ["c", "b"]
    assert sampling.work_split(10, 3) == [4, 3, 3]
    assert rows.filter(sampling.uniform(3, "frame_index") >= 1).count() == 0
