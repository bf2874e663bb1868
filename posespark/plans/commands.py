"""The commands: training samples, prediction, post-processing, calibration, evaluation.

Each takes and returns DataFrames. Frames are (video, frame_index, height, width, pixels), features as
the readers give them; crops come from imaging.crop_frames().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions.aggregates import nan_mean
from ..functions.arrow import skeleton_to_theta
from ..operators import alignment, headtail, imaging, models, sampling, timeseries
from ..operators.lineage import cut

#: Defaults: images scored for calibration and evaluation, templates that a sample is drawn from.
CALIBRATION_FRAMES, EVALUATION_FRAMES, TEMPLATES = 500, 1000, 1000
#: Bytes of template images that are sent to every task.
SENT_BYTES = 64_000_000


def labelled(features: DataFrame) -> DataFrame:
    return features.filter(A.is_labelled(F.col("skeleton")))


def body_means(features: DataFrame, joints: int) -> DataFrame:
    """video, body_length, widths along the joints: means over the labelled frames."""
    means = labelled(features).groupBy("video").agg(
        nan_mean(A.body_length(F.col("skeleton"))).alias("body_length"),
        *[nan_mean(F.col(f"{p}_width")).alias(p) for p in ("head", "midbody", "tail")],
    )
    return means.select("video", "body_length", A.width_profile(F.col("head"), F.col("midbody"), F.col("tail"), joints).alias("widths"))


def templates(features: DataFrame, crops: DataFrame) -> DataFrame:
    """video, template (frame), template_image and template_skeleton (in its pixels) of labelled frames."""
    met = labelled(features).select("video", "frame_index", "skeleton").join(crops, ["video", "frame_index"])
    local = A.to_stage(F.col("skeleton"), F.lit(1.0), F.col("offset_x").cast("double"), F.col("offset_y").cast("double"))
    return met.select("video", F.col("frame_index").alias("template"), F.col("image").alias("template_image"), local.alias("template_skeleton"))


def score(candidates: DataFrame, features: DataFrame, crops: DataFrame, size: int, joints: int) -> DataFrame:
    """candidates (video, t, k, theta; t is a frame) with score and skeleton, drawn from the nearest labelled frame.

    The nearest frame is found on narrow rows; images only meet the frames that need them.
    """
    marks = features.select("video", "frame_index", A.is_labelled(F.col("skeleton")).alias("is_label"))
    nearest = alignment.nearest_template(marks, F.col("is_label")).select("video", F.col("frame_index").alias("t"), "template")
    images = crops.select("video", F.col("frame_index").alias("t"), "image", "offset_x", "offset_y", "background")
    met = candidates.join(nearest, ["video", "t"]).join(images, ["video", "t"]).join(body_means(features, joints), "video")
    drawn = met.join(templates(features, crops), ["video", "template"])
    return imaging.score_candidates(drawn.drop("template").withColumnRenamed("template_image", "template"), size)


def expand(predictions: DataFrame) -> DataFrame:
    """video, t, k, theta: each prediction and its flip."""
    both = F.posexplode(F.array("theta", A.flip(F.col("theta")))).alias("k", "theta")
    return predictions.select("video", "t", both)


def predict(crops: DataFrame, features: DataFrame, model: Column, size: int, joints: int, frame_rate: float, threshold: float = headtail.SCORE_THRESHOLD) -> dict[str, DataFrame]:
    """Stages `original` (the labels), `unaligned` (both candidates) and `resolved` (one, or null) of every frame of videos with a label.

    model: an expression over the column image that gives theta, for instance
    models.predictor(load)(F.col("image")). The model and the scores run once: the candidates are
    cut in the shared folder, without images, and everything after them starts there.
    """
    some = labelled(features).select("video").distinct()
    thetas = crops.join(some, "video", "left_semi").select("video", F.col("frame_index").alias("t"), model.alias("theta"))
    scored = score(expand(thetas), features, crops, size, joints)
    side = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    unaligned = cut(scored.groupBy("video", "t").agg(*[side(c, k) for c in ("theta", "score", "skeleton") for k in (0, 1)]))
    labels = labelled(features).select("video", F.col("frame_index").alias("t"), F.col("skeleton").alias("label"))
    usable = headtail.score_guard(unaligned, threshold).filter("resolvable").select("video")
    frames = unaligned.join(usable, "video", "left_semi")
    chosen = headtail.resolve(frames, frames.select("video", "t", "skeleton0", "skeleton1"), labels, frame_rate, threshold)
    pick = lambda c: F.when(F.col("k") == 0, F.col(f"{c}0")).when(F.col("k") == 1, F.col(f"{c}1")).alias(c)
    resolved = chosen.join(frames, ["video", "t"]).select("video", "t", "segment", "k", "score", pick("theta"), pick("skeleton"))
    return {"original": original(features.join(some, "video", "left_semi"), joints), "unaligned": unaligned, "resolved": resolved}


def original(features: DataFrame, joints: int) -> DataFrame:
    """video, t, theta and skeleton of the labels; theta null where a frame has none."""
    theta = F.when(A.is_labelled(F.col("skeleton")), skeleton_to_theta(F.col("skeleton"), joints))
    return features.select("video", F.col("frame_index").alias("t"), theta.alias("theta"), "skeleton")


def rescore(processed: DataFrame, features: DataFrame, crops: DataFrame, size: int, joints: int, names: Sequence[str] = ("interp", "smooth")) -> DataFrame:
    """processed with score_* and skeleton_* of the named angles, drawn and scored again; null where there are no angles.

    processed: as post_process() gives it, by tick. A tick meets the frames whose timestamp it is;
    of several the last counts, and a tick without a frame has no score. Angles turned for
    the ventral side must be rescored before they are turned.
    """
    frames = features.select("video", "frame_index", F.coalesce("timestamp", F.col("frame_index").cast("bigint")).alias("tick"))
    at = alignment.tick_lookup(processed.select("video", "t"), frames).select("video", "t", "frame_index")
    each = processed.select("video", "t", F.posexplode(F.array(*names)).alias("k", "theta")).filter("theta is not null")
    drawn = each.join(at, ["video", "t"]).select("video", F.col("frame_index").alias("t"), "k", "theta")
    scored = score(drawn, features, crops, size, joints).select("video", F.col("t").alias("frame_index"), "k", "score", "skeleton")
    last = lambda c, k: F.max_by(F.when(F.col("k") == k, F.col(c)), F.when(F.col("k") == k, F.col("frame_index")))
    by_tick = scored.join(at, ["video", "frame_index"]).groupBy("video", "t").agg(*[last(c, k).alias(f"{c}_{n}") for k, n in enumerate(names) for c in ("score", "skeleton")])
    return processed.join(by_tick, ["video", "t"], "left")


def post_process(
    resolved: DataFrame, max_gap: int = timeseries.MAX_GAP, min_segment: int = timeseries.MIN_SEGMENT,
    window: int = timeseries.SMOOTH_WINDOW, order: int = timeseries.SMOOTH_ORDER, basis: Sequence[Sequence[float]] | None = None, ventral_side: Column | None = None,
) -> DataFrame:
    """video, t, raw, interp and smooth angles of each frame (and modes_* for a basis); null where unknown.

    resolved: video, t, theta (null: unresolved), a row for every tick. Series without a known
    frame are left out. Raw angles stay as they came; interp and smooth are unwrapped.
    """
    rows = resolved.select("video", F.col("t").cast("int").alias("frame_index"), "theta")
    most = rows.filter("theta is not null").groupBy("video").agg(F.max(F.size("theta")).alias("_most"))
    rows = rows.join(most, "video")
    segments = timeseries.valid_segments(rows, F.col("theta").isNotNull(), max_gap, min_segment)
    inside = timeseries.in_segments(rows.select("video", "frame_index", "_most"), segments).filter("_most > 0")
    padded = F.transform(F.sequence(F.lit(0), F.col("_most") - 1), lambda i: F.get("unwrapped", i))
    unwrapped = F.when(F.size("unwrapped") == F.col("_most"), F.col("unwrapped")).when(F.col("unwrapped").isNotNull(), padded)
    every = inside.join(timeseries.unwrapped_frames(rows), ["video", "frame_index"], "left").withColumn("unwrapped", unwrapped).drop("_most")
    keys = ["video", "segment_start"]
    filled = timeseries.spline_fill(every, "unwrapped", keys).drop("unwrapped")
    smoothed = timeseries.smooth(filled, "filled", window, order, keys, bounds=("segment_start", "segment_end"))
    whole = lambda name: F.when(~F.exists(name, lambda x: x.isNull()), F.col(name))
    out = rows.join(smoothed, ["video", "frame_index"], "left").select("video", F.col("frame_index").alias("t"), F.col("theta").alias("raw"), whole("filled").alias("interp"), whole("smoothed").alias("smooth"))
    names = ("raw", "interp", "smooth")
    if ventral_side is not None:
        out = out.withColumns({n: A.dorsal_ventral_flip(F.col(n), ventral_side) for n in names})
    if basis is not None:
        vectors = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in basis])
        out = out.withColumns({f"modes_{n}": A.project(F.col(n), vectors) for n in names})
    return out


def calibrate(features: DataFrame, crops: DataFrame, size: int, joints: int, frames: int = CALIBRATION_FRAMES, seed: int = 0) -> DataFrame:
    """video, frame_index, score of labelled frames redrawn from their own labels, some of each video."""
    chosen = sampling.sample_per_group(labelled(features), frames, ["video"], [sampling.draw(seed, "frame_index"), "frame_index"])
    thetas = chosen.select("video", F.col("frame_index").alias("t"), F.lit(0).alias("k"), skeleton_to_theta(F.col("skeleton"), joints).alias("theta"))
    return score(thetas, features, crops, size, joints).select("video", F.col("t").alias("frame_index"), "score")


def calibration_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("video").agg(nan_mean(F.col("score")).alias("mean_score"), F.count("*").alias("n"))


def evaluate(features: DataFrame, crops: DataFrame, model: Column, joints: int, frames: int = EVALUATION_FRAMES, seed: int = 0) -> DataFrame:
    """video, frame_index, k and distance (radians) of predictions for labelled frames, the better flip of each."""
    chosen = sampling.two_stage_sample(labelled(features).select("video", "frame_index", "skeleton"), frames, seed)
    truth = chosen.select("video", "frame_index", skeleton_to_theta(F.col("skeleton"), joints).alias("label"))
    met = truth.join(crops, ["video", "frame_index"]).select("video", "frame_index", "label", model.alias("theta"))
    return met.select("video", "frame_index", alignment.closest_flip(F.col("theta"), F.col("label")).alias("b")).select("video", "frame_index", "b.*")


def generate(features: DataFrame, crops: DataFrame, mixture: tuple, samples: int, size: int, joints: int, seed: int = 0, most: int = TEMPLATES) -> DataFrame:
    """id, image, label0, label1 of synthetic samples: a drawn posture, a template and random changes each.

    mixture: weights, means and covariances of posture vectors with `joints` angles. Of all
    labelled frames `most` serve as templates, spread evenly over the videos; that bounds what
    is numbered in one task (names only). Their images go to every task up to SENT_BYTES, else they are joined by shuffle.
    """
    marks = labelled(features).select("video", "frame_index")
    chosen = sampling.two_stage_sample(marks, most, seed).select("video", F.col("frame_index").alias("template"))
    chosen = cut(chosen.withColumn("place", F.row_number().over(Window.orderBy("video", "template")) - 1))
    grounds = crops.select("video", F.col("frame_index").alias("template"), "background")
    pool = templates(features, crops).join(F.broadcast(chosen), ["video", "template"]).join(grounds, ["video", "template"]).join(body_means(features, joints), "video")
    pool = pool.withColumnRenamed("template", "frame").withColumnRenamed("template_image", "template")
    n = chosen.count()
    if not n:
        raise ValueError("no labelled frame to take a template from")
    postures = imaging.augmentation(models.sample_postures(features.sparkSession, samples, *mixture, seed=seed), seed)
    drawn = postures.withColumn("place", sampling.choice(seed + 9, n, "id").cast("int"))
    pool = F.broadcast(pool) if n * (size * size + 16 * joints) <= SENT_BYTES else pool
    return imaging.synthesize(drawn.join(pool, "place").drop("place", "video", "frame"), size)
