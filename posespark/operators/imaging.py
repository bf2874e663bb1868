"""Image operators over frames (video, frame_index, height, width, pixels BINARY)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..functions.angles import nan
from ..functions.arrow import points_of, with_nan
from .sampling import choice, uniform

#: Augmentation: shift, thickness, length, share of blurred images, odd blur kernels, tail on top.
SHIFT, THICKER, LONGER, BLURRED, KERNELS, TAIL_ON_TOP = 0.05, 0.1, 0.1, 0.25, (3, 5, 7, 9, 11, 13), 0.5

#: Preprocessing steps by name, as callables from image to (image, background, box).
PREPROCESSING: dict[str, Callable[..., tuple]] = {"default": images.preprocess}


def register_preprocessing(name: str, step: Callable[..., tuple]) -> None:
    PREPROCESSING[name] = step


def image_of(pixels: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(pixels, dtype=np.uint8).reshape(height, width)


def crop_frames(frames: DataFrame, size: int, preprocessing: str = "default", **options) -> DataFrame:
    """video, frame_index, image (size x size), offset x and y, background of each frame."""
    step = PREPROCESSING[preprocessing]
    kinds = dict(frames.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                clean, background, box = step(image_of(r.pixels, r.height, r.width), **options)
                image, (x, y) = images.crop(clean, box, size, background)
                out.append((r.video, r.frame_index, image.tobytes(), x, y, background))
            yield pd.DataFrame(out, columns=["video", "frame_index", "image", "offset_x", "offset_y", "background"])

    return frames.select("video", "frame_index", "height", "width", "pixels").mapInPandas(
        run, f"video {kinds['video']}, frame_index {kinds['frame_index']}, image binary, offset_x int, offset_y int, background int")


def resize_frames(frames: DataFrame, factor: float) -> DataFrame:
    """Frames with both sides multiplied; a pure function of its input."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            small = [images.resize(image_of(r.pixels, r.height, r.width), factor) for r in batch.itertuples(index=False)]
            batch["pixels"] = [s.tobytes() for s in small]
            batch["height"], batch["width"] = [s.shape[0] for s in small], [s.shape[1] for s in small]
            yield batch

    return frames.mapInPandas(run, frames.schema)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds score, x and y: the similarity of template in source (both with height and width)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [images.similarity(image_of(r.source, r.source_height, r.source_width), image_of(r.template, r.template_height, r.template_width)) for r in batch.itertuples(index=False)]
            batch["score"], batch["x"], batch["y"] = [f[0] for f in found], [f[1][0] for f in found], [f[1][1] for f in found]
            yield batch

    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return pairs.mapInPandas(run, f"{schema}, score double, x int, y int")


def score_candidates(candidates: DataFrame, size: int) -> DataFrame:
    """Scores posture candidates against real crops by drawing them from their template.

    candidates: video, t, k, theta, body_length, widths (along the joints), template
    (image of size x size), template_skeleton (in its pixels), image, offset_x, offset_y and background.
    Adds score and skeleton (in frame pixels); missing angles give NaN.
    """
    kinds = dict(candidates.dtypes)

    def one(r) -> tuple[float, list]:
        theta = np.asarray(r.theta, float)
        if np.isnan(theta).any():
            return float("nan"), [{"x": float("nan"), "y": float("nan")}] * len(theta)
        step = r.body_length / max(1, len(theta) - 1)
        points = np.cumsum(np.stack([np.cos(theta), np.sin(theta)], axis=1) * step, axis=0)
        points += (size - (points.max(axis=0) - points.min(axis=0))) / 2 - points.min(axis=0)
        template = image_of(r.template, size, size)
        drawn = images.render(template, points_of(r.template_skeleton), points, np.asarray(r.widths, float), (size, size), r.background)
        rows, cols = images.bounding_box(drawn, r.background)
        score, (x, y) = images.similarity(image_of(r.image, size, size), drawn[rows, cols])
        moved = points + [x - cols.start + r.offset_x, y - rows.start + r.offset_y]
        return score, [{"x": float(a), "y": float(b)} for a, b in moved]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(r) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"video": batch["video"], "t": batch["t"], "k": batch["k"], "theta": batch["theta"], "score": [f[0] for f in found], "skeleton": [f[1] for f in found]})

    scored = candidates.mapInPandas(run, f"video {kinds['video']}, t {kinds['t']}, k {kinds['k']}, theta {kinds['theta']}, score double, skeleton array<struct<x:double,y:double>>")
    return scored.withColumns({"score": F.coalesce("score", nan()), "skeleton": with_nan(F.col("skeleton"))})


def augmentation(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """Columns of random changes for synthetic images, each a hash of seed and key."""
    around = lambda k, most: (uniform(seed + k, key) * 2 - 1) * most
    kernels = F.array(*[F.lit(k) for k in KERNELS])
    return rows.withColumns({
        "shift_x": around(1, SHIFT), "shift_y": around(2, SHIFT), "thickness": 1 + around(3, THICKER), "length": 1 + around(4, LONGER),
        "blur": F.when(uniform(seed + 5, key) < BLURRED, F.get(kernels, choice(seed + 6, len(KERNELS), key).cast("int"))).otherwise(1),
        "tail_on_top": uniform(seed + 7, key) < TAIL_ON_TOP,
    })


def synthesize(samples: DataFrame, size: int) -> DataFrame:
    """Synthetic labelled images: id, image and the two labels (angles and their flip).

    samples: id, theta, body_length, widths, template, template_skeleton, background and
    the columns of augmentation().
    """
    def one(r) -> bytes:
        theta = np.asarray(r.theta, float)
        step = r.body_length * r.length / max(1, len(theta) - 1)
        points = np.cumsum(np.stack([np.cos(theta), np.sin(theta)], axis=1) * step, axis=0)
        points += (size - (points.max(axis=0) - points.min(axis=0))) / 2 - points.min(axis=0)
        points += np.array([r.shift_x, r.shift_y]) * size
        order = slice(None, None, -1) if r.tail_on_top else slice(None)
        image = images.render(image_of(r.template, size, size), points_of(r.template_skeleton)[order], points[order], np.asarray(r.widths, float)[order] * r.thickness, (size, size), r.background)
        return np.clip(np.rint(images.blur(image, r.blur)), 0, 255).astype(np.uint8).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "image": [one(r) for r in batch.itertuples(index=False)], "label0": batch["theta"], "label1": [[float(a) + np.pi for a in reversed(t)] for t in batch["theta"]]})

    return samples.mapInPandas(run, "id long, image binary, label0 array<double>, label1 array<double>")


def overlay_frames(frames: DataFrame, skeleton: str = "skeleton") -> DataFrame:
    """Frames with their skeleton drawn in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["pixels"] = [images.draw_overlay(image_of(r.pixels, r.height, r.width), points_of(getattr(r, skeleton)) if getattr(r, skeleton) is not None else np.empty((0, 2))).tobytes() for r in batch.itertuples(index=False)]
            yield batch

    return frames.mapInPandas(run, frames.schema)


def pixel_table(frames: DataFrame) -> DataFrame:
    """A row for each pixel: key, height, width, y, x, value."""
    n = F.col("height") * F.col("width")
    places = frames.select("video", "frame_index", "height", "width", "pixels", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    value = F.conv(F.hex(F.substring("pixels", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    return places.select("video", "frame_index", "height", "width", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), value.alias("value"))
