"""A generated video with a known answer: a half ellipse that turns one degree a frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import points_of
from ..functions.images import body_mask

FRAME_RATE, WIDTH, SIDE = 30.0, 5.0, 100


def toy_features(spark: SparkSession, num_frames: int = 500, num_joints: int = 50, video: str = "toy") -> DataFrame:
    """video, frame_index, timestamp, skeleton (whole-number points), three widths, frame_rate, ventral_side."""
    return toy_features_of(spark.range(num_frames).select(F.lit(video).alias("video"), "id"), num_joints)


def toy_features_of(frames: DataFrame, num_joints: int = 50) -> DataFrame:
    """The same for the frames (video, id) of a table."""
    step = 180.0 / (num_joints - 1)
    angle = lambda j: F.radians(F.col("id") + j * F.lit(step))
    whole = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")
    point = lambda j: F.struct(whole(50 + 25 * F.cos(angle(j))).alias("x"), whole(50 - 33 * F.sin(angle(j))).alias("y"))
    return frames.select(
        "video", F.col("id").cast("int").alias("frame_index"), F.col("id").cast("long").alias("timestamp"),
        F.transform(F.sequence(F.lit(0), F.lit(num_joints - 1)), point).alias("skeleton"),
        *[F.lit(WIDTH).alias(f"{part}_width") for part in ("head", "midbody", "tail")],
        F.lit(FRAME_RATE).alias("frame_rate"), F.lit("unknown").alias("ventral_side"),
    )


def toy_frames(features: DataFrame) -> DataFrame:
    """The frames of such a video: the body drawn dark on a light ground."""
    @F.pandas_udf("binary")
    def draw(skeletons: pd.Series) -> pd.Series:
        out = []
        for s in skeletons:
            points = points_of(s)
            image = np.full((SIDE, SIDE), 200, dtype=np.uint8)
            shade = (40 + 60 * np.linspace(0, 1, len(points))).astype(np.uint8)
            for k in range(len(points) - 1, 0, -1):
                image[body_mask(image.shape, points[k - 1 : k + 1], np.array([WIDTH, WIDTH]))] = shade[k]
            out.append(image.tobytes())
        return pd.Series(out)

    return features.select("video", "frame_index", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), draw("skeleton").alias("pixels"))
