"""Readers of features, frames, models and bases, and a registry of loaders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "array<struct<x:double,y:double>>"
FEATURES = f"video string, frame_index int, timestamp bigint, skeleton {POINTS}, head_width double, midbody_width double, tail_width double, frame_rate double, ventral_side string"
FRAMES = "video string, frame_index int, height int, width int, pixels binary"
MIN_JOINTS = 20
#: Files that Spark's image source decodes.
IMAGE_FILES = "*.{png,jpg,jpeg,bmp,gif,PNG,JPG,JPEG,BMP,GIF}"

_LOADERS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {}


def register_loader(name: str, load: Callable[..., tuple[DataFrame, DataFrame]]) -> None:
    """load(spark, path, **options) returns (frames, features)."""
    _LOADERS[name] = load


def load_dataset(spark: SparkSession, loader: str, path: str, videos: Sequence[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Frames and validated features of a dataset, of the chosen videos."""
    if loader not in _LOADERS:
        raise NotImplementedError(f"no loader named {loader!r}; known: {sorted(_LOADERS)}")
    frames, features = _LOADERS[loader](spark, path, **options)
    if videos is not None:
        frames, features = select_videos(frames, videos), select_videos(features, videos)
    return frames, validated(features)


def select_videos(rows: DataFrame, videos: Sequence[str], key: str = "video") -> DataFrame:
    """Rows of the named videos, which must be different and present."""
    names = list(videos)
    if not names or len(set(names)) != len(names):
        raise ValueError("name at least one video, each once")
    there = {r[0] for r in rows.filter(F.col(key).isin(names)).select(key).distinct().collect()}  # as many as were named
    if missing := sorted(set(names) - there):
        raise ValueError(f"no such video: {', '.join(missing)}")
    return rows.filter(F.col(key).isin(names))


def validated(features: DataFrame, min_joints: int = MIN_JOINTS) -> DataFrame:
    """features, where too few joints raise an error as the row is read; timestamps default to frame numbers."""
    enough = F.when(F.size("skeleton") < min_joints, F.raise_error(F.lit(f"skeletons need {min_joints} joints or more"))).otherwise(F.col("skeleton"))
    return features.withColumns({
        "skeleton": enough.cast(POINTS), "timestamp": F.coalesce(F.col("timestamp"), F.col("frame_index").cast("bigint")),
        "ventral_side": F.coalesce("ventral_side", F.lit("unknown")), "frame_rate": F.coalesce("frame_rate", F.lit(1.0)),
    })


def frame_rate_of(*stored: Column) -> Column:
    """The first stored rate that is a number, else 1."""
    return F.coalesce(*[s.try_cast("double") for s in stored], F.lit(1.0))


def ventral_side_of(info: Column) -> Column:
    return F.coalesce(F.get_json_object(info, "$.ventral_side"), F.lit("unknown"))


def microns_per_pixel(xml: Column) -> Column:
    """|microns| / |pixels| of stage settings in XML, else 1."""
    microns, pixels = (F.abs(F.xpath_double(xml, F.lit(f"//{n}"))) for n in ("microns", "pixels"))
    usable = (pixels > 0) & ~F.isnan(microns) & ~F.isnan(pixels)
    return F.coalesce(F.when(usable, microns / F.when(usable, pixels).otherwise(1.0)), F.lit(1.0))


def checked_timestamps(rows: DataFrame, ts: str, key: str = "video") -> DataFrame:
    """rows; an error for a video all of whose timestamps are missing."""
    some = F.max(~F.isnan(ts)).over(Window.partitionBy(key))
    return rows.withColumn(ts, F.when(some, F.col(ts)).otherwise(F.raise_error(F.lit("all timestamps are missing")).cast("double")))


def single_entity(rows: DataFrame, entity: str, key: str) -> DataFrame:
    """Rows of each key's least entity."""
    return rows.withColumn("_least", F.min(entity).over(Window.partitionBy(key))).filter(F.col(entity) == F.col("_least")).drop("_least")


def column_like(rows: DataFrame, *parts: str) -> str:
    """The first column whose name holds all parts."""
    for name in rows.columns:
        if all(p in name for p in parts):
            return name
    raise ValueError(f"no column like {parts}")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def read_image_folder(spark: SparkSession, path: str, pattern: str | None = None, decode: Callable[[bytes], tuple[int, int, bytes]] | None = None) -> DataFrame:
    """Frames of a folder of images in name order, in grey; the folder's name is the video.

    Binary PGM is decoded here, PNG, JPEG, BMP and GIF by Spark's image source, other
    formats by a decoder from bytes to (height, width, pixels). Without a pattern
    all files with these endings are frames. An unreadable image is an error.
    """
    own = decode or decode_pgm
    plain = [pattern or "*.pgm"] if decode or pattern is None or pattern.lower().endswith(".pgm") else []
    spark_made = [] if decode else [pattern or IMAGE_FILES] if pattern is None or not plain else []

    @F.pandas_udf("height int, width int, pixels binary")
    def pixels(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([own(bytes(c)) for c in content], columns=["height", "width", "pixels"])

    @F.pandas_udf("binary")
    def grey(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([grey_of(d, n) for d, n in zip(data, channels, strict=True)])

    def files(source: str, glob: str) -> DataFrame:
        return spark.read.format(source).option("pathGlobFilter", glob).load(path)

    name = F.regexp_replace("path", "^file:/+", "file:/")
    listed = reduce(DataFrame.unionByName, [files("binaryFile", g).select(name.alias("path")) for g in [*plain, *spark_made]])  # reads no content
    if listed.isEmpty():
        raise FileNotFoundError(f"no {pattern or 'images'} in {path}")
    read = [files("binaryFile", g).select(name.alias("path"), pixels("content").alias("p")) for g in plain]
    for g in spark_made:
        images = files("image", g).select(F.col("image.origin").alias("path"), "image.*").withColumn("path", name)
        height = F.when(F.col("height") > 0, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), "path")))
        read.append(images.select("path", F.struct(height.cast("int").alias("height"), "width", grey("data", "nChannels").alias("pixels")).alias("p")))
    order = (F.row_number().over(Window.partitionBy("video").orderBy("path")) - 1).alias("frame_index")
    numbered = listed.select("path", F.element_at(F.split("path", "/"), -2).alias("video")).select("path", "video", order)  # without the images
    return reduce(DataFrame.unionByName, read).join(numbered, "path").select("video", "frame_index", "p.*")


def grey_of(data: bytes, channels: int) -> bytes:
    """One byte a pixel of rows of grey, blue-green-red or blue-green-red-alpha bytes, by the usual weights."""
    if channels == 1:
        return bytes(data)
    if channels not in (3, 4):
        return b""
    parts = np.frombuffer(data, dtype=np.uint8).reshape(-1, channels)[:, :3]
    return np.rint(parts @ np.array([0.114, 0.587, 0.299])).astype(np.uint8).tobytes()


def decode_pgm(data: bytes) -> tuple[int, int, bytes]:
    """Height, width and pixels of an eight-bit binary PGM file."""
    import re

    head = re.match(rb"P5\s+(?:#[^\n]*\s+)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not head or int(head[3]) > 255:
        raise ValueError("not an eight-bit binary PGM image")
    width, height = int(head[1]), int(head[2])
    return height, width, data[head.end() : head.end() + width * height]


def read_basis(spark: SparkSession, path: str | None) -> list[list[float]] | None:
    """Mode vectors (columns) of a square matrix in a CSV file; None for None, OSError where unreadable."""
    if path is None:
        return None
    try:
        rows = spark.read.text(path).select(F.split("value", ",").cast("array<double>").alias("v")).filter("size(v) > 1").collect()  # a basis is small
    except Exception as e:
        raise OSError(f"cannot read {path}") from e
    return [list(column) for column in zip(*[r["v"] for r in rows], strict=True)]


def read_mixture(spark: SparkSession, path: str) -> DataFrame:
    """component, weight, mean and covariance of a mixture stored as (gzipped) JSON of parallel arrays."""
    schema = "means array<array<double>>, covariances array<array<array<double>>>, weights array<double>"
    zipped = F.arrays_zip(F.col("weights").alias("weight"), F.col("means").alias("mean"), F.col("covariances").alias("covariance"))
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode(zipped).alias("component", "m"))
    return rows.select("component", "m.*")


def features_schema() -> T.StructType:
    return T._parse_datatype_string(FEATURES)
