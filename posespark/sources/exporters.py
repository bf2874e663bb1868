"""Exporters: trajectories as JSON, results, scores and evaluation tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import is_labelled

_EXPORTERS: dict[str, Callable[..., None]] = {}


def register_exporter(name: str, export: Callable[..., None]) -> None:
    """export(results, path, **options); loaders without one export nothing."""
    _EXPORTERS[name] = export


def export(name: str, results: DataFrame, path: str, **options) -> None:
    _EXPORTERS.get(name, lambda *_, **__: None)(results, path, **options)


def trajectory_json(rows: DataFrame, frame_rate: float, ident: str = "1", chunk: int = 10_000) -> DataFrame:
    """video, part and json: points over time with units, `chunk` frames a part.

    A skeleton with a missing number becomes nulls. Parts bound what one task gathers.
    """
    def coordinates(axis: str) -> Column:
        return F.transform("skeleton", lambda p: F.when(is_labelled(F.col("skeleton")), F.round(p[axis], 4)))

    frames = rows.select("video", F.floor(F.col("t") / chunk).cast("int").alias("part"), F.struct((F.col("t") / frame_rate).alias("t"), coordinates("x").alias("x"), coordinates("y").alias("y")).alias("f"))
    gathered = frames.groupBy("video", "part").agg(F.sort_array(F.collect_list("f")).alias("f"))
    units = F.struct(F.lit("seconds").alias("t"), F.lit("micrometers").alias("x"), F.lit("micrometers").alias("y"))
    data = F.struct(F.lit(ident).alias("id"), *[F.col("f")[k].alias(k) for k in ("t", "x", "y")])
    return gathered.select("video", "part", F.to_json(F.struct(units.alias("units"), F.array(data).alias("data")), {"ignoreNullFields": "false"}).alias("json"))


def write_results(results: Mapping[str, DataFrame], path: str) -> None:
    """Each stage of results under its own partition of one table, by video; a rerun replaces a stage whole, videos that it no longer has included."""
    for stage, rows in results.items():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("video").parquet(f"{path}/stage={stage}")


def read_results(spark, path: str, stages: tuple[str, ...] = ("resolved", "original")) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("stage").isin(*stages))


def write_provenance(frames: DataFrame, path: str) -> None:
    """(video, frame_index) of evaluation frames, separated by spaces."""
    frames.select("video", "frame_index").write.mode("overwrite").csv(path, sep=" ")


def write_scores(scores: DataFrame, path: str) -> None:
    """Calibration scores, one partition a video; written anew."""
    scores.write.mode("overwrite").partitionBy("video").parquet(path)


def frame_file_name(t: Column, frame: Column, score: Column, digits: int = 6) -> Column:
    """Name of an annotated image: time, frame and score, padded with zeros."""
    return F.concat(F.lit("t"), F.lpad(t.cast("string"), digits, "0"), F.lit("_f"), F.lpad(frame.cast("string"), digits, "0"), F.lit("_s"), F.when(score.isNull() | F.isnan(score), "nan").otherwise(F.format_string("%.4f", score)), F.lit(".pgm"))


def write_archives(files: DataFrame, path: str, part: int = 1_000) -> None:
    """A zip archive for each video and `part` files of it, as rows (video, part, archive) of a Parquet table.

    files: video, name and content (binary). Names are numbered on narrow rows; a task holds one archive.
    """
    place = F.row_number().over(Window.partitionBy("video").orderBy("name")) - 1
    parts = files.select("video", "name").distinct().withColumn("part", F.floor(place / part).cast("int"))
    numbered = files.dropDuplicates(["video", "name"]).join(parts, ["video", "name"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in sorted(zip(rows["name"], rows["content"], strict=True)):
                archive.writestr(zipfile.ZipInfo(name), bytes(content))
        return pd.DataFrame({"video": [rows["video"].iloc[0]], "part": [rows["part"].iloc[0]], "archive": [held.getvalue()]})

    kind = dict(files.dtypes)["video"]
    numbered.groupBy("video", "part").applyInPandas(pack, f"video {kind}, part int, archive binary").write.mode("overwrite").parquet(path)


def write_settings(spark: SparkSession, settings: Mapping[str, object], path: str) -> None:
    """Settings of an experiment as one JSON text file."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True, indent=None),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(spark.read.text(path).first()[0])
