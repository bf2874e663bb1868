"""Grouped measures: widths, lengths, scores, histograms, percentiles, boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import nan_mean
from ..functions.angles import crop_size
from .lineage import cut
from .timeseries import meet_pieces


def video_means(rows: DataFrame, columns: Sequence[str], key: str = "video") -> DataFrame:
    """Mean of each column per video, missing numbers passed over."""
    return rows.groupBy(key).agg(*[nan_mean(F.col(c)).alias(c) for c in columns])


def longest_mean(rows: DataFrame, length: str, key: str = "video") -> DataFrame:
    """One row: the greatest of the videos' mean lengths, and the crop size for it."""
    per_video = rows.groupBy(key).agg(F.avg(F.when(~F.isnan(length), F.col(length))).alias("m"))
    return per_video.agg(F.max("m").alias("max_average_length")).withColumn("crop_size", crop_size(F.col("max_average_length")))


def resize_factor(longest: float, image_size: int | None = None, factor: float | None = None) -> float:
    """An explicit factor, else image size by the longest mean length, else 1."""
    if image_size is not None and factor is not None:
        raise ValueError("give an image size or a factor, not both")
    if image_size is not None and (image_size % 2 or image_size < 32):
        raise ValueError("image size must be even and at least 32")
    return factor if factor is not None else image_size / longest if image_size is not None else 1.0


def histogram(rows: DataFrame, value: str, low: float, high: float, n_bins: int) -> DataFrame:
    """bin, n and density of n_bins equal bins; the last one holds its upper end too."""
    inside = rows.filter((F.col(value) >= low) & (F.col(value) <= high))
    width = (high - low) / n_bins
    bins = F.least(F.floor((F.col(value) - low) / width), F.lit(n_bins - 1)).cast("int")
    counts = inside.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def percentile_cut(rows: DataFrame, value: str, percent: float, key: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Per group the percentile (linear interpolation); no value of the cut is taken from a sample.

    Exact: distinct values are counted before they move and sorted over range partitions; counts of each partition tell
    which one or two hold the ranks that are wanted, and only these are numbered. No task holds a group. With an accuracy it is a value of the
    group whose rank is off by one in so many of its rows at most, in one pass. Nulls don't count; a group of nulls has no row in the exact form.
    """
    if accuracy is not None:
        return rows.groupBy(*key).agg(F.percentile_approx(value, percent / 100, accuracy).alias("cut"))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ordered = counts.repartitionByRange(*key, "_value").sortWithinPartitions(*key, "_value")
    ordered = cut(ordered.withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy(*key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(*key, "_part").agg(F.sum("_n").alias("_here"))
    parts = parts.select(*key, "_part", "_here", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), F.sum("_here").over(whole).alias("_all"))
    place = (F.col("_all") - 1) * (percent / 100)
    parts = parts.withColumns({"_low": F.floor(place), "_high": F.ceil(place), "_share": place - F.floor(place)})
    holds = lambda rank, first, n: (F.col(rank) >= first) & (F.col(rank) < first + n)
    parts = parts.filter(holds("_low", F.col("_before"), F.col("_here")) | holds("_high", F.col("_before"), F.col("_here")))
    near = meet_pieces(ordered, parts, [*key, "_part"])
    inside = Window.partitionBy(*key, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    pick = lambda rank: F.max(F.when(holds(rank, F.col("_first"), F.col("_n")), F.col("_value")))
    found = near.groupBy(*key).agg(pick("_low").alias("_a"), pick("_high").alias("_b"), F.max("_share").alias("_s"))
    return found.select(*key, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_s")).alias("cut"))


def curvature_order(means: DataFrame, vector: str = "mean", name: str = "component") -> DataFrame:
    """Components with the sum of absolute steps of their mean, in ascending order."""
    v = F.col(vector)
    steps = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.abs(b - a))
    return means.select(name, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x).alias("curvature")).orderBy("curvature", name)


def bounding_box(pixels: DataFrame, foreground: Column, padding: int = 2, key: Sequence[str] = ("video", "frame_index")) -> DataFrame:
    """Box of the foreground with padding, clipped to the image; the whole image where there is none.

    pixels: a row a pixel with y, x, height and width.
    """
    def limit(name: str, size: str) -> tuple[Column, Column]:
        low, high = F.min(F.when(foreground, F.col(name))), F.max(F.when(foreground, F.col(name)))
        n = F.max(size)
        return F.coalesce(F.greatest(low - padding, F.lit(0)), F.lit(0)), F.coalesce(F.least(high + 1 + padding, n), n)

    (y0, y1), (x0, x1) = limit("y", "height"), limit("x", "width")
    return pixels.groupBy(*key).agg(y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))


def background_and_roi(pixels: DataFrame, foreground: Column, key: Sequence[str] = ("video", "frame_index")) -> DataFrame:
    """Mean background, cut to a whole number, and the foreground's range; upper ends are left out."""
    mean = F.floor(F.avg(F.when(~foreground, F.col("value")))).cast("int")
    ends = {f"{name}{i}": f(F.when(foreground, F.col(name))) for name in ("y", "x") for i, f in ((0, F.min), (1, F.max))}
    return pixels.groupBy(*key).agg(mean.alias("background"), *[c.alias(k) for k, c in ends.items()])
