"""Sampling and top-n; every random choice is a hash of a seed and the row's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *key: Column | str) -> Column:
    """A number that looks random but depends on seed and key only."""
    return F.xxhash64(F.lit(seed), *key)


def uniform(seed: int, *key: Column | str) -> Column:
    """The same as a number in [0, 1)."""
    return F.shiftrightunsigned(draw(seed, *key), 11) / F.lit(float(1 << 53))


def choice(seed: int, n: Column | int, *key: Column | str) -> Column:
    """A whole number from 0 to n - 1, with replacement."""
    return F.pmod(draw(seed, *key), F.lit(n) if isinstance(n, int) else n)


def first_n(rows: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The n first rows in order (each task keeps n)."""
    return rows.orderBy(*order).limit(n)


def best_models(losses: DataFrame, n: int = 5) -> DataFrame:
    """The n least losses; of equal ones the names later in the alphabet."""
    return losses.orderBy(F.col("val_loss"), F.col("name").desc()).limit(n)


def model_registry(losses: DataFrame, n: int = 5) -> DataFrame:
    """name, epoch, val_loss, is_best, is_last and keep of each saved model.

    The n best and the latest epoch are kept, the latest being where training goes on; of equal
    losses or epochs the names later in the alphabet. losses: name, epoch, val_loss.
    """
    last = losses.agg(F.max(F.struct("epoch", "name")).alias("last")).select(F.col("last.name").alias("_last"))
    best = best_models(losses, n).select(F.col("name").alias("_best"))
    marked = losses.join(F.broadcast(best), F.col("name") == F.col("_best"), "left").join(F.broadcast(last))  # n rows and one row
    marked = marked.select("name", "epoch", "val_loss", F.col("_best").isNotNull().alias("is_best"), (F.col("name") == F.col("_last")).alias("is_last"))
    return marked.withColumn("keep", F.col("is_best") | F.col("is_last"))


def sample_per_group(rows: DataFrame, n: int, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The n first rows of each group in an order, all where there are fewer."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def template_quota(counts: DataFrame, samples: int, workers: int, most: int = 1000) -> DataFrame:
    """Templates each video gives a worker: counts (video, n) with quota added."""
    per_worker = min(most, max(1, samples // max(1, workers)))
    n_videos = counts.count()
    share = max(per_worker // max(1, n_videos), 1)
    return counts.withColumn("quota", F.least(F.lit(share), F.col("n")).cast("int"))


def two_stage_sample(rows: DataFrame, n: int, seed: int, key: str = "video", order: str = "frame_index") -> DataFrame:
    """n rows spread evenly over videos, then at random within, without repetition."""
    inside = Window.partitionBy(key).orderBy(draw(seed, key, order), order)
    ranked = rows.withColumn("_round", F.row_number().over(inside))
    return ranked.orderBy("_round", draw(seed + 1, key, "_round"), key).limit(n).drop("_round").orderBy(key, order)


def stratified_bins(rows: DataFrame, value: str, low: float = -30.0, high: float = 30.0, n_bins: int = 100, width: float = 0.6) -> DataFrame:
    """rows with the bins (both ends closed) whose start is on an even grid with both ends.

    The grid step differs from the width, so a value can lie in no bin. Bins follow
    from arithmetic, not from a join.
    """
    step = (high - low) / (n_bins - 1)
    guess = F.floor((F.col(value) - low) / step).cast("int")
    start = lambda b: F.lit(low) + b * F.lit(step)
    bins = F.filter(F.array(guess - 1, guess, guess + 1), lambda b: (b >= 0) & (b < n_bins) & (F.col(value) >= start(b)) & (F.col(value) <= start(b) + width))
    return rows.withColumn("bin", F.explode(bins))


def every_other(rows: DataFrame, order: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Rows 1, 3, 5, ... of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n % 2 = 1").drop("_n")


def representatives(rows: DataFrame, n: int, value: str, tie: str, key: Sequence[str]) -> DataFrame:
    """First, last and evenly spaced rows by value in each group, about n."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(value, tie)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / max(1, n - 1)))
    return ranked.filter((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def chunk(index: Column, size: int) -> Column:
    """Number of the fixed-size chunk that a row index falls in."""
    return F.floor(index / size).cast("int")


def work_split(total: int, workers: int) -> list[int]:
    """Equal shares; what is left goes to the first worker."""
    share = total // workers
    return [share + total - share * workers, *[share] * (workers - 1)]
