"""Joins in time: exact ticks, first positions, nearest templates, candidates against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import angle_distance, flip
from .timeseries import carried_fill


def exact_align(frames: DataFrame, features: DataFrame, values: Sequence[str], key: str = "video", ts: str = "ts", position: str = "position") -> DataFrame:
    """Each frame with the features of its timestamp; of equal ones the first, null where none."""
    first = features.groupBy(key, ts).agg(F.min_by(F.struct(*values), position).alias("_v"))
    return frames.join(first, [key, ts], "left").select(*frames.columns, *[F.col("_v")[v].alias(v) for v in values])


def first_positions(rows: DataFrame, ident: str, position: str, key: str = "video") -> DataFrame:
    """Where each id first occurs."""
    return rows.groupBy(key, ident).agg(F.min(position).alias("first_position"))


def nearest_template(frames: DataFrame, is_template: Column, key: str = "video", order: str = "frame_index", out: str = "template") -> DataFrame:
    """Adds the nearest template frame before or after; the earlier one on a tie, null without any.

    The last and the next template are carried along pieces of the series in both directions: cost is linear in
    frames, does not depend on how many templates there are, and a long video is the work of many tasks.
    """
    here = F.when(is_template, F.col(order))
    rows = carried_fill(frames, here, [key], [order], back="_back", ahead="_ahead")
    nearer = (F.col("_ahead") - F.col(order)) < (F.col(order) - F.col("_back"))
    return rows.withColumn(out, F.when(F.col("_back").isNull() | nearer, F.col("_ahead")).otherwise(F.col("_back"))).drop("_back", "_ahead")


def tick_lookup(ticks: DataFrame, frames: DataFrame, key: str = "video", tick: str = "t", ts: str = "tick", order: str = "frame_index", first: bool = False) -> DataFrame:
    """Ticks joined with the frames whose timestamp, from the series' first on, is that tick.

    All frames of a tick, or the first only. The join is by sorting: ticks made from bounds look as small as the bounds to
    the planner, which would send all of them to every task.
    """
    start = frames.groupBy(key).agg(F.min(ts).alias("_start"))
    placed = frames.join(start, key).withColumn(tick, (F.col(ts) - F.col("_start")).cast("int")).drop("_start")
    if first:
        placed = placed.groupBy(key, tick).agg(F.min(order).alias(order))
    return ticks.select(key, tick).hint("merge").join(placed, [key, tick])


def closest_flip(predicted: Column, label: Column) -> Column:
    """Struct (k, distance) of the better of a prediction (k = 0) and its flip (k = 1); 0 on a tie."""
    raw, turned = angle_distance(predicted, label), angle_distance(flip(predicted), label)
    better = turned < raw
    return F.struct(F.when(better, 1).otherwise(0).alias("k"), F.when(better, turned).otherwise(raw).alias("distance"))
