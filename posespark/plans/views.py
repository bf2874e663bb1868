"""The engine's inputs derived from general tables, as DataFrames and as SQL."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import flip

FRAME_RATE = 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame_index, valid, angle, tick (hours since the video's first frame), event_type."""
    w = Window.partitionBy("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros.alias("us"))
    return events.select(
        F.col("user_id").alias("video"),
        (F.row_number().over(w.orderBy("event_id")) - 1).alias("frame_index"),
        (F.col("event_type") != "error").alias("valid"),
        F.col("value").alias("angle"),
        F.expr("cast((us - min(us) over (partition by user_id)) div 3600000000 as int)").alias("tick"),
        "event_type",
    )


SERIES = """series AS (SELECT user_id AS video, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS frame_index,
  event_type <> 'error' AS valid, value AS angle,
  CAST((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 3600000000 AS INTEGER) AS tick, event_type FROM events)"""


def poses(spark: SparkSession, sf_dir: str, factor: float = 4.0) -> DataFrame:
    """video, t, vec_id, theta (raw), theta0, theta1 (candidates), score."""
    theta = F.transform("embedding", lambda x: x.cast("double") * factor)
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("video"),
        (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("t"),
        "vec_id", theta.alias("theta"),
        (0.5 + 0.5 * F.abs(F.cos("vec_id"))).alias("score"),
    )
    swapped = F.col("vec_id") % 3 == 0
    return rows.withColumns({
        "theta0": F.when(swapped, flip(F.col("theta"))).otherwise(F.col("theta")),
        "theta1": F.when(swapped, F.col("theta")).otherwise(flip(F.col("theta"))),
    })


def poses_sql(factor: float = 4.0) -> str:
    turned = f"list_transform(list_reverse(theta), lambda a: a + {pi!r})"
    return f"""raw_poses AS (SELECT label AS video, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS t, vec_id,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE) * {factor!r}::DOUBLE) AS theta, 0.5 + 0.5 * abs(cos(vec_id)) AS score FROM embeddings),
poses AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN {turned} ELSE theta END AS theta0,
  CASE WHEN vec_id % 3 = 0 THEN theta ELSE {turned} END AS theta1 FROM raw_poses)"""


def widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, head_width, midbody_width, tail_width; NaN for returned lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag")
    value = lambda k: F.when(F.col("l_returnflag") == "R", F.lit(float("nan"))).otherwise(F.col("l_quantity") * k)
    return lines.select(F.col("l_suppkey").alias("video"), value(1.0).alias("head_width"), value(1.2).alias("midbody_width"), value(0.8).alias("tail_width"))


WIDTHS = """widths AS (SELECT l_suppkey AS video, CASE WHEN l_returnflag = 'R' THEN 'NaN'::DOUBLE ELSE l_quantity * 1.0::DOUBLE END AS head_width,
  CASE WHEN l_returnflag = 'R' THEN 'NaN'::DOUBLE ELSE l_quantity * 1.2::DOUBLE END AS midbody_width,
  CASE WHEN l_returnflag = 'R' THEN 'NaN'::DOUBLE ELSE l_quantity * 0.8::DOUBLE END AS tail_width FROM lineitem)"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").alias("val_loss"))


def cosine_basis(dims: int, modes: int) -> list[list[float]]:
    """Orthonormal cosine vectors without the constant one."""
    from math import cos, sqrt

    return [[sqrt(2 / dims) * cos(pi * (i + 0.5) * m / dims) for i in range(dims)] for m in range(1, modes + 1)]
