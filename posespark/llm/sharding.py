"""Sharding by a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_order, part_of, place_of, shuffle_partitions

#: Metadata dimensions of `documents`, and bits of the grid for each.
DIMENSIONS = ("source", "lang", "n_chars")
BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n rows, d dimensions).

    The coordinates go through the usual exclusive-or form of the transform from
    axes to a transposed index (bit planes from high to low), whose bits are then
    interleaved. Works on whole columns.
    """
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for k in range(len(x)):
            on = (x[k] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            if k:
                x[k] ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    gray = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        gray ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for column in x:
            index = (index << 1) | (((column ^ gray) >> level) & 1)
    return index


def cut_points(docs: DataFrame, names: Sequence[str], bits: int) -> list[list[float | str]]:
    """2**bits - 1 values of each dimension that cut its rows into equal shares, exact, in order.

    Distinct values are counted before they move, sorted over range partitions and
    accumulated with offsets from one row a partition; only the cut points reach the driver. A
    value that many rows have takes several of them, so its cell lies where its share of the rows does: the
    cells of four languages spread over the whole grid. Nulls do not count.
    """
    kinds, cells = dict(docs.dtypes), 1 << bits
    entry = lambda i, n: F.struct(
        F.lit(i).alias("dim"),
        (F.lit(None) if kinds[n] == "string" else F.col(n)).cast("double").alias("num"),
        (F.col(n) if kinds[n] == "string" else F.lit(None)).cast("string").alias("txt"),
    )
    values = docs.select(F.explode(F.array(*[entry(i, n) for i, n in enumerate(names)])).alias("e")).select("e.*")
    values = values.filter("num is not null or txt is not null").groupBy("dim", "num", "txt").agg(F.count("*").alias("n"))
    rows = in_order(values, F.col("dim"), F.col("num"), F.col("txt")).withColumn("_part", part_of(F.col("_row")))
    of_dim = Window.partitionBy("dim")
    earlier = of_dim.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", "dim").agg(F.sum("n").alias("_n"))
    parts = parts.select("_part", "dim", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(of_dim).alias("_all"))
    inside = Window.partitionBy("_part", "dim").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts), ["_part", "dim"])
    at = at.withColumn("_start", F.col("_before") + F.col("_inside"))
    low, high = F.expr(f"(_start * {cells}) div _all + 1"), F.least(F.expr(f"((_start + n) * {cells}) div _all"), F.lit(cells - 1))
    at = at.select("dim", "num", "txt", low.alias("low"), high.alias("high")).filter("low <= high")
    found = at.select("dim", "num", "txt", F.explode(F.sequence("low", "high")).alias("k")).collect()  # 2**bits - 1 rows a dimension
    points = {(r["dim"], r["k"]): r["num"] if r["txt"] is None else r["txt"] for r in found}
    return [[points[i, k] for k in range(1, cells) if (i, k) in points] for i in range(len(names))]


def quantise(docs: DataFrame, names: Sequence[str], bits: int) -> list[Column]:
    """A cell number from 0 to 2**bits - 1 for each dimension, by quantiles; null takes the last cell."""
    kinds = dict(docs.dtypes)
    cells = []
    for n, points in zip(names, cut_points(docs, names, bits), strict=True):
        value = F.col(n) if kinds[n] == "string" else F.col(n).cast("double")
        distinct = sorted(set(points))
        below = F.lit(0)
        for p in distinct:
            below = below + F.when(value >= F.lit(p), points.count(p)).otherwise(0)
        cells.append(F.when(value.isNull(), (1 << bits) - 1).otherwise(below))
    return cells


def curve(cells: Sequence[Column], bits: int) -> Column:
    """Hilbert index of the cells, on whole Arrow batches."""

    @F.pandas_udf(T.LongType())
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return index(*cells)


def shard_documents(
    docs: DataFrame,
    n_shards: int = 40,
    law: str = "rows",
    dimensions: Sequence[str] = DIMENSIONS,
    bits: int = BITS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Puts documents into shards that are runs of one Hilbert curve.

    The dimensions are quantised, rows sort by (curve index, doc_id, text_crc32,
    size), and the sorted rows are cut into n_shards runs: for law `rows` counts
    differ by one at most, for law `bytes` each row goes where the middle of its
    bytes falls, so sizes differ by one document at most. Files written by shard
    then hold narrow ranges of every dimension, which min/max statistics prune.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (always null:
    neither law moves rows only into a new shard), curve_index and the carried
    columns. Order is settled by two passes over narrow rows: range partitions
    that are cut, then offsets from one count a partition; no task sees all rows.

    Null text: no bytes (size 16, checksum 0). Null doc_id sorts first; null
    dimensions take the last cell. Equal rows are ties: both stay, in either
    order. An empty table gives no rows. Extra columns are ignored unless carried.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}: rows or bytes")
    cells = quantise(docs, dimensions, bits)
    plain = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *[c.cast("int").alias(f"_cell{i}") for i, c in enumerate(cells)],
        *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)],
    )
    keyed = plain.withColumn("curve_index", curve([F.col(f"_cell{i}") for i in range(len(cells))], bits))
    rows = in_order(keyed, F.col("curve_index"), F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    rows = rows.withColumn("_part", part_of(F.col("_row")))

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        rows.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.sum("_n").over(everything).alias("_all_rows"),
            F.sum("_bytes").over(everything).alias("_all_bytes"),
        )
    )  # a row for each range partition: as many as spark.sql.shuffle.partitions
    at = rows.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_rows_before") + place_of(F.col("_row")))
    if law == "rows":
        at = at.withColumn("shard", F.expr(f"(_rank * {n_shards}) div _all_rows").cast("int"))
        first = F.expr(f"(shard * _all_rows + {n_shards} - 1) div {n_shards}")
        at = at.withColumn("slot", F.col("_rank") - first)
    else:
        inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("_bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
        at = at.withColumn("_start", start)
        at = at.withColumn("shard", F.expr(f"least({n_shards - 1}, ((2 * _start + size) * {n_shards}) div (2 * _all_bytes))").cast("int"))
        at = cut(at)
        firsts = at.groupBy("shard").agg(F.min("_rank").alias("_first"))
        at = at.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_rank") - F.col("_first"))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve_index",
        *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)],
    )


def write_files(docs: DataFrame, path: str, n_files: int | None = None, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> None:
    """Writes whole documents as Parquet files that are runs of the curve.

    Null dimensions take the last cell; null, empty and repeated rows are written like any other, other
    columns stay as they are. An empty table writes no rows.
    """
    n = n_files or shuffle_partitions(docs.sparkSession)
    cells = quantise(docs, dimensions, bits)
    keyed = docs.withColumn("_curve", curve([c.cast("int") for c in cells], bits))
    keyed.repartitionByRange(n, "_curve", "doc_id").sortWithinPartitions("_curve", "doc_id").drop("_curve").write.parquet(path)
