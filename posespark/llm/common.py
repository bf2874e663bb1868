"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, shared_dir

__all__ = ["LOWER", "ROW_BITS", "WORD", "Scratch", "cut", "finished", "in_order", "part_of", "place_of", "read", "remove", "shared_dir", "shuffle_partitions", "utf8", "written"]

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Byte table that lower-cases A-Z and leaves all other bytes, so UTF-8 stays whole.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: monotonically_increasing_id() puts the partition above this many bits.
ROW_BITS = 33


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for rows too wide to checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table in the shared store was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


class Scratch:
    """Tables in the shared folder that are deleted when the block ends.

    What leaves the block must be cut: it may not read these tables any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.paths.append(f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.parquet(self.paths[-1])

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            remove(self.spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, *keys: Column) -> DataFrame:
    """df sorted by keys over range partitions of about equal row counts, cut.

    Adds `_row`, which ascends in that order; its bits from ROW_BITS up are the
    partition, the bits below count the partition's rows from 0. Rows of one hot
    key spread over partitions as long as the later keys tell them apart.
    """
    parts = shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return cut(placed.withColumn("_row", F.monotonically_increasing_id()))


def part_of(row: Column) -> Column:
    return F.shiftright(row, ROW_BITS)


def place_of(row: Column) -> Column:
    return row.bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()
