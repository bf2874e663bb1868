"""Labelled images as record files: length-prefixed records with masked CRC-32C sums, each a message of named features.

A file is gzip-compressed. A message has `data` (the pixels), `label0` and `label1` (angles as 32-bit floats).
"""

from __future__ import annotations

import gzip
import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "data binary, label0 array<float>, label1 array<float>"
#: The reflected polynomial of CRC-32C, and the sum's mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


def _table() -> list[int]:
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (POLYNOMIAL if k & 1 else 0)
        out.append(k)
    return out


_TABLE = _table()


def crc32c(data: bytes) -> int:
    crc, table = 0xFFFFFFFF, _TABLE
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def masked(data: bytes) -> bytes:
    crc = crc32c(data)
    return struct.pack("<I", ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF)


def framed(record: bytes) -> bytes:
    length = struct.pack("<Q", len(record))
    return length + masked(length) + record + masked(record)


def unframed(stream: bytes, verify: bool = True) -> Iterator[bytes]:
    """The records of a file; a sum that does not fit, or a file that ends too early, is an error."""
    at = 0
    while at < len(stream):
        length = stream[at : at + 8]
        if len(length) < 8 or at + 16 + struct.unpack("<Q", length)[0] > len(stream):
            raise ValueError("the file ends within a record")
        n = struct.unpack("<Q", length)[0]
        record = stream[at + 12 : at + 12 + n]
        if verify and (stream[at + 8 : at + 12] != masked(length) or stream[at + 12 + n : at + 16 + n] != masked(record)):
            raise ValueError("a record's sum does not fit")
        yield record
        at += 16 + n


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def encode(data: bytes, labels: Sequence[Sequence[float]]) -> bytes:
    """A message with the pixels (a list of one byte string) and the labels (lists of packed floats)."""
    features = [("data", _field(1, _field(1, data)))]
    features += [(f"label{k}", _field(2, _field(1, np.asarray(v, "<f4").tobytes()))) for k, v in enumerate(labels)]
    return _field(1, b"".join(_field(1, _field(1, name.encode()) + _field(2, value)) for name, value in features))


def _fields(body: bytes) -> Iterator[tuple[int, bytes]]:
    """Field numbers and bodies of a message: length-delimited fields, and floats that are not packed as bodies of four bytes."""
    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (body[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if body[at - 1] < 128:
                return n, at

    at = 0
    while at < len(body):
        tag, at = varint(at)
        if tag & 7 == 2:
            size, at = varint(at)
        elif tag & 7 == 5:
            size = 4
        else:
            raise ValueError(f"unexpected wire type {tag & 7}")
        yield tag >> 3, body[at : at + size]
        at += size


def decode(record: bytes) -> dict[str, object]:
    """Features by name: the first byte string of a list of bytes, floats of a list of floats."""
    out: dict[str, object] = {}
    for _, features in _fields(record):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            for kind, values in _fields(parts[2]):
                bodies = [b for _, b in _fields(values)]
                out[parts[1].decode()] = (bodies or [b""])[0] if kind == 1 else np.frombuffer(b"".join(bodies), "<f4")
    return out


def read_records(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """data, label0 and label1 of all records of the files *.tfrecord below path, in any store that Spark reads; a task decodes a file at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = [decode(r) for r in unframed(gzip.decompress(content), verify)]
                yield pd.DataFrame({n: [f.get(n) for f in found] for n in ("data", "label0", "label1")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tfrecord").load(path)
    return files.select("content").mapInPandas(run, SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    """The file of one task, still under its own name, and its records."""

    made: str
    n: int


class RecordWriter(DataSourceWriter):
    """A file for each task, written under a name of its own and renamed when all tasks are done; a task that is tried again leaves nothing behind that counts."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        made, n = f"{self.path}/_{uuid.uuid4().hex}.part", 0
        with open(made, "wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as file:
            for n, row in enumerate(rows, 1):  # noqa: B007
                file.write(framed(encode(bytes(row["data"]), [row["label0"], row["label1"]])))
        return Written(made, n)

    def commit(self, messages: list[Written | None]) -> None:
        old = [f for f in os.listdir(self.path) if f.endswith(".tfrecord")] if self.overwrite else []
        done = [m for m in messages if m is not None]
        for k, m in enumerate(done):
            if m.n:
                os.replace(m.made, f"{self.path}/{uuid.uuid4().hex[:12]}-{k:05d}.tfrecord")
            else:
                os.remove(m.made)
        for f in old:
            os.remove(f"{self.path}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.made):
                os.remove(m.made)


class RecordSource(DataSource):
    """Spark's writer of record files, into a folder that driver and executors share as a path of the file system."""

    @classmethod
    def name(cls) -> str:
        return "labelled_records"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(urlparse(self.options["path"]).path, overwrite)


def write_records(samples: DataFrame, path: str, image: str = "image") -> None:
    """Samples (image, label0, label1) as record files in path, one for each of their partitions; what was there is replaced.

    path is a folder of the file system that all machines share (file: or plain).
    """
    if urlparse(path).scheme not in ("", "file"):
        raise ValueError("record files are written into a shared folder of the file system")
    samples.sparkSession.dataSource.register(RecordSource)
    rows = samples.selectExpr(f"`{image}` AS data", "CAST(label0 AS array<float>) AS label0", "CAST(label1 AS array<float>) AS label1")
    rows.write.format("labelled_records").mode("overwrite").save(path)
