from __future__ import annotations

import gzip
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from posespark.operators.aggregations import resize_factor
from posespark.sources import exporters, readers
from posespark.sources.toy import toy_features


def test_loader_registry_and_selection(spark):
    features = toy_features(spark, 5).unionByName(toy_features(spark, 3, video="other")).withColumn("timestamp", F.lit(None).cast("long"))
    readers.register_loader("made", lambda s, path, **_: (features.select("video", "frame_index"), features))
    frames, chosen = readers.load_dataset(spark, "made", "", ["other"])
    assert frames.count() == 3 and [r["timestamp"] for r in chosen.orderBy("frame_index").collect()] == [0, 1, 2]
    with pytest.raises(NotImplementedError):
        readers.load_dataset(spark, "unknown", "")
    for wrong in ([], ["toy", "toy"], ["nobody"]):
        with pytest.raises(ValueError):
            readers.select_videos(features, wrong)
    with pytest.raises(Exception, match="joints"):
        readers.validated(toy_features(spark, 2, num_joints=19)).collect()


def test_attributes(spark):
    one = spark.range(1)
    first = lambda c: one.select(c.alias("v")).first()["v"]
    assert first(readers.frame_rate_of(F.lit(None), F.lit("25"))) == 25 and first(readers.frame_rate_of(F.lit("x"))) == 1
    assert first(readers.ventral_side_of(F.lit('{"ventral_side": "clockwise"}'))) == "clockwise" and first(readers.ventral_side_of(F.lit("no json"))) == "unknown"
    assert first(readers.microns_per_pixel(F.lit("<a><microns>-5</microns><pixels>2</pixels></a>"))) == 2.5
    assert first(readers.microns_per_pixel(F.lit("<a><pixels>0</pixels></a>"))) == 1


def test_timestamps_and_entities(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("a", 1.0, 4), ("a", nan, 3), ("a", 2.0, 3)], "video string, ts double, worm int")
    assert readers.checked_timestamps(rows, "ts").count() == 3
    with pytest.raises(Exception, match="missing"):
        readers.checked_timestamps(rows.withColumn("ts", F.lit(nan)), "ts").collect()
    assert readers.single_entity(rows, "worm", "video").count() == 2
    assert readers.column_like(rows, "wo", "rm") == "worm"
    with pytest.raises(ValueError):
        readers.column_like(rows, "zzz")


def test_image_folder(spark, tmp_path):
    for k in (2, 0, 1):
        (tmp_path / "clip").mkdir(exist_ok=True)
        (tmp_path / "clip" / f"{k}.pgm").write_bytes(b"P5 # made\n3 2\n255\n" + bytes([k] * 6))
    rows = readers.read_image_folder(spark, str(tmp_path / "clip")).orderBy("frame_index").collect()
    assert [(r["video"], r["frame_index"], r["height"], r["width"], bytes(r["pixels"])) for r in rows] == [("clip", k, 2, 3, bytes([k] * 6)) for k in range(3)]
    with pytest.raises(FileNotFoundError):
        readers.read_image_folder(spark, str(tmp_path / "clip"), "*.none")


def _png(rows, channels):
    """A PNG file of eight-bit rows: grey, red-green-blue or with alpha."""
    size = (len(rows[0]) // channels, len(rows))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", *size, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")


def test_image_folder_of_png_files(spark, tmp_path):
    clip = tmp_path / "film"
    clip.mkdir()
    (clip / "1.png").write_bytes(_png([[0, 10, 255], [1, 2, 3]], 1))
    (clip / "0.png").write_bytes(_png([[255, 0, 0, 0, 255, 0]], 3))
    (clip / "2.PNG").write_bytes(_png([[0, 0, 255, 255]], 4))
    (clip / "1b.pgm").write_bytes(b"P5\n2 1\n255\n" + bytes([7, 8]))
    (clip / "notes.txt").write_text("no image")
    rows = readers.read_image_folder(spark, str(clip)).orderBy("frame_index").collect()
    got = [(r["video"], r["frame_index"], r["height"], r["width"], list(r["pixels"])) for r in rows]
    assert got == [("film", 0, 1, 2, [76, 150]), ("film", 1, 2, 3, [0, 10, 255, 1, 2, 3]), ("film", 2, 1, 2, [7, 8]), ("film", 3, 1, 1, [29])]
    assert [r["frame_index"] for r in readers.read_image_folder(spark, str(clip), "*.png").collect()] == [0, 1]
    (clip / "3.png").write_bytes(b"broken")
    with pytest.raises(Exception, match="not an image"):
        readers.read_image_folder(spark, str(clip)).collect()


def test_models_on_disk(spark, tmp_path):
    (tmp_path / "basis.csv").write_text("1,2\n3,4\n")
    assert readers.read_basis(spark, str(tmp_path / "basis.csv")) == [[1, 3], [2, 4]] and readers.read_basis(spark, None) is None
    with pytest.raises(OSError):
        readers.read_basis(spark, str(tmp_path / "nowhere.csv"))
    with gzip.open(tmp_path / "m.json.gz", "wt") as f:
        json.dump({"means": [[0, 1]], "covariances": [[[1, 0], [0, 1]]], "weights": [1.0]}, f)
    assert readers.read_mixture(spark, str(tmp_path / "m.json.gz")).first()["mean"] == [0, 1]


def test_exports(spark, tmp_path):
    nan = float("nan")
    rows = spark.createDataFrame([("v", 1, [(1.0, 2.0)]), ("v", 0, [(nan, 2.0)])], "video string, t int, skeleton array<struct<x:double,y:double>>")
    made = json.loads(exporters.trajectory_json(rows, 10.0).first()["json"])
    assert made["data"][0] == {"id": "1", "t": [0.0, 0.1], "x": [[None], [1.0]], "y": [[None], [2.0]]} and made["units"]["t"] == "seconds"
    exporters.write_results({"resolved": rows, "original": rows.limit(1), "unaligned": rows}, str(tmp_path / "r"))
    assert exporters.read_results(spark, str(tmp_path / "r")).count() == 3
    seen = []
    exporters.register_exporter("mine", lambda results, path: seen.append(path))
    exporters.export("mine", rows, "p")
    exporters.export("other", rows, "q")
    assert seen == ["p"]
    exporters.write_provenance(rows.withColumnRenamed("t", "frame_index"), str(tmp_path / "p"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "p")).collect()) == ["v 0", "v 1"]


def test_resize_factor():
    assert resize_factor(50.0) == 1 and resize_factor(50.0, 100) == 2 and resize_factor(50.0, factor=3.0) == 3
    for wrong in ({"image_size": 33}, {"image_size": 30}, {"image_size": 64, "factor": 2.0}):
        with pytest.raises(ValueError):
            resize_factor(50.0, **wrong)


def test_results_written_again_replace_their_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("v", 1), ("w", 2)], "video string, t int")
    for part in (rows, rows.filter("video = 'v'"), rows):
        exporters.write_results({"resolved": part, "original": part}, str(tmp_path / "r"))
    assert exporters.read_results(spark, str(tmp_path / "r")).count() == 4


def test_settings(spark, tmp_path):
    settings = {"resize_factor": 0.5, "image_shape": [80, 80], "video_names": ["v"], "worm_is_lighter": False}
    exporters.write_settings(spark, settings, str(tmp_path / "s"))
    assert exporters.read_settings(spark, str(tmp_path / "s")) == settings


def test_archives(spark, tmp_path):
    import io
    import zipfile

    files = spark.createDataFrame([("v", f"f{k}.pgm", bytes([k])) for k in range(5)] + [("w", "f0.pgm", b"x"), ("v", "f1.pgm", b"\x01")], "video string, name string, content binary")
    exporters.write_archives(files, str(tmp_path / "z"), part=3)
    found = {}
    for r in spark.read.parquet(str(tmp_path / "z")).collect():
        archive = zipfile.ZipFile(io.BytesIO(bytes(r["archive"])))
        found[(r["video"], r["part"])] = {n: archive.read(n) for n in archive.namelist()}
    assert found == {("v", 0): {f"f{k}.pgm": bytes([k]) for k in range(3)}, ("v", 1): {f"f{k}.pgm": bytes([k]) for k in (3, 4)}, ("w", 0): {"f0.pgm": b"x"}}


def test_a_rerun_replaces_a_stage_whole(spark, tmp_path):
    from posespark.sources.exporters import read_results, write_results

    rows = spark.createDataFrame([("a", 0), ("b", 0)], "video string, t int")
    write_results({"resolved": rows, "original": rows}, f"{tmp_path}/r")
    write_results({"resolved": rows.filter("video = 'a'")}, f"{tmp_path}/r")
    got = sorted((r["stage"], r["video"]) for r in read_results(spark, f"{tmp_path}/r").collect())
    assert got == [("original", "a"), ("original", "b"), ("resolved", "a")]


def test_record_files(spark, tmp_path):
    import gzip
    import struct
    from pathlib import Path

    from posespark.sources import records

    # published check value of CRC-32C, and of its masked form for the eight bytes of a length
    assert records.crc32c(b"123456789") == 0xE3069283 and records.crc32c(bytes(32)) == 0x8A9136AA
    rows = [(i, bytearray([i % 256] * i), [float(i), -0.5], [0.25 * i]) for i in range(300)]
    samples = spark.createDataFrame(rows, "id int, image binary, label0 array<double>, label1 array<double>").repartition(4)
    for _ in range(2):  # the second run replaces the first
        records.write_records(samples, f"{tmp_path}/r")
    files = list(Path(f"{tmp_path}/r").glob("*"))
    assert len(files) == 4 and all(f.suffix == ".tfrecord" for f in files)
    got = sorted((bytes(r["data"]), r["label0"], r["label1"]) for r in records.read_records(spark, f"{tmp_path}/r").collect())
    assert got == sorted((bytes(d), a, b) for _, d, a, b in rows)
    plain = gzip.decompress(files[0].read_bytes())
    broken = bytearray(plain)
    broken[20] ^= 1
    for stream in (bytes(broken), plain[:-3]):
        try:
            list(records.unframed(stream))
        except ValueError:
            continue
        raise AssertionError("a damaged file was read")
    # floats that are not packed are read as well
    loose = records._field(1, records._field(1, records._field(1, b"label0") + records._field(2, records._field(2, b"\x0d" + struct.pack("<f", 1.5) + b"\x0d" + struct.pack("<f", 2.0)))))
    assert records.decode(loose)["label0"].tolist() == [1.5, 2.0]


def test_record_files_need_a_shared_folder(spark):
    import pytest

    from posespark.sources.records import write_records

    with pytest.raises(ValueError, match="shared"):
        write_records(spark.createDataFrame([], "image binary, label0 array<float>, label1 array<float>"), "s3a://somewhere/x")
