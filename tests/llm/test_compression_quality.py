from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from posespark.llm import compression_quality as cq


@pytest.fixture(scope="module")
def tables(spark):
    import os

    d = os.environ.get("TEST_SF_BIG", "/root/testdata/sf0.1")
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return tuple(spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = cq.score_documents(docs, cq.fit(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    by = {q: [r["predicted"] == q for r in rows if r["quality"] == q] for q in (0, 1)}
    assert len(rows) > 1000
    assert all(sum(x) / len(x) > 0.9 for x in by.values())
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_only_the_other_folds_teach(tables):
    docs, labels = tables
    held = cq.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", 1 - F.col("toxic"))
    assert cq.fit(docs, labels) == cq.fit(docs, turned)


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(200), -5, None]], "doc_id long").select("doc_id", cq.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_one_class_or_none_scores_one_half(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1), (3, 1)]):
        model = cq.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r["score"] for r in cq.score_documents(docs, model).collect()] == [0.5] * 3


def test_long_texts_are_scored_whole():
    good, bad = b"calm river stone " * 40, b"### $$$ %%% &&& " * 40
    sizes = cq.Model(good, bad, 1.0, 0.0).differences()
    assert sizes(good * 50) > sizes(good * 50 + bad * 50) > sizes(bad * 50)


def test_scores_against_a_plain_version(spark, tables):
    """Every block compressed by itself with either dictionary as it is, sizes summed, one logistic line."""
    import math

    import zstandard

    docs, labels = tables
    model = cq.fit(docs, labels)
    rows = [r for r in docs.orderBy("doc_id").limit(120).select("doc_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(-1, None), (-2, ""), (-3, "é" * 3000), (-4, "x " * 40_000)]

    def plain(text):
        data, sizes = (text or "").encode(), []
        for d in (model.good, model.bad):
            frame = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append(sum(len(frame.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
        x = (sizes[1] - sizes[0]) / (sizes[1] + sizes[0]) if data else 0.0
        return 1 / (1 + math.exp(-(model.slope * x + model.offset)))

    out = {r["doc_id"]: r for r in cq.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc, text in rows:
        assert out[doc]["score"] == pytest.approx(plain(text), abs=1e-12) and out[doc]["predicted"] == int(plain(text) >= 0.5)


def test_logistic_line():
    """At the line the slope of the weighted likelihood is nothing."""
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = np.concatenate([rng.normal(1, 1, 300), rng.normal(-1, 1, 90)]), np.repeat([1, 0], [300, 90])
    slope, offset = cq.logistic(x, y)
    off = (1 / (1 + np.exp(-(slope * x + offset))) - y) * np.where(y == 1, 1 / 600, 1 / 180)
    assert abs((off * x).sum() + 1e-6 * slope) < 1e-8 and abs(off.sum() + 1e-3 * offset) < 1e-8 and slope > 1
