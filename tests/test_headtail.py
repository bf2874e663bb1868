from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from posespark.functions import angles as A
from posespark.operators import headtail
from posespark.streaming import headtail as stream

RATE = 30.0
SCHEMA = "video string, t int, theta0 array<double>, theta1 array<double>, score0 double, score1 double"


def _turn(theta):
    return theta[::-1] + np.pi


def _frames(seed=0, n=150, bad=(40, 41, 42, 43, 44, 45, 46, 47, 90), odd=(20,)):
    """A slowly turning body whose candidates come in random order; frames with low scores; a jump."""
    rng = np.random.default_rng(seed)
    base, rows, truth = np.linspace(0, 1.2, 8), [], {}
    for t in range(n):
        theta = base + 0.01 * t + (1.3 if t in odd else 0)
        k = int(rng.random() < 0.5)
        truth[t] = k
        pair = (theta, _turn(theta)) if k == 0 else (_turn(theta), theta)
        score = 0.4 if t in bad else 0.9
        rows.append(("v", t, pair[0].tolist(), pair[1].tolist(), score, score - 0.1))
    return rows, truth


def _fold(rows):
    state, segment, out = headtail.FoldState(), -1, []
    for video, t, a, b, s0, s1 in sorted(rows):
        if max(s0, s1) >= headtail.SCORE_THRESHOLD:
            state, (accepted, opens, k) = headtail.fold_step(state, t, np.array(a), np.array(b), headtail.frames_of(headtail.LOOK_BACK_S, RATE))
            segment += opens
            if accepted:
                out.append((video, t, segment, k))
    return out


def test_fold_in_parallel_stretches(spark):
    rows, _ = _frames()
    got = headtail.continuous_partitions(spark.createDataFrame(rows, SCHEMA), RATE).collect()
    want = _fold(rows)
    assert sorted(map(tuple, got)) == want
    assert 20 not in {w[1] for w in want} and len({w[2] for w in want}) == 2


def _random_frames(seed, n):
    """Angles of few directions, missing scores and pauses, so that frames are refused, turned and opened at random."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n):
        if rng.random() < 0.15:
            continue
        a, b = rng.choice([0.0, 0.3, 0.6, 1.4, 3.0], 2)
        rows.append((f"v{rng.integers(2)}", t, [float(a)] * 3, [float(b)] * 3, 0.9 if rng.random() < 0.9 else 0.2, 0.1))
    return rows


@pytest.mark.parametrize("piece", [7, 16, 50])
def test_fold_in_pieces_equals_the_sequential_fold(spark, piece):
    rows = _random_frames(piece, 600)
    got = headtail.continuous_partitions(spark.createDataFrame(rows, SCHEMA).repartition(5), RATE, piece=piece).collect()
    want = [w for v in ("v0", "v1") for w in _fold([r for r in rows if r[0] == v])]
    assert sorted(map(tuple, got)) == want


def test_one_long_stretch_without_a_pause(spark):
    """100,000 frames: the same as the sequential fold, and no window over a video in the plan."""
    n = 100_000
    rng = np.random.default_rng(1)
    turn, jump = rng.random(n) < 0.5, rng.random(n) < 0.01
    base = 0.01 * np.arange(n) + 1.3 * jump
    rows = [("v", t, [x, x + 0.1], [x + np.pi, x + np.pi + 0.1], 0.9, 0.1) if k else ("v", t, [x + np.pi, x + np.pi + 0.1], [x, x + 0.1], 0.9, 0.1) for t, (x, k) in enumerate(zip(base.tolist(), turn))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = sorted(map(tuple, headtail.continuous_partitions(df, RATE).collect()))
    assert got == _fold(rows)


def test_scores_that_are_missing(spark):
    nan = float("nan")
    rows = [("v", 0, [0.0], [1.0], nan, 0.9), ("v", 1, [0.0], [1.0], 0.7, 0.1), ("v", 2, [0.0], [1.0], 0.69, 0.1)]
    assert [r["t"] for r in headtail.passing(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]


def test_resolution_finds_the_true_orientation(spark):
    rows, truth = _frames()
    frames = spark.createDataFrame(rows, SCHEMA).withColumn("score1", F.col("score0"))
    body = lambda c: A.skeleton_from_theta(F.col(c), F.lit(60.0))
    skeletons = frames.select("video", "t", body("theta0").alias("skeleton0"), body("theta1").alias("skeleton1"))
    spread = spark.createDataFrame([(t, k) for t, k in truth.items() if 0 <= t < 12], "t int, k int")
    labels = skeletons.join(spread, "t").select("video", "t", F.when(F.col("k") == 0, F.col("skeleton0")).otherwise(F.col("skeleton1")).alias("label"))
    out = {r["t"]: r["k"] for r in headtail.resolve(frames, skeletons, labels, RATE).collect()}
    assert len(out) == 150 and all(out[t] is None for t in (20, 40, 90))
    assert all(out[t] == truth[t] for t in out if out[t] is not None)
    assert sum(k is not None for k in out.values()) == 140
    stats = headtail.resolution_stats(headtail.resolve(frames, skeletons, labels, RATE), labels).first()
    assert (stats["n_frames"], stats["n_resolved"], stats["n_labelled"]) == (150, 140, 12)
    none = headtail.resolve(frames, skeletons, labels.limit(5), RATE)
    assert none.filter("k is not null").count() == 0 and none.count() == 150


def test_short_segments_and_guard(spark):
    parts = spark.createDataFrame([("v", t, 0, 0) for t in range(5)] + [("v", t, 1, 0) for t in range(20, 26)], "video string, t int, segment int, k int")
    assert {r["segment"] for r in headtail.drop_short(parts, RATE).collect()} == {1}
    nan = float("nan")
    rows = [("a", 0, [0.0], [0.0], nan, nan), ("b", 0, [0.0], [0.0], 0.1, 0.2), ("c", 0, [0.0], [0.0], 0.1, 0.9), ("d", 0, [0.0], [0.0], nan, 0.1)]
    out = {r["video"]: r["resolvable"] for r in headtail.score_guard(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {"a": False, "b": False, "c": True, "d": True}


def test_spread_takes_the_smallest_gap_first():
    import pandas as pd

    up, down = [1.0, 0.0], [-1.0, 0.0]
    rows = pd.DataFrame([(0, 9, 0, up, down, up, down), (12, 20, None, down, up, down, up), (25, 40, None, up, down, up, down), (90, 99, None, up, down, up, down)], columns=["first_t", "last_t", "alignment", "first0", "first1", "last0", "last1"])
    out = headtail.spread(rows, 30)["alignment"].tolist()
    assert out[:3] == [0, 1, 0] and pd.isna(out[3])
    rows["alignment"] = None
    assert headtail.spread(rows, 30)["alignment"].isna().all()


def test_stream_equals_batch(spark, tmp_path):
    rows, _ = _frames(seed=4)
    rows += [("w", *r[1:]) for r in _frames(seed=5, n=90)[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    source = str(tmp_path / "in")
    for k, (a, b) in enumerate([(0, 30), (30, 95), (95, 150)]):
        df.filter((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.mode("append").parquet(f"{source}/part={k}")
    live = spark.readStream.schema(f"{SCHEMA}, part int").option("maxFilesPerTrigger", 1).parquet(source).drop("part")
    query = stream.continuous_partitions(live, RATE).writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = Counter(tuple(r) for r in spark.table("parts").collect())
    assert got == Counter(tuple(r) for r in headtail.continuous_partitions(df, RATE).collect())


def test_windowed_scores_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("v", k, 0.5, float("nan") if k == 3 else 0.8) for k in range(120)], "video string, k int, score0 double, score1 double").withColumn("time", F.timestamp_seconds(F.col("k")))
    assert {r["n_frames"] for r in stream.windowed_scores(df).collect()} == {60}
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.windowed_scores(live).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["mean_score"] for r in spark.table("windows").collect()] == pytest.approx([0.8, 0.8])
