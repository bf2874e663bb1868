from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posespark.operators import alignment, timeseries
from posespark.plans import commands


def _runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def _segments(flags, max_gap, min_run):
    big = np.zeros(len(flags), bool)
    for a, b in _runs(flags):
        big[a:b] = b - a >= min_run
    cut = np.zeros(len(flags), bool)
    for a, b in _runs(~big):
        cut[a:b] = b - a > max_gap
    return [(a, b, int(np.sum(flags[a:b]))) for a, b in _runs(~cut)]


def frames(spark, flags):
    return spark.createDataFrame([("v", i, bool(f)) for i, f in enumerate(flags)], "video string, frame_index int, valid boolean")


SERIES = st.lists(st.tuples(st.booleans(), st.integers(1, 10)), min_size=1, max_size=10).map(lambda x: np.array([f for f, n in x for _ in range(n)]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SERIES)
def test_runs_and_segments(spark, flags):
    rows = frames(spark, flags)
    got = sorted((r["run_start"], r["run_end"]) for r in timeseries.valid_runs(rows, F.col("valid")).collect())
    assert got == _runs(flags)
    got = sorted((r["segment_start"], r["segment_end"], r["n_valid"]) for r in timeseries.valid_segments(rows, F.col("valid")).collect())
    assert got == _segments(flags, timeseries.MAX_GAP, timeseries.MIN_SEGMENT)


@pytest.mark.parametrize(("pattern", "want"), [
    ([1] * 8 + [0] * 4 + [1] * 8, [(0, 20)]), ([1] * 8 + [0] * 5 + [1] * 8, [(0, 8), (13, 21)]), ([1] * 7 + [0] * 9, []),
    ([0] * 4 + [1] * 9, [(0, 13)]), ([0] * 3, [(0, 3)]), ([1] * 8 + [0, 0, 1, 1, 0, 0, 0] + [1] * 8, [(0, 8), (15, 23)]),
])
def test_segment_edges(spark, pattern, want):
    out = timeseries.valid_segments(frames(spark, pattern), F.col("valid")).collect()
    assert sorted((r["segment_start"], r["segment_end"]) for r in out) == want


def test_resample_keeps_the_latest_of_a_tick(spark):
    rows = spark.createDataFrame([("v", 0, 5, 1.0), ("v", 1, 7, 2.0), ("v", 2, 7, 3.0), ("w", 0, 9, 4.0)], "video string, frame_index int, tick int, a double")
    out = sorted((r["video"], r["t"], r["a"]) for r in timeseries.dense_resample(rows, ["a"]).collect())
    assert [o for o in out if o[0] == "w"] == [("w", 0, 4.0)]
    assert [o[1:] for o in out if o[0] == "v"] == [(0, 1.0), (1, None), (2, 3.0)]


def test_unwrap_is_as_numpy(spark):
    values = np.cumsum(np.random.default_rng(1).uniform(-5, 5, 300))
    wrapped = np.angle(np.exp(1j * values))
    rows = spark.createDataFrame([("v", i, float(a)) for i, a in enumerate(wrapped)], "video string, frame_index int, a double")
    got = [r["unwrapped"] for r in timeseries.unwrap(rows, "a", ["video"], ["frame_index"]).orderBy("frame_index").collect()]
    assert got == pytest.approx(np.unwrap(wrapped), abs=1e-9)


def _cubic(spark, n, missing=()):
    value = lambda i: 0.01 * i**3 - 0.2 * i**2 + i
    return value, spark.createDataFrame([("v", 0, i, None if i in missing else float(value(i))) for i in range(n)], "video string, segment_start int, frame_index int, a double")


def test_smoothing_keeps_a_cubic_and_needs_a_window(spark):
    value, rows = _cubic(spark, 30)
    out = timeseries.smooth(rows, "a").orderBy("frame_index").collect()
    assert [r["smoothed"] for r in out] == pytest.approx([value(i) for i in range(30)])
    assert all(r["smoothed"] is None for r in timeseries.smooth(_cubic(spark, 8)[1], "a").collect())
    assert all(r["smoothed"] is not None for r in timeseries.smooth(_cubic(spark, 9)[1], "a").collect())


def test_spline_fill(spark, monkeypatch):
    value, rows = _cubic(spark, 60, missing={0, 5, 6, 30, 31, 32, 59})
    monkeypatch.setattr(timeseries, "CHUNK_KNOTS", 20)
    monkeypatch.setattr(timeseries, "OVERLAP_KNOTS", 6)
    out = {r["frame_index"]: r["filled"] for r in timeseries.spline_fill(rows, "a").collect()}
    assert len(out) == 60 and out[0] is None and out[59] is None
    assert [out[i] for i in range(1, 59)] == pytest.approx([value(i) for i in range(1, 59)])
    assert all(r["filled"] is None for r in timeseries.spline_fill(_cubic(spark, 6, missing={1, 2, 3})[1], "a").collect())
    with pytest.raises(Exception, match="outside"):
        timeseries.spline_fill(rows, "a", strict=True).collect()


def test_nearest_template(spark):
    rows = spark.createDataFrame([("v", i, i in (2, 6)) for i in range(9)] + [("w", 0, False)], "video string, frame_index int, mark boolean")
    out = {(r["video"], r["frame_index"]): r["template"] for r in alignment.nearest_template(rows, F.col("mark")).collect()}
    assert [out[("v", i)] for i in range(9)] == [2, 2, 2, 2, 2, 6, 6, 6, 6] and out[("w", 0)] is None


def test_exact_align(spark):
    frames = spark.createDataFrame([("v", 0, 1.0), ("v", 1, 2.0), ("v", 2, None)], "video string, frame_index int, ts double")
    features = spark.createDataFrame([("v", 1.0, 10, 0), ("v", 1.0, 20, 1), ("v", 3.0, 30, 2)], "video string, ts double, x int, position int")
    out = {r["frame_index"]: r["x"] for r in alignment.exact_align(frames, features, ["x"]).collect()}
    assert out == {0: 10, 1: None, 2: None}


def test_post_processing(spark):
    rng = np.random.default_rng(3)
    base = rng.uniform(-1, 1, 6)
    theta = lambda t: [float(x) for x in base + 0.02 * t]
    gap = {0, 12, 13, *range(30, 38)}
    rows = [("v", t, None if t in gap else theta(t)) for t in range(60)] + [("none", t, None) for t in range(20)]
    df = spark.createDataFrame(rows, "video string, t int, theta array<double>")
    basis = [[1 / np.sqrt(6)] * 6]
    out = {r["t"]: r for r in commands.post_process(df, basis=basis).collect()}
    assert set(out) == set(range(60))
    assert out[12]["raw"] is None and out[12]["interp"] == pytest.approx(np.unwrap(theta(12)), abs=1e-6)
    assert out[12]["smooth"] == pytest.approx(np.unwrap(theta(12)), abs=1e-6)
    assert out[0]["interp"] is None and out[33]["interp"] is None and out[45]["smooth"] is not None
    assert out[12]["modes_smooth"] == pytest.approx([0], abs=1e-6)


def test_frames_are_processed_whole(spark, monkeypatch):
    """Angles stay in one row a frame: turned, filled and smoothed as a row an angle is, missing angles and short frames included."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(timeseries, "CHUNK_KNOTS", 70)
    body = lambda t: [float(a) for a in rng.uniform(-9, 9, 3)]
    odd = {12: None, 13: None, 20: [1.0, None, 2.0], 31: [0.5, 4.0], 40: [], 57: [3.0, 1.0, None]}
    rows = spark.createDataFrame([(v, t, odd[t] if t in odd else body(t)) for v in ("v", "w") for t in range(120)], "video string, t int, theta array<double>").repartition(3)
    flat = timeseries.frame_major_unwrap(rows.filter("theta is not null"))
    want = {(r["video"], r["t"], r["dim"]): r["unwrapped"] for r in flat.collect()}
    got = {(r["video"], r["t"], d): a for r in timeseries.unwrapped_frames(rows, order="t").collect() for d, a in enumerate(r["unwrapped"])}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    values = [("v", 0, 120, t, d, want.get(("v", t, d))) for t in range(120) for d in range(3)]
    single = spark.createDataFrame(values, "video string, segment_start int, segment_end int, frame_index int, dim int, a double")
    filled = timeseries.spline_fill(single, "a", ["video", "segment_start", "dim"])
    smoothed = timeseries.smooth(filled, "filled", keys=["video", "segment_start", "dim"], bounds=("segment_start", "segment_end"))
    of = {(r["frame_index"], r["dim"]): (r["filled"], r["smoothed"]) for r in smoothed.collect()}
    processed = commands.post_process(rows)
    out = {r["t"]: r for r in processed.filter("video = 'v'").collect()}
    assert len(out) == 120 and sum(r["smooth"] is not None for r in out.values()) > 90
    for t, r in out.items():
        for k, name in enumerate(("interp", "smooth")):
            each = [of[t, d][k] for d in range(3)]
            assert r[name] == (None if None in each else pytest.approx(each))
    assert "posexplode" not in processed._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("piece", [5, 16, 1000])
def test_runs_segments_and_templates_over_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(timeseries, "PIECE", piece)
    for f in (timeseries.carried_steps, timeseries.carried_fill):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], piece))
    rng = np.random.default_rng(piece)
    flags = np.repeat(rng.random(60) < 0.6, rng.integers(1, 14, 60))
    rows = frames(spark, flags).repartition(3)
    assert sorted((r["run_start"], r["run_end"]) for r in timeseries.valid_runs(rows, F.col("valid")).collect()) == _runs(flags)
    segments = timeseries.valid_segments(rows, F.col("valid"))
    want = _segments(flags, timeseries.MAX_GAP, timeseries.MIN_SEGMENT)
    assert sorted((r["segment_start"], r["segment_end"], r["n_valid"]) for r in segments.collect()) == want
    inside = timeseries.in_segments(rows, segments).collect()
    assert sorted((r["frame_index"], r["segment_start"]) for r in inside) == [(t, a) for a, b, _ in want for t in range(a, b)]
    marks = rng.random(len(flags)) < 0.03
    marked = spark.createDataFrame([("v", t, bool(m)) for t, m in enumerate(marks)], "video string, frame_index int, mark boolean").repartition(3)
    places = np.flatnonzero(marks)
    got = {r["frame_index"]: r["template"] for r in alignment.nearest_template(marked, F.col("mark")).collect()}
    assert got == {t: int(min(places, key=lambda p: (abs(p - t), p))) for t in range(len(flags))}
    ticks = spark.createDataFrame([("v", 0, 3, 1.0), ("v", 1, 3 + 4 * piece, 2.0)], "video string, frame_index int, tick int, a double")
    assert {r["t"]: r["a"] for r in timeseries.dense_resample(ticks, ["a"]).collect()} == {t: {0: 1.0, 4 * piece: 2.0}.get(t) for t in range(4 * piece + 1)}


@pytest.mark.parametrize("piece", [9, 25, 1000])
def test_smoothing_in_pieces(spark, piece):
    """Halos give the same numbers as whole groups; gaps in a group are refused."""
    rng = np.random.default_rng(2)
    rows = [("v", a, t, float(rng.normal())) for a, n in ((3, 40), (60, 9), (80, 8), (100, 1), (110, 27)) for t in range(a, a + n)]
    df = spark.createDataFrame(rows, "video string, segment_start int, frame_index int, a double").repartition(3)
    got = {r["frame_index"]: r["smoothed"] for r in timeseries.smooth(df, "a", piece=piece).collect()}
    value = {r[2]: r[3] for r in rows}
    for a, n in ((3, 40), (60, 9), (80, 8), (100, 1), (110, 27)):
        for i in range(n):
            if n < 9:
                assert got[a + i] is None
                continue
            first = min(max(i - 4, 0), n - 9)
            fit = np.polynomial.Polynomial.fit(np.arange(9), [value[a + first + j] for j in range(9)], 3)
            assert got[a + i] == pytest.approx(fit(i - first))
    last = {a: a + n for a, n in ((3, 40), (60, 9), (80, 8), (100, 1), (110, 27))}
    bounded = spark.createDataFrame([(*r, last[r[1]]) for r in rows], "video string, segment_start int, frame_index int, a double, segment_end int").repartition(3)
    again = {r["frame_index"]: r["smoothed"] for r in timeseries.smooth(bounded, "a", piece=piece, bounds=("segment_start", "segment_end")).collect()}
    assert again == got
    with pytest.raises(Exception, match="consecutive"):
        timeseries.smooth(df.filter("frame_index <> 20"), "a", piece=piece).collect()
    with pytest.raises(ValueError, match="longer"):
        timeseries.smooth(df, "a", piece=8)


def test_a_long_video_is_linear_and_has_no_window_over_it(spark):
    """100,000 frames of one video: nearest templates within seconds; no frame reaches to the end of a partition in any plan."""
    import time

    rows = spark.range(100_000).select(F.lit("v").alias("video"), F.col("id").cast("int").alias("frame_index"), (F.col("id") % 1000 < 990).alias("valid"), F.sin("id").alias("a"), F.lit(0).alias("segment_start"))
    template = alignment.nearest_template(rows, F.col("frame_index") % 777 == 5)
    template.count()
    start = time.perf_counter()
    assert template.filter("template is null or abs(template - frame_index) > 389").count() == 149  # the last frames have none after them
    assert time.perf_counter() - start < 10
    for df in (template, timeseries.valid_segments(rows, F.col("valid")), timeseries.smooth(rows, "a")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "unboundedfollowing" not in plan.lower()
        over_frames = [line for line in plan.splitlines() if " Window " in line and "windowspecdefinition(video" in line and "frame_index" in line.split("windowspecdefinition")[1] and "_piece" not in line]
        assert over_frames == []


def test_made_ticks_are_not_broadcast(spark):
    """Two frames a video with many ticks between them: the ticks do not go to every task."""
    rows = spark.range(40).select((F.col("id") % 20).alias("video"), F.floor(F.col("id") / 20).cast("int").alias("frame_index"), (F.floor(F.col("id") / 20) * 5000 + F.col("id") % 20).cast("int").alias("tick"))
    met = alignment.tick_lookup(timeseries.dense_resample(rows, ["frame_index"]), rows)
    assert sorted((r["video"], r["t"], r["frame_index"]) for r in met.collect()) == [(v, 5000 * i, i) for v in range(20) for i in (0, 1)]
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    made = [i for i, line in enumerate(plan) if "Generate explode" in line]
    assert made
    for i in made:
        above = [j for j in range(i) if all(depth[j] < d for d in depth[j + 1 : i + 1])]
        assert not any("BroadcastExchange" in plan[j] for j in above)


@pytest.mark.parametrize("piece", [3, 7, 1000])
def test_pieces_carry_over(spark, piece):
    """Lags and running totals over pieces equal those over whole series; null keys and values included."""
    rng = np.random.default_rng(4)
    rows = [(k, int(t), None if t % 5 == 0 else float(rng.uniform(-9, 9))) for k in ("a", "b", None) for t in rng.choice(60, 30, replace=False)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    out = timeseries.carried_sum(timeseries.carried_lag(df, "v", ["k"], ["t"], "before", piece), F.coalesce("v", F.lit(0.0)), ["k"], ["t"], "total", piece).collect()
    assert len(out) == len(rows)
    for k in ("a", "b", None):
        mine, known = sorted((r for r in out if r["k"] == k), key=lambda r: r["t"]), {t: v for key, t, v in rows if key == k}
        values = [known[t] for t in sorted(known)]
        assert [r["before"] for r in mine] == [None, *values[:-1]]
        assert [r["total"] for r in mine] == pytest.approx(np.cumsum([v or 0.0 for v in values]).tolist())


def test_exact_percentile_by_ranks(spark):
    from posespark.operators.aggregations import percentile_cut

    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=999).tolist(), "b": [1.0] * 500 + [2.0], "c": [3.0], None: [5.0, 7.0], "d": rng.integers(0, 4, 1000).astype(float).tolist()}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for percent in (0, 37.5, 97.5, 100):
        got = {r["k"]: r["cut"] for r in percentile_cut(df, "v", percent, ["k"]).collect()}
        assert got == {k: pytest.approx(np.percentile(values, percent)) for k, values in groups.items()}


def test_percentile_of_bounded_memory(spark):
    from posespark.operators.aggregations import percentile_cut

    df = spark.range(10_000).selectExpr("id % 2 AS video", "CAST(id AS double) AS v")
    exact = {r["video"]: r["cut"] for r in percentile_cut(df, "v", 97.5, ["video"]).collect()}
    near = {r["video"]: r["cut"] for r in percentile_cut(df, "v", 97.5, ["video"], accuracy=1000).collect()}
    assert all(abs(near[k] - exact[k]) <= 2 * 5000 / 1000 + 2 for k in (0, 1))
