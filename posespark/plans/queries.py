"""Queries of the engine's operators over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from math import pi
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions.aggregates import nan_mean
from ..functions.arrow import resample_skeleton
from ..functions.kernels import savgol_weights
from ..operators import aggregations, alignment, blobs, headtail, models, patches, sampling, timeseries
from ..sources.toy import toy_features_of
from . import commands
from .views import FRAME_RATE, SERIES, WIDTHS, cosine_basis, losses, poses, poses_sql, series, table, widths

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BODY = 63.0
PI = repr(pi)
MODES = 5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(value: Column) -> Column:
    """Six decimals, null for a missing number, no negative zero."""
    return F.round(F.when(~F.isnan(value), value), 6) + F.lit(0.0)


def _wrapped(a: str, b: str) -> str:
    return f"abs(atan2(sin({a} - {b}), cos({a} - {b})))"


def _distance(a: str, b: str) -> str:
    return f"list_avg(list_transform(list_zip({a}, {b}), lambda z: {_wrapped('z[1]', 'z[2]')}))"


def _points(theta: str, keys: str, source: str, where: str = "") -> str:
    """CTEs flat and points: the centred skeleton of an angle list, a row a point."""
    return f"""flat AS (SELECT {keys}, unnest({theta}) AS a, unnest(range(len({theta}))) AS i, len({theta}) AS n FROM {source} {where}),
steps AS (SELECT {keys}, i, sum({BODY} / (n - 1) * cos(a)) OVER w AS x, sum({BODY} / (n - 1) * sin(a)) OVER w AS y FROM flat WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
points AS (SELECT {keys}, i, x - min(x) OVER w + (0 - (max(x) OVER w - min(x) OVER w)) / 2 AS x,
  y - min(y) OVER w + (0 - (max(y) OVER w - min(y) OVER w)) / 2 AS y FROM steps WINDOW w AS (PARTITION BY {keys}))"""


def _skeletons(spark: SparkSession, sf_dir: str, factor: float = 4.0) -> DataFrame:
    return poses(spark, sf_dir, factor).withColumn("skeleton", A.skeleton_from_theta(F.col("theta"), F.lit(BODY)))


# --- angles and skeletons


@query(f"""WITH {poses_sql()}, {_points('theta', 'video, t', 'poses')}
SELECT video, t, CAST(i AS INTEGER) AS i, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM points""")
def skeleton_from_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _skeletons(spark, sf_dir).select("video", "t", F.posexplode("skeleton").alias("i", "p"))
    return flat.select("video", "t", "i", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@query(f"""WITH {poses_sql()}, {_points('theta', 'video, t', 'poses')},
s AS (SELECT video, t, i, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM points WINDOW w AS (PARTITION BY video, t ORDER BY i))
SELECT video, t, CAST(count(*) AS INTEGER) AS n_angles, round(sum(cos(atan2(dy, dx))), 6) + 0.0 AS cos_sum, round(sum(sin(atan2(dy, dx))), 6) + 0.0 AS sin_sum FROM s WHERE dx IS NOT NULL GROUP BY video, t""")
def theta_from_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = _skeletons(spark, sf_dir).select("video", "t", A.theta_from_points(F.col("skeleton")).alias("theta"))
    total = lambda f: F.aggregate(F.transform("theta", f), F.lit(0.0), lambda a, v: a + v)
    return angles.select("video", "t", F.size("theta").alias("n_angles"), r6(total(F.cos)).alias("cos_sum"), r6(total(F.sin)).alias("sin_sum"))


@query(f"""WITH {poses_sql()}, c AS (SELECT video, t, 0 AS k, theta AS theta FROM poses UNION ALL
SELECT video, t, 1 AS k, list_transform(list_reverse(theta), lambda a: a + {PI}) AS theta FROM poses)
SELECT video, t, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, round(a, 6) + 0.0 AS angle FROM (SELECT video, t, k, unnest(theta) AS a, unnest(range(len(theta))) AS i FROM c)""")
def flip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = poses(spark, sf_dir).select("video", "t", F.posexplode(F.array("theta", A.flip(F.col("theta")))).alias("k", "theta"))
    return both.select("video", "t", "k", F.posexplode("theta").alias("i", "a")).select("video", "t", "k", "i", r6(F.col("a")).alias("angle"))


@query(f"""WITH {poses_sql()}, n AS (SELECT video, t, theta, lead(theta) OVER (PARTITION BY video ORDER BY t) AS next FROM poses)
SELECT video, t, round({_distance('theta', 'next')}, 6) AS distance FROM n WHERE next IS NOT NULL""")
def angle_distance_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("theta").over(Window.partitionBy("video").orderBy("t"))
    rows = poses(spark, sf_dir).select("video", "t", "theta", following.alias("next")).filter("next is not null")
    return rows.select("video", "t", r6(A.angle_distance(F.col("theta"), F.col("next"))).alias("distance"))


@query(f"""WITH {poses_sql()}, {_points('theta', 'video, t', 'poses')},
v AS (SELECT video, t, arg_max(x, i) - arg_min(x, i) AS vx, arg_max(y, i) - arg_min(y, i) AS vy FROM points GROUP BY video, t),
p AS (SELECT video, t, vx, vy, lead(vx) OVER w AS wx, lead(vy) OVER w AS wy FROM v WINDOW w AS (PARTITION BY video ORDER BY t))
SELECT video, t, CASE WHEN vx * vx + vy * vy = 0 OR wx * wx + wy * wy = 0 THEN NULL ELSE round((vx * wx + vy * wy) / (sqrt(vx * vx + vy * vy) * sqrt(wx * wx + wy * wy)), 6) + 0.0 END AS cosine FROM p WHERE wx IS NOT NULL""")
def headtail_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("skeleton").over(Window.partitionBy("video").orderBy("t"))
    rows = _skeletons(spark, sf_dir).select("video", "t", "skeleton", following.alias("next")).filter("next is not null")
    return rows.select("video", "t", r6(A.head_tail_cosine(F.col("skeleton"), F.col("next"))).alias("cosine"))


def _basis_sql() -> str:
    return f"""basis AS (SELECT m, i, sqrt(2.0::DOUBLE / 64) * cos({PI} * (i + 0.5) * m / 64) AS b FROM range(1, {MODES + 1}) AS a(m), range(64) AS c(i)),
flat AS (SELECT video, t, unnest(theta) AS a, unnest(range(64)) AS i, list_avg(theta) AS m0 FROM poses),
coef AS (SELECT video, t, m, sum((a - m0) * b) AS c FROM flat JOIN basis USING (i) GROUP BY video, t, m)"""


def _basis() -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in v]) for v in cosine_basis(64, MODES)])


@query(f"WITH {poses_sql()}, {_basis_sql()} SELECT video, t, CAST(m AS INTEGER) AS mode, round(c, 6) + 0.0 AS coefficient FROM coef")
def project_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses(spark, sf_dir).select("video", "t", F.posexplode(A.project(F.col("theta"), _basis())).alias("m", "c"))
    return rows.select("video", "t", (F.col("m") + 1).alias("mode"), r6(F.col("c")).alias("coefficient"))


@query(f"""WITH {poses_sql()}, {_basis_sql()}
SELECT video, t, CAST(i AS INTEGER) AS i, round(sum(c * b), 6) + 0.0 AS angle FROM coef JOIN basis USING (m) GROUP BY video, t, i""")
def modes_to_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses(spark, sf_dir).select("video", "t", A.project(F.col("theta"), _basis()).alias("modes"))
    back = rows.select("video", "t", F.posexplode(A.reconstruct(F.col("modes"), _basis())).alias("i", "a"))
    return back.select("video", "t", "i", r6(F.col("a")).alias("angle"))


@query(f"""WITH {poses_sql()}, f AS (SELECT video, t, unnest(theta) AS a, unnest(range(len(theta))) AS i FROM poses)
SELECT video, t, CAST(i AS INTEGER) AS i, round(CASE WHEN video % 2 = 0 THEN 2 * {PI} - a ELSE a END, 6) + 0.0 AS angle FROM f""")
def ventral_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("video") % 2 == 0, "clockwise").otherwise("anticlockwise")
    rows = poses(spark, sf_dir).select("video", "t", F.posexplode(A.dorsal_ventral_flip(F.col("theta"), side)).alias("i", "a"))
    return rows.select("video", "t", "i", r6(F.col("a")).alias("angle"))


@query(f"""WITH {poses_sql()}, {_points('theta', 'video, t', 'poses')},
s AS (SELECT video, t, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM points WINDOW w AS (PARTITION BY video, t ORDER BY i))
SELECT video, t, round(sum(sqrt(dx * dx + dy * dy)), 6) AS length FROM s WHERE dx IS NOT NULL GROUP BY video, t""")
def body_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skeletons(spark, sf_dir).select("video", "t", r6(A.body_length(F.col("skeleton"))).alias("length"))


@query(f"""WITH {poses_sql()}, {_points('theta', 'video, t', 'poses', 'WHERE vec_id % 7 <> 0')} SELECT video, CAST(count(*) // 64 AS BIGINT) AS n_labelled FROM points GROUP BY video""")
def labelled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _skeletons(spark, sf_dir)
    spoiled = F.transform("skeleton", lambda p, i: F.struct(F.when((F.col("vec_id") % 7 == 0) & (i == 3), A.nan()).otherwise(p["x"]).alias("x"), p["y"].alias("y")))
    return rows.withColumn("skeleton", spoiled).filter(A.is_labelled(F.col("skeleton"))).groupBy("video").agg(F.count("*").alias("n_labelled"))


@query(f"""WITH {poses_sql()}, j AS (SELECT video, t, theta, i FROM poses, range(40) AS r(i)),
p AS (SELECT video, t, theta, i, i * 63 / 39.0::DOUBLE AS place FROM j), q AS (SELECT *, CAST(least(floor(place), 62) AS INTEGER) AS low FROM p)
SELECT video, t, CAST(i AS INTEGER) AS i, round(theta[low + 1] + (theta[low + 2] - theta[low + 1]) * (place - low), 6) + 0.0 AS value FROM q""")
def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses(spark, sf_dir).select("video", "t", F.posexplode(A.linear_resample(F.col("theta"), 40)).alias("i", "v"))
    return rows.select("video", "t", "i", r6(F.col("v")).alias("value"))


@query(f"""WITH {poses_sql()}, {_points('theta', 'video, t', 'poses')}
SELECT video, t, CAST(i AS INTEGER) AS i, round(x * 2.5 - video, 6) + 0.0 AS x, round(y * 2.5 - 1.5, 6) + 0.0 AS y, round(x * 1.25, 6) + 0.0 AS resized_x FROM points""")
def stage_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _skeletons(spark, sf_dir)
    moved = A.to_stage(F.col("skeleton"), F.lit(2.5), F.col("video").cast("double"), F.lit(1.5))
    flat = rows.select("video", "t", F.posexplode(F.arrays_zip(moved.alias("a"), A.rescale(F.col("skeleton"), 1.25).alias("b"))).alias("i", "p"))
    return flat.select("video", "t", "i", r6(F.col("p")["a"]["x"]).alias("x"), r6(F.col("p")["a"]["y"]).alias("y"), r6(F.col("p")["b"]["x"]).alias("resized_x"))


# --- widths and lengths


@query(f"""WITH {WIDTHS} SELECT video, round(avg(CASE WHEN NOT isnan(head_width) THEN head_width END), 6) AS head_width,
round(avg(CASE WHEN NOT isnan(midbody_width) THEN midbody_width END), 6) AS midbody_width, round(avg(CASE WHEN NOT isnan(tail_width) THEN tail_width END), 6) AS tail_width FROM widths GROUP BY video""")
def video_mean_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["head_width", "midbody_width", "tail_width"]
    return aggregations.video_means(widths(spark, sf_dir), names).select("video", *[r6(F.col(n)).alias(n) for n in names])


@query(f"""WITH {WIDTHS}, m AS (SELECT video, avg(CASE WHEN NOT isnan(midbody_width) THEN midbody_width END) AS m FROM widths GROUP BY video),
x AS (SELECT max(m) AS m FROM m) SELECT round(m, 6) AS max_average_length, CAST(greatest(32, floor(m)) + greatest(32, floor(m)) % 2 AS INTEGER) AS crop_size FROM x""")
def crop_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = aggregations.longest_mean(widths(spark, sf_dir), "midbody_width")
    return one.select(r6(F.col("max_average_length")).alias("max_average_length"), "crop_size")


def _profile_sql() -> str:
    n, h, m, t = 50, 5, 25, 45
    return f"""WITH {WIDTHS}, a AS (SELECT video, avg(CASE WHEN NOT isnan(head_width) THEN head_width END) AS h, avg(CASE WHEN NOT isnan(midbody_width) THEN midbody_width END) AS m,
avg(CASE WHEN NOT isnan(tail_width) THEN tail_width END) AS t FROM widths GROUP BY video)
SELECT video, CAST(i AS INTEGER) AS i, round(CASE WHEN i < {h} THEN h WHEN i < {m} THEN h + (m - h) * (i - {h}) / {m - h - 1}.0 WHEN i < {t} THEN m + (t - m) * (i - {m}) / {t - m - 1}.0 ELSE t END, 6) AS width FROM a, range({n}) AS r(i)"""


@query(_profile_sql())
def width_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = aggregations.video_means(widths(spark, sf_dir), ["head_width", "midbody_width", "tail_width"])
    profile = A.width_profile(F.col("head_width"), F.col("midbody_width"), F.col("tail_width"), 50)
    return means.select("video", F.posexplode(profile).alias("i", "w")).select("video", "i", r6(F.col("w")).alias("width"))


# --- runs, segments, resampling, smoothing


_VALID_RUNS = f"""WITH {SERIES}, g AS (SELECT video, frame_index, frame_index - row_number() OVER (PARTITION BY video ORDER BY frame_index) AS island FROM series WHERE valid)
SELECT video, CAST(min(frame_index) AS INTEGER) AS run_start, CAST(max(frame_index) + 1 AS INTEGER) AS run_end FROM g GROUP BY video, island"""


@query(_VALID_RUNS)
def valid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.valid_runs(series(spark, sf_dir), F.col("valid"))


def _segments_sql(max_gap: int, min_run: int) -> str:
    def islands(source: str, flag: str, name: str) -> str:
        return f"""{name}_g AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_index) - row_number() OVER (PARTITION BY video, {flag} ORDER BY frame_index) AS isl FROM {source}),
{name} AS (SELECT * EXCLUDE (isl), count(*) OVER (PARTITION BY video, {flag}, isl) AS {name}_n, isl AS {name}_isl FROM {name}_g)"""

    return f"""WITH {SERIES}, {islands('series', 'valid', 'a')}, b0 AS (SELECT *, valid AND a_n >= {min_run} AS big FROM a), {islands('b0', 'big', 'b')},
c0 AS (SELECT *, NOT big AND b_n > {max_gap} AS cut FROM b), {islands('c0', 'cut', 'c')}
SELECT video, CAST(min(frame_index) AS INTEGER) AS segment_start, CAST(max(frame_index) + 1 AS INTEGER) AS segment_end, CAST(count(*) FILTER (valid) AS BIGINT) AS n_valid FROM c WHERE NOT cut GROUP BY video, c_isl"""


@query(_segments_sql(timeseries.MAX_GAP, timeseries.MIN_SEGMENT))
def valid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: stretches of each video that are usable once small gaps are bridged."""
    return timeseries.valid_segments(series(spark, sf_dir), F.col("valid"))


@query(f"""WITH {SERIES}, d AS (SELECT video, tick, arg_max(angle, frame_index) AS angle FROM series GROUP BY video, tick),
b AS (SELECT video, min(tick) AS lo, max(tick) AS hi FROM series GROUP BY video), e AS (SELECT video, lo, unnest(range(0, hi - lo + 1)) AS t FROM b)
SELECT e.video, CAST(e.t AS INTEGER) AS t, round(d.angle, 6) AS angle FROM e LEFT JOIN d ON d.video = e.video AND d.tick = e.t + e.lo""")
def dense_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.dense_resample(series(spark, sf_dir), ["angle"]).select("video", "t", r6(F.col("angle")).alias("angle"))


_UNWRAP = """fix AS (SELECT *, a - lag(a) OVER w AS dd FROM {source} WINDOW w AS (PARTITION BY video ORDER BY {order})),
m AS (SELECT *, CASE WHEN abs(dd) < {pi} OR dd IS NULL THEN 0.0::DOUBLE ELSE (CASE WHEN (dd + {pi}) - 2 * {pi} * floor((dd + {pi}) / (2 * {pi})) - {pi} = -{pi} AND dd > 0 THEN {pi} ELSE (dd + {pi}) - 2 * {pi} * floor((dd + {pi}) / (2 * {pi})) - {pi} END) - dd END AS c FROM fix),
u AS (SELECT *, a + sum(c) OVER (PARTITION BY video ORDER BY {order}) AS unwrapped FROM m)"""


@query(f"""WITH {SERIES}, v AS (SELECT video, frame_index, angle AS a FROM series WHERE valid), {_UNWRAP.format(source='v', order='frame_index', pi=PI)}
SELECT video, frame_index, round(unwrapped, 6) + 0.0 AS unwrapped FROM u""")
def phase_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeseries.unwrap(series(spark, sf_dir).filter("valid"), "angle", ["video"], ["frame_index"])
    return rows.select("video", "frame_index", r6(F.col("unwrapped")).alias("unwrapped"))


@query(f"""WITH {poses_sql(12.0)}, v AS (SELECT video, t, unnest(theta) AS a, unnest(range(len(theta))) AS dim FROM poses), {_UNWRAP.format(source='v', order='t, dim', pi=PI)}
SELECT video, t, CAST(dim AS INTEGER) AS dim, round(unwrapped, 6) + 0.0 AS unwrapped FROM u""")
def frame_major_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeseries.frame_major_unwrap(poses(spark, sf_dir, 12.0))
    return rows.select("video", "t", "dim", r6(F.col("unwrapped")).alias("unwrapped"))


def _weights(place: int, over: str) -> str:
    return " + ".join(f"({float(w)!r}) * lead(angle, {j - place}) OVER {over}" if j >= place else f"({float(w)!r}) * lag(angle, {place - j}) OVER {over}" for j, w in enumerate(savgol_weights(9, 3)[place]))


@query(f"""WITH {SERIES}, s AS (SELECT video, frame_index, {_weights(4, 'w')} AS v FROM series WINDOW w AS (PARTITION BY video ORDER BY frame_index))
SELECT video, frame_index, round(v, 6) + 0.0 AS smoothed FROM s WHERE v IS NOT NULL""")
def savgol_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("video"))
    inner = timeseries.smooth(rows.withColumn("n", n), "angle", keys=["video"]).filter("frame_index >= 4 and frame_index < n - 4")
    return inner.select("video", "frame_index", r6(F.col("smoothed")).alias("smoothed"))


def _full_sql() -> str:
    ends = " ".join(f"WHEN p = {k} THEN {_weights(k, 'w')}" for k in range(4)) + " " + " ".join(f"WHEN p = n - {k + 1} THEN {_weights(8 - k, 'w')}" for k in range(4))
    return f"""WITH {SERIES}, g AS (SELECT video, frame_index, angle, frame_index - row_number() OVER (PARTITION BY video ORDER BY frame_index) AS isl FROM series WHERE valid),
r AS (SELECT *, row_number() OVER (PARTITION BY video, isl ORDER BY frame_index) - 1 AS p, count(*) OVER (PARTITION BY video, isl) AS n FROM g),
s AS (SELECT video, frame_index, n, CASE {ends} ELSE {_weights(4, 'w')} END AS v FROM r WINDOW w AS (PARTITION BY video, isl ORDER BY frame_index))
SELECT video, frame_index, round(v, 6) + 0.0 AS smoothed FROM s WHERE n >= 9"""


@query(_full_sql())
def savgol_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    runs = timeseries.valid_runs(rows, F.col("valid")).select("video", F.col("run_start").alias("segment_start"), F.col("run_end").alias("segment_end"))
    smoothed = timeseries.smooth(timeseries.in_segments(rows, runs), "angle", bounds=("segment_start", "segment_end")).filter("smoothed is not null")
    return smoothed.select("video", "frame_index", r6(F.col("smoothed")).alias("smoothed"))


@query()
def spline_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps inside usable segments filled by splines through the unwrapped valid samples."""
    rows = series(spark, sf_dir)
    segments = timeseries.valid_segments(rows, F.col("valid"))
    unwrapped = timeseries.unwrap(rows.filter("valid"), "angle", ["video"], ["frame_index"]).select("video", "frame_index", "unwrapped")
    inside = timeseries.in_segments(rows.select("video", "frame_index", "valid"), segments).join(unwrapped, ["video", "frame_index"], "left")
    filled = timeseries.spline_fill(inside, "unwrapped")
    return filled.select("video", "frame_index", "valid", r6(F.col("filled")).alias("filled"))


_CUBIC = "0.4 * pow(f / 100.0, 3) - 1.5 * pow(f / 100.0, 2) + f / 100.0"


def _inside_sql() -> str:
    """CTE inside: frames of usable segments from their first valid frame to their last."""
    cut = _segments_sql(timeseries.MAX_GAP, timeseries.MIN_SEGMENT).rpartition("\nSELECT video,")[0]
    return cut + """, k AS (SELECT video, frame_index, valid, min(CASE WHEN valid THEN frame_index END) OVER w AS lo, max(CASE WHEN valid THEN frame_index END) OVER w AS hi,
  count(*) FILTER (valid) OVER w AS n FROM c WHERE NOT cut WINDOW w AS (PARTITION BY video, c_isl)),
inside AS (SELECT video, frame_index, CASE WHEN n >= 4 AND frame_index BETWEEN lo AND hi THEN frame_index END AS f FROM k)"""


@query(_inside_sql() + f" SELECT video, frame_index, round({_CUBIC}, 6) + 0.0 AS filled FROM inside")
def spline_fill_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled by splines through samples of a cubic, which they must give back."""
    rows = series(spark, sf_dir)
    x = F.col("frame_index") / 100.0
    value = F.when(F.col("valid"), 0.4 * F.pow(x, 3) - 1.5 * F.pow(x, 2) + x)
    inside = timeseries.in_segments(rows.select("video", "frame_index", "valid", value.alias("value")), timeseries.valid_segments(rows, F.col("valid")))
    return timeseries.spline_fill(inside, "value").select("video", "frame_index", r6(F.col("filled")).alias("filled"))


@query(_inside_sql() + " SELECT video, CAST(frame_index AS INTEGER) AS t, CAST(d AS INTEGER) AS dim, round(CAST(0.1 AS DOUBLE) * d + CAST(0.005 AS DOUBLE) * f, 6) + 0.0 AS interp FROM inside, (SELECT unnest(range(6)) AS d) WHERE f IS NOT NULL")
def post_processed_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole post-processing of angles that turn evenly: filled gaps lie on the line."""
    theta = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda d: 0.1 * d + 0.005 * F.col("frame_index"))
    rows = series(spark, sf_dir).select("video", F.col("frame_index").alias("t"), F.when(F.col("valid"), theta).alias("theta"))
    out = commands.post_process(rows).filter("interp is not null")
    return out.select("video", "t", F.posexplode("interp").alias("dim", "v")).select("video", "t", "dim", r6(F.col("v")).alias("interp"))


# --- joins in time


@query(f"""WITH {SERIES}, l AS (SELECT video, frame_index AS template FROM series WHERE event_type = 'purchase')
SELECT s.video, s.frame_index, arg_min(l.template, abs(l.template - s.frame_index)::BIGINT * 100000000 + l.template) AS template FROM series s LEFT JOIN l ON l.video = s.video GROUP BY s.video, s.frame_index""")
def nearest_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.nearest_template(series(spark, sf_dir), F.col("event_type") == "purchase").select("video", "frame_index", "template")


@query(f"""WITH {SERIES}, f AS (SELECT video, tick, arg_min(angle, frame_index) AS angle, min(frame_index) AS first_position FROM series WHERE event_type <> 'view' GROUP BY video, tick)
SELECT s.video, s.frame_index, round(f.angle, 6) AS angle, f.first_position FROM series s LEFT JOIN f USING (video, tick)""")
def exact_ts_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    features = rows.filter("event_type <> 'view'").select("video", F.col("tick").alias("ts"), "angle", F.col("frame_index").alias("position"))
    frames = rows.select("video", "frame_index", F.col("tick").alias("ts"))
    aligned = alignment.exact_align(frames, features, ["angle", "position"])
    return aligned.select("video", "frame_index", r6(F.col("angle")).alias("angle"), F.col("position").alias("first_position"))


@query(f"""WITH {SERIES} SELECT video, event_type, CAST(min(frame_index) AS INTEGER) AS first_position FROM series GROUP BY video, event_type""")
def first_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.first_positions(series(spark, sf_dir), "event_type", "frame_index")


@query(f"""WITH {SERIES}, b AS (SELECT video, min(tick) AS lo, max(tick) AS hi FROM series GROUP BY video), e AS (SELECT video, lo, unnest(range(0, hi - lo + 1)) AS t FROM b)
SELECT e.video, CAST(e.t AS INTEGER) AS t, s.frame_index FROM e JOIN series s ON s.video = e.video AND s.tick - e.lo = e.t""")
def tick_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    ticks = timeseries.dense_resample(rows, ["angle"]).select("video", "t")
    return alignment.tick_lookup(ticks, rows.select("video", "tick", "frame_index")).select("video", "t", "frame_index")


@query(f"""WITH {poses_sql()}, p AS (SELECT video, t, theta, lead(theta) OVER (PARTITION BY video ORDER BY t) AS label FROM poses),
d AS (SELECT video, t, {_distance('theta', 'label')} AS d0, {_distance(f'list_transform(list_reverse(theta), lambda a: a + {PI})', 'label')} AS d1 FROM p WHERE label IS NOT NULL)
SELECT video, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (d1 < d0) AS BIGINT) AS n_flipped, round(degrees(avg(least(d0, d1))), 6) AS mean_error_degrees FROM d GROUP BY video""")
def closest_flip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.lead("theta").over(Window.partitionBy("video").orderBy("t"))
    rows = poses(spark, sf_dir).select("video", "theta", label.alias("label")).filter("label is not null")
    best = rows.select("video", alignment.closest_flip(F.col("theta"), F.col("label")).alias("b"))
    return best.groupBy("video").agg(F.count("*").alias("n"), F.count_if(F.col("b.k") == 1).alias("n_flipped"), r6(F.degrees(F.avg("b.distance"))).alias("mean_error_degrees"))


_MEAN_SQUARE = "list_avg(list_transform(list_zip({a}, {b}), lambda z: pow({w}, 2)))"


@query(f"""WITH {poses_sql()}, p AS (SELECT video, t, theta, lead(theta) OVER (PARTITION BY video ORDER BY t) AS l FROM poses)
SELECT video, round(avg(least(sqrt({_MEAN_SQUARE.format(a='theta', b='l', w=_wrapped('z[1]', 'z[2]'))}), sqrt({_MEAN_SQUARE.format(a='theta', b=f'list_transform(list_reverse(l), lambda a: a + {PI})', w=_wrapped('z[1]', 'z[2]'))}))), 6) AS loss FROM p WHERE l IS NOT NULL GROUP BY video""")
def symmetric_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.lead("theta").over(Window.partitionBy("video").orderBy("t"))
    rows = poses(spark, sf_dir).select("video", "theta", label.alias("l")).filter("l is not null")
    return rows.groupBy("video").agg(r6(F.avg(A.symmetric_loss(F.col("theta"), F.col("l"), A.flip(F.col("l"))))).alias("loss"))


# --- head and tail


def _frames(spark: SparkSession, sf_dir: str, factor: float) -> DataFrame:
    return poses(spark, sf_dir, factor).select("video", "t", "vec_id", "theta0", "theta1", F.col("score").alias("score0"), F.col("score").alias("score1"))


LOOK_BACK = headtail.frames_of(headtail.LOOK_BACK_S, FRAME_RATE)


def _fold_sql(factor: float) -> str:
    return f"""WITH RECURSIVE {poses_sql(factor)}, good AS (SELECT video, t, theta0, theta1, row_number() OVER (PARTITION BY video ORDER BY t) AS n FROM poses WHERE score >= {headtail.SCORE_THRESHOLD}),
fold AS (SELECT video, n, t, 0 AS segment, 0 AS k, true AS accepted, theta0 AS anchor, t AS anchor_t FROM good WHERE n = 1
UNION ALL SELECT g.video, g.n, g.t, CASE WHEN x.opens THEN f.segment + 1 ELSE f.segment END, CASE WHEN x.opens OR x.d0 <= x.d1 THEN 0 ELSE 1 END,
  x.opens OR least(x.d0, x.d1) < {headtail.MAX_ANGLE!r}, CASE WHEN x.opens THEN g.theta0 WHEN least(x.d0, x.d1) < {headtail.MAX_ANGLE!r} THEN CASE WHEN x.d1 < x.d0 THEN g.theta1 ELSE g.theta0 END ELSE f.anchor END,
  CASE WHEN x.opens OR least(x.d0, x.d1) < {headtail.MAX_ANGLE!r} THEN g.t ELSE f.anchor_t END
  FROM fold f JOIN good g ON g.video = f.video AND g.n = f.n + 1,
  LATERAL (SELECT g.t - f.anchor_t > {LOOK_BACK} AS opens, {_distance('g.theta0', 'f.anchor')} AS d0, {_distance('g.theta1', 'f.anchor')} AS d1) x),
parts AS (SELECT video, t, segment, k FROM fold WHERE accepted)"""


@query(_fold_sql(4.0) + " SELECT video, t, CAST(segment AS INTEGER) AS segment, CAST(k AS INTEGER) AS k FROM parts")
def continuous_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headtail.continuous_partitions(_frames(spark, sf_dir, 4.0), FRAME_RATE)


_LONG = f", long AS (SELECT *, count(*) OVER (PARTITION BY video, segment) AS n FROM parts QUALIFY n >= {headtail.frames_of(headtail.MIN_SEGMENT_S, FRAME_RATE)})"


@query(_fold_sql(3.0) + _LONG + " SELECT video, CAST(segment AS INTEGER) AS segment, CAST(min(t) AS INTEGER) AS first_t, CAST(max(t) AS INTEGER) AS last_t, CAST(count(*) AS BIGINT) AS n_frames FROM long GROUP BY video, segment")
def short_segment_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = headtail.continuous_partitions(_frames(spark, sf_dir, 3.0), FRAME_RATE)
    return headtail.segments_of(headtail.drop_short(parts, FRAME_RATE))


def _inputs(spark: SparkSession, sf_dir: str, factor: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """frames, skeletons in candidate order, and labels: true orientations of every second vector."""
    rows = poses(spark, sf_dir, factor)
    body = lambda c: A.skeleton_from_theta(F.col(c), F.lit(BODY))
    skeletons = rows.select("video", "t", body("theta0").alias("skeleton0"), body("theta1").alias("skeleton1"))
    labels = rows.filter("vec_id % 2 = 0").select("video", "t", body("theta").alias("label"))
    return _frames(spark, sf_dir, factor), skeletons, labels


def _stored(parts: DataFrame, skeletons: DataFrame) -> DataFrame:
    first = F.when(F.col("k") == 0, F.col("skeleton0")).otherwise(F.col("skeleton1"))
    other = F.when(F.col("k") == 0, F.col("skeleton1")).otherwise(F.col("skeleton0"))
    return skeletons.join(parts, ["video", "t"]).select("video", "t", first.alias("skeleton0"), other.alias("skeleton1"))


def _vector(theta: str) -> str:
    return f"[list_sum(list_transform({theta}[2:], lambda a: cos(a))), list_sum(list_transform({theta}[2:], lambda a: sin(a)))]"


def _cosine(a: str, b: str) -> str:
    return f"({a}[1] * {b}[1] + {a}[2] * {b}[2]) / (sqrt({a}[1] * {a}[1] + {a}[2] * {a}[2]) * sqrt({b}[1] * {b}[1] + {b}[2] * {b}[2]))"


_ALIGNED = f""", v AS (SELECT l.video, l.t, l.segment, {_vector('CASE WHEN l.k = 0 THEN p.theta0 ELSE p.theta1 END')} AS c0, {_vector('CASE WHEN l.k = 0 THEN p.theta1 ELSE p.theta0 END')} AS c1,
  CASE WHEN p.vec_id % 2 = 0 THEN {_vector('p.theta')} END AS b FROM long l JOIN poses p USING (video, t)),
cs AS (SELECT video, segment, CAST(count(b) AS BIGINT) AS n_labelled, avg({_cosine('c0', 'b')}) AS cos0, avg({_cosine('c1', 'b')}) AS cos1, min(t) AS first_t, max(t) AS last_t FROM v GROUP BY video, segment),
al AS (SELECT *, CASE WHEN n_labelled > {headtail.MIN_LABELLED} AND cos0 * cos1 < 0 THEN CASE WHEN cos1 > cos0 THEN 1 ELSE 0 END END AS alignment FROM cs)"""


@query(_fold_sql(3.0) + _LONG + _ALIGNED + " SELECT video, CAST(segment AS INTEGER) AS segment, n_labelled, round(cos0, 6) + 0.0 AS cos0, round(cos1, 6) + 0.0 AS cos1, CAST(alignment AS INTEGER) AS alignment FROM al")
def label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, skeletons, labels = _inputs(spark, sf_dir, 3.0)
    parts = headtail.drop_short(headtail.continuous_partitions(frames, FRAME_RATE), FRAME_RATE)
    table = headtail.align_with_labels(parts, _stored(parts, skeletons), labels)
    return table.select("video", "segment", "n_labelled", r6(F.col("cos0")).alias("cos0"), r6(F.col("cos1")).alias("cos1"), "alignment")


@query(f"""WITH {SERIES}, g AS (SELECT video, frame_index, event_type, angle, frame_index - row_number() OVER (PARTITION BY video ORDER BY frame_index) AS isl FROM series WHERE valid),
s AS (SELECT video, min(frame_index) AS first_t, max(frame_index) AS last_t, CASE WHEN count(*) FILTER (event_type = 'purchase') >= 2 THEN CAST(min(frame_index) % 2 AS INTEGER) END AS alignment FROM g GROUP BY video, isl),
n AS (SELECT *, CASE WHEN lag(alignment) OVER w IS NOT NULL THEN first_t - lag(last_t) OVER w END AS b, CASE WHEN lead(alignment) OVER w IS NOT NULL THEN lead(first_t) OVER w - last_t END AS a FROM s WINDOW w AS (PARTITION BY video ORDER BY first_t))
SELECT video, CAST(first_t AS INTEGER) AS first_t, CAST(last_t AS INTEGER) AS last_t, CASE WHEN alignment IS NULL THEN CAST(least(b, a) AS INTEGER) END AS gap,
CASE WHEN alignment IS NOT NULL OR (a IS NULL AND b IS NULL) THEN NULL WHEN b IS NULL OR a < b THEN 1 ELSE -1 END AS side FROM n""")
def adjacent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    runs = timeseries.valid_runs(rows, F.col("valid")).select("video", F.col("run_start").alias("segment_start"), F.col("run_end").alias("segment_end"))
    found = timeseries.in_segments(rows, runs).groupBy("video", "segment_start").agg(F.max("frame_index").alias("last_t"), F.count_if(F.col("event_type") == "purchase").alias("n"))
    segments = found.select("video", F.col("segment_start").alias("first_t"), "last_t", F.when(F.col("n") >= 2, F.col("segment_start") % 2).alias("alignment"))
    return headtail.adjacent_gaps(segments).select("video", "first_t", "last_t", "gap", "side")


@query(f"""WITH {SERIES}, s AS (SELECT video, CASE WHEN NOT valid THEN 'NaN'::DOUBLE ELSE angle / 1000 END AS a, CASE WHEN NOT valid THEN 'NaN'::DOUBLE ELSE angle / 900 END AS b FROM series)
SELECT video, bool_and(isnan(a) AND isnan(b)) AS all_missing, CASE WHEN bool_or(isnan(b)) THEN NULL ELSE round(max(b), 6) END AS best_score,
NOT bool_and(isnan(a) AND isnan(b)) AND (bool_or(isnan(b)) OR max(b) >= 0.5) AS resolvable FROM s GROUP BY video""")
def score_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.when(~F.col("valid"), A.nan())
    rows = series(spark, sf_dir).select("video", missing.otherwise(F.col("angle") / 1000).alias("score0"), missing.otherwise(F.col("angle") / 900).alias("score1"))
    return headtail.score_guard(rows, 0.5).select("video", "all_missing", r6(F.col("best_score")).alias("best_score"), "resolvable")


_SPREAD = f""", ends AS (SELECT video, segment, min(t) AS f, max(t) AS l, arg_min(c0, t) AS f0, arg_min(c1, t) AS f1, arg_max(c0, t) AS l0, arg_max(c1, t) AS l1 FROM v GROUP BY video, segment),
segs AS (SELECT video, list(segment ORDER BY f) AS s, list(alignment ORDER BY f) AS a, list(f ORDER BY f) AS f, list(l ORDER BY f) AS l, list(f0 ORDER BY f) AS f0, list(f1 ORDER BY f) AS f1,
  list(l0 ORDER BY f) AS l0, list(l1 ORDER BY f) AS l1 FROM ends JOIN (SELECT video, segment, alignment FROM al) USING (video, segment) GROUP BY video),
spread AS (SELECT video, a, 0 AS step FROM segs
UNION ALL SELECT video, list_transform(range(1, len(r.a) + 1), lambda j: CASE WHEN j <> x.b.i THEN r.a[j] WHEN
  {_cosine('(CASE WHEN x.b.d < 0 THEN s.f1[x.b.i] ELSE s.l1[x.b.i] END)', '(CASE WHEN x.b.d < 0 THEN CASE WHEN r.a[x.b.i - 1] = 0 THEN s.l0[x.b.i - 1] ELSE s.l1[x.b.i - 1] END ELSE CASE WHEN r.a[x.b.i + 1] = 0 THEN s.f0[x.b.i + 1] ELSE s.f1[x.b.i + 1] END END)')}
  > {_cosine('(CASE WHEN x.b.d < 0 THEN s.f0[x.b.i] ELSE s.l0[x.b.i] END)', '(CASE WHEN x.b.d < 0 THEN CASE WHEN r.a[x.b.i - 1] = 0 THEN s.l0[x.b.i - 1] ELSE s.l1[x.b.i - 1] END ELSE CASE WHEN r.a[x.b.i + 1] = 0 THEN s.f0[x.b.i + 1] ELSE s.f1[x.b.i + 1] END END)')} THEN 1 ELSE 0 END), r.step + 1
  FROM spread r JOIN segs s USING (video), LATERAL (SELECT list_sort(list_filter(flatten(list_transform(range(1, len(r.a) + 1), lambda i: CASE WHEN r.a[i] IS NOT NULL THEN [] ELSE [
    CASE WHEN i > 1 AND r.a[i - 1] IS NOT NULL THEN {{'g': s.f[i] - s.l[i - 1], 'i': i, 'd': -1}} END, CASE WHEN i < len(r.a) AND r.a[i + 1] IS NOT NULL THEN {{'g': s.f[i + 1] - s.l[i], 'i': i, 'd': 1}} END] END)),
    lambda y: y IS NOT NULL AND y.g <= {headtail.frames_of(headtail.MAX_SPREAD_S, FRAME_RATE)}))[1] AS b) x WHERE x.b IS NOT NULL),
final AS (SELECT video, unnest(segs.s) AS segment, unnest(w.a) AS alignment FROM (SELECT video, arg_max(a, step) AS a FROM spread GROUP BY video) w JOIN segs USING (video)),
chosen AS (SELECT video, t, segment, xor(CAST(k AS INTEGER), CAST(alignment AS INTEGER)) AS k FROM long JOIN final USING (video, segment) WHERE alignment IS NOT NULL),
resolved AS (SELECT p.video, p.t, segment, CASE WHEN score >= {headtail.SCORE_THRESHOLD} THEN k END AS k, CASE WHEN k IS NOT NULL AND score >= {headtail.SCORE_THRESHOLD} THEN score END AS score
  FROM poses p LEFT JOIN chosen c ON c.video = p.video AND c.t = p.t)"""


@query(_fold_sql(3.0) + _LONG + _ALIGNED + _SPREAD + " SELECT video, t, CAST(segment AS INTEGER) AS segment, CAST(k AS INTEGER) AS k, round(score, 6) AS score FROM resolved")
def resolve_headtail(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = headtail.resolve(*_inputs(spark, sf_dir, 3.0), FRAME_RATE)
    return resolved.select("video", "t", "segment", "k", r6(F.col("score")).alias("score"))


@query(_fold_sql(3.0) + _LONG + _ALIGNED + _SPREAD + """, n AS (SELECT video, count(*) AS n_frames, count(k) AS n_resolved FROM resolved GROUP BY video), b AS (SELECT video, count(*) AS n_labelled FROM poses WHERE vec_id % 2 = 0 GROUP BY video)
SELECT video, n_frames, n_resolved, coalesce(n_labelled, 0) AS n_labelled, round(100 * n_resolved / n_frames, 4) AS resolved_percent, round(100 * coalesce(n_labelled, 0) / n_frames, 4) AS labelled_percent FROM n LEFT JOIN b USING (video)""")
def resolution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _inputs(spark, sf_dir, 3.0)
    return headtail.resolution_stats(headtail.resolve(*inputs, FRAME_RATE), inputs[2])


# --- filters, selections, means


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def video_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups only; the filter reaches the scan."""
    from ..sources.readers import select_videos

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return select_videos(orders, ["1-URGENT", "5-LOW"], "o_orderpriority").select("o_orderkey", "o_custkey")


@query(f"""WITH {SERIES} SELECT DISTINCT video FROM series""")
def video_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video")).distinct()


@query(f"""WITH {poses_sql()}, s AS (SELECT video, t, score AS s0, CASE WHEN vec_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE score / 2 END AS s1 FROM poses)
SELECT video, t, round(greatest(s0, s1), 6) AS best FROM s WHERE NOT isnan(s0) AND NOT isnan(s1) AND greatest(s0, s1) >= {headtail.SCORE_THRESHOLD}""")
def early_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses(spark, sf_dir).select("video", "t", F.col("score").alias("score0"), F.when(F.col("vec_id") % 5 == 0, A.nan()).otherwise(F.col("score") / 2).alias("score1"))
    return headtail.passing(rows).select("video", "t", r6(F.greatest("score0", "score1")).alias("best"))


@query(f"""WITH {poses_sql()}, s AS (SELECT video, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE greatest(score, score / 2) END AS best FROM poses)
SELECT video, round(avg(best), 6) AS mean_score, CAST(count(*) FILTER (best >= {headtail.SCORE_THRESHOLD}) AS BIGINT) AS n_good, count(*) AS n FROM s GROUP BY video""")
def mean_best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses(spark, sf_dir).select("video", F.when(F.col("vec_id") % 5 == 0, A.nan()).otherwise(F.greatest(F.col("score"), F.col("score") / 2)).alias("best"))
    good = F.count_if(~F.isnan("best") & (F.col("best") >= headtail.SCORE_THRESHOLD))
    return rows.groupBy("video").agg(r6(nan_mean(F.col("best"))).alias("mean_score"), good.alias("n_good"), F.count("*").alias("n"))


@query(f"""WITH {WIDTHS}, m AS (SELECT video, avg(CASE WHEN NOT isnan(midbody_width) THEN midbody_width END) AS m FROM widths GROUP BY video)
SELECT l_orderkey, l_linenumber, round(l_quantity / m, 6) AS relative_width FROM lineitem JOIN m ON video = l_suppkey WHERE l_returnflag <> 'R'""")
def template_mean_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled frame beside the means of its video."""
    means = aggregations.video_means(widths(spark, sf_dir), ["midbody_width"]).withColumnRenamed("video", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag").filter("l_returnflag <> 'R'")
    return lines.join(means, "l_suppkey").select("l_orderkey", "l_linenumber", r6(F.col("l_quantity") / F.col("midbody_width")).alias("relative_width"))


@query("""SELECT p_partkey, CAST(floor(0.1::DOUBLE * p_size) AS INTEGER) AS head, CAST(floor(0.5::DOUBLE * p_size) AS INTEGER) AS middle, CAST(floor(0.9::DOUBLE * p_size) AS INTEGER) AS tail FROM part""")
def joint_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    joints = A.joint_indexes(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", *[joints[i].alias(n) for i, n in enumerate(("head", "middle", "tail"))])


@query()
def resampled_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic resampling of skeletons to 30 points."""
    rows = _skeletons(spark, sf_dir).select("video", "t", F.posexplode(resample_skeleton(F.col("skeleton"), 29)).alias("i", "p"))
    return rows.select("video", "t", "i", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@query()
def post_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled, angles unwrapped, smoothed and projected on modes, a row a frame and mode."""
    rows = poses(spark, sf_dir).select("video", "t", F.when(F.col("vec_id") % 11 != 0, F.col("theta")).alias("theta"))
    out = commands.post_process(rows, basis=cosine_basis(64, MODES))
    return out.filter("smooth is not null").select("video", "t", F.posexplode("modes_smooth").alias("mode", "c")).select("video", "t", "mode", r6(F.col("c")).alias("coefficient"))


# --- sampling, ranking, counting


@query()
def evaluation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames spread evenly over videos, then at random within each."""
    return sampling.two_stage_sample(series(spark, sf_dir).select("video", "frame_index"), 1000, 7)


@query()
def template_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with replacement for each event: one of its user's frames as a template, and whether it is turned, by hash of the event's number."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    return rows.join(sizes, "user_id").select(F.col("event_id").alias("id"), sampling.choice(7, F.col("n"), "event_id").alias("template"), sampling.choice(8, 2, "event_id").alias("turned"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS name, o_totalprice AS val_loss FROM orders ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR) DESC LIMIT 5""")
def best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.best_models(losses(spark, sf_dir))


@query(f"""WITH {SERIES} SELECT video, frame_index, round(angle, 6) AS angle FROM series QUALIFY row_number() OVER (PARTITION BY video ORDER BY angle, frame_index) <= 10""")
def sample_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_group(series(spark, sf_dir), 10, ["video"], ["angle", "frame_index"]).select("video", "frame_index", r6(F.col("angle")).alias("angle"))


@query(f"""WITH {SERIES}, c AS (SELECT video, count(*) AS n FROM series GROUP BY video)
SELECT video, n, CAST(least(greatest(least(1000, 500000 // 8) // (SELECT count(*) FROM c), 1), n) AS INTEGER) AS quota FROM c""")
def template_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.template_quota(series(spark, sf_dir).groupBy("video").agg(F.count("*").alias("n")), 500_000, 8)


@query(f"""WITH {SERIES}, v AS (SELECT angle / 10 - 15 AS a FROM series), b AS (SELECT i, -30.0::DOUBLE + i * (60.0::DOUBLE / 99) AS lo FROM range(100) AS r(i))
SELECT CAST(i AS INTEGER) AS bin, count(*) AS n FROM v JOIN b ON a >= lo AND a <= lo + 0.6::DOUBLE GROUP BY i""")
def bin_stratified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = series(spark, sf_dir).select((F.col("angle") / 10 - 15).alias("a"))
    return sampling.stratified_bins(values, "a").groupBy("bin").agg(F.count("*").alias("n"))


@query(f"""WITH {poses_sql()}, b AS (SELECT CAST(least(floor((score - 0.5) / 0.01), 49) AS INTEGER) AS bin FROM poses WHERE score BETWEEN 0.5 AND 1.0)
SELECT bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * 0.01), 6) AS density FROM b GROUP BY bin""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregations.histogram(poses(spark, sf_dir), "score", 0.5, 1.0, 50).select("bin", "n", r6(F.col("density")).alias("density"))


@query(f"""WITH {SERIES} SELECT video, round(quantile_cont(angle, 0.975), 6) AS cut FROM series GROUP BY video""")
def percentile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregations.percentile_cut(series(spark, sf_dir), "angle", 97.5, ["video"]).select("video", r6(F.col("cut")).alias("cut"))


@query(f"""WITH {SERIES} SELECT video, CAST(frame_index // 16 AS INTEGER) AS chunk, count(*) AS n FROM series GROUP BY video, frame_index // 16""")
def chunk_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("video", sampling.chunk(F.col("frame_index"), 16).alias("chunk")).agg(F.count("*").alias("n"))


@query(f"""WITH {SERIES} SELECT video, frame_index FROM series WHERE frame_index % 2 = 0""")
def every_other_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.every_other(series(spark, sf_dir), ["frame_index"], ["video"]).select("video", "frame_index")


@query(f"""WITH {SERIES}, r AS (SELECT video, frame_index, row_number() OVER (PARTITION BY video ORDER BY angle, frame_index) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM series)
SELECT video, frame_index FROM r WHERE i % greatest(1, n // 4) = 0 OR i = n - 1""")
def representative_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.representatives(series(spark, sf_dir), 5, "angle", "frame_index", ["video"]).select("video", "frame_index")


@query(f"""WITH {poses_sql()}, m AS (SELECT video, i, avg(a) AS a FROM (SELECT video, unnest(theta) AS a, unnest(range(len(theta))) AS i FROM poses) GROUP BY video, i),
d AS (SELECT video, abs(lead(a) OVER (PARTITION BY video ORDER BY i) - a) AS d FROM m) SELECT video AS component, round(sum(d), 6) AS curvature FROM d GROUP BY video""")
def curvature_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = poses(spark, sf_dir).select("video", F.posexplode("theta").alias("i", "a")).groupBy("video", "i").agg(F.avg("a").alias("a"))
    means = flat.groupBy(F.col("video").alias("component")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("mean"))
    return aggregations.curvature_order(means).select("component", r6(F.col("curvature")).alias("curvature"))


# --- pixels


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel for each part of an order: a 50 x 32 image a supplier, brighter with the price."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity")
    place = lines.groupBy(F.col("l_suppkey").alias("video"), (F.col("l_quantity").cast("int") - 1).alias("x"), (F.col("l_partkey") % 32).cast("int").alias("y"))
    return place.agg((F.max("l_orderkey") % 256).cast("int").alias("value")).select("*", F.lit(0).alias("frame_index"), F.lit(32).alias("height"), F.lit(50).alias("width"))


_PIXELS = """pixels AS (SELECT l_suppkey AS video, CAST(l_quantity AS INTEGER) - 1 AS x, CAST(l_partkey % 32 AS INTEGER) AS y, CAST(max(l_orderkey) % 256 AS INTEGER) AS value FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {_PIXELS} SELECT video, coalesce(greatest(min(y) FILTER (value > 200) - 2, 0), 0) AS y0, coalesce(least(max(y) FILTER (value > 200) + 3, 32), 32) AS y1,
coalesce(greatest(min(x) FILTER (value > 200) - 2, 0), 0) AS x0, coalesce(least(max(x) FILTER (value > 200) + 3, 50), 50) AS x1 FROM pixels GROUP BY video""")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregations.bounding_box(_pixels(spark, sf_dir), F.col("value") > 200).drop("frame_index")


@query(f"""WITH {_PIXELS} SELECT video, CAST(floor(avg(value) FILTER (value <= 200)) AS INTEGER) AS background, min(y) FILTER (value > 200) AS y0, max(y) FILTER (value > 200) AS y1,
min(x) FILTER (value > 200) AS x0, max(x) FILTER (value > 200) AS x1 FROM pixels GROUP BY video""")
def background_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregations.background_and_roi(_pixels(spark, sf_dir), F.col("value") > 200).drop("frame_index")


_OTSU = f"""{_PIXELS}, bins AS (SELECT video, value, count(*) AS n FROM pixels WHERE value > 0 GROUP BY ALL),
sums AS (SELECT video, value, sum(n) OVER w AS below, sum(n * value) OVER w AS mass, sum(n) OVER (PARTITION BY video) AS all_n, sum(n * value) OVER (PARTITION BY video) AS all_mass FROM bins WINDOW w AS (PARTITION BY video ORDER BY value)),
between_classes AS (SELECT video, value, CASE WHEN below < all_n THEN pow(all_mass::DOUBLE * below - mass::DOUBLE * all_n, 2) / (below::DOUBLE * (all_n - below)) ELSE -1 END AS v FROM sums),
levels AS (SELECT video, CASE WHEN v < 0 THEN 0 ELSE value END AS level FROM between_classes QUALIFY row_number() OVER (PARTITION BY video ORDER BY v DESC, value) = 1)"""


@query(f"WITH {_OTSU} SELECT video, level FROM levels")
def otsu_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.otsu_levels(_pixels(spark, sf_dir)).select("video", "level")


@query(f"""WITH RECURSIVE {_PIXELS}, dark AS (SELECT video, y, x FROM pixels WHERE value > 0 AND value < 70),
islands AS (SELECT *, x - row_number() OVER (PARTITION BY video, y ORDER BY x) AS island FROM dark),
runs AS (SELECT video, y, min(x) AS x0, max(x) AS x1, y * 65536 + min(x) AS id FROM islands GROUP BY video, y, island),
links AS (SELECT a.video, a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.video = b.video AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
reach AS (SELECT video, id, id AS blob FROM runs UNION SELECT l.video, l.b, r.blob FROM reach r JOIN links l ON l.video = r.video AND l.a = r.id WHERE r.blob < l.b),
named AS (SELECT video, id, min(blob) AS blob FROM reach GROUP BY video, id),
found AS (SELECT video, blob, CAST(sum(x1 - x0 + 1) AS BIGINT) AS n_pixels, CAST(sum(CASE WHEN y BETWEEN 7 AND 24 THEN greatest(0, least(x1, 42) - greatest(x0, 7) + 1) ELSE 0 END) AS BIGINT) AS n_central,
  min(y) AS y0, max(y) AS y1, min(x0) AS x0, max(x1) AS x1 FROM runs JOIN named USING (video, id) GROUP BY video, blob)
SELECT video, CAST(blob AS INTEGER) AS blob, n_pixels, n_central, y0, y1, x0, x1 FROM found QUALIFY row_number() OVER (PARTITION BY video ORDER BY n_central DESC, blob) = 1""")
def central_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    levels = pixels.select("video", "frame_index").distinct().withColumn("level", F.lit(70))
    sizes = pixels.select("video", "frame_index", "height", "width").distinct()
    return blobs.central_blob(blobs.dark_pixels(pixels, levels), sizes).drop("frame_index")


_SIDE = "CAST(trunc({c}x + {s} * ey / len * {h}) AS INTEGER) AS {n}_x, CAST(trunc({c}y - {s} * ex / len * {h}) AS INTEGER) AS {n}_y"


def _outline_sql() -> str:
    half = "(2.0::DOUBLE + 3 * sin({i} * 0.05::DOUBLE))"
    sides = ", ".join(_SIDE.format(c=c, s=s, h=half.format(i=i), n=n) for c, s, i, n in (("", 1, "i", "a"), ("", -1, "i", "b"), ("p0", 1, 1, "f"), ("p0", -1, 1, "g")))
    edges = " UNION ALL ".join(f"SELECT video, t, i, {a}_x AS px, {a}_y AS py, {b}_x AS qx, {b}_y AS qy, lo, hi FROM quads" for a, b in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")))
    return f"""WITH {poses_sql()}, {_points('theta', 'video, t', 'poses')},
moved AS (SELECT video, t, i, round(x, 6) + 40 AS x, round(y, 6) + 40 AS y FROM points),
near AS (SELECT *, lag(x, 2) OVER w AS p0x, lag(y, 2) OVER w AS p0y, max(i) OVER (PARTITION BY video, t) AS last FROM moved WINDOW w AS (PARTITION BY video, t ORDER BY i)),
lines AS (SELECT *, x - p0x AS ex, y - p0y AS ey, nullif(sqrt((x - p0x) * (x - p0x) + (y - p0y) * (y - p0y)), 0) AS len FROM near),
sides AS (SELECT video, t, i, {sides} FROM lines WHERE i >= 2),
joined AS (SELECT video, t, i, a_x, a_y, b_x, b_y, CASE WHEN i = 2 THEN g_x ELSE lag(b_x) OVER w END AS c_x, CASE WHEN i = 2 THEN g_y ELSE lag(b_y) OVER w END AS c_y,
  CASE WHEN i = 2 THEN f_x ELSE lag(a_x) OVER w END AS d_x, CASE WHEN i = 2 THEN f_y ELSE lag(a_y) OVER w END AS d_y FROM sides WINDOW w AS (PARTITION BY video, t ORDER BY i)),
quads AS (SELECT *, least(a_y, b_y, c_y, d_y) AS lo, greatest(a_y, b_y, c_y, d_y) AS hi FROM joined WHERE a_x + b_x + c_x + d_x IS NOT NULL),
edges AS ({edges}),
crossings AS (SELECT video, t, i, y, CASE WHEN py = qy THEN px ELSE px + (qx - px) * (y - py)::DOUBLE / (qy - py) END AS x, CASE WHEN py = qy THEN qx END AS x2
  FROM (SELECT *, unnest(range(lo, hi + 1)) AS y FROM edges) WHERE y BETWEEN least(py, qy) AND greatest(py, qy)),
spans AS (SELECT video, t, y, floor(least(min(x), coalesce(min(x2), min(x))) + 0.5) AS x0, floor(greatest(max(x), coalesce(max(x2), max(x))) + 0.5) AS x1 FROM crossings GROUP BY video, t, i, y),
discs AS (SELECT video, t, CAST(trunc(x) AS INTEGER) AS x, CAST(trunc(y) AS INTEGER) AS y, CAST(trunc({half.format(i='i')}) AS INTEGER) AS r FROM lines WHERE i = 0 OR i = last),
pixels AS (SELECT video, t, y, unnest(range(CAST(x0 AS INTEGER), CAST(x1 AS INTEGER) + 1)) AS x FROM spans
  UNION SELECT video, t, y + a, x + b FROM discs, range(-9, 10) AS r(a), range(-9, 10) AS s(b) WHERE a * a + b * b <= r * r)
SELECT video, t, count(*) AS n_pixels FROM pixels GROUP BY video, t"""


@query(_outline_sql())
def outline_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the outline of each pose's body, drawn as scan-lines of quads and end discs."""
    moved = F.transform("skeleton", lambda p: F.struct((F.round(p["x"], 6) + 40).alias("x"), (F.round(p["y"], 6) + 40).alias("y")))
    rows = _skeletons(spark, sf_dir).select("video", "t", moved.alias("skeleton"))
    half = F.transform("skeleton", lambda p, i: 2.0 + 3 * F.sin(i * 0.05))
    return blobs.span_area(blobs.outline_spans(rows, "skeleton", half, ["video", "t"]), ["video", "t"])


_CORNERS = ", ".join(f"round({e}{c} {s} p{c}, 5) + 0.0 AS {c}{k}" for c in "xy" for k, (e, s) in enumerate((("a", "+"), ("b", "+"), ("b", "-"), ("a", "-"))))


@query(f"""WITH {poses_sql()}, {_points('theta', 'video, t', 'poses')}, moved AS (SELECT video, t, i, round(x, 6) AS x, round(y, 6) AS y FROM points),
far AS (SELECT a.video, a.t, a.i, a.x, a.y, b.x AS fx, b.y AS fy FROM moved a JOIN moved b ON b.video = a.video AND b.t = a.t AND b.i = a.i + 4),
laid AS (SELECT video, t, 61 - i AS place, x AS ax, y AS ay, fx AS bx, fy AS b_y, 6.0::DOUBLE + 0.05 * i AS w FROM far
  UNION ALL SELECT video, t, 0, 2 * x - fx, 2 * y - fy, x, y, 6.0::DOUBLE FROM far WHERE i = 0 UNION ALL SELECT video, t, 1, fx, fy, 2 * fx - x, 2 * fy - y, 6.0::DOUBLE + 0.05 * 60 FROM far WHERE i = 59),
across AS (SELECT *, -(b_y - ay) / nullif(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)), 0) * (w / 2) AS px, (bx - ax) / nullif(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)), 0) * (w / 2) AS py FROM laid)
SELECT video, t, CAST(place AS INTEGER) AS place, {_CORNERS.replace("by ", "b_y ")} FROM across""")
def body_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the patches along each pose's body, in drawing order."""
    plain = F.transform("skeleton", lambda p: F.struct(F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y")))
    rows = _skeletons(spark, sf_dir).select("video", "t", plain.alias("skeleton"))
    corners = patches.body_patches(rows, "skeleton", F.transform("skeleton", lambda p, i: 6.0 + 0.05 * i), ["video", "t"])
    return corners.select("video", "t", "place", *[(F.round(n, 5) + 0.0).alias(n) for n in corners.columns[3:]])


# --- attributes, columns and sources


@query("""SELECT count(*) AS n, CAST(len(embedding) AS INTEGER) AS dims, label, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 4) + 0.0 AS total,
round(sum(CAST(embedding[1]::DOUBLE + vec_id % 100 AS FLOAT)::DOUBLE), 4) AS flipped FROM embeddings GROUP BY label, len(embedding)""")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples written as record files and read again; the image holds the label's number."""
    from ..operators.lineage import cut, remove, shared_dir
    from ..sources.records import read_records, write_records

    path = f"{shared_dir(spark)}/records-{uuid4().hex}"
    rows = table(spark, sf_dir, "embeddings")
    other = F.transform("embedding", lambda x: (x.cast("double") + F.col("vec_id") % 100).cast("float"))
    write_records(rows.select(F.col("label").cast("string").cast("binary").alias("image"), F.col("embedding").alias("label0"), other.alias("label1")), path)
    total = F.aggregate("label0", F.lit(0.0), lambda a, x: a + x.cast("double"))
    back = read_records(spark, path).groupBy(F.col("data").cast("string").cast("int").alias("label"), F.size("label0").alias("dims"))
    found = cut(back.agg(F.count("*").alias("n"), (F.round(F.sum(total), 4) + 0.0).alias("total"), F.round(F.sum(F.get("label1", F.lit(0)).cast("double")), 4).alias("flipped")))
    remove(spark, path)
    return found


@query("""WITH j AS (SELECT event_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k, props ->> '$.fps' AS fps, value FROM events)
SELECT event_id, coalesce(TRY_CAST(fps AS DOUBLE), k, 1.0) AS frame_rate, 'unknown' AS ventral_side FROM j""")
def json_attribute_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import frame_rate_of, ventral_side_of

    events = table(spark, sf_dir, "events").select("event_id", "props")
    rate = frame_rate_of(F.get_json_object("props", "$.fps"), F.get_json_object("props", "$.k"))
    return events.select("event_id", rate.alias("frame_rate"), ventral_side_of(F.col("props")).alias("ventral_side"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice * 0.5::DOUBLE AS width FROM orders QUALIFY o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey)""")
def single_entity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import column_like, single_entity

    rows = single_entity(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")
    return rows.select("o_custkey", "o_orderkey", (F.col(column_like(rows, "price", "total")) * 0.5).alias("width"))


@query(f"""WITH {poses_sql()} SELECT video, t AS frame_index, CAST(j AS INTEGER) AS joint, CAST(trunc(50 + 25 * cos(radians(t + j * 180.0::DOUBLE / 49))) AS DOUBLE) AS x, CAST(trunc(50 - 33 * sin(radians(t + j * 180.0::DOUBLE / 49))) AS DOUBLE) AS y
FROM poses, range(50) AS b(j)""")
def toy_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of known shape for each frame of each video of the poses."""
    features = toy_features_of(poses(spark, sf_dir).select("video", F.col("t").alias("id")))
    return features.select("video", "frame_index", F.posexplode("skeleton").alias("joint", "p")).select("video", "frame_index", "joint", "p.x", "p.y")


@query()
def trajectory_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.exporters import trajectory_json as export

    rows = _skeletons(spark, sf_dir).select("video", "t", A.rescale(F.col("skeleton"), 1.0).alias("skeleton"))
    return export(rows, FRAME_RATE)


@query(f"""WITH {poses_sql()}, {_points("theta", "video, t", "poses")}
SELECT video, CAST(t AS INTEGER) AS t, CAST(i AS INTEGER) AS i, round(0.5 * x, 4) + 0.0 AS x, round(0.5 * y, 4) + 0.0 AS y FROM points""")
def trajectory_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescaled skeletons exported as JSON and read again."""
    from ..sources.exporters import trajectory_json as export

    rows = _skeletons(spark, sf_dir).select("video", "t", A.rescale(F.col("skeleton"), 0.5).alias("skeleton"))
    made = F.from_json("json", "data array<struct<t: array<double>, x: array<array<double>>, y: array<array<double>>>>")
    data = export(rows, FRAME_RATE).select("video", F.get(made["data"], F.lit(0)).alias("d"))
    frames = data.select("video", F.explode(F.arrays_zip(F.col("d.t"), F.col("d.x"), F.col("d.y"))).alias("f"))
    points = frames.select("video", F.round(F.col("f.t") * FRAME_RATE).cast("int").alias("t"), F.posexplode(F.arrays_zip(F.col("f.x"), F.col("f.y"))).alias("i", "p"))
    return points.select("video", "t", "i", (F.round("p.x", 4) + 0.0).alias("x"), (F.round("p.y", 4) + 0.0).alias("y"))


@query(f"""WITH {poses_sql()} SELECT stage, video, CAST(t AS INTEGER) AS t, round(score, 6) AS score FROM (SELECT 'resolved' AS stage, video, t, score FROM poses UNION ALL SELECT 'original', video, t, score FROM poses WHERE t % 3 = 0)""")
def results_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written by stage and video, the one stage twice and one that is not asked for, and read again."""
    from ..operators.lineage import cut, remove, shared_dir
    from ..sources.exporters import read_results, write_results

    path = f"{shared_dir(spark)}/results-{uuid4().hex}"
    rows = poses(spark, sf_dir).select("video", "t", "score")
    for stages in ({"resolved": rows.filter("t < 5"), "unaligned": rows}, {"resolved": rows, "original": rows.filter("t % 3 = 0")}):
        write_results(stages, path)
    found = cut(read_results(spark, path).select("stage", "video", "t", r6(F.col("score")).alias("score")))
    remove(spark, path)
    return found


@query(f"""WITH {poses_sql()} SELECT video, CAST(t AS INTEGER) AS t, 't' || lpad(CAST(t AS VARCHAR), 6, '0') || '_f' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '_s' || CASE WHEN vec_id % 7 = 0 THEN 'nan' ELSE printf('%.4f', score) END || '.pgm' AS name FROM poses""")
def annotated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.exporters import frame_file_name

    score = F.when(F.col("vec_id") % 7 != 0, F.col("score"))
    return poses(spark, sf_dir).select("video", "t", frame_file_name(F.col("t"), F.col("vec_id"), score).alias("name"))


@query(f"""WITH {poses_sql()} SELECT video, CAST(t AS INTEGER) AS t, CASE WHEN vec_id % 3 = 0 THEN CAST(t AS BIGINT) ELSE vec_id END AS timestamp, CASE WHEN vec_id % 4 = 0 THEN 'unknown' ELSE 'clockwise' END AS ventral_side,
CAST(CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 30 END AS DOUBLE) AS frame_rate, CAST(len(theta) AS INTEGER) AS n_joints FROM poses""")
def feature_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a registered loader, checked, with defaults for what is missing."""
    from ..sources.readers import load_dataset, register_loader

    def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        some = lambda k, value: F.when(F.col("vec_id") % k != 0, value)
        rows = poses(spark, path)
        features = rows.select(
            "video", F.col("t").alias("frame_index"), some(3, F.col("vec_id")).alias("timestamp"), F.transform("theta", lambda a: F.struct(F.cos(a).alias("x"), F.sin(a).alias("y"))).alias("skeleton"),
            some(4, F.lit("clockwise")).alias("ventral_side"), some(5, F.lit(30.0)).alias("frame_rate"),
        )
        return rows, features

    register_loader("poses", load)
    features = load_dataset(spark, "poses", sf_dir)[1]
    return features.select("video", F.col("frame_index").alias("t"), "timestamp", "ventral_side", "frame_rate", F.size("skeleton").alias("n_joints"))


@query(f"""WITH {poses_sql()} SELECT video, round(avg(score) FILTER (vec_id % 7 <> 0), 6) AS mean_score, count(*) AS n FROM poses GROUP BY video""")
def calibration_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = poses(spark, sf_dir).select("video", F.when(F.col("vec_id") % 7 == 0, A.nan()).otherwise(F.col("score")).alias("score"))
    return commands.calibration_means(rows).select("video", r6(F.col("mean_score")).alias("mean_score"), "n")


@query("""SELECT CAST(o_custkey % 7 AS INTEGER) AS k, count(*) FILTER (o_orderkey % 11 <> 0) AS n, round(avg(o_totalprice) FILTER (o_orderkey % 11 <> 0), 3) AS mean_aic,
round(stddev_pop(o_totalprice) FILTER (o_orderkey % 11 <> 0), 3) AS deviation FROM orders GROUP BY 1""")
def criterion_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over the seeds of a sweep; failed fits left out."""
    aic = F.when(F.col("o_orderkey") % 11 == 0, A.nan()).otherwise(F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).cast("int").alias("k"), aic.alias("aic"))
    return models.criterion_spread(rows).select("k", "n", F.round("mean_aic", 3).alias("mean_aic"), F.round("deviation", 3).alias("deviation"))


_RIDGE = repr(models.RIDGE)


@query(f"""WITH p AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
s AS (SELECT count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM p), r AS (SELECT n, va, vb, c, va + {_RIDGE} AS ra, vb + {_RIDGE} AS rb FROM s)
SELECT CAST(1 AS INTEGER) AS k, round(10 + n * (2 * ln(2 * {PI}) + ln(ra * rb - c * c) + (rb * va - 2 * c * c + ra * vb) / (ra * rb - c * c)), 3) AS aic FROM r""")
def gaussian_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criterion of a mixture of one component, which has a closed form."""
    points = table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 2).alias("v"))
    rows = models.information_criterion(points, "v", [1])
    return spark.createDataFrame([(k, round(aic, 3)) for k, _, aic in rows], "k int, aic double")


@query()
def mixture_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of mixtures of several sizes and seeds over the modes of all poses, fitted in the same passes."""
    modes = poses(spark, sf_dir).select(F.slice(A.project(F.col("theta"), _basis()), 1, 3).alias("v"))
    found = models.sweep_mixtures(modes, "v", (1, 2, 4), (0, 1), max_iter=20)
    return spark.createDataFrame([(k, seed, m.steps, float(m.likelihood), float(m.criterion())) for (k, seed), m in found.items()], "k int, seed int, steps int, likelihood double, aic double")


@query("""WITH m AS (SELECT CAST(o_orderkey AS VARCHAR) AS name, o_custkey AS epoch, o_totalprice AS val_loss FROM orders WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT name FROM m ORDER BY val_loss, name DESC LIMIT 5), l AS (SELECT name FROM m ORDER BY epoch DESC, name DESC LIMIT 1)
SELECT name, epoch, round(val_loss, 6) AS val_loss, name IN (SELECT name FROM b) AS is_best, name IN (SELECT name FROM l) AS is_last, name IN (SELECT name FROM b) OR name IN (SELECT name FROM l) AS keep FROM m""")
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the saved models are kept: the five best and the latest."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").alias("epoch"), F.col("o_totalprice").alias("val_loss"))
    return sampling.model_registry(rows).withColumn("val_loss", F.round("val_loss", 6))


_PART = "p[8 * y + 1:8 * y + 32]"


def _product(a: str, b: str) -> str:
    """SQL for the sum of products of two lists of 32 less their means."""
    return f"(list_inner_product({a}, {b}) - list_sum({a}) * list_sum({b}) / 32)"


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: trunc(least(255, greatest(0, 128 + 255 * x::DOUBLE)))) AS p FROM embeddings),
s AS (SELECT vec_id, CAST(y AS INTEGER) AS y, CASE WHEN {_product(_PART, _PART)} > 0 THEN {_product(_PART, 'p[17:48]')} / sqrt({_product(_PART, _PART)} * {_product('p[17:48]', 'p[17:48]')}) ELSE 0 END AS score FROM v, range(5) AS r(y))
SELECT vec_id, round(max(score), 6) AS score, 0 AS x, arg_max(y, score) AS y FROM s GROUP BY vec_id""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.imaging import score_pairs

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> cast(least(255, greatest(0, 128 + 255 * x)) as int))").alias("v"))
    pixels = rows.select("vec_id", F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")).alias("p"))
    pairs = pixels.select("vec_id", F.col("p").alias("source"), F.lit(8).alias("source_height"), F.lit(8).alias("source_width"), F.substring("p", 17, 32).alias("template"), F.lit(4).alias("template_height"), F.lit(8).alias("template_width"))
    return score_pairs(pairs).select("vec_id", F.round("score", 6).alias("score"), "x", "y")
