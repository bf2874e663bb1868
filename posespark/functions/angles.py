"""Angles and skeletons as Column expressions: nothing here leaves the JVM.

theta is ARRAY<DOUBLE> of tangent angles; a skeleton is ARRAY<STRUCT<x, y>>. NULL is
'unassigned', NaN is 'numerically missing'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def nan() -> Column:
    return F.lit(NAN).cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often the body uses it.

    Array functions are not compiled, so equal parts of an expression are not shared
    and parts that an inner function mentions are computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array."""
    start = F.struct(F.expr("cast(array() as array<double>)").alias("out"), F.lit(0.0).alias("sum"))
    step = lambda a, v: F.struct(F.array_append(a["out"], a["sum"] + v).alias("out"), (a["sum"] + v).alias("sum"))
    return F.aggregate(values, start, step, lambda a: a["out"])


def _centred(values: Column, canvas: float) -> Column:
    def shifted(v: Column) -> Column:
        low, high = F.array_min(v), F.array_max(v)
        return let((F.lit(canvas) - (high - low)) / 2 - low, lambda by: F.transform(v, lambda a: a + by))

    return let(values, shifted)


def skeleton_from_theta(theta: Column, length: Column, canvas: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Points one segment apart along the angles, centred on a canvas (width, height)."""
    step = length / (F.size(theta) - 1)

    def axis(f: Callable[[Column], Column], size: float) -> Column:
        return _centred(prefix_sums(F.transform(theta, lambda a: step * f(a))), size)

    return F.zip_with(axis(F.cos, canvas[0]), axis(F.sin, canvas[1]), lambda a, b: F.struct(a.alias("x"), b.alias("y")))


def theta_from_points(skeleton: Column) -> Column:
    """Angle of each step from a point to the next."""
    return let(skeleton, lambda s: _steps(
        s,
        lambda a, b: F.when(F.isnan(a["x"]) | F.isnan(a["y"]) | F.isnan(b["x"]) | F.isnan(b["y"]), nan()).otherwise(F.atan2(b["y"] - a["y"], b["x"] - a["x"])),
    ))


def _steps(points: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each point and the next."""
    n = F.size(points) - 1
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), f)


def flip(theta: Column) -> Column:
    """The same body seen from its other end; angles are not wrapped again."""
    return F.transform(F.reverse(theta), lambda a: a + F.pi())


def dorsal_ventral_flip(theta: Column, ventral_side: Column) -> Column:
    """Mirrored angles where the ventral side is clockwise."""
    return F.when(ventral_side == "clockwise", F.transform(theta, lambda a: 2 * F.pi() - a)).otherwise(theta)


def wrapped_difference(a: Column, b: Column) -> Column:
    d = a - b
    return F.abs(F.atan2(F.sin(d), F.cos(d)))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def angle_distance(a: Column, b: Column) -> Column:
    """Mean over the body of the wrapped angle between two postures."""
    return mean(F.zip_with(a, b, wrapped_difference))


def symmetric_loss(predicted: Column, label0: Column, label1: Column) -> Column:
    """Root mean square of the wrapped angle to the nearer of two labels."""
    rms = lambda b: F.sqrt(mean(F.zip_with(predicted, b, lambda x, y: F.pow(wrapped_difference(x, y), F.lit(2.0)))))
    return F.least(rms(label0), rms(label1))


def head_tail_cosine(a: Column, b: Column) -> Column:
    """Cosine between the vectors from first to last point; NaN where one has no length."""
    def ends(s: Column) -> Column:
        first, last = F.element_at(s, 1), F.element_at(s, -1)
        return F.struct((last["x"] - first["x"]).alias("x"), (last["y"] - first["y"]).alias("y"))

    def cosine(v: Column) -> Column:
        p, q = v["p"], v["q"]
        size = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]) * F.sqrt(q["x"] * q["x"] + q["y"] * q["y"])
        return F.when(size == 0, nan()).otherwise((p["x"] * q["x"] + p["y"] * q["y"]) / F.when(size == 0, F.lit(1.0)).otherwise(size))

    return let(F.struct(let(a, ends).alias("p"), let(b, ends).alias("q")), cosine)


def project(theta: Column, basis: Column) -> Column:
    """Coefficients of theta, less its mean, on each mode; basis is ARRAY of mode vectors."""
    dot = lambda t, v: F.aggregate(F.zip_with(t, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    centred = let(mean(theta), lambda m: F.transform(theta, lambda a: a - m))
    return let(centred, lambda t: F.transform(basis, lambda v: dot(t, v)))


def reconstruct(modes: Column, basis: Column) -> Column:
    """Angles of the coefficients given, on the first modes; the mean stays out."""
    used = F.slice(basis, F.lit(1), F.size(modes))
    scaled = F.zip_with(modes, used, lambda m, v: F.transform(v, lambda x: m * x))
    zero = F.transform(F.element_at(used, 1), lambda x: F.lit(0.0))
    return F.aggregate(scaled, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def is_labelled(skeleton: Column) -> Column:
    """Whether no coordinate is missing."""
    return ~F.exists(skeleton, lambda p: F.isnan(p["x"]) | F.isnan(p["y"]))


def body_length(skeleton: Column) -> Column:
    """Length along the points; NaN unless all are there."""
    def length(s: Column) -> Column:
        steps = _steps(s, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
        return F.when(is_labelled(s), F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)).otherwise(nan())

    return let(skeleton, length)


def rescale(skeleton: Column, factor: float | Column) -> Column:
    f = F.lit(factor) if isinstance(factor, float | int) else factor
    return F.transform(skeleton, lambda p: F.struct((p["x"] * f).alias("x"), (p["y"] * f).alias("y")))


def to_stage(skeleton: Column, ratio: Column, stage_x: Column, stage_y: Column) -> Column:
    """Pixels to stage units: scaled, then moved by the stage position."""
    return F.transform(skeleton, lambda p: F.struct((p["x"] * ratio - stage_x).alias("x"), (p["y"] * ratio - stage_y).alias("y")))


def from_stage(skeleton: Column, ratio: Column, stage_x: Column, stage_y: Column) -> Column:
    return F.transform(skeleton, lambda p: F.struct(((p["x"] + stage_x) / ratio).alias("x"), ((p["y"] + stage_y) / ratio).alias("y")))


def joint_indexes(n: Column) -> Column:
    """Joints at 10, 50 and 90 % of the body (floating-point product, cut)."""
    return F.array(*[F.floor(F.lit(share) * n).cast("int") for share in (0.1, 0.5, 0.9)])


def linear_resample(values: Column, n: int) -> Column:
    """Linear interpolation of an array to n points, ends kept."""
    size = F.size(values)

    def at(i: Column) -> Column:
        place = i * (size - 1) / F.lit(float(max(1, n - 1)))
        low = F.least(F.floor(place), size - 2).cast("int")
        a, b = F.get(values, low), F.get(values, low + 1)
        return F.when(size == 1, F.get(values, F.lit(0))).otherwise(a + (b - a) * (place - low))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def width_profile(head: Column, mid: Column, tail: Column, n: int) -> Column:
    """Widths along n joints: flat to the head joint, straight lines to middle and tail, flat after."""
    h, m, t = int(0.1 * n), int(0.5 * n), int(0.9 * n)

    def line(i: Column, a: Column, b: Column, start: int, stop: int) -> Column:
        # inclusive ends: the last joint before `stop` has the far value
        return a + (b - a) * (i - start) / F.lit(float(max(1, stop - start - 1)))

    def at(i: Column) -> Column:
        return F.when(i < h, head).when(i < m, line(i, head, mid, h, m)).when(i < t, line(i, mid, tail, m, t)).otherwise(tail)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def crop_size(longest: Column) -> Column:
    """Even window side, 32 at least, for the longest average body."""
    side = F.greatest(F.lit(32), F.floor(longest).cast("int"))
    return side + side % 2
