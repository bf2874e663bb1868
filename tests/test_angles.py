"""Angles, skeletons and distances by known values."""

from __future__ import annotations

from math import isnan, nan, pi, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from posespark.functions import angles as A
from posespark.functions.arrow import resample_skeleton, skeleton_to_theta
from posespark.functions.kernels import not_a_knot, savgol_weights


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def arr(values):
    return F.array(*[F.lit(float(v)) for v in values])


def skel(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


@pytest.mark.parametrize(("theta", "want"), [(0.0, pi), (pi / 2, 3 * pi / 2), (nan, nan)])
def test_flip_turns_and_does_not_wrap(spark, theta, want):
    assert one(spark, A.flip(arr([theta] * 10))) == pytest.approx([want] * 10, nan_ok=True)


def test_flip_reverses(spark):
    assert one(spark, A.flip(arr([0, 1, 2]))) == pytest.approx([2 + pi, 1 + pi, pi])


@pytest.mark.parametrize(("a", "b", "want"), [(0, 0, 0), (0, pi / 6, pi / 6), (0, 2 * pi, 0), (pi / 4, -pi / 4, pi / 2), (-pi, pi, 0), (3 * pi, pi - pi / 8, pi / 8)])
def test_angle_distance(spark, a, b, want):
    assert one(spark, A.angle_distance(arr([a] * 10), arr([b] * 10))) == pytest.approx(want, abs=1e-9)


LINE = [(k / 9, k / 9) for k in range(10)]


@pytest.mark.parametrize(("a", "b", "want"), [
    ([(0, 0)] * 10, LINE, nan), (LINE, [(0, 0)] * 10, nan), ([(nan, nan)] * 10, LINE, nan), (LINE, LINE, 1), (LINE, [(-x, -y) for x, y in LINE], -1), (LINE, [(-x, y) for x, y in LINE], 0),
])
def test_head_tail_cosine(spark, a, b, want):
    assert one(spark, A.head_tail_cosine(skel(a), skel(b))) == pytest.approx(want, nan_ok=True, abs=1e-12)


@pytest.mark.parametrize(("theta", "length", "first", "last"), [
    (0, 25, (-12.5, 0), (12.5, 0)), (pi / 2, 50, (0, -25), (0, 25)), (pi / 4, 20 * sqrt(2), (-10, -10), (10, 10)),
])
def test_skeleton_is_a_centred_line(spark, theta, length, first, last):
    points = one(spark, A.skeleton_from_theta(arr([theta] * 10), F.lit(float(length))))
    assert len(points) == 10
    assert [points[0]["x"], points[0]["y"]] == pytest.approx(first, abs=1e-9)
    assert [points[-1]["x"], points[-1]["y"]] == pytest.approx(last, abs=1e-9)


def test_missing_angles_make_missing_skeletons(spark):
    assert all(isnan(p["x"]) and isnan(p["y"]) for p in one(spark, A.skeleton_from_theta(arr([nan] * 10), F.lit(5.0))))


@pytest.mark.parametrize("dims", [29, 9, 19, 4])
def test_resampled_skeletons_stay_on_the_line(spark, dims):
    points = one(spark, resample_skeleton(skel(LINE), dims))
    assert all([p["x"] for p in points] == pytest.approx(np.linspace(0, 1, dims + 1)) and p["x"] == pytest.approx(p["y"]) for p in points)
    assert one(spark, skeleton_to_theta(skel(LINE), dims)) == pytest.approx([pi / 4] * dims)
    assert all(isnan(v) for v in one(spark, skeleton_to_theta(skel([(nan, 0)] + LINE[1:]), dims)))


def test_joints_and_profile(spark):
    for n in (10, 30, 49):
        a, b, c = one(spark, A.joint_indexes(F.lit(n)))
        assert (a, b, c) == (int(0.1 * n), int(0.5 * n), int(0.9 * n))
    widths = one(spark, A.width_profile(F.lit(1.0), F.lit(5.0), F.lit(2.0), 20))
    assert widths[:3] == [1, 1, 1] and widths[9] == 5 and widths[17] == 2 and widths[-1] == 2


def test_modes(spark):
    eye = F.array(*[arr(row) for row in np.eye(4)])
    assert one(spark, A.project(arr([3.0] * 4), eye)) == pytest.approx([0] * 4)
    assert one(spark, A.project(arr([1, 2, 3, 6]), eye)) == pytest.approx([-2, -1, 0, 3])
    assert one(spark, A.reconstruct(arr([2, -1]), eye)) == pytest.approx([2, -1, 0, 0])
    assert all(isnan(v) for v in one(spark, A.project(arr([nan] * 4), eye)))


def test_lengths_and_units(spark):
    assert one(spark, A.body_length(skel([(0, 0), (3, 4), (3, 5)]))) == 6
    assert isnan(one(spark, A.body_length(skel([(0, 0), (nan, 4), (3, 5)]))))
    moved = A.to_stage(skel(LINE), F.lit(2.0), F.lit(1.0), F.lit(-1.0))
    back = one(spark, A.from_stage(moved, F.lit(2.0), F.lit(1.0), F.lit(-1.0)))
    assert [p["x"] for p in back] == pytest.approx([x for x, _ in LINE]) and [p["y"] for p in back] == pytest.approx([y for _, y in LINE])
    assert one(spark, A.crop_size(F.lit(33.5))) == 34 and one(spark, A.crop_size(F.lit(3.0))) == 32


def test_mirror_and_loss(spark):
    assert one(spark, A.dorsal_ventral_flip(arr([1.0]), F.lit("clockwise"))) == pytest.approx([2 * pi - 1])
    assert one(spark, A.dorsal_ventral_flip(arr([1.0]), F.lit("anticlockwise"))) == [1.0]
    t = arr([0.1, 0.2, 0.3])
    assert one(spark, A.symmetric_loss(A.flip(t), t, A.flip(t))) == pytest.approx(0, abs=1e-9)


def test_spline_and_weights():
    x = np.array([0, 1, 3, 4, 7.0, 8])
    cubic = lambda v: 2 * v**3 - v**2 + 3
    at = np.linspace(0, 8, 33)
    assert not_a_knot(x, cubic(x), at) == pytest.approx(cubic(at))
    assert not_a_knot(x[:4], cubic(x[:4]), at[at <= 4]) == pytest.approx(cubic(at[at <= 4]))
    assert np.isnan(not_a_knot(x, x, np.array([-1.0, 9]))).all()
    with pytest.raises(ValueError):
        not_a_knot(x[:3], x[:3], at)
    assert savgol_weights(9, 3)[4] * 231 == pytest.approx([-21, 14, 39, 54, 59, 54, 39, 14, -21])
