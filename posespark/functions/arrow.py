"""Arrow functions around the kernels, for what expressions cannot say."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import nan, theta_from_points
from .kernels import interpolate_skeleton

POINTS = "array<struct<x:double,y:double>>"


def points_of(skeleton) -> np.ndarray:
    return np.array([[np.nan if p[k] is None else p[k] for k in ("x", "y")] for p in skeleton], dtype=float).reshape(-1, 2)


def with_nan(points: Column) -> Column:
    """points with NaN for null coordinates: on its way back from pandas NaN becomes null."""
    return F.transform(points, lambda p: F.struct(F.coalesce(p["x"], nan()).alias("x"), F.coalesce(p["y"], nan()).alias("y")))


def resample_skeleton(skeleton: Column, steps: int) -> Column:
    """Cubic resampling to steps + 1 points; null stays null."""

    @F.pandas_udf(POINTS)
    def resample(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            if v is None:
                out.append(None)
            else:
                out.append([{"x": float(x), "y": float(y)} for x, y in interpolate_skeleton(points_of(v), steps)])
        return pd.Series(out)

    return with_nan(resample(skeleton))


def skeleton_to_theta(skeleton: Column, dims: int) -> Column:
    """dims tangent angles of a skeleton, after cubic resampling."""
    return theta_from_points(resample_skeleton(skeleton, dims))
