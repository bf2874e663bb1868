"""NumPy kernels: not-a-knot cubic splines and Savitzky-Golay weights."""

from __future__ import annotations

import numpy as np


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y) with not-a-knot ends, at the places asked; NaN outside.

    Solves for the second derivatives: inside, the usual three-term relations; at each
    end, an equal third derivative across the second knot. Fewer than four knots are
    an error. y may have several columns.
    """
    x, y, at = np.asarray(x, float), np.asarray(y, float), np.asarray(at, float)
    n = len(x)
    if n < 4:
        raise ValueError("a cubic spline needs four points or more")
    flat = y.reshape(n, -1)
    h = np.diff(x)
    slope = np.diff(flat, axis=0) / h[:, None]
    right = 6 * np.diff(slope, axis=0)
    # the end conditions give m[0] and m[-1] from their neighbours, which leaves three bands
    low, main, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    main[0] += h[0] * (1 + h[0] / h[1])
    up[0] -= h[0] * h[0] / h[1]
    main[-1] += h[-1] * (1 + h[-1] / h[-2])
    low[-1] -= h[-1] * h[-1] / h[-2]
    inner = _three_bands(low, main, up, right)
    m = np.empty_like(flat)
    m[1:-1] = inner
    m[0] = inner[0] * (1 + h[0] / h[1]) - (m[2] if n > 3 else inner[-1]) * h[0] / h[1]
    m[-1] = inner[-1] * (1 + h[-1] / h[-2]) - m[-3] * h[-1] / h[-2]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[k]
    a, b, w = m[k], m[k + 1], h[k][:, None]
    t = t[:, None]
    out = flat[k] + t * (slope[k] - w * (2 * a + b) / 6) + t * t * a / 2 + t**3 * (b - a) / (6 * w)
    out[(at < x[0]) | (at > x[-1])] = np.nan
    return out.reshape((len(at), *y.shape[1:]))


def _three_bands(low: np.ndarray, main: np.ndarray, up: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Elimination along the bands; low[0] and up[-1] lie outside the matrix."""
    n = len(main)
    c, d = np.empty(n), np.empty_like(right)
    c[0], d[0] = up[0] / main[0], right[0] / main[0]
    for i in range(1, n):
        pivot = main[i] - low[i] * c[i - 1]
        c[i] = up[i] / pivot
        d[i] = (right[i] - low[i] * d[i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def savgol_weights(window: int, order: int) -> np.ndarray:
    """Row p: weights of a window's values in the fitted polynomial at place p.

    The middle row smooths inner samples, the others the ends of a segment.
    """
    places = np.arange(window) - window // 2
    powers = np.vander(places / max(1, window // 2), order + 1, increasing=True)
    return powers @ np.linalg.pinv(powers)


def interpolate_skeleton(points: np.ndarray, steps: int) -> np.ndarray:
    """A skeleton resampled to steps + 1 points by splines; an axis with a missing value is all missing."""
    n = len(points)
    at = np.linspace(0, n - 1, steps + 1)
    out = np.full((steps + 1, points.shape[1]), np.nan)
    for axis in range(points.shape[1]):
        if not np.isnan(points[:, axis]).any():
            out[:, axis] = not_a_knot(np.arange(n), points[:, axis], at)
    return out
