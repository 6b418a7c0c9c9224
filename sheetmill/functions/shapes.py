"""Polygon measures of vertex arrays (array<array<double>>: [[x, y], …]), outlines closed from last to first."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def vertices(json: Column) -> Column:
    return F.from_json(json, "array<array<double>>")


def _cyclic_sum(points: Column, term: Callable) -> Column:
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    pairs = F.zip_with(points, nxt, term)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def polygon_area(points: Column) -> Column:
    """Shoelace area; 0 below three vertices."""
    cross = _cyclic_sum(points, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.when(F.size(points) >= 3, F.abs(cross) / 2).when(F.size(points) >= 0, 0.0)


def polygon_perimeter(points: Column) -> Column:
    return F.when(F.size(points) >= 1, _cyclic_sum(points, lambda p, q: F.sqrt(F.pow(q[0] - p[0], 2) + F.pow(q[1] - p[1], 2))))


def circularity(area: Column, perimeter: Column) -> Column:
    """4πA / P², at most 1."""
    return F.when(perimeter > 0, F.least(F.lit(1.0), 4 * math.pi * area / (perimeter * perimeter)))


def dissection(area: Column, perimeter: Column) -> Column:
    """P / (2√(πA)), at least 1."""
    return F.when(area > 0, F.greatest(F.lit(1.0), perimeter / (2 * F.sqrt(math.pi * area))))


def centroid_size(points: Column) -> Column:
    """Root of the summed squared distances from the mean vertex."""
    n = F.size(points)
    mean = lambda i: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[i]) / n
    mx, my = mean(0), mean(1)
    return F.when(n > 0, F.sqrt(F.aggregate(points, F.lit(0.0), lambda s, p: s + F.pow(p[0] - mx, 2) + F.pow(p[1] - my, 2))))


def _points(value: object) -> np.ndarray | None:
    """The vertices as an (n, 2) array, None for fewer than three finite ones."""
    if value is None or len(value) < 3:
        return None
    rows = [v for v in value if v is not None and len(v) >= 2 and v[0] is not None and v[1] is not None]
    out = np.array([[float(v[0]), float(v[1])] for v in rows]) if rows else np.empty((0, 2))
    out = out[np.isfinite(out).all(axis=1)]
    return out if len(out) >= 3 else None


def hull_area_of(pts: np.ndarray) -> float:
    ordered = sorted(map(tuple, pts.tolist()))

    def half(points: list[tuple]) -> list[tuple]:
        chain: list[tuple] = []
        for p in points:
            while len(chain) >= 2 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    hull = np.array(half(ordered) + half(ordered[::-1]))
    if len(hull) < 3:
        return 0.0
    x, y = hull[:, 0], hull[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


@F.pandas_udf(DoubleType())
def hull_area(points: pd.Series) -> pd.Series:
    """Area of the convex hull."""
    return points.map(lambda v: None if (p := _points(v)) is None else hull_area_of(p)).astype("float64")


def elliptic_fourier(pts: np.ndarray, harmonics: int) -> np.ndarray:
    """(harmonics, 4): coefficients a, b, c, d of the closed outline by chord length."""
    step = np.diff(np.vstack([pts, pts[:1]]), axis=0)
    dt = np.hypot(step[:, 0], step[:, 1])
    step, dt = step[dt > 0], dt[dt > 0]
    if not len(dt):
        return np.zeros((harmonics, 4))
    t = np.r_[0.0, np.cumsum(dt)]
    whole = t[-1]
    n = np.arange(1, harmonics + 1)[:, None]
    angle = 2 * np.pi * n * t[None, :] / whole
    dcos, dsin = np.diff(np.cos(angle), axis=1), np.diff(np.sin(angle), axis=1)
    factor = whole / (2 * np.pi**2 * n[:, 0] ** 2)
    return np.stack([factor * (dcos @ (step[:, 0] / dt)), factor * (dsin @ (step[:, 0] / dt)), factor * (dcos @ (step[:, 1] / dt)), factor * (dsin @ (step[:, 1] / dt))], axis=1)


def fourier_outline(coefficients: np.ndarray, n: int) -> np.ndarray:
    """``n`` vertices of the outline around the origin."""
    t = np.arange(n) / n * 2 * np.pi
    k = np.arange(1, len(coefficients) + 1)[:, None]
    c, s = np.cos(k * t), np.sin(k * t)
    return np.stack([coefficients[:, 0] @ c + coefficients[:, 1] @ s, coefficients[:, 2] @ c + coefficients[:, 3] @ s], axis=1)


def fourier_column(points: Column, harmonics: int) -> Column:
    """array of a1, b1, c1, d1, a2, … of each outline."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda v: None if (p := _points(v)) is None else elliptic_fourier(p, harmonics).ravel().tolist())

    return run(points)


def resample(pts: np.ndarray, n: int) -> np.ndarray:
    """``n`` vertices at equal distance along the closed outline."""
    closed = np.vstack([pts, pts[:1]])
    t = np.r_[0.0, np.cumsum(np.hypot(*np.diff(closed, axis=0).T))]
    at = np.arange(n) / n * t[-1]
    return np.stack([np.interp(at, t, closed[:, 0]), np.interp(at, t, closed[:, 1])], axis=1)


def euler_curve(pts: np.ndarray, thresholds: int, directions: int) -> np.ndarray:
    """(directions, thresholds): vertices minus edges of the closed outline below each height, in each direction;
    the outline is centred and scaled to radius 1."""
    p = pts - pts.mean(axis=0)
    p = p / max(1e-12, float(np.hypot(p[:, 0], p[:, 1]).max()))
    angle = 2 * np.pi * np.arange(directions) / directions
    height = p @ np.stack([np.cos(angle), np.sin(angle)])
    edge = np.maximum(height, np.roll(height, -1, axis=0))
    levels = np.linspace(-1, 1, thresholds)
    return np.stack([(height <= v).sum(axis=0) - (edge <= v).sum(axis=0) for v in levels], axis=1)


def euler_column(points: Column, thresholds: int = 32, directions: int = 36) -> Column:
    @F.pandas_udf(ArrayType(IntegerType()))
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda v: None if (p := _points(v)) is None else euler_curve(p, thresholds, directions).ravel().tolist())

    return run(points)
