"""Maps of values at scattered places, and detection maps of grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.geometry import centre


def linear(points: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation over the Delaunay triangles of the points (y, x); NaN outside their hull.

    Triangles by inserting the points one after another: those whose circumcircle holds the new one make way. For the some
    thousands of probes of one grid.
    """
    n = len(points)
    out = np.full(len(at), np.nan)
    if n < 3:
        return out
    span = np.ptp(points, axis=0).max() or 1.0
    mid = points.mean(axis=0)
    jitter = np.random.default_rng(0).uniform(-1, 1, points.shape) * span * 1e-9  # places on a circle have no unique triangles
    p = np.vstack([points + jitter, mid + span * np.array([[-40, -30], [0, 60], [40, -30]])])

    def circle(t):
        a, b, c = p[t[0]], p[t[1]] - p[t[0]], p[t[2]] - p[t[0]]
        d = 2 * (b[0] * c[1] - b[1] * c[0])
        if d == 0:
            return None
        u = np.array([c[1] * (b @ b) - b[1] * (c @ c), b[0] * (c @ c) - c[0] * (b @ b)]) / d
        return a + u, u @ u

    first = (n, n + 1, n + 2)
    triangles = {first: circle(first)}
    for k in range(n):
        bad = [t for t, (c, r) in triangles.items() if (p[k] - c) @ (p[k] - c) < r]
        edges: dict = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                key = tuple(sorted(e))
                edges[key] = edges.get(key, 0) + 1
            del triangles[t]
        for (a, b), times in edges.items():
            if times == 1 and (c := circle((a, b, k))) is not None:
                triangles[a, b, k] = c
    for t in triangles:
        if max(t) >= n:
            continue
        a, b, c = (points[k] for k in t)
        m = np.array([b - a, c - a]).T
        if abs(np.linalg.det(m)) < 1e-12 * span * span:
            continue
        uv = (at - a) @ np.linalg.inv(m).T
        inside = (uv >= -1e-9).all(axis=1) & (uv.sum(axis=1) <= 1 + 1e-9)
        out[inside] = values[t[0]] + uv[inside] @ np.array([values[t[1]] - values[t[0]], values[t[2]] - values[t[0]]])
    return out


def points_to_map(df: DataFrame, by: list[str], r: str, pa: str, value: str, ny: int, nx: int) -> DataFrame:
    """(by, y, x, v): each group's values at (r, pa) interpolated to the pixels of an image; NULL outside the hull."""
    fields = ", ".join(f"{c} {t}" for c, t in df.select(*by).dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.radians(90 + pdf[pa].to_numpy(float))
        pts = np.stack([pdf[r] * np.sin(a) + centre(ny), pdf[r] * np.cos(a) + centre(nx)], axis=1)
        y, x = np.mgrid[:ny, :nx]
        v = linear(pts, pdf[value].to_numpy(float), np.stack([y.ravel(), x.ravel()], axis=1).astype(float))
        out = pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "v": [None if q != q else q for q in v]})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "y", "x", "v"]]

    places = df.groupBy(*by, r, pa).agg(F.avg(value).alias(value))  # a place that is there twice counts once
    return places.groupBy(*by).applyInPandas(one, f"{fields}, y int, x int, v double")


def regrid(pix: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """An image at scattered coordinates, by cubic convolution."""
    from starloom.operators.resample import weights

    yi, xi = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx, total = weights(y - yi), weights(x - xi), np.zeros(y.shape)
    for i in range(4):
        for j in range(4):
            sy, sx = np.clip(yi + i - 1, 0, pix.shape[0] - 1), np.clip(xi + j - 1, 0, pix.shape[1] - 1)
            total += wy[i] * wx[j] * pix[sy, sx]
    return np.where((y >= 0) & (y <= pix.shape[0] - 1) & (x >= 0) & (x <= pix.shape[1] - 1), total, np.nan)
