"""Image transforms on frames: one row in, one row out, in Arrow batches; nothing is shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from starloom.functions.geometry import centre


def image(pix, ny: int, nx: int) -> np.ndarray:
    """A pixel array as an image of doubles; NULL and non-finite as NaN."""
    out = np.array(pix, dtype=float).reshape(ny, nx)
    out[~np.isfinite(out)] = np.nan
    return out


def flat(img: np.ndarray) -> list:
    return [None if v != v else v for v in img.ravel().tolist()]


def weights(t: np.ndarray) -> np.ndarray:
    """Catmull-Rom weights of neighbours -1, 0, 1, 2 at t."""
    t2, t3 = t * t, t * t * t
    return 0.5 * np.stack([-t + 2 * t2 - t3, 2 - 5 * t2 + 3 * t3, t + 4 * t2 - 3 * t3, t3 - t2])


def affine(img: np.ndarray, m, shape=None, fill: float = 0.0, missing: float = np.nan) -> np.ndarray:
    """Bicubic resampling; m maps destination x, y to the source's.

    Neighbours that are missing or outside count as `fill`; with half of the 16 or more of those the pixel is `missing`.
    """
    ny, nx = shape or img.shape
    dy, dx = np.mgrid[:ny, :nx]
    x, y = m[0][0] * dx + m[0][1] * dy + m[0][2], m[1][0] * dx + m[1][1] * dy + m[1][2]
    x, y = np.round(x, 9), np.round(y, 9)  # a whole number but for rounding is one, as at turns by 90 degrees
    xi, yi = np.floor(x).astype(int), np.floor(y).astype(int)
    wx, wy = weights(x - xi), weights(y - yi)
    total, good = np.zeros((ny, nx)), np.zeros((ny, nx), int)
    for i in range(4):
        for j in range(4):
            sy, sx = yi + i - 1, xi + j - 1
            inside = (sy >= 0) & (sy < img.shape[0]) & (sx >= 0) & (sx < img.shape[1])
            v = np.where(inside, img[np.clip(sy, 0, img.shape[0] - 1), np.clip(sx, 0, img.shape[1] - 1)], np.nan)
            there = ~np.isnan(v)
            good += there
            total += wy[i] * wx[j] * np.where(there, v, fill)
    return np.where(good > 8, total, missing)


def turn(deg: float, ny: int, nx: int):
    c, s, yc, xc = math.cos(math.radians(deg)), math.sin(math.radians(deg)), centre(ny), centre(nx)
    return [[c, s, xc - c * xc - s * yc], [-s, c, yc + s * xc - c * yc]]


def move(dx: float, dy: float):
    return [[1, 0, -dx], [0, 1, -dy]]


def zoom(factor: float, ny: int, nx: int):
    yc, xc = centre(ny), centre(nx)
    return [[1 / factor, 0, xc - xc / factor], [0, 1 / factor, yc - yc / factor]]


def each(fr: DataFrame, work, *args: Column) -> DataFrame:
    """frames with pix replaced by work(image, *values of args)."""

    @pandas_udf("array<double>")
    def run(pix: pd.Series, ny: pd.Series, nx: pd.Series, *cols: pd.Series) -> pd.Series:
        return pd.Series([flat(work(image(p, a, b), *more)) for p, a, b, *more in zip(pix, ny, nx, *cols, strict=True)])

    return fr.withColumn("pix", run("pix", "ny", "nx", *args))


def derotated(fr: DataFrame, angle: Column, fill: float = 0.0) -> DataFrame:
    """Frames turned anticlockwise by their angle in degrees."""
    return each(fr, lambda img, a: affine(img, turn(a, *img.shape), fill=fill), angle)


def shifted(fr: DataFrame, dx: Column, dy: Column, fill: float = 0.0) -> DataFrame:
    return each(fr, lambda img, a, b: affine(img, move(a, b), fill=fill), dx, dy)


def rescaled(fr: DataFrame, factor: Column, fill: float = 0.0) -> DataFrame:
    return each(fr, lambda img, f: affine(img, zoom(f, *img.shape), fill=fill), factor)


def fourier_shift(img: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """A shift by the phase of the transform, wrapping at the edges; the total stays."""
    ky, kx = np.fft.fftfreq(img.shape[0])[:, None], np.fft.fftfreq(img.shape[1])[None]
    return np.fft.ifft2(np.fft.fft2(np.nan_to_num(img)) * np.exp(-2j * np.pi * (ky * dy + kx * dx))).real


def fourier_shifted(fr: DataFrame, dx: Column, dy: Column) -> DataFrame:
    return each(fr, fourier_shift, dx, dy)


def gaussian_smooth(img: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian, wrapping at the edges, by the transform."""
    ky, kx = np.fft.fftfreq(img.shape[0])[:, None], np.fft.fftfreq(img.shape[1])[None]
    return np.fft.ifft2(np.fft.fft2(np.nan_to_num(img)) * np.exp(-2 * (np.pi * sigma) ** 2 * (ky * ky + kx * kx))).real


def smoothed(fr: DataFrame, sigma: float) -> DataFrame:
    return each(fr, lambda img: gaussian_smooth(img, sigma))


def unsharp_masked(fr: DataFrame, sigma: float) -> DataFrame:
    """Frames less themselves smoothed."""
    return each(fr, lambda img: img - gaussian_smooth(img, sigma))


def phase_shift(ref: np.ndarray, img: np.ndarray, upsample: int = 100, whiten: bool = False) -> tuple[float, float]:
    """(dy, dx) by which img has to move to lie on ref: the peak of the cross-correlation, refined on a grid of 1 / upsample;
    with whitening, of the phase correlation."""
    cross = np.fft.fft2(np.nan_to_num(ref)) * np.conj(np.fft.fft2(np.nan_to_num(img)))
    if whiten:
        cross /= np.maximum(np.abs(cross), 1e-12 * np.abs(cross).max() or 1)
    corr = np.abs(np.fft.ifft2(cross))
    peak = np.array(np.unravel_index(corr.argmax(), corr.shape), float)
    size = np.array(corr.shape)
    peak = np.where(peak > size // 2, peak - size, peak)
    if upsample > 1:
        fine = np.arange(-int(1.5 * upsample / 2), int(1.5 * upsample / 2) + 1) / upsample
        ky, kx = np.fft.fftfreq(size[0]), np.fft.fftfreq(size[1])
        a = np.exp(2j * np.pi * np.outer(peak[0] + fine, ky))
        b = np.exp(2j * np.pi * np.outer(kx, peak[1] + fine))
        got = (a @ cross @ b).real
        i, j = np.unravel_index(got.argmax(), got.shape)
        peak = np.array([peak[0] + fine[i], peak[1] + fine[j]])
    return float(peak[0]), float(peak[1])


def filled(px: DataFrame) -> DataFrame:
    """Missing pixels as the mean of those there in the window of offsets -1 to 2 in y and x; 0 where none is, as in frames of no
    number or extension. A frame is a row in between: neighbours are looked up where its pixels lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for whole, ys, xs, vs in zip(df["whole"], df["y"], df["x"], df["v"], strict=True):
                y, x, v = np.asarray(ys, np.int64), np.asarray(xs, np.int64), np.array(vs, float)
                gone = np.isnan(v)
                at = np.flatnonzero(gone)
                total, n = np.zeros(len(at)), np.zeros(len(at), int)
                if whole and len(at) and not gone.all():
                    # Places of pixels as numbers: with four columns to spare a row's neighbours aren't those of another.
                    width = x.max() - x.min() + 4
                    place = lambda y, x: (y - ys_min) * width + (x - xs_min)  # noqa: E731, B023
                    ys_min, xs_min = y.min(), x.min()
                    here = np.flatnonzero(~gone)
                    here = here[np.argsort(place(y[here], x[here]), kind="stable")]
                    line = place(y[here], x[here])
                    sums = np.concatenate([[0.0], np.cumsum(v[here])]) if len(np.unique(line)) < len(line) else None
                    for dy in range(-1, 3):
                        for dx in range(-1, 3):
                            want = place(y[at] + dy, x[at] + dx)
                            lo = np.searchsorted(line, want)
                            if sums is not None:  # a pixel more than once
                                hi = np.searchsorted(line, want, "right")
                                total, n = total + sums[hi] - sums[lo], n + hi - lo
                            else:
                                hit = line[np.minimum(lo, len(line) - 1)] == want
                                total, n = total + np.where(hit, v[here[np.minimum(lo, len(line) - 1)]], 0.0), n + hit
                v[at] = total / np.maximum(n, 1)
                out.append(v)
            yield df[["frame_idx", "ext", "y", "x"]].assign(v=out)

    kinds = dict(px.dtypes)
    listed = px.groupBy("frame_idx", "ext").agg(F.collect_list(F.struct("y", "x", "v")).alias("p"))
    whole = F.col("frame_idx").isNotNull() & F.col("ext").isNotNull()
    # Frames' own columns go beside the arrays, untouched.
    rows = listed.select("frame_idx", "ext", whole.alias("whole"), F.col("p.y").alias("y"), F.col("p.x").alias("x"), F.col("p.v").alias("v"))
    done = rows.mapInPandas(run, f"frame_idx {kinds['frame_idx']}, ext {kinds['ext']}, y array<{kinds['y']}>, x array<{kinds['x']}>, v array<double>")
    return done.select("frame_idx", "ext", F.explode(F.arrays_zip("y", "x", "v")).alias("p")).select("frame_idx", "ext", "p.y", "p.x", F.col("p.v").alias("v"))


def gauss2d(ny: int, nx: int, yc: float, xc: float, sy: float, sx: float) -> np.ndarray:
    y, x = np.mgrid[:ny, :nx]
    return np.exp(-0.5 * (((y - yc) / sy) ** 2 + ((x - xc) / sx) ** 2))


def convolved(px: DataFrame, kernel: list[tuple[int, int, float]]) -> DataFrame:
    """Sums of neighbours (dy, dx) times the kernel's weights, missing and outside pixels being 0; same shape."""
    k = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(w)).alias("w")) for a, b, w in kernel))
    spread = px.withColumn("_k", F.explode(k)).select("frame_idx", "ext", (F.col("y") + F.col("_k.dy")).alias("y"), (F.col("x") + F.col("_k.dx")).alias("x"), (F.coalesce("v", F.lit(0.0)) * F.col("_k.w")).alias("v"), ((F.col("_k.dy") == 0) & (F.col("_k.dx") == 0)).alias("own"))
    return spread.groupBy("frame_idx", "ext", "y", "x").agg(F.sum("v").alias("v"), F.max("own").alias("own")).where("own").drop("own")


def tophat(diameter: float) -> list[tuple[int, int, float]]:
    """A disk of ones about the centre of its grid: of an even grid the centre is between pixels, and the output is past it."""
    n = math.ceil(diameter) + 2
    c = (n - 1) / 2
    return [(a - (n - 1) // 2, b - (n - 1) // 2, 1.0) for a in range(n) for b in range(n) if math.hypot(a - c, b - c) <= diameter / 2]


def injected(fr: DataFrame, companions: DataFrame, template: np.ndarray, angle: Column, clip: float | None = None) -> DataFrame:
    """frames plus companions (r_px, pa_deg, scale): the template, its centre moved to where each is before derotation, times scale."""
    if not np.isfinite(template).all():
        raise ValueError("the template has missing pixels")
    one = companions.agg(F.collect_list(F.struct("r_px", "pa_deg", "scale")).alias("_c"))  # a few rows of a config

    def work(img, deg, cs):
        out = img.copy()
        ty, tx = centre(template.shape[0]), centre(template.shape[1])
        for c in cs:
            a = math.radians(90 + c["pa_deg"] - deg)
            x, y = c["r_px"] * math.cos(a) + centre(img.shape[1]), c["r_px"] * math.sin(a) + centre(img.shape[0])
            out = out + c["scale"] * affine(template, move(x - tx, y - ty), img.shape, 0.0, 0.0)
        return np.minimum(out, clip) if clip is not None else out

    with_list = fr.withColumn("_a", angle.cast("double")).crossJoin(F.broadcast(one))
    return each(with_list, work, F.col("_a"), F.col("_c")).drop("_a", "_c")
