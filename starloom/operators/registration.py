"""Registration: features located by phase correlation with templates, frames moved to a common centre, cutouts, cropping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from starloom.operators import resample
from starloom.operators.selection import Box


def fill_nonfinite(img: np.ndarray) -> np.ndarray:
    """Missing pixels as the mean of those there at offsets -1 to 2, 0 without any."""
    out = img.copy()
    for y, x in np.argwhere(~np.isfinite(img)):
        near = img[max(0, y - 1) : y + 3, max(0, x - 1) : x + 3]
        good = near[np.isfinite(near)]
        out[y, x] = good.mean() if len(good) else 0.0
    return out


def offsets(fr: DataFrame, template: np.ndarray, y0: int, x0: int, upsample: int = 100, sigma: float | None = None) -> DataFrame:
    """frames with dy, dx: how far the feature in the template's box at (y0, x0) is from where the template has it."""
    ny, nx = template.shape

    @pandas_udf("dy double, dx double")
    def run(pix: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for p, h, w in zip(pix, a, b, strict=True):
            cut = fill_nonfinite(resample.image(p, h, w))[y0 : y0 + ny, x0 : x0 + nx]
            if sigma:
                cut = resample.gaussian_smooth(cut, sigma)
            dy, dx = resample.phase_shift(cut, template, upsample)
            out.append((dy, dx))
        return pd.DataFrame(out, columns=["dy", "dx"])

    return fr.withColumn("_o", run("pix", "ny", "nx")).select(*fr.columns, "_o.dy", "_o.dx")


def aligned(fr: DataFrame, template: np.ndarray, y0: int, x0: int, upsample: int = 100) -> DataFrame:
    """Frames moved so that the feature lies as in the template."""
    found = offsets(fr, template, y0, x0, upsample)
    return resample.shifted(found, -F.col("dx"), -F.col("dy")).select(*fr.columns)


def cutouts(fr: DataFrame, template: np.ndarray, box: Box, upsample: int = 100, sigma: float = 0.0) -> DataFrame:
    """Frames of the template's shape: the feature found in the search box, interpolated to lie as in the template.

    Box and template may be of different shapes: the smaller is padded with zeros before they are compared. With sigma the
    images are smoothed for that comparison only. Missing pixels are filled from their neighbours.
    """
    h, w = template.shape

    def grown(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        return np.pad(a, [(0, n - m) for n, m in zip(shape, a.shape, strict=True)])

    def work(img: np.ndarray) -> np.ndarray:
        img = fill_nonfinite(img)
        y0, y1, x0, x1 = box.overlap(*img.shape)
        cut = (resample.gaussian_smooth(img, sigma) if sigma > 0 else img)[y0:y1, x0:x1]
        shape = (max(cut.shape[0], h), max(cut.shape[1], w))
        dy, dx = resample.phase_shift(grown(template, shape), grown(cut, shape), upsample)
        return resample.affine(img, resample.move(dx - x0, dy - y0), (h, w), 0.0, 0.0)

    return resample.each(fr, work).withColumns({"ny": F.lit(h), "nx": F.lit(w)})


def centre_offsets(features: DataFrame, centres: DataFrame) -> DataFrame:
    """(feature, dy, dx): mean way from each feature (frame_idx, feature, y, x) to the centre (frame_idx, cy, cx) over the frames
    that have one."""
    both = features.join(centres, "frame_idx").select("feature", (F.col("cy") - F.col("y")).alias("dy"), (F.col("cx") - F.col("x")).alias("dx"))
    return mean_offsets(both, ["feature"])


def obscured_centres(features: DataFrame, offsets: DataFrame) -> DataFrame:
    """(frame_idx, cy, cx) of frames whose centre isn't seen: the mean of what their features and the offsets say."""
    said = features.join(F.broadcast(offsets), "feature")  # a row for each feature of a config
    return said.groupBy("frame_idx").agg(F.avg(F.col("y") + F.col("dy")).alias("cy"), F.avg(F.col("x") + F.col("dx")).alias("cx"))


def centred_frames(fr: DataFrame, centres: DataFrame, ny: int, nx: int) -> DataFrame:
    """Frames of ny x nx whose middle is the centre found in each (cy, cx)."""

    def work(img: np.ndarray, cy: float, cx: float) -> np.ndarray:
        return resample.affine(img, resample.move((nx - 1) / 2 - cx, (ny - 1) / 2 - cy), (ny, nx), 0.0, 0.0)

    moved = resample.each(fr.join(centres, "frame_idx"), work, F.col("cy"), F.col("cx"))
    return moved.select("frame_idx", "ext", F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), "pix")


def mean_offsets(measured: DataFrame, by: list[str]) -> DataFrame:
    """Mean offset of each feature; those of obscured frames are put together from them."""
    return measured.groupBy(*by).agg(F.avg("dy").alias("dy"), F.avg("dx").alias("dx"))


def crop(px: DataFrame, ny: int, nx: int) -> DataFrame:
    """The largest centred part, the same for all frames, in which no pixel is missing: smallest cut from every edge."""
    edge = F.least(F.col("y"), F.col("x"), F.lit(ny - 1) - F.col("y"), F.lit(nx - 1) - F.col("x"))
    cut = px.where("v is null").agg(F.coalesce(F.max(edge) + 1, F.lit(0)).alias("cut"))
    inside = (F.col("y") >= F.col("cut")) & (F.col("x") >= F.col("cut")) & (F.col("y") < ny - F.col("cut")) & (F.col("x") < nx - F.col("cut"))
    return px.crossJoin(F.broadcast(cut)).where(inside).drop("cut")  # cut: one row
