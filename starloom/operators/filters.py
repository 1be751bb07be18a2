"""Filters of images before and after stacking: a normalised tophat, and matched filters from the model's own images.

Both keep missing pixels missing and take them as 0 in their neighbours' sums. Kernels are at most (2 radius + 1) squared pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.geometry import centre, rho, x_of, y_of
from starloom.model import pixels
from starloom.operators import resample

KEYS = ["frame_idx", "ext", "y", "x"]


def where_there(out: DataFrame, px: DataFrame) -> DataFrame:
    """out, missing where px is."""
    gone = px.where("v is null").select(*KEYS).withColumn("_gone", F.lit(True))
    return out.join(gone, KEYS, "left").select(*KEYS, F.when(F.col("_gone").isNull(), F.col("v")).alias("v"))


def disk(radius: float) -> list[tuple[int, int, float]]:
    """Equal weights, 1 in all, of the pixels within radius of the middle one."""
    n = math.floor(radius)
    at = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if math.hypot(a, b) <= radius]
    return [(a, b, 1.0 / len(at)) for a, b in at]


def tophat(px: DataFrame, radius: float) -> DataFrame:
    """The mean within radius of each pixel."""
    return where_there(resample.convolved(px, disk(radius)), px)


def centred_models(models: DataFrame, r_px: float, pa_deg: float, angle: Column | float = 0.0) -> DataFrame:
    """Frames of a companion's model, moved so that its place before derotation is the centre."""
    angle = angle if isinstance(angle, Column) else F.lit(float(angle))
    r, pa = F.lit(float(r_px)), F.lit(float(pa_deg))
    return resample.shifted(models, -x_of(r, pa, 0.0, angle), -y_of(r, pa, 0.0, angle))


def matched_kernels(model: DataFrame, radius: float, ny: int, nx: int) -> DataFrame:
    """(frame_idx, ext, _k): of each centred model image its pixels within radius, as offsets (dy, dx) from the centre and
    weights that give 1 for the model itself; `whole` is false where one of them is missing."""
    near = model.where(rho(F.col("y"), F.col("x"), centre(ny), centre(nx)) <= radius)
    one = F.struct((F.col("y") - (ny - 1) // 2).alias("dy"), (F.col("x") - (nx - 1) // 2).alias("dx"), F.coalesce("v", F.lit(0.0)).alias("w"))
    sums = near.groupBy("frame_idx", "ext").agg(F.collect_list(one).alias("_k"), F.sum(F.col("v") * F.col("v")).alias("_s"), (F.count("v") == F.count("*")).alias("whole"))
    scaled = F.transform("_k", lambda k: F.struct(k.dy.alias("dy"), k.dx.alias("dx"), (k.w / F.col("_s")).alias("w")))
    return sums.where("_s > 0").select("frame_idx", "ext", scaled.alias("_k"), "whole")


def matched(px: DataFrame, kernels: DataFrame, by: list[str]) -> DataFrame:
    """px correlated with the kernel of equal `by` (frame_idx and ext, or ext alone for one kernel an image)."""
    keys = [c for c in ("frame_idx", "ext") if c not in by]
    each = px.join(kernels.drop(*keys), by).withColumn("_o", F.explode("_k"))
    moved = each.select("frame_idx", "ext", (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.dx")).alias("x"), (F.coalesce("v", F.lit(0.0)) * F.col("_o.w")).alias("v"))
    sums = moved.groupBy(*KEYS).agg(F.sum("v").alias("v"))
    there = px.where("v is not null").select(*KEYS).withColumn("_in", F.lit(True))
    # Pixels that no weight reaches are 0; those that were missing stay so.
    return px.select(*KEYS).join(sums, KEYS, "left").join(there, KEYS, "left").select(*KEYS, F.when(F.col("_in"), F.coalesce("v", F.lit(0.0))).alias("v"))


def pre_matched(px: DataFrame, models: DataFrame, r_px: float, pa_deg: float, radius: float, ny: int, nx: int, angle: Column | float = 0.0) -> DataFrame:
    """Each frame filtered by its own model image (frames), before stacking."""
    return matched(px, matched_kernels(pixels(centred_models(models, r_px, pa_deg, angle)), radius, ny, nx), ["frame_idx", "ext"])


def post_filters(image: DataFrame, model: DataFrame, r_px: float, pa_deg: float, resel_px: float, ny: int, nx: int, diameter_resel: float = 1.5) -> DataFrame:
    """(filter_name, frame_idx, ext, y, x, v): stacked images by both filters. model: frames of the stacked model of each ext.

    The matched image is missing altogether where its kernel has a missing pixel.
    """
    kernels = matched_kernels(pixels(centred_models(model, r_px, pa_deg)), diameter_resel * resel_px / 2, ny, nx)
    by_model = matched(image, kernels, ["ext"]).join(kernels.select("ext", "whole"), "ext").withColumn("v", F.when(F.col("whole"), F.col("v"))).select(*KEYS, "v")
    out = tophat(image, resel_px / 2).withColumn("filter_name", F.lit("tophat"))
    return out.unionByName(by_model.withColumn("filter_name", F.lit("matched"))).select("filter_name", *KEYS, "v")
