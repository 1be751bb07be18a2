"""Coordinates: pixel centres at integers, centre of an image at ((ny - 1) / 2, (nx - 1) / 2), position angle from +Y anticlockwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centre(n: int) -> float:
    return (n - 1) / 2


def rho(y: Column, x: Column, yc: float, xc: float) -> Column:
    return F.sqrt((x - xc) * (x - xc) + (y - yc) * (y - yc))


def phi(y: Column, x: Column, yc: float, xc: float) -> Column:
    """Angle from +X in radians, -pi to pi."""
    return F.atan2((y - yc).cast("double"), (x - xc).cast("double"))


def x_of(r: Column, pa_deg: Column, xc: float = 0.0, derotation_deg=0.0) -> Column:
    return r * F.cos(F.radians(F.lit(90.0) + pa_deg - derotation_deg)) + xc


def y_of(r: Column, pa_deg: Column, yc: float = 0.0, derotation_deg=0.0) -> Column:
    return r * F.sin(F.radians(F.lit(90.0) + pa_deg - derotation_deg)) + yc


def pa_of(y: Column, x: Column, yc: float = 0.0, xc: float = 0.0) -> Column:
    return F.pmod(F.degrees(phi(y, x, yc, xc)) - 90, F.lit(360.0))


def max_radius(ny: int, nx: int) -> float:
    """Radius of the largest circle about the centre that is inside the image."""
    return min(centre(ny), centre(nx))


def min_radius(px: DataFrame, ny: int, nx: int) -> DataFrame:
    """(frame_idx, ext, r): the least whole radius below the largest circle's whose ring of one pixel has nothing missing, NULL if none."""
    ring = F.floor(rho(F.col("y"), F.col("x"), centre(ny), centre(nx)) + 0.5).cast("int")
    gone = px.groupBy("frame_idx", "ext").agg(F.collect_set(F.when(F.col("v").isNull(), ring)).alias("_g"))  # at most a ring a pixel of radius
    whole = F.expr(f"filter(sequence(0, {int(max_radius(ny, nx)) - 1}), i -> not array_contains(_g, i))")
    return gone.select("frame_idx", "ext", F.try_element_at(whole, F.lit(1)).alias("r"))


def working_radii(ny: int, nx: int, diameter: float, exclude_nearest: int, low: float | None = None, high: float | None = None) -> tuple[float, float]:
    """Radii with two noise apertures at least and apertures inside the image, within the data's own limits."""
    least = (2 * exclude_nearest + 3) * diameter / (2 * math.pi) + diameter / 2
    most = max_radius(ny, nx) - diameter / 2
    return max(least, low + diameter / 2 if low is not None else least), min(most, high - diameter / 2 if high is not None else most)
