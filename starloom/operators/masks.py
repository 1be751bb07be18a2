"""Masks: predicates on pixel positions, mask algebra and morphology. A mask is a table (y, x) of the pixels that it holds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.geometry import phi, rho


def arc(yc: float, xc: float, r0: float = 0.0, r1: float | None = None, from_rad: float = 0.0, to_rad: float = 0.0, turn_rad: float = 0.0) -> Column:
    """Radii from r0 to r1, angles from from_rad to to_rad past +X, ends included; equal angles are a full ring."""
    r, a = rho(F.col("y"), F.col("x"), yc, xc), F.pmod(phi(F.col("y"), F.col("x"), yc, xc) + turn_rad, F.lit(2 * math.pi))
    inside = r >= r0
    if r1 is not None:
        inside &= r <= r1
    lo, hi = from_rad % (2 * math.pi), to_rad % (2 * math.pi)
    return inside & (a >= lo) & (a <= hi) if lo != hi else inside


def box(yc: float, xc: float, height: float, width: float, deg: float = 0.0) -> Column:
    """A box about (yc, xc), turned by deg, edges included."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    if deg:
        r, a = rho(F.col("y"), F.col("x"), yc, xc), phi(F.col("y"), F.col("x"), yc, xc) + math.radians(deg)
        y, x = r * F.sin(a) + yc, r * F.cos(a) + xc
    return (y >= yc - height / 2) & (y <= yc + height / 2) & (x >= xc - width / 2) & (x <= xc + width / 2)


def radial(yc: float, xc: float, low: float | None = None, high: float | None = None) -> Column:
    """Radii strictly between the limits that are given."""
    r, out = rho(F.col("y"), F.col("x"), yc, xc), F.lit(True)
    if low is not None:
        out &= r > low
    return out & (r < high) if high is not None else out


def half_planes(yc: float, xc: float, deg: float) -> Column:
    """Which side of a line through the centre at an angle a pixel is on: left true."""
    return F.sin(phi(F.col("y"), F.col("x"), yc, xc) - math.radians(deg)) > 0


def dark_hole(yc: float, xc: float, owa: float, offset: float, deg: float, left: bool) -> Column:
    """A half disk of radius owa, its straight edge `offset` from the centre on one side of a line at an angle."""
    along = (F.col("y") - yc) * math.cos(math.radians(deg)) - (F.col("x") - xc) * math.sin(math.radians(deg))
    return (rho(F.col("y"), F.col("x"), yc, xc) <= owa) & (along > offset if left else along < -offset)


def applied(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels in the mask. A mask is as large as one image: Spark broadcasts it where that is below its limit."""
    return px.join(mask, ["y", "x"], "left_semi")


def regions(grid: DataFrame, shapes: DataFrame, invert: bool = False) -> DataFrame:
    """Pixels in any of the shapes (shape, cx, cy, r, w, h, rot_deg), or in none."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    a = F.radians(F.col("rot_deg"))
    u, v = dx * F.cos(a) + dy * F.sin(a), -dx * F.sin(a) + dy * F.cos(a)
    hit = F.when(F.col("shape") == "circle", dx * dx + dy * dy <= F.col("r") * F.col("r")).otherwise((F.abs(u) <= F.col("w") / 2) & (F.abs(v) <= F.col("h") / 2))
    return grid.join(F.broadcast(shapes), hit, "left_anti" if invert else "left_semi")  # shapes: a region file's lines


def dilated(mask: DataFrame, n: int, ny: int, nx: int) -> DataFrame:
    """n dilations by the cross of four neighbours: the diamond of radius n about each pixel."""
    diamond = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-n, n + 1) for dx in range(-n + abs(dy), n - abs(dy) + 1)))
    out = mask.withColumn("_d", F.explode(diamond)).select((F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x") + F.col("_d.dx")).alias("x"))
    return out.where((F.col("y") >= 0) & (F.col("y") < ny) & (F.col("x") >= 0) & (F.col("x") < nx)).distinct()


def eroded(mask: DataFrame, grid: DataFrame, n: int, ny: int, nx: int) -> DataFrame:
    """n erosions; outside the image counts as outside the mask."""
    out = grid.join(mask, ["y", "x"], "left_anti")
    edge = grid.where((F.col("y") < n) | (F.col("x") < n) | (F.col("y") >= ny - n) | (F.col("x") >= nx - n))
    near = dilated(out, n, ny, nx)
    return mask.join(near, ["y", "x"], "left_anti").join(edge, ["y", "x"], "left_anti")


def closed(mask: DataFrame, grid: DataFrame, n: int, ny: int, nx: int) -> DataFrame:
    """Dilation, then erosion."""
    return eroded(dilated(mask, n, ny, nx), grid, n, ny, nx)
