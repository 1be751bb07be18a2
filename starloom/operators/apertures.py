"""Aperture photometry: rings of apertures, sums, small-sample signal to noise, maps, peaks and profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.geometry import centre, pa_of, rho


def ring(locations: DataFrame, diameter: float, exclude_nearest: int = 0) -> DataFrame:
    """locations (r_px, pa_deg, ...) with a row for each aperture: k (0 the signal's own), ax, ay from the centre.

    As many as fit the circumference, anticlockwise from the location; exclude_nearest of them on either side of it are left out.
    """
    n = F.floor(2 * math.pi * F.col("r_px") / diameter).cast("int")
    k = F.explode(F.sequence(F.lit(0), F.col("n_apertures") - 1))
    out = locations.withColumn("n_apertures", n).where("n_apertures > 0").withColumn("k", k)
    angle = F.radians(F.col("pa_deg") + 90) + F.col("k") * (2 * math.pi / F.col("n_apertures"))
    out = out.withColumn("ax", F.col("r_px") * F.cos(angle)).withColumn("ay", F.col("r_px") * F.sin(angle))
    if exclude_nearest:
        out = out.where((F.col("k") == 0) | ((F.col("k") > exclude_nearest) & (F.col("k") < F.col("n_apertures") - exclude_nearest)))
    return out


def aperture_means(px: DataFrame, apertures: DataFrame, diameter: float, ny: int, nx: int) -> DataFrame:
    """Mean of the pixels there within diameter / 2 of each aperture's centre: by frame and the apertures' columns, `v`.

    Each aperture is spread over the pixels of the square about it, so the join is on equal y, x.
    """
    reach, half = math.ceil(diameter / 2) + 1, diameter / 2
    cy, cx = F.col("ay") + centre(ny), F.col("ax") + centre(nx)
    near = F.sequence(F.lit(-reach), F.lit(reach))
    wide = apertures.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near))
    wide = wide.withColumn("y", (F.round(cy).cast("int") + F.col("_dy"))).withColumn("x", (F.round(cx).cast("int") + F.col("_dx")))
    wide = wide.where(F.sqrt((F.col("y") - cy) * (F.col("y") - cy) + (F.col("x") - cx) * (F.col("x") - cx)) <= half)
    keys = [c for c in apertures.columns if c not in ("y", "x")]
    return px.join(wide.drop("_dy", "_dx"), ["y", "x"]).groupBy("frame_idx", "ext", *keys).agg((F.sum("v") / F.count("v")).alias("v")).where("v is not null")


def snr(signal: Column, noise: Column) -> Column:
    """Signal to noise with the small-sample penalty: an aggregate of noise values, NULL without any or without spread."""
    n = F.count(noise)
    return (signal - F.avg(noise)) / F.nullif(F.stddev_pop(noise) * F.sqrt(1 + 1 / F.nullif(n, F.lit(0))), F.lit(0.0))


def measured(values: DataFrame, by: list[str]) -> DataFrame:
    """signal, snr and n_noise of apertures (k, v)."""
    signal, noise = F.max(F.when(F.col("k") == 0, F.col("v"))), F.when(F.col("k") > 0, F.col("v"))
    return values.groupBy(*by).agg(signal.alias("signal"), snr(signal, noise).alias("snr"), F.count(noise).alias("n_noise"))


def snr_map(convolved: DataFrame, diameter: float, iwa: float, owa: float, exclude_nearest: int, ny: int, nx: int) -> DataFrame:
    """signal and snr of each pixel between the radii, from the pixel nearest each aperture's centre in a convolved image."""
    yc, xc = centre(ny), centre(nx)
    at = convolved.select("frame_idx", "ext", "y", "x", rho(F.col("y"), F.col("x"), yc, xc).alias("r_px"), pa_of(F.col("y"), F.col("x"), yc, xc).alias("pa_deg"))
    rings = ring(at.where((F.col("r_px") >= iwa) & (F.col("r_px") <= owa)), diameter, exclude_nearest)
    rings = rings.withColumnsRenamed({"y": "py", "x": "px"}).withColumn("y", F.bround(F.round(F.col("ay") + yc, 9)).cast("int")).withColumn("x", F.bround(F.round(F.col("ax") + xc, 9)).cast("int"))
    got = rings.join(convolved, ["frame_idx", "ext", "y", "x"]).select("frame_idx", "ext", F.col("py").alias("y"), F.col("px").alias("x"), "k", "v")
    return measured(got, ["frame_idx", "ext", "y", "x"]).where("n_noise >= 2")


def local_maxima(px: DataFrame, ny: int, nx: int, reach: int = 2) -> DataFrame:
    """Pixels that no pixel within reach in y and x exceeds; those nearer than reach to an edge are none."""
    around = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)))
    wide = px.withColumn("_o", F.explode(around)).select("frame_idx", "ext", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), "v", F.when((F.col("_o.dy") == 0) & (F.col("_o.dx") == 0), F.col("v")).alias("own"))
    inside = (F.col("y") >= reach) & (F.col("y") < ny - reach) & (F.col("x") >= reach) & (F.col("x") < nx - reach)
    return wide.where(inside).groupBy("frame_idx", "ext", "y", "x").agg(F.max("own").alias("v"), F.max("v").alias("m")).where("v >= m").drop("m")


def peaks(snr_px: DataFrame, threshold: float, ny: int, nx: int) -> DataFrame:
    """Local maxima of an snr image (v) above the threshold with their radius, angle and rank in their frame."""
    best = local_maxima(snr_px, ny, nx).where(F.col("v") > threshold)
    yc, xc = centre(ny), centre(nx)
    w = Window.partitionBy("frame_idx", "ext").orderBy(F.col("v").desc(), "y", "x")
    return best.select("frame_idx", "ext", "y", "x", F.col("v").alias("snr"), rho(F.col("y"), F.col("x"), yc, xc).alias("r_px"), pa_of(F.col("y"), F.col("x"), yc, xc).alias("pa_deg"), F.row_number().over(w).alias("rank"))


def profile(px: DataFrame, ny: int, nx: int, saturation: float | None = None) -> DataFrame:
    """By frame and ring n (n - 1 <= rho < n, n below the largest radius): encircled energy, profile at n - 0.5, pixels."""
    yc, xc = centre(ny), centre(nx)
    n = (F.floor(rho(F.col("y"), F.col("x"), yc, xc)) + 1).cast("int")
    rings = px.withColumn("n", n).where(F.col("n") < int(min(yc, xc))).groupBy("frame_idx", "ext", "n").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.count("*").alias("npix"), F.max("v").alias("m"))
    value = F.col("s") / F.col("npix")
    if saturation is not None:
        value = F.when(F.coalesce(F.col("m") < saturation, F.lit(True)), value)
    w = Window.partitionBy("frame_idx", "ext").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return rings.select("frame_idx", "ext", "n", "npix", F.sum("s").over(w).alias("encircled"), (F.col("n") - 0.5).alias("r"), value.alias("profile"))


def trimmed(profiles: DataFrame) -> DataFrame:
    """Profiles up to their first negative value."""
    w = Window.partitionBy("frame_idx", "ext")
    first = F.min(F.when(F.col("profile") < 0, F.col("n"))).over(w)
    return profiles.withColumn("_f", first).where("_f is null or n < _f").drop("_f")


def template_factors(profiles: DataFrame, template: DataFrame) -> DataFrame:
    """Mean ratio of each frame's profile to the template's (n, t) over rings that both have."""
    return profiles.join(F.broadcast(template), "n").groupBy("frame_idx", "ext").agg(F.avg(F.col("profile") / F.col("t")).alias("factor"))  # rings of one image


def radial_std(px: DataFrame, ny: int, nx: int) -> DataFrame:
    """Standard deviation of radius about the centre by the pixels' values as weights, in y and x, added in squares."""
    w = F.col("v")
    my, mx = F.sum(w * F.col("y")) / F.sum(w), F.sum(w * F.col("x")) / F.sum(w)
    one = px.groupBy("frame_idx", "ext").agg(my.alias("my"), mx.alias("mx"), (F.sum(w * F.col("y") * F.col("y")) / F.sum(w)).alias("yy"), (F.sum(w * F.col("x") * F.col("x")) / F.sum(w)).alias("xx"))
    return one.select("frame_idx", "ext", F.sqrt(F.col("yy") - F.col("my") ** 2 + F.col("xx") - F.col("mx") ** 2).alias("radial_std"))
