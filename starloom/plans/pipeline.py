"""Starlight subtraction end to end: rank, residuals for each mode count, derotation, stack, filter, measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.geometry import centre
from starloom.model import pixels, repacked, series, unseries
from starloom.operators import apertures, resample
from starloom.plans import linalg


def residuals(fr: DataFrame, ks: list[int], ny: int, nx: int) -> DataFrame:
    """frames of the residuals for each mode count (`k`): one decomposition for all of them."""
    se = linalg.centred(series(pixels(fr)))
    _, v = linalg.main_modes(se, max(ks, default=0))
    order = fr.select("frame_idx").orderBy("frame_idx").toPandas()["frame_idx"].tolist()  # as many as a mode has values
    place = fr.sparkSession.createDataFrame(list(enumerate(order)), "i int, frame_idx long")
    out = None
    for k in ks:
        left = unseries(linalg.mapped(se, lambda m, w=v[:, :k]: m - (m @ w) @ w.T)).join(F.broadcast(place), "i").select("frame_idx", "ext", "y", "x", "v")  # a row a frame
        one = repacked(left, ny, nx).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def stacked(fr: DataFrame, angle: Column, how=F.avg, least: int = 0) -> DataFrame:
    """Derotated frames combined by mode count: (k, ext, y, x, v, n), pixels with more than `least` frames."""
    turned = resample.derotated(fr, angle)
    one = turned.select("k", "ext", "nx", F.posexplode("pix").alias("i", "v"))
    image = one.groupBy("k", "ext", F.expr("cast(i div nx as int)").alias("y"), F.expr("cast(i % nx as int)").alias("x"))
    return image.agg(how("v").alias("v"), F.count("v").alias("n")).where(F.col("n") > least)


def inject_and_measure(fr: DataFrame, angle: Column, companions: list[tuple[float, float, float]], ks: list[int], diameter: float, ny: int, nx: int) -> DataFrame:
    """(k, r_px, pa_deg, signal, snr) of companions injected into frames, after subtraction, derotation and a tophat filter."""
    spark = fr.sparkSession
    places = spark.createDataFrame(companions, "r_px double, pa_deg double, scale double")
    template = resample.gauss2d(5, 5, 2, 2, 1.0, 1.0)
    with_signal = resample.injected(fr, places, template, angle)
    image = stacked(residuals(with_signal, ks, ny, nx), angle)
    convolved = resample.convolved(image.select(F.col("k").cast("long").alias("frame_idx"), "ext", "y", "x", "v"), resample.tophat(diameter))
    rings = apertures.ring(places.select("r_px", "pa_deg"), diameter)
    rings = rings.withColumn("y", F.bround(F.col("ay") + centre(ny)).cast("int")).withColumn("x", F.bround(F.col("ax") + centre(nx)).cast("int"))
    values = F.broadcast(rings).join(convolved, ["y", "x"])  # rings: some apertures for each companion of a config
    return apertures.measured(values, ["frame_idx", "r_px", "pa_deg"]).select(F.col("frame_idx").cast("int").alias("k"), "r_px", "pa_deg", "signal", "snr")
