"""Whole commands composed of the operators: evaluation of an image, summary of a calibration grid, measurement of a grid of tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import geometry, photometry
from starloom.model import missing, pixels
from starloom.operators import apertures, combine, grid, resample, selection
from starloom.sources import fits

#: What makes a task of its own; rows that agree in these share one execution.
EXTERNAL = ["r_px", "pa_deg", "annulus_resel", "injected_scale", "decimate_frames_by"]
FILTERS = ["tophat", "matched"]


def evaluated(px: DataFrame, companions: DataFrame, diameter: float, exclude_nearest: int, ny: int, nx: int, threshold: float, low: float | None = None, high: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(recovered, candidates) of images: signal and snr where companions are expected, and the peaks of a blind search."""
    rings = apertures.ring(companions, diameter, exclude_nearest)
    recovered = apertures.measured(apertures.aperture_means(px, rings, diameter, ny, nx), ["frame_idx", "ext", *(c for c in companions.columns)])
    iwa, owa = geometry.working_radii(ny, nx, diameter, exclude_nearest, low, high)
    snr = apertures.snr_map(resample.convolved(px, resample.tophat(diameter)), diameter, iwa, owa, exclude_nearest, ny, nx)
    whole = px.select("frame_idx", "ext", "y", "x").join(snr.select("frame_idx", "ext", "y", "x", F.col("snr").alias("v")), ["frame_idx", "ext", "y", "x"], "left").fillna(0.0, "v")
    return recovered, apertures.peaks(whole, threshold, ny, nx)


def as_json(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, result): the rows of each part as JSON texts."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("result"))
        out = one if out is None else out.unionByName(one)
    return out


def grid_summarised(df: DataFrame, predicates: list[tuple[str, str, object]], params: list[str], index: list[str], least_snr: float, detected: float, arcsec_per_px: float, wavelength_m: float, diameter_m: float, normalise: list[str] | None = None, enforce_spacing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(limits, detections) of a grid (r_px, pa_deg, scale, snr, ..): rows that satisfy the predicates and have an snr, divided by
    their spread by `normalise` if that is given; magnitudes, separations in arcseconds and lambda / D; detections only on radii
    with limits that are lambda / D apart."""
    rows = selection.with_value(grid.kept(df, predicates), "snr")
    if normalise:
        rows = grid.normalised(rows, normalise, "snr", "scale")
    limits, detections = grid.summarised(rows, "r_px", "pa_deg", "snr", "scale", params, index, least_snr, detected)
    limits = limits.withColumn("delta_mag_contrast_limit_snr5", photometry.contrast_to_deltamag(F.col("contrast_limit_snr5")))
    if enforce_spacing:
        per = np.degrees(wavelength_m / diameter_m) * 3600 / arcsec_per_px
        detections = detections.join(F.broadcast(grid.spaced(limits, "r_px", float(per))), "r_px", "left_semi")  # radii: one per ring
    more = {"r_as": F.col("r_px") * arcsec_per_px, "r_lambda_over_d": photometry.arcsec_to_lambda_over_d(F.col("r_px") * arcsec_per_px, wavelength_m, diameter_m)}
    return limits.withColumns(more), detections.withColumns(more)


def measurement_grid(spark: SparkSession, iwa: float, owa: float, n_radii: int, spacing: float, scales: list[float], decimations: list[int], ks: list, annuli: list[float], exts: list[str]) -> DataFrame:
    """Every point to measure, time_total_sec 0, index from 0 by decimation, place, scale, modes, annulus, extension and filter. A scale of
    0 is put first if there is none: detections need it."""
    scales = scales if 0.0 in map(float, scales) else [0.0, *scales]
    # Places in the order of rings and angles, scales in the order given: probes() of the angles' own numbers.
    places = selection.numbered(grid.probes(spark, iwa, owa, n_radii, spacing, [0.0]).select("r_px", "pa_deg"), "r_px", "pa_deg").withColumnRenamed("frame_idx", "_i")
    index, out = F.col("_i"), places.crossJoin(F.broadcast(places.agg(F.count("*").alias("_n"))))  # one row
    step = lambda t, name, values: t.withColumn("_c", F.lit(name)).select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"_{name}", name)).drop("_c")
    axes = {"decimate_frames_by": decimations, "injected_scale": [float(s) for s in scales], "k_modes_requested": ks, "annulus_resel": [float(a) for a in annuli], "ext": sorted(exts), "filter_name": FILTERS}
    for name, values in axes.items():
        out = step(out, name, values)
    index = F.col("_decimate_frames_by") * F.col("_n") + index
    for name in list(axes)[1:]:
        index = index * len(axes[name]) + F.col(f"_{name}")
    return out.select(index.cast("long").alias("index"), F.lit(0.0).alias("time_total_sec"), "r_px", "pa_deg", *axes)


def tasks_run(points: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str] | None = None) -> DataFrame:
    """work on the points of each task, one call for all that share the keys; it returns them with what it measured."""
    return points.groupBy(*(keys or EXTERNAL)).applyInPandas(work, schema)


def computed_once(points: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """points with the columns that work gives for their keys, worked out once for each distinct key."""
    return points.join(work(points.select(*keys).distinct()), keys)


def measured_grid(points: DataFrame, checkpoint: str, run: Callable[[DataFrame], DataFrame], batches: int = 1, by: str = "index") -> DataFrame:
    """The whole measured grid. Points without a time in the checkpoint are run, in batches, each of which is appended to the
    checkpoint when it is done, so that a run that was stopped goes on from there."""
    spark = points.sparkSession

    def done() -> DataFrame | None:
        return spark.read.parquet(checkpoint) if fits.exists(spark, checkpoint) else None

    for k in range(batches):
        old = done()
        left = points if old is None else grid.pending(points, old, [by])
        run(left.where(F.pmod(F.hash(*EXTERNAL), F.lit(batches)) == k)).write.mode("append").parquet(checkpoint)
    return done()


def ring_scaled(df: DataFrame, r: str, value: str, width: float, out: str = "snr", excluded=None) -> DataFrame:
    """value divided by the robust spread of the values on rings less than width away, those excluded left out of the spread."""
    sample = df if excluded is None else df.where(~excluded)
    sigmas = grid.ring_sigmas(sample.select(r, value), r, value, width, df.select(r)).withColumnRenamed("r0", r)
    return df.join(sigmas, r, "left").withColumn(out, F.col(value) / F.nullif(F.col("sigma"), F.lit(0.0))).drop("sigma")


def loaded(fr: DataFrame, angle: Column, template: np.ndarray, companions: list[tuple[float, float, float]], factor: Column | None = None, every: int = 1, offset: int = 0, size: int = 1, how: str = "sum") -> DataFrame:
    """(kind, frame_idx, ext, y, x, v, angle_deg) of the frames offset, offset + every, ..: kind `model` is the companions' signal at
    scale 1, `image` the frames divided by their factor plus companions (r_px, pa_deg, scale) at their scale. Every `size` frames are
    combined, their angles averaged; frame_idx counts what is left."""
    part = fr.withColumn("_a", angle.cast("double")).where((F.col("frame_idx") >= offset) & ((F.col("frame_idx") - offset) % every == 0))
    image = part.withColumn("_f", F.lit(1.0) if factor is None else factor.cast("double"))
    image = image.withColumn("pix", F.transform("pix", lambda v: missing(v) / F.col("_f"))).drop("_f")
    zeros = part.withColumn("pix", F.transform("pix", lambda _: F.lit(0.0)))
    place = "r_px double, pa_deg double, scale double"
    table = lambda rows: fr.sparkSession.createDataFrame(rows, place)
    some = [c for c in companions if c[2] != 0]
    image = resample.injected(image, table(some), template, F.col("_a")) if some else image
    model = resample.injected(zeros, table([(r, pa, 1.0) for r, pa, _ in companions]), template, F.col("_a")) if companions else zeros
    turned = part.select(F.floor((F.col("frame_idx") - offset) / (every * size)).alias("frame_idx"), "ext", "_a").groupBy("frame_idx", "ext").agg(F.avg("_a").alias("angle_deg"))
    out = None
    for kind, frames in (("image", image), ("model", model)):
        px = pixels(frames).withColumn("frame_idx", F.expr(f"(frame_idx - {offset}) div {every}"))
        one = combine.chunks(px, size, how).withColumnRenamed("chunk", "frame_idx").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.join(turned, ["frame_idx", "ext"]).select("kind", "frame_idx", "ext", "y", "x", "v", "angle_deg")


def components_stacked(components: list[tuple[DataFrame, DataFrame | None, float, Column | None, int]], how: str = "sum") -> DataFrame:
    """(destination, y, x, v, coverage) of components (frames, mask (y, x) or None, amplitude, angle or None, destination): pixels
    outside the mask are missing, frames are derotated by their angle, multiplied by the amplitude and combined; the coverage is
    the sum of the masks, derotated alike."""
    out = None
    for fr, mask, amplitude, angle, destination in components:
        px = pixels(fr).withColumn("_n", F.lit(1.0))
        if mask is not None:
            px = px.join(mask.select("y", "x").distinct().withColumn("_in", F.lit(True)), ["y", "x"], "left").withColumn("_n", F.when(F.col("_in"), 1.0).otherwise(0.0))
        px = px.withColumn("v", F.when(F.col("_n") > 0, F.col("v")))
        if angle is not None:
            whole = fr.select("frame_idx", "ext", "ny", "nx", angle.cast("double").alias("_a"))
            at = F.col("y") * F.col("nx") + F.col("x")
            rows = px.join(whole, ["frame_idx", "ext"]).groupBy("frame_idx", "ext", "ny", "nx", "_a").agg(F.array_sort(F.collect_list(F.struct(at.alias("i"), "v", "_n"))).alias("_p"))  # an image a row
            turned = lambda c: resample.derotated(rows.withColumn("pix", F.col(f"_p.{c}")), F.col("_a")).select("frame_idx", "ext", "ny", "nx", "pix")  # noqa: E731, B023
            px = pixels(turned("v")).join(pixels(turned("_n")).withColumnRenamed("v", "_n"), ["frame_idx", "ext", "y", "x"])
        one = px.select(F.lit(destination).alias("destination"), "y", "x", (F.col("v") * amplitude).alias("v"), "_n")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("destination", "y", "x").agg(combine.STATISTICS[how](F.col("v")).alias("v"), F.coalesce(F.sum("_n"), F.lit(0.0)).alias("coverage"))


def saved(spark: SparkSession, artifacts: dict[str, DataFrame], folder: str) -> list[str]:
    """The artifacts as Parquet tables of their names in the folder; FileExistsError if any of them is there, and nothing is written."""
    paths = [f"{folder.rstrip('/')}/{name}" for name in artifacts]
    for path in paths:
        if fits.exists(spark, path):
            raise FileExistsError(path)
    for path, df in zip(paths, artifacts.values(), strict=True):
        df.write.parquet(path)
    return paths


def exclusions(angles_deg: np.ndarray, nearest: int = 0, px: tuple[float, float] | None = None, deg: float = 0.0) -> list[np.ndarray]:
    """For each frame the mask of those left out of its reference: within `nearest` places, within px = (radius, distance) of
    rotation at that radius, else within deg of angle; any of them suffices. ValueError if a frame's are not contiguous."""
    angles_deg = np.asarray(angles_deg, float)
    criteria = [(np.arange(len(angles_deg)), nearest)] if nearest > 0 else []
    if px is not None and px[1] > 0:
        criteria.append((px[0] * np.unwrap(np.radians(angles_deg)), px[1]))
    elif deg > 0:
        criteria.append((angles_deg, deg))
    out = []
    for i in range(len(angles_deg)):
        mask = np.zeros(len(angles_deg), bool)
        for values, delta in criteria:
            mask |= np.abs(values - values[i]) <= delta
        at = np.flatnonzero(mask)
        if len(at) and at[-1] - at[0] + 1 != len(at):
            raise ValueError(f"the frames excluded for frame {i} are not contiguous")
        out.append(mask)
    return out


def exclusion_table(spark: SparkSession, masks: list[np.ndarray]) -> DataFrame:
    """(i, first, last, n) of frames' exclusions; as many rows as the Gram matrix has."""
    rows = [(i, *((int(a[0]), int(a[-1]), len(a)) if len(a := np.flatnonzero(m)) else (None, None, 0))) for i, m in enumerate(masks)]
    return spark.createDataFrame(rows, "i long, first long, last long, n long")
