"""Calibration grids: parameter products, resumption, noise normalisation, contrast limits and detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPARE = {"gt": "__gt__", "ge": "__ge__", "eq": "__eq__", "le": "__le__", "lt": "__lt__", "ne": "__ne__"}


def probes(spark, iwa: float, owa: float, n_radii: int, spacing: float, scales: list[float], start_pa: float = 0.0) -> DataFrame:
    """(r_px, pa_deg, scale): on n_radii rings as many angles as `spacing` allows, at each every scale."""
    step = (owa - iwa) / (n_radii - 1) if n_radii > 1 else 0.0
    rings = spark.range(n_radii).select((F.lit(float(iwa)) + F.col("id") * step).alias("r_px"))
    n = F.floor(2 * F.pi() * F.col("r_px") / spacing).cast("int")
    at = rings.withColumn("n", n).where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = at.select("r_px", F.pmod(F.lit(float(start_pa)) + F.col("j") * (360.0 / F.col("n")), F.lit(360.0)).alias("pa_deg"))
    return at.withColumn("scale", F.explode(F.array(*(F.lit(float(s)) for s in scales))))


def product(*axes: DataFrame) -> DataFrame:
    """Every combination of small parameter tables, with an index. The result is the grid itself: a row for each task."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the grid that the checkpoint has no time for."""
    return grid.join(done.where("time_total_sec > 0").select(*keys).distinct(), keys, "left_anti")


def kept(df: DataFrame, predicates: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that satisfy all (column, comparison, value); a missing value only satisfies ne."""
    for column, op, value in predicates:
        c = F.col(column)
        df = df.where(c.eqNullSafe(F.lit(value)) if op == "eq" else ~c.eqNullSafe(F.lit(value)) if op == "ne" else getattr(c, COMPARE[op])(value))
    return df


def normalised(df: DataFrame, by: list[str], snr: str, scale: str) -> DataFrame:
    """snr divided by its spread over the rows without injection of the same configuration; the old one as unnormalized_snr."""
    spread = df.where(F.col(scale) == 0).groupBy(*by).agg(F.stddev_pop(snr).alias("_s"))
    return df.join(spread, by, "left").withColumn("unnormalized_snr", F.col(snr)).withColumn(snr, F.col(snr) / F.nullif(F.coalesce("_s", F.lit(1.0)), F.lit(0.0))).drop("_s")


def summarised(df: DataFrame, r: str, pa: str, snr: str, scale: str, params: list[str], index: list[str], least_snr: float, detected: float) -> tuple[DataFrame, DataFrame]:
    """(limits, detections). Limits: at each place the injection with the smallest contrast at snr 5, where the same
    parameters without injection show nothing at `detected` or above. Detections: those rows without injection.
    Ties go to the smallest index.
    """
    place = [r, pa]
    injected = df.where((F.col(scale) > 0) & (F.col(snr) > least_snr)).withColumn("contrast_limit_snr5", F.col(scale) / F.col(snr) * 5)
    first = Window.partitionBy(*place).orderBy("contrast_limit_snr5", *index)
    best = injected.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    none = df.where(~(F.col(scale) > 0)).withColumn("_k", F.row_number().over(Window.partitionBy(*place, *params).orderBy(*index))).where("_k = 1").drop("_k")
    detections = none.join(best.select(*place, *params, "contrast_limit_snr5"), [*place, *params])
    limits = best.join(detections.where(F.col(snr) < detected).select(*place).distinct(), place, "left_semi")
    return limits, detections


def sigma_mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """1.48 times the median distance from the median, by group."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_m"))
    return df.join(middle, by).groupBy(*by).agg((1.48 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("sigma"))


def ring_sigmas(df: DataFrame, r: str, value: str, width: float, at: DataFrame | None = None) -> DataFrame:
    """For each distinct radius (of `at`, if given) the sigma_mad of all values less than `width` from it.

    Radii are put in bands of the width: a radius only needs its own band and the two beside it, an equi-join.
    """
    radii = (df if at is None else at).select(F.col(r).alias("r0")).distinct().withColumn("_b", F.explode(F.array(*(F.floor(F.col("r0") / width) + k for k in (-1, 0, 1)))))
    rows = df.select(F.col(r).alias("_r"), F.col(value).alias("_v"), F.floor(F.col(r) / width).alias("_b"))
    near = rows.join(radii, "_b").where(F.abs(F.col("_r") - F.col("r0")) < width).select("r0", "_v")
    return sigma_mad(near, ["r0"], "_v")


def spaced(limits: DataFrame, r: str, least: float) -> DataFrame:
    """The radii that have limits, in ascending order, leaving out those less than `least` past the last that was kept, 0 being
    taken as kept at first. Distinct radii are few (one per ring of an image)."""
    fold = f"""aggregate(_s, cast(array() as array<double>), (a, v) -> if(v - coalesce(try_element_at(a, -1), 0d) >= {least!r}, concat(a, array(v)), a))"""
    return limits.agg(F.array_sort(F.collect_set(F.col(r).cast("double"))).alias("_s")).select(F.explode(F.expr(fold)).alias(r))
