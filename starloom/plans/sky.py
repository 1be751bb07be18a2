"""Sky background: pixels fit to estimate it, and subtraction with a PCA model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.model import series
from starloom.plans import linalg


def by_frame(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """A left join on the frame and more keys, in which a missing extension meets a missing one."""
    names, same = {k: f"_{k}" for k in ("frame_idx", "ext", *keys)}, F.lit(True)
    for k, name in names.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(names), same, "left").drop(*names.values())


def filled(px: DataFrame) -> DataFrame:
    """Frames of sky for its model: a missing pixel counts as 0."""
    return px.withColumn("v", F.coalesce("v", F.lit(0.0)))


def statistics(px: DataFrame) -> DataFrame:
    """(y, x, m, s): the mean of frames of sky and its spread."""
    return filled(px).groupBy("y", "x").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))


def components(px: DataFrame, k: int) -> DataFrame:
    """(y, x, c): the k main images of frames of sky."""
    parts, _ = linalg.sky_components(series(filled(px).withColumn("ext", F.lit(0))), k)
    return parts.select("y", "x", F.col("ts").alias("c"))


def background(px: DataFrame, sky: DataFrame, n_sigma: float, grow: int, ny: int, nx: int, level: DataFrame | None = None, excluded: DataFrame | None = None, percentile: float = 0.9) -> DataFrame:
    """px with `background`: not at pixels that are missing or excluded (y, x), where the sky's own spread (y, x, m, s) is in its top
    tenth or the frame is over the mean sky by n_sigma median spreads, nor within `grow` steps of them.

    With a level (frame_idx, ext, m) frames are held against that, and sky is (y, x, s)."""
    limits = sky.agg(F.expr(f"percentile(s, {percentile})").alias("ps"), F.median("s").alias("ms"))
    one = px.join(sky, ["y", "x"]).crossJoin(F.broadcast(limits))  # limits: one row
    if level is not None:
        one = one.join(level, ["frame_idx", "ext"])
    bad = one.where((F.col("s") > F.col("ps")) | (F.col("v") > F.col("m") + n_sigma * F.col("ms")) | F.col("v").isNull()).select("frame_idx", "ext", "y", "x")
    if excluded is not None:
        bad = bad.union(px.join(excluded, ["y", "x"], "left_semi").select("frame_idx", "ext", "y", "x"))
    diamond = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-grow, grow + 1) for b in range(-grow + abs(a), grow - abs(a) + 1)))
    wide = bad.withColumn("_d", F.explode(diamond)).select("frame_idx", "ext", (F.col("y") + F.col("_d.a")).alias("y"), (F.col("x") + F.col("_d.b")).alias("x")).distinct()
    inside = wide.where((F.col("y") >= 0) & (F.col("y") < ny) & (F.col("x") >= 0) & (F.col("x") < nx))
    return by_frame(px, inside.withColumn("_bad", F.lit(True)), "y", "x").withColumn("background", F.col("_bad").isNull()).drop("_bad")


def subtracted(px: DataFrame, sky: DataFrame, parts: DataFrame, k: int, least: float = 0.05) -> DataFrame:
    """px (with `background`) less the mean sky (y, x, m) and the components fitted on the background alone; what is left has zero
    mean there. A frame with less than the share `least` of its pixels as background is an error."""
    off = px.join(sky.select("y", "x", "m").join(parts, ["y", "x"]), ["y", "x"]).withColumn("v", F.col("v") - F.col("m")).drop("m")
    fit = linalg.masked_fit(off.where("background"), None, k)
    image = F.aggregate(F.zip_with("c", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    left = by_frame(off, fit).withColumn("v", F.col("v") - image)
    frame = Window.partitionBy("frame_idx", "ext")
    enough = F.count_if("background").over(frame) >= least * F.count("*").over(frame)
    zero = F.avg(F.when(F.col("background"), F.col("v"))).over(frame)
    few = F.raise_error(F.concat(F.lit("too few background pixels in frame "), F.col("frame_idx").cast("string")))
    return left.select("frame_idx", "ext", "y", "x", F.when(enough, F.col("v") - zero).otherwise(few).alias("v"), "background")


def validation(left: DataFrame) -> DataFrame:
    """Smallest, largest and mean spread of what is left of the frames (err), and of their background pixels (rms)."""
    spread = left.groupBy("frame_idx", "ext").agg(F.stddev_pop("v").alias("err"), F.stddev_pop(F.when(F.col("background"), F.col("v"))).alias("rms"))
    return spread.agg(*(f(c).alias(f"{name}_{c}") for c in ("err", "rms") for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg))))
