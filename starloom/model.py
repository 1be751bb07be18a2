"""The data model: frames, pixels and pixel series, and their conversions. A missing pixel is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(v: Column) -> Column:
    """NaN and infinities as NULL."""
    v = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
    return F.when(F.abs(v) != float("inf"), v)


def frames(df: DataFrame, index: str, ext: str, pix: str, ny: int, nx: int) -> DataFrame:
    """(frame_idx, ext, ny, nx, pix) from a table with one array of pixels, row-major, for each frame."""
    return df.select(F.col(index).cast("long").alias("frame_idx"), F.col(ext).alias("ext"), F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), F.col(pix).alias("pix"))


def pixels(fr: DataFrame) -> DataFrame:
    """(frame_idx, ext, y, x, v): one row for each pixel of frames."""
    one = fr.select("frame_idx", "ext", "nx", F.posexplode("pix").alias("i", "raw"))
    return one.select("frame_idx", "ext", F.expr("cast(i div nx as int)").alias("y"), F.expr("cast(i % nx as int)").alias("x"), missing(F.col("raw")).alias("v"))


def repacked(px: DataFrame, ny: int, nx: int) -> DataFrame:
    """frames again: pixels in row-major order, those that aren't there NULL."""
    at = F.map_from_entries(F.collect_list(F.struct((F.col("y") * nx + F.col("x")).alias("i"), "v")))
    pix = F.transform(F.sequence(F.lit(0), F.lit(ny * nx - 1)), lambda i: F.try_element_at("at", i))
    return px.groupBy("frame_idx", "ext").agg(at.alias("at")).select("frame_idx", "ext", F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), pix.alias("pix"))


def series(px: DataFrame) -> DataFrame:
    """(ext, y, x, ts): each pixel's values in order of the frame; the observation matrix by rows."""
    ordered = F.array_sort(F.collect_list(F.struct("frame_idx", "v")))
    return px.groupBy("ext", "y", "x").agg(ordered.alias("s")).select("ext", "y", "x", F.col("s.v").alias("ts"))


def unseries(se: DataFrame) -> DataFrame:
    """(ext, y, x, i, v): pixel series as rows, i the place in the series."""
    return se.select("ext", "y", "x", F.posexplode("ts").alias("i", "v"))


def grid(spark, ny: int, nx: int) -> DataFrame:
    """(y, x) of an image."""
    n = F.col("id")
    return spark.range(ny * nx).select(F.expr(f"cast(id div {nx} as int)").alias("y"), (n % nx).cast("int").alias("x"))
