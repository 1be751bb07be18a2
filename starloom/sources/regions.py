"""DS9 region files and whitespace tables, by Spark's text source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"([-+0-9.eE]+)"


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """(shape, cx, cy, r, w, h, rot_deg) of circle(...) and box(...) lines, coordinates from 0; other lines are left out."""
    line = F.col(value)
    circle, box = rf"^\s*circle\(\s*{NUMBER}\s*,\s*{NUMBER}\s*,\s*{NUMBER}\s*\)", rf"^\s*box\(\s*{NUMBER}\s*,\s*{NUMBER}\s*,\s*{NUMBER}\s*,\s*{NUMBER}\s*,\s*{NUMBER}\s*\)"
    kind = F.when(line.rlike(circle), "circle").when(line.rlike(box), "box")
    get = lambda p, k: F.regexp_extract(line, p, k).try_cast("double")
    either = lambda k: F.when(F.col("shape") == "circle", get(circle, k)).otherwise(get(box, k))
    in_box = lambda k: F.when(F.col("shape") == "box", get(box, k))
    out = lines.withColumn("shape", kind).where("shape is not null")
    return out.select("shape", (either(1) - 1).alias("cx"), (either(2) - 1).alias("cy"), F.when(F.col("shape") == "circle", get(circle, 3)).alias("r"), in_box(3).alias("w"), in_box(4).alias("h"), F.coalesce(in_box(5), F.lit(0.0)).alias("rot_deg"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def circles(df: DataFrame, x: Column, y: Column, r: Column, *more: str) -> DataFrame:
    """(value): lines of a region file, coordinates from 1, beside the columns asked for."""
    return df.select(*more, F.format_string("circle(%.4f,%.4f,%.4f)", x + 1, y + 1, r).alias("value"))


def curve(spark: SparkSession, path: str) -> DataFrame:
    """(wavelength_um, transmission) of a two-column text with # comments."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(parts[0].cast("double").alias("wavelength_um"), parts[1].cast("double").alias("transmission"))
