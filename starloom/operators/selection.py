"""Choosing and shaping frames, pixels and rows: ranges, good pixels, coarse grids, boxes, padding, paired images, placements."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from starloom.functions import geometry

SPECS = "r_px double, pa_deg double, scale double"
#: Rows of a range that a task numbers, and the most ranges there are: each row is compared with all their bounds.
RANGE_ROWS = 100_000
MOST_RANGES = 1000


def without_range(df: DataFrame, low: int, high: int, *index: str) -> DataFrame:
    """Rows none of whose index columns lies in [low, high)."""
    for c in index:
        df = df.where((F.col(c) < low) | (F.col(c) >= high))
    return df


def frame_range(px: DataFrame, first: int | None = None, end: int | None = None, step: int = 1, index: str = "frame_idx") -> DataFrame:
    """Frames first, first + step, .. below end."""
    first = first or 0
    out = px.where((F.col(index) >= first) & ((F.col(index) - first) % step == 0))
    return out if end is None else out.where(F.col(index) < end)


def with_value(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither NULL nor NaN."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def as_text(df: DataFrame) -> DataFrame:
    """Columns that are neither numbers, truth values nor times as strings."""
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz", "string")
    return df.select(*(F.col(c) if t in plain or t.startswith("decimal") else F.col(c).cast("string").alias(c) for c, t in df.dtypes))


def with_dq(fr: DataFrame, dq: str = "dq") -> DataFrame:
    """Frames with a plane of quality bits: zeros where there is none."""
    none = F.array_repeat(F.lit(0).cast("int"), F.size("pix"))
    return fr.withColumn(dq, F.coalesce(F.col(dq), none) if dq in fr.columns else none)


def good_pixels(grid: DataFrame, ny: int, nx: int, inner: float | None = None, outer: float | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(y, x) not nearer than inner and not farther than outer from the centre, and in the existing mask.

    Known behaviour that is kept: with both radii given neither limits the pixels.
    """
    if existing is not None:
        grid = grid.join(existing.select("y", "x").distinct(), ["y", "x"], "left_semi")
    if inner is None or outer is None:
        rho = geometry.rho(F.col("y"), F.col("x"), (ny - 1) / 2, (nx - 1) / 2)
        grid = grid.where(rho >= inner) if inner is not None else grid
        grid = grid.where(rho <= outer) if outer is not None else grid
    return grid


def coarse(mask: DataFrame, step: int, ny: int, nx: int) -> DataFrame:
    """(r_px, pa_deg, x, y) of every step-th pixel in both directions that is in the mask."""
    yc, xc = (ny - 1) / 2, (nx - 1) / 2
    y, x = F.col("y"), F.col("x")
    return mask.where((y % step == 0) & (x % step == 0)).select(geometry.rho(y, x, yc, xc).alias("r_px"), geometry.pa_of(y, x, yc, xc).alias("pa_deg"), "x", "y")


def padded(px: DataFrame, ny: int, nx: int, to_ny: int, to_nx: int) -> DataFrame:
    """Images of ny x nx on the larger shape, 0 beyond their last row and column."""
    to_ny, to_nx = max(ny, to_ny), max(nx, to_nx)
    keys = [c for c in px.columns if c not in ("y", "x", "v")]
    cells = F.expr(f"filter(transform(sequence(0, {to_ny * to_nx - 1}), i -> struct(cast(i div {to_nx} as int) as y, cast(i % {to_nx} as int) as x)), c -> c.y >= {ny} or c.x >= {nx})")
    more = px.select(*keys).distinct().select(*keys, F.explode(cells).alias("c")).select(*keys, "c.y", "c.x", F.lit(0.0).alias("v"))
    return px.select(*keys, "y", "x", "v").unionByName(more)


@dataclass(frozen=True)
class Box:
    """Pixels from (y, x) on, height x width of them; the part below 0 is cut off."""

    y: int
    x: int
    height: int
    width: int

    @classmethod
    def around(cls, yc: float, xc: float, height: int, width: int) -> Box:
        return cls(int(yc - (height - 1) / 2), int(xc - (width - 1) / 2), height, width)

    def overlap(self, ny: int, nx: int) -> tuple[int, int, int, int]:
        """First row, end row, first column, end column of what lies in an image."""
        return max(self.y, 0), min(self.y + self.height, ny), max(self.x, 0), min(self.x + self.width, nx)

    def of(self, px: DataFrame, ny: int, nx: int) -> DataFrame:
        """The image's pixels in the box, at places from 0 in what is left of it."""
        y0, y1, x0, x1 = self.overlap(ny, nx)
        inside = px.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
        return inside.withColumn("y", (F.col("y") - y0).cast("int")).withColumn("x", (F.col("x") - x0).cast("int"))


def moved_grid(grid: DataFrame, rotation: float, about: tuple[float, float], scale: tuple[float, float], scale_about: tuple[float, float], shift: tuple[float, float]) -> DataFrame:
    """(y, x, to_x, to_y): pixel centres rotated (radians) about a point, shrunk by scale about a point, then shifted; pairs are x, y."""
    c, s = math.cos(rotation), math.sin(rotation)
    x, y = F.col("x") - about[0], F.col("y") - about[1]
    rx, ry = c * x - s * y + about[0], s * x + c * y + about[1]
    place = lambda v, k: (v - scale_about[k]) / scale[k] + scale_about[k] + shift[k]
    return grid.select("y", "x", place(rx, 0).alias("to_x"), place(ry, 1).alias("to_y"))


def stitched(left: DataFrame, right: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Pixels of either image, the right one's where both have one: a union and one grouped aggregation, no outer join."""
    both = left.select(*keys, F.col(value).alias("_l"), F.lit(None).cast("double").alias("_r")).unionByName(right.select(*keys, F.lit(None).cast("double").alias("_l"), F.col(value).alias("_r")))
    return both.groupBy(*keys).agg(F.coalesce(F.max("_r"), F.max("_l")).alias(value))


def spiral(spark: SparkSession, low: float, high: float, steps: int, exclude: float, scale, arms: int = 1, start_pa: float = 0.0) -> DataFrame:
    """Placements (SPECS) on `arms` spiral arms: ring k of steps at low + k / steps * (high - low), turned by k * exclude radians."""
    rows = spark.range(steps * arms).select(F.expr(f"cast(id div {arms} as int)").alias("k"), (F.col("id") % arms).alias("arm"))
    scales = F.array(*(F.lit(float(s)) for s in scale)) if isinstance(scale, (list, tuple)) else F.array_repeat(F.lit(float(scale)), steps)
    pa = F.col("arm") * (360.0 / arms) + F.degrees(F.col("k") * F.lit(float(exclude))) + start_pa
    return rows.select((low + F.col("k") / steps * (high - low)).alias("r_px"), pa.alias("pa_deg"), F.element_at(scales, F.col("k") + 1).alias("scale"))


def specs_table(spark: SparkSession, specs: list[tuple[float, float, float]]) -> DataFrame:
    """Placements as a table."""
    return spark.createDataFrame([tuple(map(float, s)) for s in specs], SPECS)


def specs_of(table: DataFrame, most: int = 100_000) -> list[tuple[float, float, float]]:
    """The placements of a table, of a checked size, in its columns' order."""
    rows = table.select("r_px", "pa_deg", "scale").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} placements")
    return [tuple(r) for r in rows]


def first_points(points: DataFrame, n: int, most: str, *order: str) -> DataFrame:
    """The first n distinct rows of `order`, each at its largest `most`."""
    return points.groupBy(*order).agg(F.max(most).alias(most)).orderBy(*order).limit(n)


def numbered(log: DataFrame, *order: str) -> DataFrame:
    """Observations with frame_idx from 0 in order of the columns (such as DATE-OBS), over any number of partitions.

    Ranges of the order are told apart by values collected beforehand, so that a row is in the same one wherever the plan is run:
    the number of its partition, or bounds that are sampled again, may differ between the rows and their counts.
    """
    from pyspark.sql import Window

    keys = log.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    n = keys.count()
    ranges = min(MOST_RANGES, n // RANGE_ROWS + 1)
    bounds = []
    if ranges > 1:
        some = sorted(map(tuple, keys.sample(min(1.0, 20 * ranges / n), seed=0).collect()), key=lambda t: [(v is not None, v) for v in t])  # some 20 a range
        bounds = [some[len(some) * i // ranges] for i in range(1, ranges) if some]
    table = log.sparkSession.createDataFrame([(bounds,)], StructType().add("_bounds", ArrayType(keys.schema)))
    row = F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    base = log.crossJoin(F.broadcast(table)).withColumn("_p", F.size(F.filter("_bounds", lambda b: b <= row))).drop("_bounds")  # one row
    before = base.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = base.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return base.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn("frame_idx", F.col("_b") + F.col("_i")).drop("_p", "_b", "_i")  # a row a range


def trimmed_model(px: DataFrame, share: float) -> DataFrame:
    """Pixels below that share of their frame's peak as 0."""
    from pyspark.sql import Window

    peak = F.max("v").over(Window.partitionBy("frame_idx", "ext"))
    return px.withColumn("_m", peak).withColumn("v", F.when(F.col("v") >= share * F.col("_m"), F.col("v")).otherwise(0.0)).drop("_m")


def without_signal(px: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(y, x) of pixels that no frame's model is above the threshold in."""
    return px.groupBy("y", "x").agg(F.max("v").alias("_m")).where(~F.coalesce(F.col("_m") > threshold, F.lit(False))).select("y", "x")


def not_flat(px: DataFrame) -> DataFrame:
    """(frame_idx, ext) of frames whose pixels aren't all of one value."""
    return px.groupBy("frame_idx", "ext").agg(F.min("v").alias("_a"), F.max("v").alias("_b")).where("_a <> _b").select("frame_idx", "ext")


def unusual_pixels(px: DataFrame, spread: float, peak: float) -> DataFrame:
    """(y, x, bad): whether the values' spread or maximum is above that quantile of all pixels' (one image's worth of rows)."""
    s = px.groupBy("y", "x").agg(F.stddev_pop("v").alias("_s"), F.max("v").alias("_m"))
    q = s.agg(F.percentile("_s", F.lit(spread)).alias("_qs"), F.percentile("_m", F.lit(peak)).alias("_qm"))
    return s.crossJoin(F.broadcast(q)).select("y", "x", ((F.col("_s") > F.col("_qs")) | (F.col("_m") > F.col("_qm"))).alias("bad"))  # q: one row


def without_median(px: DataFrame, *by: str) -> DataFrame:
    """Pixels less the median of their group."""
    return px.join(px.groupBy(*by).agg(F.median("v").alias("_m")), list(by)).withColumn("v", F.col("v") - F.col("_m")).drop("_m")


def peak_in_box(px: DataFrame, box: Box, ny: int, nx: int) -> DataFrame:
    """(frame_idx, ext, peak_y, peak_x, found): the largest pixel in a box, the first of equal ones; not found if it lies on the
    box's border, and the box's middle then stands in for it."""
    y0, y1, x0, x1 = box.overlap(ny, nx)
    inside = px.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1) & F.col("v").isNotNull())
    best = inside.groupBy("frame_idx", "ext").agg(F.max(F.struct("v", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("_b"))
    y, x = -F.col("_b.y"), -F.col("_b.x")
    found = (y > y0) & (y < y1 - 1) & (x > x0) & (x < x1 - 1)
    at = lambda v, middle: F.when(found, v).otherwise(F.lit(middle)).cast("int")
    return best.select("frame_idx", "ext", at(y, box.y + box.height // 2).alias("peak_y"), at(x, box.x + box.width // 2).alias("peak_x"), found.alias("found"))
