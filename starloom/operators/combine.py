"""Combining frames: statistics along the frame axis, chunks of fixed size or of a value's range, metadata along with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATISTICS = {
    "mean": F.avg,
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "median": F.median,
    "std": F.stddev_pop,
}


def combine(px: DataFrame, how: str, by: list[str] = ("ext",)) -> DataFrame:
    """Each pixel's statistic over frames, missing values left out; std is that of the population."""
    return px.groupBy(*by, "y", "x").agg(STATISTICS[how](F.col("v")).alias("v"))


def normalised(image: DataFrame, to: str, by: list[str] = ("ext",)) -> DataFrame:
    """Images scaled to unit peak or unit total."""
    w = Window.partitionBy(*by)
    return image.withColumn("v", F.col("v") / {"peak": F.max, "total": F.sum}[to]("v").over(w))


def chunks(px: DataFrame, size: int, how: str = "mean") -> DataFrame:
    """Every `size` frames combined; the last chunk can be short."""
    return px.groupBy("ext", F.floor(F.col("frame_idx") / size).alias("chunk"), "y", "x").agg(STATISTICS[how](F.col("v")).alias("v"))


def overlapping(n: int, per_chunk: int, stride: int, spark) -> DataFrame:
    """(chunk, lo, hi): slices of n frames, each per_chunk long at most and stride after the one before."""
    lo = F.col("id") * stride
    return spark.range(-(-n // stride)).select(F.col("id").alias("chunk"), lo.alias("lo"), F.least(lo + per_chunk, F.lit(n)).alias("hi"))


def greedy(df: DataFrame, by: list[str], order: list[str], value: Column, delta: float) -> DataFrame:
    """df with `chunk`: a chunk ends before the row whose value is delta or more past that of the chunk's first row.

    A fold over each ordered sequence: neither a frame nor a session window restarts at a chunk's first row. A sequence's order
    columns and values are one array, so a sequence has to fit a task; sequences are dealt out by `by`.
    """
    step = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, value.cast("double").alias("_value")))).alias("_s"))
    # What grows in the fold is the list of chunks' first places, not one of all rows.
    fold = f"""aggregate(_s, cast(struct(cast(null as double) as first, 0 as n, array() as starts) as struct<first:double,n:int,starts:array<int>>),
        (a, r) -> if(a.first is null or r._value - a.first >= {float(delta)!r}D,
            struct(r._value as first, a.n + 1 as n, concat(a.starts, array(a.n)) as starts),
            struct(a.first as first, a.n + 1 as n, a.starts as starts)), a -> a.starts)"""
    ids = step.withColumn("_c", F.expr(fold)).select(*by, "_c", F.posexplode("_s").alias("_i", "_r"))
    ids = ids.select(*by, *(F.col(f"_r.{o}").alias(o) for o in order), (F.size(F.filter("_c", lambda s: s <= F.col("_i"))) - 1).cast("long").alias("chunk"))
    return df.join(ids, [*by, *order])


def chunk_table(df: DataFrame, by: list[str], order: list[str], numeric: list[str], other: list[str]) -> DataFrame:
    """A row for each chunk: means of numeric columns, other columns from its first row."""
    first = F.struct(*order)
    return df.groupBy(*by, "chunk").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in numeric), *(F.min_by(c, first).alias(c) for c in other))


def unwrapped(df: DataFrame, by: list[str], order: list[str], angle: str, period: float = 360.0) -> DataFrame:
    """df with `unwrapped`: jumps of over half a period between neighbours taken out."""
    w = Window.partitionBy(*by).orderBy(*order)
    jump = F.col(angle) - F.lag(angle).over(w)
    turn = F.coalesce(-F.floor((jump + period / 2) / period) * period, F.lit(0.0))
    # A jump of exactly half a period up stays as it is.
    turn = F.when((jump > 0) & (F.pmod(jump + period / 2, F.lit(period)) == 0), turn + period).otherwise(turn)
    return df.withColumn("_turn", F.coalesce(turn, F.lit(0.0))).withColumn("unwrapped", F.col(angle) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def monotonic(df: DataFrame, by: list[str], order: list[str], angle: str) -> DataFrame:
    """df with `monotonic`: unwrapped angles from the first row on, with the sign that makes them grow."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    u = unwrapped(df, by, order, angle)
    first, last = F.first("unwrapped").over(w), F.last("unwrapped").over(w)
    return u.withColumn("monotonic", (F.col("unwrapped") - first) * F.when(last < first, -1.0).otherwise(1.0)).drop("unwrapped")


def contiguous_pairs(df: DataFrame, by: list[str], order: list[str], seconds: Column, most: float = 5.0) -> DataFrame:
    """Neighbours whose gap is at most `most` times the median gap of their sequence: by, order, next_*, gap."""
    w = Window.partitionBy(*by).orderBy(*order)
    gaps = df.withColumn("_t", seconds).withColumn("gap", F.lead("_t").over(w) - F.col("_t")).withColumns({f"next_{o}": F.lead(o).over(w) for o in order}).where("gap is not null")
    typical = gaps.groupBy(*by).agg(F.median("gap").alias("_m"))
    return gaps.join(typical, by).where(F.col("gap") <= most * F.col("_m")).select(*by, *order, *(f"next_{o}" for o in order), "gap")


def exclusion_counts(df: DataFrame, by: list[str], value: Column, delta: int) -> DataFrame:
    """df with `n_excluded`: rows of its sequence whose value is within delta of its own, itself included."""
    w = Window.partitionBy(*by).orderBy("_value").rangeBetween(-delta, delta)
    return df.withColumn("_value", value.cast("long")).withColumn("n_excluded", F.count("*").over(w)).drop("_value")


def paired(px: DataFrame) -> DataFrame:
    """Neighbouring frames 2k and 2k + 1 of a pixel in one row; a last odd one is dropped."""
    rows = px.groupBy("ext", F.floor(F.col("frame_idx") / 2).alias("pair"), "y", "x")
    both = rows.agg(F.max(F.when(F.col("frame_idx") % 2 == 0, F.col("v"))).alias("v0"), F.max(F.when(F.col("frame_idx") % 2 == 1, F.col("v"))).alias("v1"), F.count("*").alias("n"))
    return both.where("n = 2").drop("n")


def decimated(px: DataFrame, every: int, offset: int = 0) -> DataFrame:
    return px.where((F.col("frame_idx") >= offset) & (F.pmod(F.col("frame_idx") - offset, F.lit(every)) == 0))
