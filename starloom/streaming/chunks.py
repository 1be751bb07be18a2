"""Frames that arrive as a stream: fixed-size chunks as a keyed aggregation, greedy ranges as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def fixed(stream: DataFrame, size: int) -> DataFrame:
    """Running mean and count of each pixel in chunks of `size` frames; for update or complete mode."""
    return stream.groupBy(F.floor(F.col("frame_idx") / size).alias("chunk"), "ext", "y", "x").agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def windows(stream: DataFrame, ts: str, key: str, value: str, length: str, late: str) -> DataFrame:
    """Tumbling windows of event time with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def greedy(stream: DataFrame, key: str, value: str, delta: float) -> DataFrame:
    """(key, chunk, n, mean) of chunks that end: a chunk ends before the row whose value is delta or more past its first row's.

    The state of a key is its open chunk: number, first value, count, sum. Rows of a trigger are taken in order of the value.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chunk, first, n, total = state.get if state.exists else (0, None, 0, 0.0)
        out = []
        for v in sorted(v for df in batches for v in df[value]):
            if first is not None and v - first >= delta:
                out.append((k[0], chunk, n, total / n))
                chunk, first, n, total = chunk + 1, v, 0, 0.0
            first = v if first is None else first
            n, total = n + 1, total + v
        state.update((chunk, first, n, total))
        yield pd.DataFrame(out, columns=["key", "chunk", "n", "mean"])

    picked = stream.select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias(value))
    return picked.groupBy("key").applyInPandasWithState(run, "key long, chunk long, n long, mean double", "chunk long, first double, n long, total double", "append", "NoTimeout")
