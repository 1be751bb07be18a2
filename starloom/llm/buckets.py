"""Comparing all pairs within buckets of any size: sorted runs, with large buckets split into tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import stored

#: Rows of a bucket that one group may hold from a tile.
TILE = 1024


def tiled(rows: DataFrame, key: str, item: str) -> DataFrame:
    """rows (key, item, ...) with `part` and `tile`: within (key, tile) every pair of a bucket's items meets.

    A bucket of n rows gets t = ceil(n / TILE) parts by a hash of the item and a group for each pair of parts, which holds
    at most about 2 * TILE rows; each row is then there t times. Items of unlike parts meet once; those of one part meet in
    each of its groups, and `twice` tells where that isn't the first. Buckets of one row are left out: they have no pair.
    """
    size = stored(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.ceil(F.col("_n") / TILE).cast("int").alias("_t")), "bucket-sizes")
    large = size.where("_t > 1")
    if large.limit(FEW + 1).count() <= FEW:
        # Large buckets are tiled where their rows lie, before anything is dealt out by their keys.
        table = F.broadcast(large)
        hot = rows.join(table, key)
        rest = rows.join(table.select(key), key, "left_anti").join(size.where("_t = 1"), key)
    else:
        # They too have to be dealt out: each over SALTS tasks.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = rows.withColumn("_s", F.pmod(F.xxhash64(item, F.lit(11)), F.lit(SALTS)).cast("int"))
        hot = salted.join(large.withColumn("_s", salts), [key, "_s"]).drop("_s")
        rest = salted.join(large.select(key).withColumn("_s", salts), [key, "_s"], "left_anti").drop("_s").join(size.where("_t = 1"), key)
    pair = F.transform(F.sequence(F.lit(0), F.col("_t") - 1), lambda k: F.least("part", k).cast("long") * (1 << 31) + F.greatest("part", k))
    hot = hot.withColumn("part", F.pmod(F.xxhash64(item, F.lit(7)), F.col("_t")).cast("int")).withColumn("tile", F.explode(pair)).drop("_t")
    return hot.unionByName(rest.drop("_t").withColumn("part", F.lit(0)).withColumn("tile", F.lit(0).cast("long")))


#: Large buckets up to this number are broadcast (some bytes each), once they have been counted; beyond it, tasks of each.
FEW, SALTS = 10_000, 64


def twice(part_a: np.ndarray, part_b: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Whether two items of a tile's group meet in another one too, which counts: that of their part with itself."""
    return (part_a == part_b) & ((tile >> 31) != (tile & ((1 << 31) - 1)))


def compared(rows: DataFrame, order: list[str], columns: list[str], pairs: Callable, schema: str) -> DataFrame:
    """pairs(group ids, arrays) of each run of whole groups: rows are dealt and sorted by key and tile, then `order`.

    `pairs` gets a non-decreasing array of group numbers and the columns as arrays, and returns arrays of the schema.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table):
            key, tile = table["key"].to_numpy(), table["tile"].to_numpy()
            new = np.ones(len(key), np.int64)
            new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
            out = pairs(np.cumsum(new), {c: (table[c].to_numpy() if pa.types.is_primitive(table[c].type) else table[c].combine_chunks()) for c in columns})
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.num_rows < 1 << 14 and table.nbytes < 1 << 24:
                continue
            # Up to the last group's start; that group may go on in the next batch.
            key, tile = table["key"].to_numpy(), table["tile"].to_numpy()
            cut = int(np.flatnonzero((key != key[-1]) | (tile != tile[-1])).max(initial=-1)) + 1
            if cut:
                yield work(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    ready = rows.select(*dict.fromkeys(["key", "tile", *columns])).repartition("key", "tile").sortWithinPartitions("key", "tile", *order)
    return ready.mapInArrow(run, schema)
