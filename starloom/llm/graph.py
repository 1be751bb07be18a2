"""Connected components of an edge table, distributed: alternating large-star and small-star steps until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import looked_up, stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), sorted, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars (node, smallest node of its component here), in rounds of bounded size."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def star():
        nodes, root = roots(a, b)
        return nodes[nodes != root], root[nodes != root]

    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) >= 1 << 20:
            a, b = star()
            if len(a) >= 1 << 19:  # that many nodes: what is held doesn't grow further
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
                a, b = a[:0], b[:0]
    a, b = star()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for every node of edges (a, b: long, not null) the smallest node it is linked with, over any path.

    Each step is a grouped minimum with partial aggregation, and a node with very many edges gets its minimum where they lie, so
    that they aren't gathered in one task; each result is written to the shared folder, the one before deleted. Raises if
    `rounds` steps don't do (they grow with the logarithm).
    """
    e = stored(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v").mapInArrow(_contract, "u long, v long"), "edges")
    for _ in range(rounds):
        # Large star: every larger neighbour of u goes to the smallest node near u.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * e.count()
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = looked_up(both.where("v > u"), low, ["u"], total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours go to the smallest of them.
        down = stored(large.where("u <> v").distinct(), "edges")
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = looked_up(down, low, ["u"], down.count()).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = stored(small, "edges")
        # All stars: each node once as u, and no root is a u.
        twice = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not twice and not new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            e = new
            break
        e = new
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_ids(joined: DataFrame, node: str) -> DataFrame:
    """(node, n, component_id): the smallest `first` of each root, for joined (node, first, n, root)."""
    joined = stored(joined, "members")
    low = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    return looked_up(joined.withColumnRenamed("n", "m"), low, ["root"], joined.count()).select(node, F.col("m").alias("n"), "component_id")
