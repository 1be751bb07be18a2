"""Embedding near duplicates: binary codes of randomly rotated vectors, with correction factors.

Each vector is rotated by random orthogonal matrices and kept as signs. Groups of b sign bits are bucket keys: two vectors at
the threshold's angle agree on one bit with probability 1 - angle / pi, and there are as many tables as make the chance to
meet in one at least RECALL at the threshold itself (more above it). b follows from the largest label's count, so that
buckets stay small and recall the same at every size. In a bucket, of one vector's signs s and the other's rotated y the
inner product <s, y> / <s, x> is an unbiased estimate of <x, y>, with an error of about sqrt((1 - f^2) / f^2 / (d - 1)) for the
stored correction factor f = <s, x>: pairs whose estimate plus EPSILON of those is below the threshold are discarded, all
others are computed again in double precision, so nothing below the threshold is linked. Equal vectors are compared once.
A pair counts in the first table where it meets; counts and a spanning forest leave a task, never all pairs of a group.

Edge cases. Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing: 0 links, a component of their own. Vectors of unlike lengths don't link. Repeated rows are vectors of their own, and so
are different vectors that share a vec_id. A null vec_id links like any other; a component of null ids alone has the id null. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.buckets import compared, tiled, twice
from starloom.llm.common import looked_up, read, stored, tune
from starloom.llm.graph import component_ids, components

THRESHOLD, RECALL, EPSILON, SEED = 0.93, 0.98, 5.0, 20
#: Groups of more rows than this are compared by matrix products.
LARGE = 48


@lru_cache(8)
def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random orthogonal matrix of size d."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, k]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def plan(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for labels of up to `largest` vectors."""
    bits = min(max(12, math.ceil(math.log2(max(largest, 2))) + 2), 40)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def valid() -> F.Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def with_keys(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """classes (cls, label, embedding array<double>, n) with `keys`: one hash for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            out = np.zeros((batch.num_rows, tables), np.uint64)
            vec = batch.column(2)
            size = np.asarray(vec.value_lengths())
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = np.asarray(vec.take(pa.array(at)).flatten()).reshape(-1, d)
                signs = np.concatenate([x @ rotation(int(d), k) > 0 for k in range(-(-bits * tables // int(d)))], axis=1)
                for t in range(tables):
                    part = signs[:, t * bits : (t + 1) * bits]
                    h = (part.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    h = (h + np.uint64(((t + 1) * 0x9E3779B97F4A7C15 + int(d)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(31)) ^ labels[at]) * np.uint64(0x94D049BB133111EB)
                    out[at, t] = h ^ (h >> np.uint64(29))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "keys"])

    return classes.mapInArrow(run, "cls long, label long, embedding array<double>, n long, keys array<long>")


def matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 1))


def near_pairs(threshold: float):
    def pairs(group: np.ndarray, cols: dict):
        """Links of each row (its other rows' multiplicities) and a forest: (a, b, links): b null for a count, links 0 for an edge."""
        sizes = np.asarray(cols["embedding"].value_lengths())
        done = [some(group[at], {k: (v.take(pa.array(at)) if isinstance(v, pa.Array) else v[at]) for k, v in cols.items()}) for at in (np.flatnonzero(sizes == d) for d in np.unique(sizes))]
        return [np.concatenate(x) for x in zip(*done, strict=True)]

    def some(group: np.ndarray, cols: dict):
        n = len(group)
        x, keys = matrix(cols["embedding"], n), matrix(cols["keys"], n)
        cls, mult, table, part, tile = (cols[k] for k in ("cls", "n", "t", "part", "tile"))
        d = x.shape[1]
        norm = np.sqrt((x * x).sum(axis=1))
        turned = (x / norm[:, None]) @ rotation(d, 0)
        code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(d)
        factor = (code * turned).sum(axis=1)
        slack = EPSILON * np.sqrt(np.maximum(1 - factor * factor, 0) / factor**2 / max(d - 1, 1))
        links, label, found = np.zeros(n, np.int64), np.arange(n), []

        def settle(i: np.ndarray, j: np.ndarray) -> None:
            """Of pairs that the bound leaves: exact cosines, first meetings only."""
            ok = (cls[i] != cls[j]) & ~twice(part[i], part[j], tile[i])
            i, j = i[ok], j[ok]
            ok = (x[i] * x[j]).sum(axis=1) / (norm[i] * norm[j]) >= threshold
            i, j = i[ok], j[ok]
            if not len(i):
                return
            first = np.argmax(keys[i] == keys[j], axis=1) == table[i]
            i, j = i[first], j[first]
            np.add.at(links, i, mult[j])
            np.add.at(links, j, mult[i])
            new = label[i] != label[j]
            for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
                u, v = a, b
                while label[u] != u:
                    u = label[u]
                while label[v] != v:
                    v = label[v]
                if u != v:
                    label[max(u, v)] = min(u, v)
                    found.append((a, b))
            while (label[label] != label).any():
                label[:] = label[label]

        edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if n else 0, append=group[-1] + 1 if n else 0))
        count = np.diff(edge)
        small = np.repeat(count <= LARGE, count)
        at, step = np.flatnonzero(small), 1
        while len(at):
            at = at[at + step < n]
            at = at[group[at] == group[at + step]]
            for s in range(0, len(at), 1 << 15):
                i = at[s : s + (1 << 15)]
                guess = (code[i] * turned[i + step]).sum(axis=1) / factor[i]
                i = i[guess + slack[i] >= threshold]
                settle(i, i + step)
            step += 1
        for a, c in zip(edge[:-1][count > LARGE].tolist(), count[count > LARGE].tolist(), strict=True):
            for s in range(0, c, 256):
                rows = slice(a + s, min(a + s + 256, a + c))
                guess = code[rows] @ turned[a : a + c].T / factor[rows, None]
                i, j = np.nonzero(guess + slack[rows, None] >= threshold)
                i += s
                settle(a + i[i < j], a + j[i < j])
        has = np.flatnonzero(links)
        edges = np.array(found, np.int64).reshape(-1, 2)
        return np.concatenate([cls[has], cls[edges[:, 0]]]), np.concatenate([cls[has], cls[edges[:, 1]]]), np.concatenate([links[has], np.zeros(len(edges), np.int64)])

    return pairs


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    tune(vectors.sparkSession)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = base.where(valid()).withColumn("h", F.xxhash64("label", "embedding"))
    # Equal vectors of a label are a class, with a number of its own: vec_ids may be null or clash.
    classes = good.groupBy("h", "label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, tables = plan(largest, threshold, recall)
    keyed = stored(with_keys(classes.select("cls", "label", "embedding", "n"), bits, tables), "vector-keys")
    rows = keyed.select(F.posexplode("keys").alias("t", "key"), "cls")
    met = tiled(rows, "key", "cls").join(keyed.select("cls", "embedding", "n", "keys"), "cls")
    linked = stored(compared(met, ["cls"], ["cls", "n", "t", "part", "tile", "embedding", "keys"], near_pairs(threshold), "a long, b long, links long"), "vector-links")
    counts = linked.where("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    member = components(linked.where("links = 0").select("a", "b"))
    joined = classes.select("cls", "first", "n").join(member, classes.cls == member.node, "left").select("cls", "first", "n", F.coalesce("root", "cls").alias("root"))
    ids = component_ids(joined, "cls").drop("n")
    per = classes.join(counts, "cls", "left").join(ids, "cls")
    per = per.select("h", "label", "embedding", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = looked_up(good, per, ["h", "label", "embedding"], good.count()).select("vec_id", "n_links", "component_id")
    out = out.unionByName(base.where(~valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with recursive v as (select row_number() over () as k, vec_id, label, embedding::double[] as e from embeddings),
g as (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.k as x, b.k as y from g a join g b on a.label = b.label and a.k <> b.k
  where case when len(a.e) = len(b.e) then list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93 else false end
),
reach as (select k as x, k as y from v union select r.x, l.y from reach r join links l on r.y = l.x),
low as (select r.x as k, min(o.vec_id) as component_id from reach r join v o on o.k = r.y group by r.x),
n as (select x as k, count(*) as n_links from links group by x)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from v join low using (k) left join n using (k)
"""
