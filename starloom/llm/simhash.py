"""SimHash near duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius through pivot tables.

Fingerprints are compared once each, however many documents share them. Candidates come from the pigeonhole principle: with
more blocks of bits than the radius, two fingerprints within it agree on some of the blocks, so every pair meets in a bucket
of a choice of blocks. Each fingerprint carries its Hamming distances to PIVOTS reference fingerprints: in a bucket, sorted by
the first, only pairs whose distances differ by at most the radius in every coordinate are left (the triangle inequality: no
pair within the radius is lost), and those are verified exactly. Buckets of any size are split into tiles.

Edge cases. Null and empty texts and texts without words have fingerprint zero and link like any other. A text with fewer
words than a shingle is one shingle. Documents of equal fingerprint form one component. Repeated rows stay, each with the same
result; a null doc_id keeps its row, with the component of the others' smallest id. Only doc_id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.buckets import compared, tiled
from starloom.llm.common import looked_up, read, stored, tune
from starloom.llm.graph import component_ids, components
from starloom.llm.textblock import Block, U, blocks, mix, owner, string_parts

WORDS, RADIUS, SEED, PIVOTS = 4, 4, 42, 24
#: Blocks of bits, of which any two fingerprints within the radius share BLOCKS - RADIUS: 15 choices of 2 of 6.
BLOCKS = 6
#: Keys of a set of shingles and smallest elements in each, odd factors that order the elements, and keys of the first pass.
BANDS, ROWS, FIRST = 28, 5, 3
#: Fingerprints of sets: 64-bit lanes, and the bits in which those of two sets at 0.8 differ at most. The mean is highest, 3 bits of
#: 16, for sets of 4 and 5 elements: 48 bits with a deviation of 6.2, so that 88 is passed with a probability below 1e-9.
LANES, FAR = 4, 88
ORDERS = np.array([xxhash.xxh64_intdigest(f"order {k}", 0) & 0xFFFFFFFF | 1 for k in range(BANDS * ROWS)], np.uint32)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random 64-bit numbers."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {k}", 0) for k in range(n)], np.uint64)


def shingle_hashes(words: list[bytes], size: int = WORDS) -> list[int]:
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    run, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    return [digest(run[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed number."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, block in blocks(batch):
                low = block.lower()
                data, off = low.data.tobytes(), low.offsets.tolist()
                for a, b in zip(off, off[1:], strict=False):
                    h = shingle_hashes(data[a:b].split(), words)  # bytes split at the same six white spaces
                    out.append(majority(np.array(h, "<u8")) if h else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def spans(n_blocks: int = BLOCKS) -> list[int]:
    """For each block the mask of its bits, sizes as even as can be."""
    edge = [64 * k // n_blocks for k in range(n_blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_rows(fps: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS) -> DataFrame:
    """(key, fp): each fingerprint under every choice of n_blocks - radius blocks; the key is a hash of choice and bits."""
    masks = [sum(c) for c in itertools.combinations(spans(n_blocks), n_blocks - radius)]
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)))
    return fps.select(F.explode(keys).alias("key"), "fp")


def forest(group: np.ndarray, near: np.ndarray, radius: int, links) -> tuple[list[int], list[int]]:
    """Links that connect what all links within the groups do, at most one less than a group's rows, as lists of places.

    `near` doesn't decrease within a group, and places whose values are more than radius apart have no link. links(i, j) is
    the part of i whose pairs (i, j) are links; j - i is the same for all.
    """
    label, found_a, found_b = np.arange(len(group)), [], []
    at, step = np.arange(len(group)), 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[(group[at] == group[at + step]) & (near[at + step] - near[at] <= radius)]
        i = at[label[at] != label[at + step]]
        i = links(i, i + step) if len(i) else i
        for a in i.tolist():
            x, y = a, a + step
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                found_a.append(a)
                found_b.append(a + step)
        while len(i) and (label[label] != label).any():
            label = label[label]
        step += 1
    return found_a, found_b


def near_pairs(radius: int) -> callable:
    refs = pivots()

    def pairs(group: np.ndarray, cols: dict) -> tuple[np.ndarray, np.ndarray]:
        fp = cols["fp"].view(np.uint64)
        table = np.stack([popcount(fp ^ p) for p in refs]).astype(np.int16)  # the pivot distance table
        order = np.lexsort((table[0], group))
        fp, table = fp[order], table[:, order]

        def links(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            step = j[0] - i[0]
            for row in table[1:]:
                i = i[np.abs(row[i] - row[i + step]) <= radius]
            return i[(popcount(fp[i] ^ fp[i + step]) <= radius) & (fp[i] != fp[i + step])]

        a, b = forest(group[order], table[0], radius, links)
        return fp[a].view(np.int64), fp[b].view(np.int64)

    return pairs


def link(fps: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all pairs within the radius, over all blocks of bits."""
    rows = tiled(bucket_rows(fps, radius, n_blocks), "key", "fp")
    return compared(rows, [], ["fp"], near_pairs(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, n_blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    marked = stored(fingerprints(docs, words), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    member = components(link(fps.select("fp"), radius, n_blocks))
    joined = fps.join(member, fps.fp == member.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    return looked_up(marked, component_ids(joined, "fp"), ["fp"], marked.count()).select("doc_id", "fp", "component_id")


def shingled(block: Block, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted set of the hashes of its shingles of words; of all its words, where they are fewer."""
    low = block.lower()
    starts, ends, bounds = low.words()
    word = low.hashes(low.prefix_hashes(), starts, ends)
    own = owner(bounds)
    last, h = bounds[1:][own], np.zeros(len(word), np.uint64)
    at = np.arange(len(word))
    for k in range(words):
        inside = at + k < last
        h *= U(0x9E3779B97F4A7C15)
        h[inside] += word[at[inside] + k]
    h, whole = mix(h), (at + words <= last) | (at == bounds[own])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(h[a:b][whole[a:b]])


def set_hash(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set the BANDS keys of ROWS smallest elements each, under as many orders; none for an empty set."""
    size = np.array([len(h) for h in sets], np.int64)
    if not size.any():
        return [np.zeros(0, np.int64)] * len(sets)
    some = np.flatnonzero(size)
    high = (np.concatenate([sets[k] for k in some.tolist()]) >> U(32)).astype(np.uint32)
    start = np.cumsum(size[some]) - size[some]
    key = np.zeros((len(some), BANDS), np.uint64)
    for k, order in enumerate(ORDERS):
        least = np.minimum.reduceat(high * order, start)
        key[:, k // ROWS] = mix(key[:, k // ROWS] * U(0x9E3779B97F4A7C15) + least + U(k))
    out = [np.zeros(0, np.int64)] * len(sets)
    for k, row in zip(some.tolist(), key.view(np.int64), strict=True):
        out[k] = row
    return out


def shingle_marks(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, keys): a hash of the text's set of shingles, and the set's keys."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, keys = [], []
            for _, _, block in blocks(batch):
                sets = list(shingled(block, words))
                node += [set_hash(h) for h in sets]
                keys += band_keys(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, node long, keys array<long>")


def set_fingerprint(h: np.ndarray) -> bytes:
    """LANES 64-bit SimHash fingerprints of a set of hashes, under as many mixings of them."""
    return np.array([majority(mix(h + U(k))) for k in range(LANES)], "<u8").tobytes()


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, fp, shingles): the hash of each text's set, its fingerprint, and the set as 64-bit numbers in order."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch):
                sets = list(shingled(block, words))
                node = np.array([set_hash(h) for h in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([set_fingerprint(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "fp", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, fp binary, shingles binary")


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id): texts whose sets of shingles have a Jaccard similarity of `least` at least, over any path.

    Candidates are texts that share a key: those of ROWS smallest elements are equal with a probability of similarity ** ROWS,
    so that a pair at 0.8 shares none of BANDS with 1.5e-5, and a document has BANDS keys whatever the corpus. Of the candidates the
    pivot distance tables discard pairs whose fingerprints of 64 * LANES bits are more than FAR apart, the fingerprints themselves
    the next, and each link is confirmed on the sets. Keys are taken in two passes, so that the second only compares what isn't
    linked yet.
    """
    marked = stored(shingle_marks(docs, words), "shingles")
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("keys").alias("keys"), F.count("*").alias("n")), "distinct-shingles")
    rows = nodes.where("first is not null").select("node", "first", F.posexplode("keys").alias("band", "key"))
    shared = stored(rows.join(rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "key"), "shared-keys")
    some = docs.join(shared.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(shingle_sets(some, words).dropDuplicates(["node"]), "shingle-sets")
    once = stored(confirmed(shared.where(F.col("band") < FIRST).withColumn("root", F.col("node")), sets, least), "links")
    member = components(once)
    rest = shared.where(F.col("band") >= FIRST).join(member, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = rest.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    member = components(once.unionByName(confirmed(rest.join(apart, "key"), sets, least)))
    joined = nodes.join(member, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    return looked_up(marked.select("doc_id", "node"), component_ids(joined, "node"), ["node"], marked.count()).select("doc_id", "component_id")


def confirmed(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes of rows (key, node, root) that share a key and not the root, and are as similar as `least`."""
    ready = tiled(rows.select("key", "node", "root"), "key", "node").join(sets, "node")
    return compared(ready, [], ["node", "root", "fp", "shingles"], set_pairs(least), "a long, b long")


def set_pairs(least: float) -> callable:
    far = (1 - least) / (1 + least) + 1e-9  # of both sizes' sum: the most elements in which two such sets differ

    def pairs(group: np.ndarray, cols: dict) -> tuple[np.ndarray, np.ndarray]:
        off, data = string_parts(cols["shingles"])
        off, data = off // 8, data.view("<u8")
        size = np.diff(off)
        order = np.lexsort((size, group))
        bins = np.bincount(owner(off) * 64 + (data & U(63)).astype(np.int64), minlength=64 * len(size)).reshape(-1, 64).astype(np.int32)[order]
        begin, end, size, root, node = off[:-1][order], off[1:][order], size[order], cols["root"][order], cols["node"][order]
        fp = string_parts(cols["fp"])[1].view("<u8").reshape(-1, LANES)[order]
        # References are fingerprints of the data, spread over the groups: those of one cluster are far from other clusters.
        refs = fp[np.linspace(0, len(fp) - 1, min(PIVOTS, len(fp))).astype(np.int64)]
        table = np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16) for p in refs])

        def links(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            step = j[0] - i[0]
            i = i[root[i] != root[i + step]]
            for row in table:
                i = i[np.abs(row[i] - row[i + step]) <= FAR]
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]).sum(axis=1) <= FAR]
            # Sets differ in at least as many elements as their counts by the low bits do: nothing is lost.
            i = i[np.abs(bins[i] - bins[i + step]).sum(axis=1) <= far * (size[i] + size[i + step])]
            ok = np.zeros(len(i), bool)
            for k, a in enumerate(i.tolist()):
                x, y = data[begin[a] : end[a]], data[begin[a + step] : end[a + step]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = both >= least * (len(x) + len(y) - both) - 1e-9
            return i[ok]

        a, b = forest(group[order], np.log(size), np.log(1 / least) + 1e-9, links)
        return node[a], node[b]

    return pairs


def representatives(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, with the smallest doc_id of each group of similar texts; of repeated rows of one id, one stays.

    Rows without a doc_id can't be told apart and stay.
    """
    keep = similar_groups(docs, words, least).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
