"""Harmonic packing of token sequences: lengths in reciprocal-capacity classes, bins with a fixed number of pieces.

A piece of length r is in class k = CAPACITY // r: k pieces of that class fill a bin, whatever their exact lengths, so workers
fill the bins of a class alone. Documents are cut into whole bins and a rest; a rest that would leave more than 1 / SLACK of its
class's share unused is cut at the share of a finer class first. Pieces left over from a worker's unfinished bins go, with their
ids, through rounds in which FAN workers' rests meet, again filled class by class. What one last worker has left (fewer than k
pieces of each class: at most about CAPACITY * number of classes tokens, whatever the corpus) is laid end to end and cut anew:
full sequences, then sequences of the powers of two that add up to the last tokens, which need no padding.

Edge cases. Null and empty texts are the end id alone: one piece of length 1. Repeated rows are documents of their own (their
pieces can't be told apart by doc_id). An empty table gives no piece. Very long texts are tokenised whole. Only doc_id and text
are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import read, stored, tune
from starloom.llm.textblock import blocks, gathered
from starloom.llm.tokens import Tokens, default_path

CAPACITY, END_ID, SLACK, FAN = 2048, 1, 32, 16
#: Bytes of text tokenised together, so that a stretch is looked up once for many uses.
BLOCK = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The ids of a piece whose bin isn't full yet; null once it has its place.
OPEN = SCHEMA + ", ids binary"
NAMES = [c.split()[0] for c in OPEN.split(", ")]


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a rest below the capacity."""
    out = []
    while length:
        k = capacity // length
        share = capacity // k
        if (share - length) * SLACK <= share or length * SLACK < capacity:
            out.append(length)
            break
        out.append(capacity // (k + 1))
        length -= out[-1]
    return out


_CUTS: dict[int, list[int]] = {}


class Bins:
    """Fills bins class by class; `prefix` makes the sequence ids this worker's own."""

    def __init__(self, prefix: int, capacity: int = CAPACITY):
        self.open: dict[int, list[tuple]] = {}
        self.next, self.capacity, self.rows = prefix, capacity, []

    def add(self, piece: tuple) -> None:
        """piece: doc_id, start, length, crc, doc_tokens, ids."""
        k = self.capacity // piece[2]
        mine = self.open.setdefault(k, [])
        mine.append(piece)
        if len(mine) == k:
            self.place(mine)
            self.open[k] = []

    def place(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, length, crc, total, _ in pieces:
            self.rows.append((doc, start, length, crc, total, self.next, at, None))
            at += length
        self.next += 1

    def batch(self, also: list[tuple] = ()) -> pa.RecordBatch:
        cols = list(zip(*self.rows, *also, strict=True)) or [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], NAMES)

    def rest(self) -> list[tuple]:
        return [(d, s, n, c, t, None, None, i) for mine in self.open.values() for d, s, n, c, t, i in mine]



def first_round(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins = _tokens(path), Bins(TaskContext.get().partitionId() << 32)
        for batch in gathered(batches, BLOCK):
            for a, b, block in blocks(batch, most=BLOCK):
                ids, bounds = tokens.encode(block)
                bounds = bounds.tolist()
                for k, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    mine = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(END_ID)).astype("<u4").tobytes()
                    total = len(mine) // 4
                    rest = total % CAPACITY
                    sizes = [CAPACITY] * (total // CAPACITY) + (_CUTS.get(rest) or _CUTS.setdefault(rest, cuts(rest)))
                    at = 0
                    for size in sizes:
                        piece = mine[4 * at : 4 * (at + size)]
                        bins.add((doc, at, size, zlib.crc32(piece), total, None if size == CAPACITY else piece))
                        at += size
                if len(bins.rows) >= 4096:
                    yield bins.batch()
        tokens.clear()  # an idle worker shouldn't hold them
        yield bins.batch(bins.rest())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OPEN)


_TOKENS: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(NAMES.index(c)).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")), strict=True)


def next_round(rest: DataFrame, number: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(number << 56 | TaskContext.get().partitionId() << 32)
        for piece in pieces_of(batches):
            bins.add(piece)
            if len(bins.rows) >= 4096:
                yield bins.batch()
        yield bins.batch(bins.rest())

    return rest.mapInArrow(run, OPEN)


def last_round(rest: DataFrame) -> DataFrame:
    """What is left: full sequences, then powers of two. Its size doesn't grow with the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sorted(pieces_of(batches), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]))
        total = sum(p[2] for p in pieces)
        rooms = [CAPACITY] * (total // CAPACITY) + [1 << k for k in range(10, -1, -1) if (total % CAPACITY) >> k & 1]
        rows, seq, at = [], 127 << 56, 0
        for doc, start, length, _, tokens, ids in pieces:
            done = 0
            while done < length:
                size = min(length - done, rooms[0] - at)
                rows.append((doc, start + done, size, zlib.crc32(ids[4 * done : 4 * (done + size)]), tokens, seq, at, None))
                done, at = done + size, at + size
                if at == rooms[0]:
                    rooms.pop(0)
                    seq, at = seq + 1, 0
        bins = Bins(0)
        bins.rows = rows
        yield bins.batch()

    return rest.mapInArrow(run, OPEN)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of every document: SCHEMA. path: the tokenizer's file, there on every worker."""
    tune(docs.sparkSession)
    done, number = [], 0
    table = stored(first_round(docs, path or default_path()), "packed")
    done.append(table.where("ids is null"))
    workers = docs.rdd.getNumPartitions()
    while workers > 1:
        number, workers = number + 1, -(-workers // FAN)
        rest = table.where("ids is not null")
        # Round robin over few workers; the last round of them is one, whose share is bounded.
        table = stored(next_round(rest.repartition(workers) if workers > 1 else rest.coalesce(1), number), "packed")
        done.append(table.where("ids is null"))
    done.append(last_round(table.where("ids is not null").coalesce(1)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("ids")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
