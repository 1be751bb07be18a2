"""Words, lines and hashed n-grams of a block of texts, as NumPy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _INV)):
            full = np.full(size, base, U)
            full[0] = 1
            _POWERS[k] = np.cumprod(full)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string column; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most `most` bytes, or one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


class Block:
    """Texts as one run of bytes; `start` and `end` of each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data, self.n = offsets, data, len(offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Block:
        return cls(*string_parts(column))

    def prefix_hashes(self) -> np.ndarray:
        p, n = powers(len(self.data) + 1)[0], len(self.data)
        out = np.zeros(n + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * p[:n], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from start to end, alike for equal bytes anywhere."""
        inv = powers(len(self.data) + 1)[1]
        return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def parts(self, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
        """The bytes from start to end, for ranges in order that don't overlap."""
        size = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=size[1:])
        if len(start) and size[-1] == end[-1] - start[0]:  # one after the other: nothing is copied
            data = self.data[start[0] : end[-1]]
        else:
            edge = np.zeros(len(self.data) + 1, np.int8)
            some = end > start
            edge[start[some]] += 1
            edge[end[some]] -= 1
            data = self.data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(data))])

    def codes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """For each range the place of its bytes among the distinct ones, and those: by the bytes themselves, not a hash of them."""
        got = self.parts(start, end).dictionary_encode()
        return got.indices.to_numpy().astype(np.int64), got.dictionary

    def characters(self) -> Block:
        """With four bytes a code point."""
        lead = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=lead[1:])
        return Block(4 * lead[self.offsets], np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint8))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the number of words before each text (n + 1 entries)."""
        n = len(self.data)
        edge = np.ones(n + 2, bool)
        edge[1 : n + 1] = SPACE[self.data]
        solid = ~edge[1 : n + 1]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True  # a word ends with its text
        starts = np.flatnonzero(solid & (edge[:n] | first[:n]))
        ends = np.flatnonzero(solid & (edge[2:] | first[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lower(self) -> Block:
        """With ASCII A-Z in lower case."""
        data = self.data.copy()
        data[(data >= 65) & (data <= 90)] |= 32
        return Block(self.offsets, data)


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of `least` bytes or more, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    offsets, data = string_parts(batch.column(batch.schema.get_field_index(column)))
    for a, b in slices(offsets, most):
        yield a, b, Block(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; 0 where none."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def owner(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ngram_ids(block: Block, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed word 1- and 2-grams and 3- and 4-grams of characters (code points): for each kind the feature ids and the bounds by text.

    Kinds lie in ranges of their own: id = kind * 2**bits + hash. N-grams don't cross texts.
    """
    low, mask = block.lower(), U((1 << bits) - 1)
    starts, ends, bounds = low.words()
    word = low.hashes(low.prefix_hashes(), starts, ends)
    out = [(word & mask, bounds)]
    two = mix(word[:-1] * U(3) + word[1:]) if len(word) > 1 else word[:0]
    inside = np.ones(len(two), bool)
    inside[bounds[(bounds > 0) & (bounds <= len(two))] - 1] = False
    # Nothing is left of a text with fewer than two words.
    kept = np.zeros(len(two) + 1, np.int64)
    np.cumsum(inside, out=kept[1:])
    out.append((two[inside] & mask, kept[np.minimum(bounds, len(two))]))
    wide = low.characters()
    data, offsets = wide.data.view("<u4"), wide.offsets // 4
    n = len(data)
    for size in (3, 4):
        h = np.zeros(max(0, n - size + 1), np.uint32)
        for k in range(size):
            h = h * np.uint32(0x01000193) + data[k : k + len(h)]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        ok = np.ones(len(h), bool)
        cut = offsets[(offsets > 0) & (offsets < n)]
        for k in range(1, size):
            at = cut - k
            ok[at[(at >= 0) & (at < len(h))]] = False
        kept = np.zeros(len(h) + 1, np.int64)
        np.cumsum(ok, out=kept[1:])
        out.append(((h[ok] & np.uint32(mask)).astype(np.int64), kept[np.minimum(offsets, len(h))]))
    return [(ids.astype(np.int64) + (k << bits), b) for k, (ids, b) in enumerate(out)]
