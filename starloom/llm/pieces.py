"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a stretch of text once. At each position its output links give all pieces that end there; each relaxes the
best score at its end from the best score at its start, so the pass leaves the segmentation of the greatest total score. A
character that no piece covers costs UNKNOWN below the least score and becomes its UTF-8 bytes' pieces where the file has them,
else the unknown id. Ties go to the piece found first, the one that begins earliest (the longest). No piece but runs of the space mark has that
mark after its first character, so a best path never crosses the start of a run of spaces: stretches are segmented on their
own, and each distinct one once while a worker remembers it.

The normaliser of the file is taken to be the identity with spaces marked and one mark put before the text, as in files with
byte fallback; decoding joins pieces, turns marks into spaces and takes the first one off.

Edge cases. A null text stays null with null ids; an empty one has no ids and decodes to an empty text. Texts are handled whole.
Repeated rows get equal results. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import read, tune
from starloom.llm.textblock import Block, blocks, gathered

MARK, UNKNOWN, REMEMBERED = "▁", 10.0, 400_000
#: Bytes of text encoded together.
BLOCK = 1 << 20
SCHEMA = "doc_id long, n_ids long, ids array<int>, decoded_bytes long, round_trip boolean"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.unk = sp.get_piece_size(), sp.unk_id()
        self.text = [sp.id_to_piece(k) for k in range(self.size)]
        self.bytes = {int(self.text[k][3:5], 16): k for k in range(self.size) if sp.is_byte(k)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        special = [k for k in range(self.size) if sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)]
        self.hidden = {k for k in special if sp.is_control(k)}
        plain = sorted(set(range(self.size)) - set(special))
        if any(MARK in self.text[k].lstrip(MARK) for k in plain):
            raise ValueError("a piece has the space mark inside")
        score = {k: sp.get_score(k) for k in plain}
        self.unknown = min(score.values(), default=0.0) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for k in plain:
            self.automaton.add_word(self.text[k], (k, len(self.text[k]), score[k]))
        self.automaton.make_automaton()
        self.lines = not any("\n" in self.text[k] for k in plain)
        self.decode_parts = [self.text[k].replace(MARK, " ").encode() if k in score else bytes([self.byte_of[k]]) if k in self.byte_of else b"" if k in self.hidden else " ⁇ ".encode() for k in range(self.size)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best segmentation of s, in which spaces are marks already."""
        n, low = len(s), float("-inf")
        best, back = [low] * (n + 1), [None] * (n + 1)
        best[0], at, unknown = 0.0, 0, self.unknown
        for last, (k, size, score) in self.automaton.iter(s):
            end = last + 1
            while at < end - 1:  # all pieces that end at `at` have been seen; a single unknown character is the last resort
                at += 1
                if best[at] < best[at - 1] + unknown and self._lone(s, at):
                    best[at], back[at] = best[at - 1] + unknown, (self.unk, 1)
            total = best[end - size] + score
            if total > best[end]:
                best[end], back[end] = total, (k, size)
        while at < n:
            at += 1
            if best[at] < best[at - 1] + unknown and self._lone(s, at):
                best[at], back[at] = best[at - 1] + unknown, (self.unk, 1)
        out, at = [], n
        while at:
            k, size = back[at]
            if k == self.unk:
                raw = s[at - 1].encode()
                out += [self.bytes[b] for b in reversed(raw)] if len(self.bytes) == 256 else [k]
            else:
                out.append(k)
            at -= size
        return out[::-1]

    def _lone(self, s: str, at: int) -> bool:
        """Whether the character before `at` is no piece by itself: only then is it unknown."""
        return s[at - 1] not in self.automaton

    def encode(self, text: str) -> list[int]:
        ids, _ = self.encode_block(Block.of(pa.array([text], pa.large_string())))
        return ids.tolist()

    def decode(self, ids) -> str:
        raw = b"".join(self.decode_parts[k] for k in ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")

    def _learn(self, new: list[bytes]) -> None:
        found = [self.viterbi((MARK if s[:1] == b"\0" else "") + s[s[:1] in (b"\0", b"\1") :].decode().replace(" ", MARK)) for s in new]
        size = np.array([len(x) for x in found], np.int64)
        first, total = len(self.known), self.used + int(size.sum())
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.int32)])
        if first + len(new) > len(self.count):
            more = np.zeros(max(first + len(new), len(self.count)), np.int64)
            self.start, self.count = np.concatenate([self.start, more]), np.concatenate([self.count, more])
        self.pool[self.used : total] = np.fromiter((t for x in found for t in x), np.int32, int(size.sum()))
        self.count[first : first + len(new)] = size
        self.start[first : first + len(new)] = self.used + np.cumsum(size) - size
        self.used = total
        self.known.update((s, first + k) for k, s in enumerate(new))

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids before each text (n + 1 entries)."""
        data, off, n = block.data, block.offsets, len(block.data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(block.n + 1, np.int64)
        if len(self.known) > REMEMBERED:
            self.clear()
        cut = np.zeros(n + 1, bool)
        cut[1:n] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        if self.lines:
            cut[1:] |= data == 0x0A
            cut[:n] |= data == 0x0A
        cut[off] = True
        start = np.flatnonzero(cut[:n])
        end = np.append(start[1:], n)
        head = np.isin(start, off)  # these get the mark before the text: \0 before a stretch stands for it, \1 keeps others apart from that
        code, parts = block.codes(start, end)  # by the bytes, not a hash of them
        parts = parts.to_pylist()
        both, code = np.unique(2 * code + head, return_inverse=True)
        distinct = [(b"\0" if k & 1 else b"\1" if parts[k >> 1][0] < 2 else b"") + parts[k >> 1] for k in both.tolist()]
        new = [s for s in distinct if s not in self.known]
        if new:
            self._learn(new)
        entry = np.fromiter((self.known[s] for s in distinct), np.int64, len(distinct))[code]
        size = self.count[entry]
        before = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        return self.pool[np.repeat(self.start[entry] - before[:-1], size) + np.arange(before[-1])], before[np.searchsorted(start, off)]

    def decode_block(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and bytes of the texts that the ids stand for."""
        if not hasattr(self, "_flat"):
            part = np.array([len(p) for p in self.decode_parts], np.int64)
            self._flat = np.frombuffer(b"".join(self.decode_parts), np.uint8), np.cumsum(part) - part, part
        flat, at, part = self._flat
        size = part[ids]
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        data = flat[np.repeat(at[ids] - before[:-1], size) + np.arange(before[-1])]
        off = before[bounds]
        some = off[1:] > off[:-1]
        lead = np.zeros(len(data), bool)
        lead[off[:-1][some]] = data[off[:-1][some]] == 0x20
        gone = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=gone[1:])
        return off - gone[off], data[~lead]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str | None = None) -> Pieces:
    path = path or default_path()
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids of every document, and of what they decode to the bytes and whether it is the text."""
    tune(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in gathered(batches, BLOCK):
            null = batch.column(1).is_null()
            for a, b, block in blocks(batch, most=BLOCK):
                ids, bounds = p.encode_block(block)
                off, data = p.decode_block(ids, bounds)
                size = np.diff(off)
                same = size == np.diff(block.offsets)
                if same.all():
                    wrong = np.zeros(len(data) + 1, np.int64)
                    np.cumsum(data != block.data, out=wrong[1:])
                    same = wrong[off[1:]] == wrong[off[:-1]]
                else:
                    same = np.array([s and (data[x:y] == block.data[u:v]).all() for s, x, y, u, v in zip(same, off, off[1:], block.offsets, block.offsets[1:], strict=False)])
                gone = null.slice(a, b - a).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(gone) if gone.any() else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds), mask=gone), lists, pa.array(size, mask=gone), pa.array(same, mask=gone)], [c.split()[0] for c in SCHEMA.split(", ")])
        p.clear()  # an idle worker shouldn't hold them

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (doc_id, ids array<int>) as (doc_id, text); null ids give a null text."""
    tune(rows.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            texts = [None if x is None else p.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
