"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then score all documents together.

The text view is a logistic regression over hashed word and character n-grams; the metadata view one over lang, source,
n_chars and the layout of lines (their number and lengths, which are taken from the text: the views aren't independent in the
strict sense). Both start from the same bounded sample of labelled rows. In each round both score every document, and each hands
the other pseudo-labels: of all distinct texts that it is confident about, PSEUDO at most in order of a hash of the text, so that
neither copies nor one cell of metadata fill them, and in the classes' shares of the labelled rows, so that they don't shift the
prior. Their n-grams are counted where they lie, whatever the length of the text.
At last the two calibrated views are added as log-odds and calibrated again on labelled rows held back from all training.

Edge cases. Null texts and metadata count as empty strings, a null n_chars as its own value; an empty text is scored like
any other. Repeated rows get equal scores, and ties of pseudo-labels go by the hash; of rows that share a doc_id one is learnt from.
Very long texts are scored and learnt from whole. An empty table gives an empty result. Without labels all scores are 0.5, with
one class that class's constant. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import labelled_sample, read, release, stored, tune
from starloom.llm.linear import KINDS, Linear, Part, fit_sparse, platt, sigmoid, sparse, split
from starloom.llm.textblock import Block, blocks

#: Bounds of the labelled sample; rounds; pseudo-labels that a view hands over in a round, at most; their weight.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS, PSEUDO, PSEUDO_WEIGHT = 2000, 16 << 20, 2, 200, 0.5
#: The least confidence in a class. Label 0 is the rarer one by far: at 0.75 its odds have gained more than those of label 1 at 0.95.
CONFIDENT = {1: 0.95, 0: 0.75}
MIN_PROBABILITY = 0.5
META_BITS, BITS = 12, 16
SCHEMA = "doc_id long, p_text double, p_meta double, score double, kept boolean"
FIELDS = 6


def meta_ids(block: Block, lang: list, source: list, n_chars: list) -> np.ndarray:
    """Feature ids of the metadata view, one for each of FIELDS fields: (texts, FIELDS)."""
    newline = np.flatnonzero(block.data == 10)
    lines = np.diff(np.searchsorted(newline, block.offsets)) + 1
    size = np.diff(block.offsets)
    start = np.sort(np.concatenate([block.offsets[:-1], newline + 1]), kind="stable")
    end = np.sort(np.concatenate([newline, block.offsets[1:]]), kind="stable")
    doc = np.repeat(np.arange(block.n), lines)  # in order, as the starts are
    short = np.bincount(doc[(end - start) < 30], minlength=block.n)
    log = lambda x: np.int64(np.log2(np.maximum(x, 1)) * 2)
    known: dict[tuple, int] = {}

    def hashed(k: int, values) -> list[int]:
        out = []
        for v in values:
            key = (k, v)
            if key not in known:
                known[key] = zlib.crc32(repr(key).encode()) & ((1 << META_BITS) - 1)
            out.append(known[key])
        return out

    chars = [-1 if v is None else int(2 * np.log2(v)) if v > 0 else 0 for v in n_chars]
    cols = [["" if v is None else v for v in lang], ["" if v is None else v for v in source], chars, log(lines).tolist(), log(size / lines).tolist(), (10 * short // lines).tolist()]
    return np.array([hashed(k, c) for k, c in enumerate(cols)], np.int64).reshape(FIELDS, block.n).T


@dataclass
class Views:
    text: Linear
    meta: Linear
    prior: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    handed: tuple = ()  # (round, view that was sure, label, number of pseudo-labels)

    def probabilities(self, block: Block, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.text.probabilities(block)
        margin = self.meta.bias + self.meta.weights[meta_ids(block, lang, source, n_chars)].sum(axis=1, dtype=np.float64)
        q = sigmoid(self.meta.slope * margin + self.meta.shift)
        return p, q, sigmoid(self.slope * self.joint(p, q) + self.shift)

    def joint(self, p, q):
        logit = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6)))
        return logit(p) + logit(q) - self.prior


def columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def score(docs: DataFrame, views: Views, threshold: float = MIN_PROBABILITY, hashed: bool = False) -> DataFrame:
    """Both views' probabilities, the combined score and the verdict of every document; a hash of its text, if asked for."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(views)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            lang, source, n_chars = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for a, b, block in blocks(batch):
                p, q, s = v.probabilities(block, lang[a:b], source[a:b], n_chars[a:b])
                cols = [batch.column(0).slice(a, b - a), pa.array(p), pa.array(q), pa.array(s), pa.array(s >= threshold), batch.column(5).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names)

    schema = SCHEMA + (", text_hash long" if hashed else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return columns(docs).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(run, schema)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = MIN_PROBABILITY) -> DataFrame:
    """The rows of docs, all columns, that the combined views keep; nothing is shuffled."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    place = {c: docs.columns.index(c) for c in ("lang", "source", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, n_chars = (batch.column(place[c]).to_pylist() for c in ("lang", "source", "n_chars"))
            for a, b, block in blocks(batch):
                yield batch.slice(a, b - a).filter(pa.array(shared.value.probabilities(block, lang[a:b], source[a:b], n_chars[a:b])[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)


@dataclass
class Rows:
    """Training rows of a view. The first n are the labelled ones."""

    text: bool
    y: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)
    metas: list[np.ndarray] = field(default_factory=list)

    def add(self, rows: list, labels: list[int], weight: float) -> None:
        if not rows:
            return
        if self.text:
            self.parts += [p.shifted(len(self.y)) for p in sparse([x["text"] for x in rows], BITS)]
        else:
            self.metas.append(meta_ids(Block.of(pa.array([x["text"] for x in rows], pa.large_string())), [x["lang"] for x in rows], [x["source"] for x in rows], [x["n_chars"] for x in rows]))
        self.y += labels
        self.weight += [weight] * len(rows)

    def add_counted(self, rows: list, label: int, weight: float) -> None:
        """Rows of features()."""
        for r in rows:
            if self.text:
                used = np.frombuffer(r["used"], "<i4")
                self.parts.append(Part.of(np.full(len(used), len(self.y)), used, np.frombuffer(r["vals"], "<f4")))
            else:
                self.metas.append(np.array([r["meta"]], np.int64))
            self.y.append(label)
            self.weight.append(weight)

    def fit(self, n: int) -> Linear:
        y, w = np.array(self.y, float), np.array(self.weight)
        held = split(y, n)
        if self.text:
            return fit_sparse(self.parts, y, w, held, BITS, KINDS << BITS)
        ids = np.concatenate(self.metas) if self.metas else np.zeros((0, FIELDS), np.int64)
        return fit_sparse([Part.of(np.repeat(np.arange(len(ids)), FIELDS), ids.ravel(), np.ones(ids.size))], y, w, held, META_BITS, 1 << META_BITS)


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Views:
    sample = labelled_sample(docs, labels, "quality", rows, max_bytes)
    ids = {d: int(y > 0) for d, _, y in sample}
    del sample  # the texts come again with the other columns
    first = fetch(docs, list(ids))
    first = [r for r in first if r["doc_id"] in ids]
    text_rows, meta_rows = Rows(True), Rows(False)
    for part in (text_rows, meta_rows):
        part.add(first, [ids[r["doc_id"]] for r in first], 1.0)
    n = len(first)
    release()
    taken, handed = set(ids), []
    for turn in range(rounds + 1):
        views = Views(text_rows.fit(n), meta_rows.fit(n), handed=tuple(handed))
        release()
        if turn == rounds or len(set(ids.values())) < 2:
            break
        scored = stored(score(docs, views, hashed=True).select("doc_id", "p_text", "p_meta", "text_hash"), "cotrain")
        for p, to in (("p_text", meta_rows), ("p_meta", text_rows)):
            share = {1: sum(ids.values()) / len(ids)}
            share[0] = 1 - share[1]
            picked = {}
            for y in (1, 0):
                sure = F.col(p) if y else 1 - F.col(p)
                texts = scored.where((sure >= CONFIDENT[y]) & F.col("doc_id").isNotNull()).groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
                top = texts.orderBy(F.xxhash64("text_hash", F.lit(turn)), "text_hash").limit(PSEUDO + len(taken))
                picked[y] = [d for d in dict.fromkeys(r[0] for r in top.select("doc_id").collect()) if d not in taken]
            both = min(PSEUDO, *(len(picked[y]) / share[y] for y in (1, 0)))
            for y in (1, 0):
                chosen = picked[y][: round(both * share[y])]
                taken.update(chosen)
                more = features(docs, chosen, to.text)
                to.add_counted(more, y, PSEUDO_WEIGHT)
                handed.append((turn, p, y, len(more)))
    y = np.array(text_rows.y[:n], float)
    held = split(y, n)
    text_rows = meta_rows = part = to = None
    release()
    if n and 0 < y.mean() < 1:
        views.prior = float(np.log(y.mean() / (1 - y.mean())))
        at = np.flatnonzero(held if held.any() else np.ones(n, bool))
        chosen = [first[k] for k in at]
        p, q, _ = views.probabilities(Block.of(pa.array([r["text"] for r in chosen], pa.large_string())), *([r[k] for r in chosen] for k in ("lang", "source", "n_chars")))
        views.slope, views.shift = platt(views.joint(p, q), y[at])
    elif n:
        views.prior = 0.0
    del first
    release()
    return views


def fetch(docs: DataFrame, ids: list[int]) -> list:
    """The rows of a bounded list of ids, one for each, in order of the id."""
    if not ids:
        return []
    spark = docs.sparkSession
    pick = F.broadcast(spark.createDataFrame([(d,) for d in ids], "doc_id long"))
    one = F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")).alias("r")
    return columns(docs).join(pick, "doc_id").groupBy("doc_id").agg(one).select("doc_id", "r.*").orderBy("doc_id").collect()


def features(docs: DataFrame, ids: list[int], text: bool) -> list:
    """(doc_id, used, vals) or (doc_id, meta) for a bounded list of ids, one row for each, in order of the id: a view's features.

    They are counted where the texts lie. A row has KINDS << BITS features at most, however long the text is.
    """
    if not ids:
        return []
    spark = docs.sparkSession
    tune(spark)
    pick = F.broadcast(spark.createDataFrame([(d,) for d in ids], "doc_id long"))
    schema = "doc_id long, used binary, vals binary" if text else "doc_id long, meta array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if text:
                parts = [sparse([t or ""], BITS) for t in batch.column(1).to_pylist()]
                cols = [[b"".join(p.used.astype("<i4").tobytes() for p in x) for x in parts], [b"".join(p.vals.astype("<f4").tobytes() for p in x) for x in parts]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in cols)], names)
            else:
                ids = meta_ids(Block.of(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids.tolist(), pa.list_(pa.int64()))], names)

    rows = columns(docs).join(pick, "doc_id").select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, schema)
    return rows.groupBy("doc_id").agg(F.min(F.struct(*names[1:])).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
