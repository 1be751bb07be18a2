"""Quality rules: text statistics with fixed limits, and a calibrated n-gram logistic regression against a fixed threshold.

Edge cases. A null text counts as empty: no words, base_failed, not kept. Repeated rows get equal results; null ids pass
through. An empty table gives an empty result. Only doc_id and text are read, so further columns don't matter. Without a
usable label (none, or one class) the model is a constant and the verdict that of this class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import labelled_sample, read, release, tune
from starloom.llm.linear import Linear, fit
from starloom.llm.textblock import SPACE, Block, blocks, owner, sums

#: Bounds of the labelled sample that the model is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 16 << 20
#: Fixed limits.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 20, 8, 30, 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def doubled(group: np.ndarray, value: np.ndarray, keep) -> np.ndarray:
    """For each entry whether its group has an equal value: earlier (keep "first") or anywhere else (keep False)."""
    return pd.Series(group * (int(value.max(initial=0)) + 1) + value).duplicated(keep=keep).to_numpy()


def joined(code: np.ndarray, apart: int) -> np.ndarray:
    """Places among the distinct pairs of each code and the one `apart` after it: runs twice as long, told apart exactly."""
    return pd.factorize(code[:-apart] * (int(code.max(initial=0)) + 1) + code[apart:])[0].astype(np.int64)


def statistics(block: Block) -> dict[str, np.ndarray]:
    """The base counts of each text, over the whole of it."""
    data = block.data
    starts, ends, bounds = block.words()
    out = {"n_words": np.diff(bounds)}
    out["word_chars"] = sums((~SPACE[data] & ((data & 0xC0) != 0x80)).astype(np.int64), block.offsets)
    out["n_symbols"] = sums(SYMBOL[data].astype(np.int64), block.offsets)

    # Lines: from a text's start or after a \n, up to the next \n or the text's end; those with a word count.
    newline = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([block.offsets[:-1], newline + 1]), kind="stable")
    line_end = np.sort(np.concatenate([newline, block.offsets[1:]]), kind="stable")
    has = np.searchsorted(starts, line_end, "left") > np.searchsorted(starts, line_start, "left")
    line_start, line_end = line_start[has], line_end[has]
    doc = np.searchsorted(block.offsets, line_start, "right") - 1
    dup = doubled(doc, block.codes(line_start, line_end)[0], "first")
    out["n_dup_lines"] = np.bincount(doc[dup], minlength=block.n)

    # Words in windows that are found twice or more in their text.
    h, n = block.codes(starts, ends)[0], len(starts)
    text = owner(bounds)
    if n >= WINDOW:
        for apart in (1, 2, 4):  # to runs of WINDOW = 8
            h = joined(h, apart)
        ok = text[: len(h)] == text[WINDOW - 1 :]
        at = np.flatnonzero(ok)
        at = at[doubled(text[at], h[at], False)]
        cover = np.zeros(n + 1, np.int64)
        cover[at] += 1  # each position once in `at`
        cover[at + WINDOW] -= 1
        out["n_repeat_words"] = sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), bounds)
    else:
        out["n_repeat_words"] = np.zeros(block.n, np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Linear:
    """The model of label `quality` = 1, on at most `rows` labelled documents."""
    sample = labelled_sample(docs, labels, "quality", rows, max_bytes)
    model = fit([t for _, t, _ in sample], [int(y > 0) for _, _, y in sample])
    del sample
    release()
    return model


def score(docs: DataFrame, model: Linear, threshold: float = MIN_PROBABILITY) -> DataFrame:
    """Statistics and verdict of each document, in Arrow batches."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: KINDS * 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, block in blocks(batch):
                s = statistics(block)
                p = m.probabilities(block)
                s["kept"] = ~s["base_failed"] & (p >= threshold)
                cols = [batch.column(0).slice(a, b - a), *(pa.array(s[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(s["base_failed"]), pa.array(s["kept"]), pa.array(p)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules and the model keep: verdicts are made where the rows are, nothing is shuffled."""
    return filtered(docs, train(docs, labels))


def filtered(docs: DataFrame, model: Linear, threshold: float = MIN_PROBABILITY) -> DataFrame:
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, block in blocks(batch):
                good = ~statistics(block)["base_failed"] & (shared.value.probabilities(block) >= threshold)
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
