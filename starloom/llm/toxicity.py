"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are the stems of all words: their first STEM letters in lower case, a truncating stemmer that needs no language's rules.
The vocabulary is that of all labelled examples of a bounded sample, none left out; document frequencies are counted over all
documents, and a term's weight in a text is its count times log((documents + 1) / (frequency + 1)).
Every example is indexed: each term has a posting list in blocks of BLOCK examples, with the largest weight in each block; the lists
of frequent terms are dense rows, multiplied for many texts at a time. A text's bound for a block is the largest part that the
frequent terms give there, and the sum over its other terms of its weight times the block's largest. Blocks are opened in order of
their bounds; those whose bound is below the k-th best cosine stay closed, so nothing is lost. The votes of the k nearest are weighted by their
cosine, and calibrated by isotonic regression on the examples themselves, each scored without itself.

Edge cases. Null and empty texts, and texts without a term that an example has, have no neighbours and get the sample's
smoothed share of label 1, calibrated like all votes. Ties in cosine go to the example that is first in the index. Equal
texts get equal scores; repeated rows stay. Without any label 1, or any label, all scores are the smoothed prior. Only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import labelled_sample, read, tune
from starloom.llm.textblock import Block, slices, string_parts

#: Bounds of the labelled sample; letters of a stem; neighbours; examples in a block; blocks opened first.
SAMPLE_ROWS, SAMPLE_BYTES, STEM, NEIGHBOURS, BLOCK, OPENED = 4000, 32 << 20, 4, 15, 64, 8
#: A term is frequent if at least one in FREQUENT examples has it (its list is as large as a dense row); texts asked at a time.
FREQUENT, TOGETHER = 16, 64
#: The most that dense rows may take: beyond it frequent terms have lists too, with equal results.
DENSE_BYTES = 48 << 20
LEARN = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, nearest array<long>, nearest_cosine double"

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def stems(block: Block) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of every word of a block of lower-cased texts: its text, its stem's place among the distinct ones, and those."""
    data, n = block.data, len(block.data)
    letter = np.zeros(n + 2, bool)
    letter[1 : n + 1] = LETTER[data]
    first = np.zeros(n + 1, bool)
    first[block.offsets] = True
    mid = letter[1 : n + 1]
    starts = np.flatnonzero(mid & (~letter[:n] | first[:n]))
    ends = np.flatnonzero(mid & (~letter[2:] | first[1:])) + 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
    after = np.searchsorted(lead, starts) + STEM
    ends = np.minimum(ends, np.append(lead, np.full(STEM + 1, n))[after])
    code, distinct = block.codes(starts, ends)
    return np.searchsorted(block.offsets, starts, "right") - 1, code, distinct


def counts(block: Block, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, terms (by place in the vocabulary) and counts, each pair once, in order."""
    doc, code, distinct = stems(block)
    place = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy().astype(np.int64)[code] if len(code) else code
    size = max(len(vocabulary), 1)
    got, times = np.unique(doc[place >= 0] * size + place[place >= 0], return_counts=True)
    return got // size, got % size, times


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each range, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


@dataclass
class Index:
    """Posting lists by term, in blocks of examples, with each block's largest weight; those of frequent terms as dense rows."""

    vocabulary: pa.Array
    idf: np.ndarray
    order: np.ndarray  # of each place the example's number in the sample
    frequent: np.ndarray  # of each term its dense row, -1 if it has lists
    dense: np.ndarray  # weights of frequent terms by place
    term_at: np.ndarray  # first block list of each term, one more than terms
    list_block: np.ndarray  # of each block list: block, largest weight, first posting (one more)
    list_most: np.ndarray
    list_at: np.ndarray
    example: np.ndarray  # of each posting
    weight: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    prior: float
    knots: tuple[np.ndarray, np.ndarray]  # votes and their calibrated scores, both rising

    @classmethod
    def of(cls, vocabulary: pa.Array, idf: np.ndarray, doc, term, weight, label, ids, prior: float) -> Index:
        """From the examples' normalised weights (doc, term, weight), of which examples with one main term get neighbouring places."""
        n, terms = len(label), len(vocabulary)
        main = np.full(n, terms, np.int64)
        order = np.lexsort((term, -weight, doc))
        _, first = np.unique(doc[order], return_index=True)
        main[doc[order][first]] = term[order][first]
        by = np.argsort(main, kind="stable")
        place = np.empty(n, np.int64)
        place[by] = np.arange(n)
        doc = place[doc]
        df = np.bincount(term, minlength=terms)
        many = df * FREQUENT >= max(n, 1)
        many[np.argsort(-df, kind="stable")[DENSE_BYTES // (8 * max(n, 1)) :]] = False
        frequent = np.where(many, np.cumsum(many) - 1, -1)
        dense = np.zeros((int(many.sum()), n))
        some = many[term]
        dense[frequent[term[some]], doc[some]] = weight[some]
        doc, term, weight = doc[~some], term[~some], weight[~some]
        order = np.lexsort((doc, term))
        doc, term, weight = doc[order], term[order], weight[order]
        key = term * (n // BLOCK + 1) + doc // BLOCK
        at = np.flatnonzero(np.diff(key, prepend=-1))
        most = np.maximum.reduceat(weight, at) if len(at) else np.zeros(0)
        return cls(vocabulary, idf, by, frequent, dense, np.searchsorted(term[at], np.arange(terms + 1)), doc[at] // BLOCK, most, np.append(at, len(doc)), doc, weight, label[by], ids[by], prior, (np.zeros(1), np.full(1, prior)))

    def search(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each text (terms, normalised weights), the frequent terms of TOGETHER texts in one product."""
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            x = np.zeros((len(some), len(self.dense)))
            for row, (term, weight) in zip(x, some, strict=True):
                f = self.frequent[term]
                row[f[f >= 0]] = weight[f >= 0]
            for k, (row, (term, weight)) in enumerate(zip(x @ self.dense, some, strict=True)):
                rare = self.frequent[term] < 0
                yield self.nearest(row, term[rare], weight[rare], without[at + k] if without else -1)

    def nearest(self, cosine: np.ndarray, term: np.ndarray, weight: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the NEIGHBOURS nearest examples, given the frequent terms' part of the cosines and the other terms.

        Exact: a block is left closed only if its largest part so far and its lists' largest weights can't reach the k-th best.
        """
        n = len(self.label)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        if without >= 0:
            cosine[without] = -2.0  # no sum of normalised weights makes up for it
        size = self.term_at[term + 1] - self.term_at[term]
        lists, w = spans(self.term_at[term], size), np.repeat(weight, size)
        block = self.list_block[lists]
        bound = np.maximum.reduceat(cosine, np.arange(0, n, BLOCK)) + np.bincount(block, w * self.list_most[lists], minlength=-(-n // BLOCK))
        closed = np.argsort(-bound, kind="stable")
        closed = closed[bound[closed] > 0]
        best, value, count = np.zeros(0, np.int64), np.zeros(0), OPENED
        while len(closed):
            some, closed = closed[:count], closed[count:]
            opened = np.zeros(len(bound), bool)
            opened[some] = True
            mine = np.flatnonzero(opened[block])
            size = self.list_at[lists[mine] + 1] - self.list_at[lists[mine]]
            where = spans(self.list_at[lists[mine]], size)
            cosine += np.bincount(self.example[where], np.repeat(w[mine], size) * self.weight[where], minlength=n)
            got = (np.sort(some)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            got = np.concatenate([best, got[got < n]])
            got = got[cosine[got] > 1e-12]
            if len(got) > NEIGHBOURS:
                least = np.partition(cosine[got], len(got) - NEIGHBOURS)[len(got) - NEIGHBOURS]
                got = got[cosine[got] >= least]
            best = got[np.lexsort((got, -cosine[got]))][:NEIGHBOURS]
            value = cosine[best]
            if len(best) == NEIGHBOURS:
                closed = closed[bound[closed] >= value[-1] - 1e-12]
            count = len(closed)
        return best, value

    def vote(self, place: np.ndarray, value: np.ndarray) -> float:
        """The cosine-weighted share of label 1 among the nearest, the prior having one more vote of their mean weight."""
        own = value.mean() if len(value) else 1.0
        return float(((value * self.label[place]).sum() + own * self.prior) / (value.sum() + own))

    def weights(self, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Normalised TF-IDF weights of one text."""
        w = times * self.idf[term]
        return w / max(np.sqrt((w * w).sum()), 1e-300)


def frequencies(docs: DataFrame, vocabulary: pa.Array) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term; over all documents, counted where they lie."""
    tune(docs.sparkSession)

    def run(batches):
        n, df = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            n += batch.num_rows
            offsets, data = string_parts(lowered(batch.column(0)))
            for a, b in slices(offsets):
                _, term, _ = counts(Block(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]), vocabulary)
                df += np.bincount(term, minlength=len(vocabulary))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(df[some], n), pa.int64())], ["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def build(docs: DataFrame, labels: DataFrame, where: str | None = LEARN, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Index:
    """The index of at most `rows` labelled documents and `max_bytes` bytes of their text."""
    sample = labelled_sample(docs, labels, "toxic", rows, max_bytes, where)
    y, ids = np.array([float(v > 0) for *_, v in sample]), np.array([d for d, *_ in sample], np.int64)
    prior = (y.sum() + 1) / (len(y) + 2)
    offsets, data = string_parts(lowered(pa.array([t for _, t, _ in sample], pa.large_string())))
    parts = [(a, Block(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])) for a, b in slices(offsets)]
    seen = [stems(block)[2] for _, block in parts]
    vocabulary = pc.unique(pa.chunked_array(seen, pa.large_binary())).sort() if seen else pa.array([], pa.large_binary())
    if not y.any() or y.all() or not len(vocabulary):
        none = np.zeros(0)
        return Index.of(vocabulary.slice(0, 0), none, none.astype(int), none.astype(int), none, none, none.astype(int), prior)
    total, df = frequencies(docs, vocabulary)
    idf = np.log((total + 1) / (df + 1))
    doc, term, times = (np.concatenate(x) for x in zip(*((d + a, t, n) for a, block in parts for d, t, n in [counts(block, vocabulary)]), strict=True))
    w = times * idf[term]
    norm = np.sqrt(np.bincount(doc, w * w, minlength=len(y)))
    keep = w > 0
    index = Index.of(vocabulary, idf, doc[keep], term[keep], (w / np.maximum(norm[doc], 1e-300))[keep], y, ids, prior)
    edge = np.searchsorted(doc, np.arange(len(y) + 1))  # in order
    rows = [(term[edge[k] : edge[k + 1]], w[edge[k] : edge[k + 1]] / max(norm[k], 1e-300)) for k in index.order.tolist()]
    own = np.array([index.vote(*got) for got in index.search(rows, list(range(len(y))))])
    index.knots = calibrated(own, index.label)
    return index


def calibrated(vote: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function of votes nearest to the labels, by pooling adjacent violators; a pool's share of label 1 is
    smoothed by one row of the sample's share."""
    pools: list[list[float]] = []  # sum of labels, rows, sum of votes
    at, where = np.unique(vote, return_inverse=True)
    for x, s, n in zip(at.tolist(), np.bincount(where, y).tolist(), np.bincount(where).tolist(), strict=True):
        pools.append([s, n, x * n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    share = np.array([(s + y.mean()) / (n + 1) for s, n, _ in pools])
    return np.array([x / n for _, n, x in pools]), np.maximum.accumulate(share)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """Score, prediction and nearest examples of every document."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(index)  # bounded: a posting for each distinct term of an example, and DENSE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        lone = ix.vote(np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            n = batch.num_rows
            votes, near, top = np.full(n, lone), [[] for _ in range(n)], np.zeros(n)
            offsets, data = string_parts(lowered(batch.column(2)))
            known = {}  # copies lie together often
            for a, b in slices(offsets) if len(ix.vocabulary) else []:
                doc, term, times = counts(Block(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]), ix.vocabulary)
                edge = np.searchsorted(doc, np.arange(b - a + 1))
                asked, where = {}, {}
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    t, c = term[edge[k] : edge[k + 1]], times[edge[k] : edge[k + 1]]
                    where[k] = key = (t.tobytes(), c.tobytes())
                    if key not in known and key not in asked:
                        asked[key] = (t, ix.weights(t, c))
                for key, (place, value) in zip(asked, ix.search(list(asked.values())), strict=True):
                    known[key] = ix.vote(place, value), ix.ids[place].tolist(), float(value[0]) if len(value) else 0.0
                for k, key in where.items():
                    votes[a + k], near[a + k], top[a + k] = known[key]
            p = np.interp(votes, *ix.knots)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(near, pa.list_(pa.int64())), pa.array(top)], ["doc_id", "held_out", "score", "predicted", "nearest", "nearest_cosine"])

    held = F.coalesce(~F.expr(LEARN), F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", held, "text").mapInArrow(run, SCHEMA)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, build(docs, read(spark, sf_dir, "labels")))
