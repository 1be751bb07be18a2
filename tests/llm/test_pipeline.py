"""The pipeline's stages: columns, decisions that take effect, near copies found, clean documents kept."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from starloom.llm import buckets, simhash


def test_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(buckets, "TILE", 16)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(30)]
    rows, group = [], []
    for g, text in enumerate(base):
        for c in range(1 + 5 * (g % 3)):
            new = list(text)
            for _ in range(3 if c else 0):
                new[rng.randrange(200)] = rng.choice(words)  # about 15 of 200 shingles a time
            rows.append((len(rows), " ".join(new)))
            group.append(g)
    rows += [(900, None), (901, ""), (902, "short one"), (903, "short one"), rows[0]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, root int")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    first = {g: group.index(g) for g in set(group)}
    hits = sum(got[k] == first[g] for k, g in enumerate(group))
    assert hits >= 0.95 * len(group)
    assert len({got[first[g]] for g in set(group)}) == 30  # unlike texts stay apart
    assert got[900] == got[901] == 900 and got[902] == got[903] == 902
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len({got[r[0]] for r in rows})
    assert simhash.representatives(docs.limit(0)).count() == 0


def replaced(n, rng, tag):
    """A text of n words and one with two of them replaced, 10 shingles of n - 4."""
    a = [f"{tag}w{k}" for k in range(n)]
    b = list(a)
    x = rng.randrange(4, n // 2 - 5)
    b[x], b[x + 10] = "p", "q"
    return " ".join(a), " ".join(b)


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_no_link_below_the_similarity(spark):
    rng, rows = random.Random(1), []
    for k in range(150):
        a, b = replaced(93 - k % 12, rng, f"{k}-")
        same = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert 0.75 < same < 0.8
        rows += [(2 * k, a), (2 * k + 1, b)]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got) and len(got) == 300


def test_pairs_at_the_similarity_are_found(spark):
    rng, rows = random.Random(2), []
    for k in range(300):
        a, b = replaced(94 + k % 3, rng, f"{k}-")
        assert 0.8 <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.81
        rows += [(2 * k, a), (2 * k + 1, b)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(300))


def test_keys_of_sets_at_the_similarity():
    rng, missed = np.random.default_rng(4), 0
    for _ in range(100):
        sets = []
        for n in rng.integers(1, 40, 100).tolist():
            h = rng.integers(0, 1 << 64, 10 * n, np.uint64)
            sets += [h[: 9 * n], h[n:]]  # 8 of 10 in common
        keys = simhash.band_keys(sets)
        missed += sum(not (a == b).any() for a, b in zip(keys[::2], keys[1::2]))
    assert missed <= 4  # of 10,000; 0.15 expected


def test_fingerprints_of_similar_sets_are_near():
    rng, most, apart = np.random.default_rng(5), 0, []
    for k in range(4000):
        n = int(rng.integers(1, 30))
        h = np.unique(rng.integers(0, 1 << 64, 10 * n, np.uint64))
        a, b = (h[: 9 * n], h[n:]) if k % 2 else (h[: 4 * n], h[: 5 * n])  # 8 of 10 in common; 4 of 5
        x, y = (np.frombuffer(simhash.set_fingerprint(z), "<u8") for z in (a, b))
        most = max(most, int(np.bitwise_count(x ^ y).sum()))
        z = np.frombuffer(simhash.set_fingerprint(rng.integers(0, 1 << 64, 10 * n, np.uint64)), "<u8")
        apart.append(int(np.bitwise_count(x ^ z).sum()))
    assert most <= simhash.FAR - 8 and np.mean(np.array(apart) > simhash.FAR) > 0.99


def test_pivots_discard_pairs_of_unlike_sets():
    """Within one bucket of two clusters the links are those of the clusters, found by brute force."""
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 64, 60, np.uint64)) for _ in range(2)]
    sets = [np.unique(np.append(b[k % 8 :], rng.integers(0, 1 << 64, 2, np.uint64))) for b in base for k in range(40)]
    cols = {"node": np.arange(80), "root": np.arange(80), "fp": pa.array([simhash.set_fingerprint(h) for h in sets], pa.binary()), "shingles": pa.array([h.tobytes() for h in sets], pa.binary())}
    a, b = simhash.set_pairs(0.8)(np.ones(80, int), cols)
    same = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert all(same(sets[i], sets[j]) >= 0.8 for i, j in zip(a.tolist(), b.tolist()))
    label = list(range(80))
    for i, j in zip(a.tolist(), b.tolist()):
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if x == old else x for x in label]
    assert label == [0] * 40 + [40] * 40


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
            out = spark.createDataFrame(out.collect(), out.schema)
            now = {r[0] for r in out.select("doc_id").collect()}
            assert now <= ids and len(now) == out.count() and len(now) > 0.5 * len(ids)
            ids = now
        else:
            assert {r[0] for r in out.select("doc_id").collect()} == ids
        docs = out


def test_stages_on_edge_cases(spark):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, text, "en", "s", len(text), 1), (3, text, "en", "s", len(text), 1), (None, text + " more", None, "s", 5, 1)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for _, stage in corpus_pipeline.STAGES:
            one = stage(spark, docs, sf)
            assert one.count() <= max(len(part) * 3, 0)
