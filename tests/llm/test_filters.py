"""Quality rules, quality classifier and toxicity: against brute force, on held-out rows, and on edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import quality_classifier, quality_rules, toxicity
from starloom.llm.linear import fit
from starloom.llm.textblock import Block

DIR = "/root/testdata/sf0.01"
EDGE = ["", " ", "\n\n", "a", " a b", "a\nb\na\n", "x y z 1 2 3 4 5 6 x y z 1 2 3 4 5 6", "ééé b c", "l\n\nl", "\x1cw\x1f w", "a b c d e f g h " * 3, "w " * 5000, "　x y", "|#|$ %&<>*"]


def brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_statistics_equal_brute_force(spark):
    texts = EDGE + [r[0] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").limit(150).collect()] + ["", "z"]
    got = quality_rules.statistics(Block.of(pa.array(texts)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[k][i]) for k in names) for i in range(len(texts))] == [brute(t) for t in texts]
    for i, t in enumerate(texts):
        n, *_, rep = brute(t)
        assert got["base_failed"][i] == (n < 20 or 100 * rep > 30 * n)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept int, fp long, n_pii string")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k, t, "en", "s", len(t), 0.5, 1, 2, "x") for k, t in enumerate(EDGE)]
    return table(spark, [*rows, (100, None, None, None, None, None, None, None, None), (None, "no id", "en", "s", 1, 0.0, 0, 0, ""), rows[3], rows[3]])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(14)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_edge_cases(spark, edge, labels):
    n = edge.count()
    rules = quality_rules.score(edge, quality_rules.train(edge, labels)).collect()
    assert len(rules) == n and all(r["base_failed"] and not r["kept"] for r in rules if r["doc_id"] in (0, 100))
    views = quality_classifier.score(edge, quality_classifier.train(edge, labels, rounds=1)).collect()
    assert len(views) == n and all(0 <= r["score"] <= 1 for r in views)
    tox = toxicity.score(edge, toxicity.build(edge, labels)).collect()
    assert len(tox) == n and all(0 <= r["score"] <= 1 for r in tox)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in tox if r["doc_id"] is not None)
    same = [r["score"] for r in views if r["doc_id"] == 3]
    assert len(same) == 3 and len(set(same)) == 1


def test_empty_tables(spark, edge, labels):
    none, nothing = edge.limit(0), labels.limit(0)
    for docs, lab in ((none, labels), (edge, nothing)):
        assert quality_rules.score(docs, quality_rules.train(docs, lab)).count() == docs.count()
        assert quality_classifier.score(docs, quality_classifier.train(docs, lab)).count() == docs.count()
        assert toxicity.score(docs, toxicity.build(docs, lab)).count() == docs.count()


def test_views_exchange_labels_and_gain(spark):
    """Pseudo-labels go both ways, and what is learnt from them does no worse on rows that no label was taken from."""
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").where("doc_id < 6000") for t in ("documents", "labels"))
    few = lab.where("quality is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 0")
    rest = {r["doc_id"]: r["quality"] for r in lab.where("quality is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 0").collect()}
    right = {}
    for rounds in (0, 2):
        views = quality_classifier.train(docs, few, rounds=rounds)
        got = [r for r in quality_classifier.score(docs, views).collect() if r["doc_id"] in rest]
        right[rounds] = np.mean([r["kept"] == (rest[r["doc_id"]] == 1) for r in got])
        share = np.mean([rest[r["doc_id"]] for r in got])
    print("co-training: right", right, "always keep", share, "handed", views.handed)
    assert sum(n for _, p, _, n in views.handed if p == "p_text") > 100 and sum(n for _, p, _, n in views.handed if p == "p_meta") > 0
    assert right[2] >= right[0] - 0.005 and right[2] > share + 0.03


def test_features_where_they_lie_equal_those_of_the_rows(spark):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([*EDGE, "long " * 50_000])] + [(2, "other", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in quality_classifier.features(docs, [0, 4, 6, 14], True):
        parts = quality_classifier.sparse([rows[r["doc_id"]][1]], quality_classifier.BITS)
        assert np.array_equal(np.frombuffer(r["used"], "<i4"), np.concatenate([p.used for p in parts]))
        assert np.allclose(np.frombuffer(r["vals"], "<f4"), np.concatenate([p.vals for p in parts]))
    assert [r["doc_id"] for r in quality_classifier.features(docs, [2, 3], False)] == [2, 3]


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("doc_id % 4 = 1").collect()
    model = fit([r["text"] for r in rows[:500]], [r["quality"] for r in rows[:500]])
    p = model.probabilities(Block.of(pa.array([r["text"] for r in rows[500:]])))
    y = np.array([r["quality"] for r in rows[500:]])
    assert (p >= 0.5)[y == 1].mean() > 0.97
    assert abs(p.mean() - y.mean()) < 0.06  # calibrated


def cosines(texts, queries, total, df):
    """Brute force over the whole vocabulary of the texts, from plain words."""
    stem = lambda t: Counter(w[:4] for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", t.lower()))
    bags = [stem(t) for t in texts]
    place = {w: k for k, w in enumerate(sorted(set().union(*bags)))}
    idf = np.array([np.log((total + 1) / (df[w] + 1)) for w in place])

    def matrix(rows):
        x = np.zeros((len(rows), len(place)))
        for k, bag in enumerate(rows):
            for w, n in bag.items():
                if w in place:
                    x[k, place[w]] = n * idf[place[w]]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    return matrix([stem(q) for q in queries]) @ matrix(bags).T


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))


def test_nearest_equals_brute_force(spark, tables):
    docs, lab = (t.where("doc_id < 4000") for t in tables)
    rows = {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}
    index = toxicity.build(docs, lab)
    learnt = {r[0] for r in lab.where(toxicity.LEARN).where("toxic is not null").collect()} & set(rows)
    assert set(index.ids.tolist()) == learnt  # every labelled row is indexed
    df = Counter(w for t in rows.values() for w in {w[:4] for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", t.lower())})
    asked = sorted(rows)[:200]
    cos = cosines([rows[k] for k in index.ids.tolist()], [rows[k] for k in asked], len(rows), df)
    got = {r["doc_id"]: r for r in toxicity.score(docs, index).where("doc_id < 4000").collect()}
    at = {d: k for k, d in enumerate(index.ids.tolist())}
    for k, d in enumerate(asked):
        best = np.sort(cos[k])[::-1][: toxicity.NEIGHBOURS]
        near = got[d]["nearest"]
        assert np.allclose(cos[k][[at[x] for x in near]], best[best > 1e-12][: len(near)]) and len(near) == (best > 1e-12).sum()
        assert not near or abs(got[d]["nearest_cosine"] - best[0]) < 1e-9


@pytest.mark.parametrize("frequent", [16, 2, 1])
def test_bounds_skip_blocks_without_loss(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    rng = np.random.default_rng(2)
    n, v = 1000, 60
    x = np.where(rng.random((n, v)) < 0.1, rng.random((n, v)), 0.0) + 3 * np.eye(v)[rng.integers(0, v, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    doc, term = np.nonzero(x)
    index = toxicity.Index.of(pa.array([str(k) for k in range(v)]), np.ones(v), doc, term, x[doc, term], np.zeros(n), np.arange(n), 0.5)
    for q in x[:50]:
        used = np.flatnonzero(q)
        [(place, value)] = index.search([(used, q[used])])
        assert np.allclose(value, np.sort(x @ q)[::-1][: toxicity.NEIGHBOURS])
        assert np.allclose((x @ q)[index.ids[place]], value)


def test_held_out_toxicity(spark, tables):
    """Found on rows that nothing was learnt from; calibrated there; nearly every document has neighbours."""
    docs, lab = tables
    scored = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1")
    rows = scored.join(lab, "doc_id").where("held_out and toxic is not null").collect()
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    hit = np.array([r["predicted"] for r in rows])
    print("held out: hit", hit[y == 1].mean(), "clean", hit[y == 0].mean(), "mean score", p.mean(), y.mean(), "brier", ((p - y) ** 2).mean())
    assert hit[y == 1].mean() > 0.85 and hit[y == 0].mean() < 0.03
    assert abs(p.mean() - y.mean()) < 0.03
    for low, high in ((0.0, 0.1), (0.5, 1.01)):
        some = (p >= low) & (p < high)
        assert abs(p[some].mean() - y[some].mean()) < 0.15
    assert scored.where("size(nearest) = 0").count() < 0.05 * docs.count()


def test_small_samples_and_labels_of_one_kind(spark):
    rows = [(k, f"word{k} fine text " + ("nasty nasty" if k % 4 == 0 else "good"), int(k % 4 == 0)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.build(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    for where in ("toxic = 0", "toxic = 1", "true"):
        part = df.where(where).coalesce(1)
        got = toxicity.score(part, index).join(df, "doc_id").collect()
        assert len(got) == part.count() and all(r["predicted"] == r["toxic"] for r in got)
    one = df.where("toxic = 0")
    got = toxicity.score(df, toxicity.build(df, one.select("doc_id", "toxic"))).collect()
    assert len(got) == 200 and len({r["score"] for r in got}) == 1 and got[0]["score"] < 0.5


def test_filtering_keeps_the_columns(spark, edge, labels):
    assert quality_rules.kept(edge, labels).columns == edge.columns
    assert quality_classifier.kept(edge, labels).columns == edge.columns


def test_parts_of_a_sample_are_small():
    """The driver holds all of a sample's shares: 7 bytes each, and the distinct features of a part."""
    import numpy as np

    from starloom.llm import linear

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "sigma"], 60).tolist()) for _ in range(150)]
    parts = linear.sparse(texts, 16)
    assert all(p.rows.nbytes + p.inner.nbytes + p.vals.nbytes <= 7 * len(p.vals) for p in parts)
    w = rng.standard_normal(linear.KINDS << 16).astype(np.float32)
    one = np.concatenate([linear.margins([p.shifted(3) for p in linear.sparse([t], 16)], w, 0.5, 4)[3:] for t in texts])
    assert np.allclose(linear.margins(parts, w, 0.5, len(texts)), one, atol=1e-3)
    shifted = linear.margins([p.shifted(5) for p in parts], w, 0.5, len(texts) + 5)
    assert (shifted[:5] == 0.5).all() and np.array_equal(shifted[5:], linear.margins(parts, w, 0.5, len(texts)))
