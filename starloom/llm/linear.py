"""Logistic regression over hashed n-gram shares: fitted on a bounded sample, scored on whole blocks of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from starloom.llm.textblock import Block, ngram_ids, owner, sums

#: Each kind of n-gram adds SCALE times the mean weight of its n-grams.
SCALE = 30.0
KINDS = 4


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    bits: int
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, block: Block) -> np.ndarray:
        total = np.full(block.n, self.bias)
        for ids, bounds in ngram_ids(block, self.bits):
            got = sums(self.weights[ids].astype(np.float64), bounds)
            total += SCALE * got / np.maximum(np.diff(bounds), 1)
        return total

    def probabilities(self, block: Block) -> np.ndarray:
        return sigmoid(self.slope * self.margins(block) + self.shift)


@dataclass
class Part:
    """Some rows' n-gram shares: row, counted from the first, place of the feature in `used`, value; numbers as short as they can be,
    as all parts of a sample are held at once."""

    first: int
    rows: np.ndarray
    inner: np.ndarray
    used: np.ndarray
    vals: np.ndarray

    @classmethod
    def of(cls, rows, features, vals) -> Part:
        used, inner = np.unique(features, return_inverse=True)
        first = int(rows.min()) if len(rows) else 0
        return cls(first, short(rows - first), short(inner), used.astype(np.int32), vals.astype(np.float32))

    def shifted(self, by: int) -> Part:
        return Part(self.first + by, self.rows, self.inner, self.used, self.vals)


def short(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the shortest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def sparse(texts: list[str], bits: int) -> list[Part]:
    """The texts' n-gram shares, each pair of text and feature once, in parts of 64 texts and one kind."""
    parts = []
    for at in range(0, len(texts), 64):
        kinds: dict[int, list] = {}
        for a, b in runs(texts, at, min(at + 64, len(texts))):
            for kind, (ids, bounds) in enumerate(ngram_ids(Block.of(pa.array(texts[a:b], pa.large_string())), bits)):
                pair, count = np.unique(owner(bounds).astype(np.int64) << 40 | ids, return_counts=True)
                doc = pair >> 40
                kinds.setdefault(kind, []).append((doc + a, pair & ((1 << 40) - 1), SCALE * count / np.maximum(np.diff(bounds), 1)[doc]))
        parts += [Part.of(*map(np.concatenate, zip(*kinds[kind], strict=True))) for kind in sorted(kinds)]
    return parts


def runs(texts: list[str], at: int, end: int, most: int = 1 << 16) -> list[tuple[int, int]]:
    """Texts from at to end in runs of a bounded number of characters, a longer text alone: their n-grams are held at once."""
    out, size = [], 0
    for k in range(at, end):
        if out and size + len(texts[k]) <= most:
            out[-1], size = (out[-1][0], k + 1), size + len(texts[k])
        else:
            out, size = [*out, (k, k + 1)], len(texts[k])
    return out


def margins(parts: list[Part], w: np.ndarray, b: float, n: int) -> np.ndarray:
    out = np.full(n, float(b))
    for p in parts:
        if len(p.rows):
            got = np.bincount(p.rows, p.vals * w[p.used][p.inner])
            out[p.first : p.first + len(got)] += got
    return out


def descend(parts: list[Part], y, weight, features: int, rounds: int, l2: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the weighted logistic loss, part by part: what is held besides the parts is small."""
    w, b = np.zeros(features, np.float32), 0.0
    m, v, mb, vb = np.zeros(features, np.float32), np.zeros(features, np.float32), 0.0, 0.0
    total = weight.sum() or 1.0
    for t in range(1, rounds + 1):
        err = (weight * (sigmoid(margins(parts, w, b, len(y))) - y) / total).astype(np.float32)
        g = np.float32(l2) * w
        for p in parts:
            g[p.used] += np.bincount(p.inner, p.vals * err[p.first :][p.rows], len(p.used)).astype(np.float32)
        gb = float(err.sum(dtype=float))
        m, v = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.99) * v + np.float32(0.01) * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 / (1 - 0.9**t)
        w -= np.float32(step) * m / (np.sqrt(v / np.float32(1 - 0.99**t)) + np.float32(1e-8))
        b -= step * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(b)


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of a sigmoid over margins, by Newton's method with Platt's smoothed targets; slope is kept positive."""
    n1, n0 = (y > 0.5).sum(), (y <= 0.5).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        r, s = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (r * margin).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * b
        haa, hab, hbb = (s * margin * margin).sum() + 1e-3, (s * margin).sum(), s.sum() + 1e-3
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return (float(a), float(b)) if a > 1e-3 else (1.0, 0.0)


def split(y: np.ndarray, n: int) -> np.ndarray:
    """Which of the first n rows are for calibration: every fourth, if both parts then have both classes."""
    held = (np.arange(len(y)) % 4 == 3) & (np.arange(len(y)) < n)
    if n < 40 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    return held


def fit_sparse(parts: list[Part], y, weight, held, bits: int, features: int, rounds: int = 100, l2: float = 1e-4) -> Linear:
    """From parts of rows; rows in `held` only calibrate. With one class alone the model is that class's constant."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(features, np.float32), 0.0 if not len(y) else 4.0 * (2 * y[0] - 1), bits)
    full, b = descend(parts, y, np.where(held, 0.0, weight), features, rounds, l2)
    model = Linear(full, b, bits)
    if held.any():
        margin = margins(parts, full, b, len(y))
        model.slope, model.shift = platt(margin[held], y[held])
    return model


def fit(texts: list[str], labels: list[int], bits: int = 16) -> Linear:
    """Fits on three quarters of the rows and calibrates on the rest, all given rows being a bounded sample; 0.5 without rows."""
    y = np.asarray(labels, float)
    return fit_sparse(sparse(texts, bits), y, np.ones(len(y)), split(y, len(y)), bits, KINDS << bits)
