"""Low-rank background subtraction: one distributed Gram matrix, small dense algebra, one pass over the pixel series.

X has a row for each pixel and a column for each frame, and is dealt out by pixel. What leaves a task is at most a Gram matrix of the
frames or, where these are fewer, of the pixels: both have the same modes. So the lesser of the two numbers should be some thousands
at most (MAX_FRAMES is checked); the other may be any.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Largest side of a Gram matrix that the driver takes: 4000 x 4000 doubles are 128 MB.
MAX_FRAMES = 4000
#: Values of a block of frames, or of a batch of series that is cut into such blocks: 8 MB.
BLOCK = 1_000_000
#: Eigenvalues below this share of the largest are no modes: a Gram matrix squares the condition number.
NULL_MODE = 1e-12


def stack(column: pd.Series) -> np.ndarray:
    """Series as rows of doubles, missing values as 0."""
    return np.nan_to_num(np.stack([np.array(v, dtype=float) for v in column])) if len(column) else np.zeros((0, 0))


def gram_rows(se: DataFrame, left: str = "ts", right: str | None = None) -> DataFrame:
    """(i, g): rows of the sum of outer products of two array columns (the same by default).

    A task sends one partial matrix, row by row; rows of a number meet in one task, which adds them up.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for df in batches:
            if len(df):
                one = stack(df["l"]).T @ stack(df["r"])
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "g": [row.tobytes() for row in total]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for df in batches:
            for i, g in zip(df["i"], df["g"], strict=True):
                one = np.frombuffer(g)
                sums[i] = sums[i] + one if i in sums else one
        if sums:
            yield pd.DataFrame({"i": list(sums), "g": list(sums.values())})

    rows = se.select(F.col(left).alias("l"), F.col(right or left).alias("r")).mapInPandas(part, "i int, g binary")
    return rows.repartition("i").mapInPandas(added, "i int, g array<double>")


def gram_table(se: DataFrame, left: str = "ts", right: str | None = None) -> DataFrame:
    """(i, j, g) of gram_rows()."""
    return gram_rows(se, left, right).select("i", F.posexplode("g").alias("j", "g"))


def gram(se: DataFrame, left: str = "ts", right: str | None = None, side: int | None = None) -> np.ndarray:
    """gram_rows() as a matrix on the driver, of a checked size; `side` is that of both columns if it is known."""
    right = right or left
    n = (side, side) if side is not None else se.agg(F.max(F.size(left)), F.max(F.size(right))).first()
    if (n[0] or 0) > MAX_FRAMES or (n[1] or 0) > MAX_FRAMES:
        raise ValueError(f"more than {MAX_FRAMES} frames and as many pixels: combine or chunk them first")
    out = np.zeros((n[0] or 0, n[1] or 0))
    got = gram_rows(se, left, right).toArrow()
    for i, g in zip(got["i"].to_pylist(), got["g"], strict=True):
        out[i] = g.values.to_numpy()
    return out


def mapped(se: DataFrame, work, column: str = "ts") -> DataFrame:
    """se with the array column replaced by the rows of work(matrix of a batch)."""
    fields = se.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                df[column] = list(work(stack(df[column])))
            yield df

    return se.mapInPandas(run, fields)


def mapped_both(se: DataFrame, work, columns: tuple[str, str]) -> DataFrame:
    """se with two array columns replaced by the rows of the two matrices that work gives for theirs."""
    fields = se.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                for c, m in zip(columns, work(*(stack(df[c]) for c in columns)), strict=True):
                    df[c] = list(m)
            yield df

    return se.mapInPandas(run, fields)


def centred(se: DataFrame, *more: str) -> DataFrame:
    """Each pixel's series, and those of the columns `more`, less its mean over all frames; missing values stay."""
    there = F.filter("ts", lambda v: v.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(there), F.lit(0))
    # The mean is bound as an element, once a series: a column of it would be put in, and summed again, for every value.
    less = lambda c: F.element_at(F.transform(F.array(mean), lambda m: F.transform(c, lambda v: v - m)), 1)
    return se.withColumns({c: less(c) for c in ("ts", *more)})


def top(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, descending, and their vectors; null modes are left out."""
    w, v = np.linalg.eigh((g + g.T) / 2)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    good = w > NULL_MODE * max(w.max(initial=0.0), 1e-300)
    return w[good], v[:, good]


class Excluded(Sequence):
    """Masks of the frames that each frame leaves out, made when they are asked for: order[lo[i]:hi[i]] for frame i."""

    def __init__(self, order: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.order, self.lo, self.hi = order, lo, hi

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[j] for j in range(*i.indices(len(self)))]
        mask = np.zeros(len(self), bool)
        mask[self.order[self.lo[i] : self.hi[i]]] = True
        return mask


def excluded(values: np.ndarray, delta: float) -> Excluded:
    """For each frame those whose value is within delta of its own, itself included."""
    values = np.asarray(values)
    order = np.argsort(values, kind="stable")
    line = values[order]
    lo, hi = np.searchsorted(line, values - delta, "left"), np.searchsorted(line, values + delta, "right")
    # The bounds are rounded: what counts is the difference.
    n = len(values)
    at = lambda k: line[np.clip(k, 0, n - 1)]
    while (more := (lo > 0) & (values - at(lo - 1) <= delta)).any():
        lo = lo - more
    while (less := (lo < n) & (values - at(lo) > delta)).any():
        lo = lo + less
    while (more := (hi < n) & (at(hi) - values <= delta)).any():
        hi = hi + more
    while (less := (hi > 0) & (at(hi - 1) - values > delta)).any():
        hi = hi - less
    return Excluded(order, lo, np.where(np.isnan(values), lo, hi))


def places(out: Sequence[np.ndarray]) -> tuple[Excluded, np.ndarray | None]:
    """Masks as ranges of an order of the frames, and the masks themselves where a frame's are not contiguous."""
    if isinstance(out, Excluded):
        return out, None
    n = len(out)
    ends = [(int(a[0]), int(a[-1]) + 1, len(a)) if len(a := np.flatnonzero(m)) else (0, 0, 0) for m in out]
    lo, hi, size = (np.array(c, int) for c in zip(*ends, strict=True))
    return Excluded(np.arange(n), lo, hi), None if (hi - lo == size).all() else np.array(out)


def keyed(se: DataFrame, column: str = "ts") -> tuple[DataFrame, int, int] | None:
    """se with its rows numbered from 0 (`pid`), their number and that of the frames, if pixels are fewer than frames and no more
    than a Gram matrix may have; else None."""
    keys = [c for c, t in se.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    rows = se.select(*keys, F.size(column).alias("_n")).limit(MAX_FRAMES + 1).collect()
    n = max((r["_n"] for r in rows), default=0)
    if len(rows) > MAX_FRAMES or len(rows) >= n:
        return None
    of = [tuple(r)[:-1] for r in rows]
    if len(set(of)) < len(of):
        raise ValueError("two series of the same pixel")
    names = [f"_k{i}" for i in range(len(keys))]
    table = se.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(sorted(of, key=repr))], se.select(*keys).toDF(*names).schema.add("pid", IntegerType()))
    same = F.lit(True)
    for k, name in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(name))
    return se.join(F.broadcast(table), same).drop(*names), len(rows), n  # at most MAX_FRAMES rows


def transposed(se: DataFrame, p: int, *columns: str) -> DataFrame:
    """(i, columns): the p values of each frame, in order of the pixels' numbers, of series with a `pid`; missing values as 0.

    Series are cut into blocks of frames, and the cuts of a block meet in one row."""
    size = max(1, min(1024, BLOCK // (max(p, 1) * len(columns))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                parts = [stack(df[c]) for c in columns]
                for b, at in enumerate(range(0, parts[0].shape[1], size)):
                    yield pd.DataFrame({"b": b, "pid": df["pid"], **{c: [r.tobytes() for r in np.ascontiguousarray(m[:, at : at + size])] for c, m in zip(columns, parts, strict=True)}})

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for b, rows in zip(df["b"], df["rows"], strict=True):
                rows = sorted(rows, key=lambda r: r["pid"])
                parts = {c: np.stack([np.frombuffer(r[c]) for r in rows]).T for c in columns}
                yield pd.DataFrame({"i": b * size + np.arange(len(parts[columns[0]])), **{c: list(np.ascontiguousarray(m)) for c, m in parts.items()}})

    cuts = se.select("pid", *columns).mapInPandas(cut, "b int, pid int, " + ", ".join(f"{c} binary" for c in columns))
    blocks = cuts.groupBy("b").agg(F.collect_list(F.struct("pid", *columns)).alias("rows"))
    return blocks.mapInPandas(turn, "i long, " + ", ".join(f"{c} array<double>" for c in columns))


def projected(se: DataFrame, u: np.ndarray, column: str = "ts") -> np.ndarray:
    """u' X of series with a `pid`, u having a row for each pixel: on the driver, a row for each column of u."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                yield pd.DataFrame({"u": list(u[df["pid"].to_numpy()]), "v": df[column]})

    got = gram_rows(se.select("pid", column).mapInPandas(part, "u array<double>, v array<double>"), "u", "v").toArrow()
    out = [None] * u.shape[1]
    for i, g in zip(got["i"].to_pylist(), got["g"], strict=True):
        out[i] = g.values.to_numpy()
    return np.array(out, float).reshape(u.shape[1], -1)


def main_modes(se: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """top() of the frames' Gram matrix. With fewer pixels than frames by that of the pixels: X' u / s are its vectors."""
    if (found := keyed(se)) is None:
        return top(gram(se), k)
    by_pixel, p, _ = found
    val, u = top(gram(transposed(by_pixel, p, "ts"), side=p), k)
    return val, projected(by_pixel, u / np.sqrt(val)).T


def by_frame(spark, n: int, shared, column) -> np.ndarray:
    """The n x n matrix of column(i, *shared), each worked out on the cluster; what is shared is broadcast (of a checked size)."""
    sent = spark.sparkContext.broadcast(shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"i": df["id"], "w": [column(i, *sent.value).tobytes() for i in df["id"]]})

    frames = spark.range(n, numPartitions=max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))
    got = frames.mapInPandas(run, "i long, w binary").toArrow()
    w = np.zeros((n, n))
    for i, row in zip(got["i"].to_pylist(), got["w"].to_pylist(), strict=True):
        w[:, i] = np.frombuffer(row)
    sent.destroy()
    return w


def exclusion_weights(spark, g: np.ndarray, k: int, out: list[np.ndarray]) -> np.ndarray:
    """W of the residual X (I - W): frame i is projected on the k main modes of the frames that it doesn't exclude, a decomposition
    for each frame, dealt out over the cluster."""

    def column(i, m, masks):
        keep = np.flatnonzero(~masks[i])
        val, vec = top(m[np.ix_(keep, keep)], k)
        w = np.zeros(len(m))
        w[keep] = vec @ ((vec.T @ m[keep, i]) / val)
        return w

    return by_frame(spark, len(g), (g, np.array(out)), column)


def downdate_weights(spark, g: np.ndarray, k: int, out: list[np.ndarray], rank: int) -> np.ndarray:
    """The same from one truncated basis of all frames, with excluded frames' rows taken out of it: exact for full rank."""
    val, v = top(g, rank)

    def column(i, m, masks, val, v):
        s = np.sqrt(val)
        # v'v is the identity, so only the excluded rows' products are needed.
        gone = v[masks[i]] * s
        _, u = np.linalg.eigh(np.diag(val) - gone.T @ gone)
        basis = u[:, ::-1][:, :k]
        return v @ ((basis @ (basis.T @ ((v.T @ m[:, i]) / s))) / s)

    return by_frame(spark, len(g), (g, np.array(out), val, v), column)


def excluding(found: tuple[DataFrame, int, int], k: int, out: Sequence[np.ndarray], columns: tuple[str, ...] = ("ts",), rank: int | None = None) -> DataFrame:
    """Residuals of the columns, with fewer pixels than frames: each frame less its part in the k main modes (of `ts`) of the frames
    that it doesn't exclude, whose Gram matrix of pixels is that of all less that of the excluded. With `rank` on as many modes of all.

    Frames are dealt out in blocks along an order in which excluded frames are near, each with those that its frames exclude.
    """
    se, p, n = found
    frames = transposed(se, p, *columns)
    whole = gram(frames, side=p)
    if rank is None:
        basis = np.eye(p)
    else:
        val, basis = top(whole, rank)
        whole = np.diag(val)
    ranges, masks = places(out)
    order, lo, hi = ranges.order, ranges.lo[ranges.order], ranges.hi[ranges.order]  # by place in the order
    size = max(64, min(1024, BLOCK // p), int(np.mean(hi - lo, dtype=float)) if n else 0)
    starts = np.arange(0, n, size)
    some = hi > lo
    low = np.array([min(a, lo[a : a + size][some[a : a + size]].min(initial=a)) for a in starts], int)
    high = np.array([max(min(a + size, n), hi[a : a + size].max(initial=0)) for a in starts], int)
    place = np.empty(n, int)
    place[order] = np.arange(n)
    sent = se.sparkSession.sparkContext.broadcast((order, lo, hi, place, low, high, masks, whole, basis))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, _, place, low, high, *_ = sent.value
        for df in batches:
            at = place[df["i"].to_numpy()]
            for b in np.flatnonzero((low <= at.max(initial=-1)) & (high > at.min(initial=n))):
                here = (at >= low[b]) & (at < high[b])
                if here.any():
                    part = df[here]
                    yield pd.DataFrame({"b": b, "at": at[here], **{c: [np.asarray(v).tobytes() for v in part[c]] for c in columns}})

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, lo, hi, _, low, _, masks, whole, basis = sent.value
        for df in batches:
            for b, rows in zip(df["b"], df["rows"], strict=True):
                rows = sorted(rows, key=lambda r: r["at"])
                parts = {c: np.stack([np.frombuffer(r[c]) for r in rows], 1) for c in columns}
                inner = basis.T @ parts["ts"]
                first, end = low[b], min((b + 1) * size, n)
                gone, was = np.zeros_like(whole), (first, first)
                out = {c: np.empty((p, end - b * size)) for c in columns}
                square = lambda at: inner[:, at - first] @ inner[:, at - first].T  # noqa: E731, B023
                for t in range(b * size, end):
                    now = (lo[t], hi[t])
                    if masks is None and now == was and t > b * size:
                        pass  # the modes of the frame before
                    elif masks is not None:
                        gone = square(np.arange(*now)[masks[order[t]][order[now[0] : now[1]]]])
                    elif abs(now[0] - was[0]) + abs(now[1] - was[1]) >= now[1] - now[0]:
                        gone = square(np.arange(*now))
                    else:
                        gone = gone + square(np.arange(was[1], now[1])) - square(np.arange(now[1], was[1])) - square(np.arange(was[0], now[0])) + square(np.arange(now[0], was[0]))
                    if masks is not None or now != was or t == b * size:
                        _, u = top(whole - gone, k)
                    was = now
                    for c in columns:
                        one = parts[c][:, t - first]
                        out[c][:, t - b * size] = one - basis @ (u @ (u.T @ (basis.T @ one)))
                yield pd.DataFrame({"pid": np.arange(p), "b": b, **{c: [r.tobytes() for r in m] for c, m in out.items()}})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = sent.value[0]
        for df in batches:
            series = {c: [] for c in columns}
            for rows in df["rows"]:
                rows = sorted(rows, key=lambda r: r["b"])
                for c in columns:
                    one = np.empty(n)
                    one[order] = np.concatenate([np.frombuffer(r[c]) for r in rows])
                    series[c].append(one)
            yield pd.DataFrame({"pid": df["pid"], **series})

    binary, arrays = (", ".join(f"{c} {t}" for c in columns) for t in ("binary", "array<double>"))
    blocks = frames.mapInPandas(deal, f"b int, at int, {binary}").groupBy("b").agg(F.collect_list(F.struct("at", *columns)).alias("rows"))
    rows = blocks.mapInPandas(left, f"pid int, b int, {binary}").groupBy("pid").agg(F.collect_list(F.struct("b", *columns)).alias("rows"))
    done = rows.mapInPandas(joined, f"pid int, {arrays}")
    rest = se.drop(*columns)
    plain = not any(t.startswith(("array", "map", "struct", "binary")) for _, t in rest.dtypes)
    # Without series in it, rest is a few columns of at most MAX_FRAMES pixels.
    both = done.join(F.broadcast(rest), "pid") if plain else done.hint("shuffle_merge").join(rest, "pid")
    return both.select(*(c for c in se.columns if c != "pid"))


def klip(se: DataFrame, k: int, exclusions: Sequence[np.ndarray] | None = None, rank: int | None = None) -> DataFrame:
    """Residuals of frame-wise projection; se is centred first. With `rank`, by downdating."""
    x = centred(se)
    if not exclusions:
        return klip_subspace(x, k)
    if found := keyed(x):
        return excluding(found, k, exclusions, rank=rank)
    g = gram(x)
    w = downdate_weights(se.sparkSession, g, k, exclusions, rank) if rank is not None else exclusion_weights(se.sparkSession, g, k, exclusions)
    return mapped(x, lambda m: m - m @ w)


def klip_probed(se: DataFrame, model: str, k: int, exclusions: Sequence[np.ndarray] | None = None) -> DataFrame:
    """klip() of the images and of a probe beside them: the column `model`, less the images' mean, loses what it has of the
    images' own modes."""
    x = centred(se, model)
    if found := keyed(x):
        return excluding(found, k, exclusions or Excluded(np.arange(found[2]), *np.zeros((2, found[2]), int)), ("ts", model))
    g, cross = gram(x), gram(x, "ts", model)
    if exclusions:
        masks = np.array(exclusions)

        def column(i, m, right, out):
            keep = np.flatnonzero(~out[i])
            val, vec = top(m[np.ix_(keep, keep)], k)
            w = np.zeros(len(m))
            w[keep] = vec @ ((vec.T @ right[keep, i]) / val)
            return w

        w = exclusion_weights(se.sparkSession, g, k, exclusions)
        probe = by_frame(se.sparkSession, len(g), (g, cross, masks), column)
    else:
        val, vec = top(g, k)
        w, probe = vec @ ((vec.T @ g) / val[:, None]), vec @ ((vec.T @ cross) / val[:, None])
    return mapped_both(x, lambda m, p: (m - m @ w, p - m @ probe), ("ts", model))


def klip_transpose(se: DataFrame, k: int, reference=None, model: str | None = None) -> DataFrame:
    """Residuals of pixel-wise projection on the k main time series of the reference pixels (all by default), each scaled to
    unit spread; frame medians are to be taken off before. The series of the column `model`, if it is named, lose theirs too."""
    ref = se if reference is None else se.where(reference)
    spread = lambda m: m / np.maximum(m.std(axis=1, keepdims=True), 1e-300)
    _, v = main_modes(mapped(ref, spread), k)
    left = lambda m: m - (m @ v) @ v.T
    return mapped_both(se, lambda m, p: (left(m), left(p)), ("ts", model)) if model else mapped(se, left)


def klip_subspace(se: DataFrame, k: int) -> DataFrame:
    """Residuals of the best rank-k approximation of all frames."""
    _, v = main_modes(se, k)
    return mapped(se, lambda m: m - (m @ v) @ v.T)


def dmd(se: DataFrame, k: int, first: np.ndarray | None = None, second: np.ndarray | None = None, fitted: np.ndarray | None = None) -> DataFrame:
    """Residuals of a linear dynamical model of rank k: modes of the map from frames `first` to frames `second` (by default from
    each to the next), fitted to the frames `fitted` (all), which are the places of the result."""
    if found := keyed(se):
        return dmd_by_pixel(found, k, first, second, fitted)
    g = gram(se)
    n = len(g)
    first, second = (np.arange(n - 1), np.arange(1, n)) if first is None else (first, second)
    fitted = np.arange(n) if fitted is None else fitted
    val, v = top(g[np.ix_(first, first)], k)
    s = np.sqrt(val)
    step = np.diag(1 / s) @ v.T @ g[np.ix_(first, second)] @ v @ np.diag(1 / s)
    _, vec = np.linalg.eig(step)
    b = v @ np.diag(1 / s) @ vec  # modes are X[:, second] b
    inner = b.conj().T @ g[np.ix_(second, second)] @ b
    fit = b @ np.linalg.pinv(inner) @ b.conj().T @ g[np.ix_(second, fitted)]
    return mapped(se, lambda m: m[:, fitted] - (m[:, second] @ fit).real)


def dmd_by_pixel(found: tuple[DataFrame, int, int], k: int, first: np.ndarray | None, second: np.ndarray | None, fitted: np.ndarray | None) -> DataFrame:
    """dmd() with fewer pixels than frames: the same modes from products over the frames."""
    se, p, n = found
    first, second = (np.arange(n - 1), np.arange(1, n)) if first is None else (first, second)
    fitted = np.arange(n) if fitted is None else fitted

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                m = stack(df["ts"])
                yield pd.DataFrame({"pid": df["pid"], "l": list(m[:, first]), "r": list(m[:, second])})

    pairs = transposed(se.select("pid", "ts").mapInPandas(pick, "pid int, l array<double>, r array<double>"), p, "l", "r")
    val, u = top(gram(pairs, "l", side=p), k)
    across = gram(pairs, "r", "l", p) @ (u / val)
    _, vec = np.linalg.eig(u.T @ across)
    image = across @ vec  # the modes, a column each
    parts = projected(se, np.hstack([image.real, image.imag]))[:, fitted]
    fit = np.linalg.pinv(image.conj().T @ image) @ (parts[: len(val)] - 1j * parts[len(val) :])
    fields = se.drop("pid").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                df["ts"] = list(stack(df["ts"])[:, fitted] - (image[df["pid"].to_numpy()] @ fit).real)
            yield df.drop(columns="pid")

    return se.mapInPandas(run, fields)


def pair_halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of frames 2j, 2j + 1 with an even j, and of those with an odd j; a last single frame is in neither."""
    start = 2 * np.arange(n // 2)
    both = lambda at: np.stack([at, at + 1], 1).ravel()
    return both(start[::2]), both(start[1::2])


def dmd_halves(se: DataFrame, k: int, both: bool = False) -> list[tuple[np.ndarray, DataFrame]]:
    """(places, residuals) of the odd pairs of frames by modes of the even pairs; with `both`, also the other way round."""
    n = se.agg(F.max(F.size("ts"))).first()[0] or 0
    train, test = pair_halves(n)
    ways = [(train, test), (test, train)] if both else [(train, test)]
    return [(out, dmd(se, k, basis[::2], basis[1::2], out)) for basis, out in ways]


@dataclass
class TrapResult:
    coefficient: float
    background: float
    residual: float
    backgrounds: tuple[float, ...]
    basis: np.ndarray


def trap(se: DataFrame, model: str, k: int, damp: float = 1e-8, reference=None, split=None, basis: np.ndarray | None = None) -> TrapResult:
    """Joint fit of each pixel's k temporal modes, constant background series and the planet model (array column).

    One background for all pixels, or with the condition `split` one for those that satisfy it and one for the others. The modes
    are those of the reference pixels, or a basis (frames x k) of an earlier fit. The pixel blocks are eliminated: y, backgrounds
    and model less their projections on the modes, then one aggregation to a system of two or three unknowns.
    """
    if basis is None:
        _, basis = main_modes(se if reference is None else se.where(reference), k)
    v, share, n = basis, 1 / (1 + damp * damp), 3 if split is None else 4

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for df in batches:
            if len(df):
                y, m, in_first = stack(df["ts"]), stack(df["m"]), df["s"].to_numpy(bool)[:, None]
                raw = [m, *_backgrounds(in_first, y, n), y]
                off = [a - share * (a @ v) @ v.T for a in raw]
                total += np.array([[(a * b).sum() for b in off] for a in raw])
        yield pd.DataFrame({"i": range(n * n), "g": total.ravel()})

    rows = se.select("ts", F.col(model).alias("m"), (F.lit(True) if split is None else F.coalesce(split, F.lit(False))).alias("s"))
    got = rows.mapInPandas(part, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # n * n rows
    t = np.zeros(n * n)
    for r in got:
        t[r["i"]] = r["g"]
    t = t.reshape(n, n)
    x, *_ = np.linalg.lstsq(t[:-1, :-1] + damp * damp * np.eye(n - 1), t[:-1, -1], rcond=None)
    return TrapResult(float(x[0]), float(x[1]), float(t[-1, -1] - x @ t[:-1, -1]), tuple(map(float, x[1:])), v)


def _backgrounds(in_first: np.ndarray, like: np.ndarray, n: int) -> list[np.ndarray]:
    one = np.ones_like(like)
    return [one] if n == 3 else [one * in_first, one * ~in_first]


def trap_residuals(se: DataFrame, model: str, found: TrapResult, split=None, damp: float = 1e-8) -> DataFrame:
    """The series less the fitted backgrounds and modes, and less the model times its coefficient."""
    v, share = found.basis, 1 / (1 + damp * damp)
    first, other = found.backgrounds[0], found.backgrounds[-1]
    inside = F.lit(True) if split is None else F.coalesce(split, F.lit(False))
    off = F.zip_with("ts", model, lambda y, m: y - F.lit(found.coefficient) * m - F.when(inside, F.lit(first)).otherwise(F.lit(other)))
    return mapped(se.withColumn("ts", off), lambda m: m - share * (m @ v) @ v.T)


def sky_components(se: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """The k main images of the centred frames, as series of length k for each pixel, and their singular values."""
    x = centred(se)
    val, v = main_modes(x, k)
    return mapped(x, lambda m: m @ v / np.sqrt(val)), np.sqrt(val)


def masked_fit(px: DataFrame, components: DataFrame | None, k: int) -> DataFrame:
    """By frame the least-squares coefficients of k components on the pixels that are there: normal equations by aggregation.

    px (frame_idx, ext, y, x, v), components (y, x, c array of k), or None where px has c.
    """
    c = lambda i: F.col("c")[i]
    sums = [F.sum(c(i) * c(j)).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c(i) * F.col("v")).alias(f"b{i}") for i in range(k)]
    there = px.where("v is not null")
    sums = (there if components is None else there.join(components, ["y", "x"])).groupBy("frame_idx", "ext").agg(*sums)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for row in df.itertuples(index=False):
                d = row._asdict()
                a = np.array([[d[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                out.append(np.linalg.lstsq(a, np.array([d[f"b{i}"] for i in range(k)]), rcond=None)[0])
            if out:
                yield pd.DataFrame({"frame_idx": df["frame_idx"], "ext": df["ext"], "coefficients": out})

    return sums.mapInPandas(solve, "frame_idx long, ext int, coefficients array<double>")


def sky_subtracted(px: DataFrame, components: DataFrame, mean: DataFrame, k: int) -> DataFrame:
    """px less the mean sky (y, x, m) and the fitted components; what is left has zero mean in each frame."""
    from pyspark.sql import Window

    off = px.join(mean, ["y", "x"]).withColumn("v", F.col("v") - F.col("m")).drop("m")
    fit = off.join(masked_fit(off, components, k), ["frame_idx", "ext"]).join(components, ["y", "x"])
    model = F.aggregate(F.zip_with("c", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    left = fit.select("frame_idx", "ext", "y", "x", (F.col("v") - model).alias("v"))
    return left.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("frame_idx", "ext")))


def max_rank(px: DataFrame) -> DataFrame:
    """(rank): the most modes there can be, the lesser of the numbers of pixels and of frames."""
    return px.agg(F.least(F.countDistinct("ext", "y", "x"), F.countDistinct("frame_idx")).alias("rank"))


def modes(spec, rank: int) -> list[int]:
    """Mode counts below the rank: numbers as given, shares as max(int(share * rank), 1)."""
    out = [max(int(x * rank), 1) if isinstance(x, float) and x < 1 else int(x) for x in spec]
    return [k for k in out if k < rank or k == 1]


def train_test(n: int, share: float, seed: int) -> tuple[list[int], list[int]]:
    """Seeded places of a test set, drawn with replacement (so it can be smaller than asked for), and the others."""
    test = sorted(set(random.Random(seed).choices(range(n), k=int(n * share))))
    return [i for i in range(n) if i not in set(test)], test


def lsqr(a: np.ndarray, b: np.ndarray, damp: float = 0.0, x0: np.ndarray | None = None, rounds: int | None = None, tol: float = 1e-12) -> np.ndarray:
    """Damped least squares of a small system by conjugate gradients on the normal equations."""
    x = np.zeros(a.shape[1]) if x0 is None else np.array(x0, float)
    r = a.T @ (b - a @ x) - damp * damp * x
    p, rr = r.copy(), r @ r
    for _ in range(rounds or 4 * a.shape[1]):
        if rr <= tol * tol:
            break
        q = a.T @ (a @ p) + damp * damp * p
        step = rr / (p @ q)
        x, r = x + step * p, r - step * q
        p, rr = r + (r @ r) / rr * p, r @ r
    return x
