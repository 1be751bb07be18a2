"""Background subtraction against direct dense algebra, and end to end on a synthetic cube with a planted companion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.model import frames, pixels, series, unseries
from starloom.operators import apertures, resample
from starloom.plans import linalg, pipeline

P, NF = 40, 14


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(2)
    return rng.standard_normal((P, 4)) @ rng.standard_normal((4, NF)) + 0.1 * rng.standard_normal((P, NF))


@pytest.fixture(scope="module")
def se(spark, x):
    return spark.createDataFrame([(0, k // 8, k % 8, r.tolist()) for k, r in enumerate(x)], "ext int, y int, x int, ts array<double>").repartition(3)


def matrix(se):
    return np.array([r["ts"] for r in sorted(se.collect(), key=lambda r: (r["y"], r["x"]))])


def test_gram(se, x):
    assert np.allclose(linalg.gram(se), x.T @ x)


def test_klip_equals_svd(se, x):
    c = x - x.mean(axis=1, keepdims=True)
    u, _, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(matrix(linalg.klip(se, 3)), c - u[:, :3] @ u[:, :3].T @ c)


def test_klip_with_exclusions_and_downdate(se, x):
    c = x - x.mean(axis=1, keepdims=True)
    out = linalg.excluded(np.arange(NF), 1)
    want = np.empty_like(c)
    for i in range(NF):
        u, _, _ = np.linalg.svd(c[:, ~out[i]], full_matrices=False)
        want[:, i] = c[:, i] - u[:, :3] @ (u[:, :3].T @ c[:, i])
    assert np.allclose(matrix(linalg.klip(se, 3, out)), want)
    assert np.allclose(matrix(linalg.klip(se, 3, out, rank=NF)), want, atol=1e-6)


def test_klip_transpose_and_subspace(se, x):
    _, _, vt = np.linalg.svd(x / x.std(axis=1, keepdims=True), full_matrices=False)
    assert np.allclose(matrix(linalg.klip_transpose(se, 4)), x - x @ vt[:4].T @ vt[:4])
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(matrix(linalg.klip_subspace(se, 4)), x - u[:, :4] * s[:4] @ vt[:4])


def test_dmd(se, x):
    u, s, vt = np.linalg.svd(x[:, :-1], full_matrices=False)
    u, s, vt = u[:, :3], s[:3], vt[:3]
    _, w = np.linalg.eig(u.T @ x[:, 1:] @ vt.T / s)
    phi = x[:, 1:] @ vt.T / s @ w
    assert np.allclose(matrix(linalg.dmd(se, 3)), (x - phi @ np.linalg.pinv(phi) @ x).real, atol=1e-6)


def test_dmd_of_pair_halves(se, x):
    a, b = x[:, 0:NF:4], x[:, 1:NF:4]
    u, s, vt = np.linalg.svd(a[:, : b.shape[1]], full_matrices=False)
    u, s, vt = u[:, :2], s[:2], vt[:2]
    _, w = np.linalg.eig(u.T @ b @ vt.T / s)
    phi = b @ vt.T / s @ w
    (places, left), (again, _) = linalg.dmd_halves(se, 2, both=True)
    assert places.tolist() == [2, 3, 6, 7, 10, 11] and again.tolist() == [0, 1, 4, 5, 8, 9, 12, 13]
    assert np.allclose(matrix(left), (x[:, places] - phi @ np.linalg.pinv(phi) @ x[:, places]).real, atol=1e-6)


def test_probes_beside_the_images(spark, x):
    p = np.random.default_rng(5).random((P, NF))
    df = spark.createDataFrame([(0, k // 8, k % 8, x[k].tolist(), p[k].tolist()) for k in range(P)], "ext int, y int, x int, ts array<double>, model array<double>").repartition(3)
    mean = x.mean(axis=1, keepdims=True)
    models = lambda t: np.array([r["model"] for r in sorted(t.collect(), key=lambda r: (r["y"], r["x"]))])
    u, _, _ = np.linalg.svd(x - mean, full_matrices=False)
    got = linalg.klip_probed(df, "model", 3)
    assert np.allclose(matrix(got), (x - mean) - u[:, :3] @ u[:, :3].T @ (x - mean)) and np.allclose(models(got), (p - mean) - u[:, :3] @ u[:, :3].T @ (p - mean))
    out, want = linalg.excluded(np.arange(NF), 1), np.empty_like(p)
    for i in range(NF):
        u, _, _ = np.linalg.svd((x - mean)[:, ~out[i]], full_matrices=False)
        want[:, i] = (p - mean)[:, i] - u[:, :3] @ (u[:, :3].T @ (p - mean)[:, i])
    assert np.allclose(models(linalg.klip_probed(df, "model", 3, out)), want)
    _, _, vt = np.linalg.svd(x / x.std(axis=1, keepdims=True), full_matrices=False)
    assert np.allclose(models(linalg.klip_transpose(df, 4, model="model")), p - p @ vt[:4].T @ vt[:4])


def test_trap_with_two_backgrounds(spark, x):
    rng = np.random.default_rng(9)
    model, upper = rng.random((P, NF)), np.arange(P) % 8 >= 4
    basis, _ = np.linalg.qr(rng.standard_normal((NF, 3)))
    y = rng.standard_normal((P, 3)) @ basis.T + 0.5 * model + np.where(upper, 2.0, -1.0)[:, None]
    df = spark.createDataFrame([(0, k // 8, k % 8, y[k].tolist(), model[k].tolist()) for k in range(P)], "ext int, y int, x int, ts array<double>, model array<double>")
    got = linalg.trap(df, "model", 3, basis=basis, split=F.col("x") >= 4)
    assert np.allclose([got.coefficient, *got.backgrounds], [0.5, 2.0, -1.0]) and got.residual < 1e-8
    assert np.abs(matrix(linalg.trap_residuals(df, "model", got, F.col("x") >= 4))).max() < 1e-6


def test_trap_finds_the_planted_signal(spark, x):
    rng = np.random.default_rng(8)
    model = np.where(rng.random((P, NF)) < 0.2, rng.random((P, NF)), 0)
    rows = [(0, k // 8, k % 8, (x + 0.5 * model)[k].tolist(), model[k].tolist(), not model[k].any()) for k in range(P)]
    df = spark.createDataFrame(rows, "ext int, y int, x int, ts array<double>, model array<double>, ref boolean")
    _, _, vt = np.linalg.svd(np.array([r[3] for r in rows]), full_matrices=False)
    proj = np.eye(NF) - vt[:4].T @ vt[:4]
    y, m, c = (x + 0.5 * model) @ proj, model @ proj, np.ones((P, NF)) @ proj
    want, *_ = np.linalg.lstsq(np.stack([m.ravel(), c.ravel()], 1), y.ravel(), rcond=None)
    got = linalg.trap(df, "model", 4)
    assert math.isclose(got.coefficient, want[0], rel_tol=1e-6) and abs(got.coefficient - 0.5) < 0.2


def test_masked_fit_recovers_coefficients(spark):
    rng = np.random.default_rng(4)
    comp, coef = rng.standard_normal((64, 3)), rng.standard_normal((5, 3))
    data = coef @ comp.T
    px = [(f, 0, k // 8, k % 8, None if rng.random() < 0.2 else float(data[f, k])) for f in range(5) for k in range(64)]
    parts = spark.createDataFrame([(k // 8, k % 8, comp[k].tolist()) for k in range(64)], "y int, x int, c array<double>")
    got = linalg.masked_fit(spark.createDataFrame(px, "frame_idx long, ext int, y int, x int, v double"), parts, 3).collect()
    assert np.allclose([r["coefficients"] for r in sorted(got, key=lambda r: r["frame_idx"])], coef)


def test_lsqr_and_splits():
    rng = np.random.default_rng(0)
    g, b = rng.standard_normal((35, 35)), rng.standard_normal(35)
    want = np.linalg.solve(g.T @ g + 1.5**2 * np.eye(35), g.T @ b)
    assert np.allclose(linalg.lsqr(g, b, 1.5), want, atol=1e-8) and np.allclose(linalg.lsqr(g, b, 1.5, x0=want), want, atol=1e-8)
    train, test = linalg.train_test(10, 0.5, 0)
    assert sorted(train + test) == list(range(10)) and len(test) <= 5 and linalg.train_test(10, 0.5, 0) == (train, test) != linalg.train_test(10, 0.5, 1)
    assert linalg.modes([0.1, 3, 50], 20) == [2, 3]


def test_planted_companion(spark):
    """The signal to noise at the planted place is above that of every other angle at the radius; without it, it isn't."""
    n, nf, rng = 33, 24, np.random.default_rng(42)
    angles = np.linspace(0, 80, nf)
    y, x = np.mgrid[:n, :n]
    base = [np.cos(0.1 * (k + 1) * x + 0.07 * (k + 2) * y) for k in range(4)]
    rows = []
    for f in range(nf):
        sky = sum(20 * math.sin(0.05 * f + k) * b for k, b in enumerate(base)) + 200 * resample.gauss2d(n, n, 16, 16, 3, 3) + rng.standard_normal((n, n))
        rows.append((f, 0, sky.ravel().tolist(), float(angles[f])))
    df = spark.createDataFrame(rows, "i long, ext int, pix array<double>, a double")
    fr = frames(df, "i", "ext", "pix", n, n)
    angle = F.lit(80.0 / (nf - 1)) * F.col("frame_idx")
    found = pipeline.inject_and_measure(fr, angle, [(10.0, 60.0, 8.0)], [5], 4.0, n, n).first()
    none = pipeline.inject_and_measure(fr, angle, [(10.0, 60.0, 0.0)], [5], 4.0, n, n).first()
    assert found["snr"] > 3.5 > abs(none["snr"]) and found["signal"] > 5 * abs(none["signal"])


def test_series_round_trip(spark):
    df = spark.createDataFrame([(k, 0, [float(k * 4 + i) if i != k else float("nan") for i in range(4)]) for k in range(3)], "i long, ext int, p array<double>")
    px = pixels(frames(df, "i", "ext", "p", 2, 2))
    assert px.where("v is null").count() == 3
    assert unseries(series(px)).where("v is not null").count() == 9


def test_transforms():
    for hot, deg in (((2, 1), 90), ((1, 2), 0), ((2, 3), -90)):
        img = np.zeros((5, 5))
        img[hot] = 1
        assert np.unravel_index(resample.affine(img, resample.turn(deg, 5, 5), missing=0).argmax(), (5, 5)) == (1, 2)
    wave = resample.gauss2d(32, 32, 15, 16, 3, 2)
    there = resample.fourier_shift(wave, 1.25, -2.5)
    assert np.isclose(there.sum(), wave.sum()) and np.allclose(resample.fourier_shift(there, -1.25, 2.5), wave, atol=1e-6)
    assert np.allclose(resample.phase_shift(wave, there), (2.5, -1.25), atol=0.02)
    assert np.isclose(resample.gaussian_smooth(wave, 2).sum(), wave.sum())


def test_aperture_ring(spark):
    got = apertures.ring(spark.createDataFrame([(5.0, 0.0)], "r_px double, pa_deg double"), 7.0).orderBy("k").collect()
    assert np.allclose([(r["ax"], r["ay"]) for r in got], [(0, 5), (-5, 0), (0, -5), (5, 0)], atol=1e-9)


def test_snr_formula(spark):
    df = spark.createDataFrame([(0, 10.0), (1, 1.0), (2, -1.0), (3, 1.0), (4, -1.0)], "k int, v double").withColumn("g", F.lit(1))
    assert np.isclose(apertures.measured(df, ["g"]).first()["snr"], 10 / math.sqrt(1 + 1 / 4))


def test_queries_on_all_frames(spark, monkeypatch):
    from starloom.plans import linalg_queries

    seen = []
    whole = linalg_queries.cube
    monkeypatch.setattr(linalg_queries, "cube", lambda s, d: seen.append(whole(s, d)) or seen[-1])
    for query in (linalg_queries.dmd, linalg_queries.trap_coeff):
        assert query(spark, "/root/testdata/sf0.001").count()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert [len(se.first()["ts"]) for se in seen] == [n, n]


@pytest.fixture(scope="module")
def long(spark):
    """More frames than pixels, as series with a probe beside them."""
    rng = np.random.default_rng(21)
    p, n = 12, 70
    x = rng.standard_normal((p, 4)) @ rng.standard_normal((4, n)) * 3 + rng.standard_normal((p, n))
    probe = rng.random((p, n))
    rows = [(0, k // 8, k % 8, x[k].tolist(), probe[k].tolist()) for k in range(p)]
    return spark.createDataFrame(rows, "ext int, y int, x int, ts array<double>, model array<double>").repartition(3), x, probe


@pytest.fixture
def few(monkeypatch):
    """Fewer frames than the cube has are too many for the driver; blocks of frames are small."""
    monkeypatch.setattr(linalg, "MAX_FRAMES", 30)
    monkeypatch.setattr(linalg, "BLOCK", 12 * 9)


def test_subspaces_of_more_frames_than_a_gram_matrix_takes(long, few):
    df, x, _ = long
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(matrix(linalg.klip_subspace(df, 4)), x - u[:, :4] * s[:4] @ vt[:4])
    c = x - x.mean(axis=1, keepdims=True)
    uc, sc, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(matrix(linalg.klip(df, 3)), c - uc[:, :3] @ uc[:, :3].T @ c)
    parts, found = linalg.sky_components(df, 3)
    assert np.allclose(found, sc[:3]) and np.allclose(np.abs(matrix(parts)), np.abs(uc[:, :3]))
    _, _, vt = np.linalg.svd(x / x.std(axis=1, keepdims=True), full_matrices=False)
    assert np.allclose(matrix(linalg.klip_transpose(df, 4)), x - x @ vt[:4].T @ vt[:4])


@pytest.mark.parametrize("kind", ["places", "angles", "masks", "wide"])
def test_exclusions_of_more_frames_than_a_gram_matrix_takes(long, few, kind):
    df, x, probe = long
    n, rng = x.shape[1], np.random.default_rng(3)
    values = {"places": np.arange(n), "angles": rng.random(n) * 40, "wide": rng.random(n) * 8}.get(kind)
    out = linalg.excluded(values, 2) if values is not None else [(rng.random(n) < 0.3) | (np.arange(n) == i) for i in range(n)]
    if values is not None:
        assert all((out[i] == (np.abs(values - values[i]) <= 2)).all() for i in range(n))
    c, p = x - x.mean(axis=1, keepdims=True), probe - x.mean(axis=1, keepdims=True)
    want, beside = np.empty_like(c), np.empty_like(c)
    for i in range(n):
        u = np.linalg.svd(c[:, ~out[i]], full_matrices=False)[0][:, :3]
        want[:, i], beside[:, i] = c[:, i] - u @ (u.T @ c[:, i]), p[:, i] - u @ (u.T @ p[:, i])
    assert np.allclose(matrix(linalg.klip(df, 3, out)), want)
    assert np.allclose(matrix(linalg.klip(df, 3, out, rank=n)), want)
    got = linalg.klip_probed(df, "model", 3, out)
    assert got.columns == df.columns and np.allclose(matrix(got), want)
    assert np.allclose([r["model"] for r in sorted(got.collect(), key=lambda r: (r["y"], r["x"]))], beside)


def test_dmd_of_more_frames_than_a_gram_matrix_takes(long, few):
    df, x, _ = long
    for first, second, fitted, got in (
        (np.arange(69), np.arange(1, 70), np.arange(70), linalg.dmd(df, 3)),
        (np.arange(0, 70, 4)[:17], np.arange(1, 70, 4)[:17], np.sort(np.r_[2:70:4, 3:70:4]), linalg.dmd_halves(df, 3)[0][1]),
    ):
        first, second = (first, second) if len(first) == 69 else (np.arange(0, 70, 4), np.arange(1, 70, 4))
        u, s, vt = np.linalg.svd(x[:, first], full_matrices=False)
        u, s, vt = u[:, :3], s[:3], vt[:3]
        _, w = np.linalg.eig(u.T @ x[:, second] @ vt.T / s)
        phi = x[:, second] @ vt.T / s @ w
        assert np.allclose(matrix(got), (x[:, fitted] - phi @ np.linalg.pinv(phi) @ x[:, fitted]).real, atol=1e-6)


def test_too_many_of_both_are_refused(long, monkeypatch):
    monkeypatch.setattr(linalg, "MAX_FRAMES", 5)
    with pytest.raises(ValueError, match="more than 5 frames"):
        linalg.klip(long[0], 3)


def grown(mask, n):
    for _ in range(n):
        p = np.pad(mask, 1)
        mask = mask | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return mask


def sky_left(cube, k, n_sigma, grow, excluded):
    """The frames less their sky, and the background's pixels, by least squares a frame; missing pixels are NaN."""
    filled = np.nan_to_num(cube)
    mean, std = filled.mean(axis=0), filled.std(axis=0)
    u = np.linalg.svd((filled - mean).reshape(len(cube), -1), full_matrices=False)[2][:k]
    left, good = np.empty_like(cube), np.empty(cube.shape, bool)
    for i, f in enumerate(cube):
        g = good[i] = ~grown((std > np.percentile(std, 90)) | excluded | np.isnan(f) | (f > n_sigma * np.median(std) + mean), grow)
        fit = np.linalg.lstsq(u[:, g.ravel()].T, (f - mean)[g], rcond=None)[0]
        left[i] = f - mean - (fit @ u).reshape(f.shape)
        left[i] -= left[i][g].mean()
    return left, good


@pytest.fixture(scope="module")
def skies():
    """Frames of a sky with a slope, so that no frame's mean is near the mean sky, a star in each second one, and missing pixels."""
    rng, n = np.random.default_rng(5), 12
    y, x = np.mgrid[:n, :n]
    cube = 30.0 * y + rng.standard_normal((16, 1, 1)) * np.sin(x / 3) + rng.standard_normal((16, 1, 1)) * y / 8 + 0.1 * rng.standard_normal((16, n, n))
    cube[::2, 2, 3] += 25
    cube[3, 7, 7] = cube[5, 10, 1] = np.nan
    return cube


def sky_pixels(spark, cube, ext=0):
    rows = [(i, ext, None if np.isnan(v) else float(v), y, x) for i, f in enumerate(cube) for (y, x), v in np.ndenumerate(f)]
    return spark.createDataFrame(rows, "frame_idx long, ext int, v double, y int, x int")


@pytest.mark.parametrize("ext", [0, None])
def test_background_is_over_the_mean_sky_and_left_with_zero_mean(spark, skies, ext):
    from starloom.plans import sky

    px, n = sky_pixels(spark, skies, ext), skies.shape[1]
    stats, out = sky.statistics(px), np.zeros((n, n), bool)
    out[9, 9] = True
    mask = spark.createDataFrame([(9, 9)], "y int, x int")
    want, good = sky_left(skies, 2, 3.0, 2, out)
    got = sky.subtracted(sky.background(px, stats, 3.0, 2, n, n, excluded=mask), stats, sky.components(px, 2), 2).toPandas().sort_values(["frame_idx", "y", "x"])
    assert len(got) == skies.size and (got["background"].to_numpy().reshape(good.shape) == good).all()
    assert not good[:, 9, 9].any() and not good[3, 7, 9] and good[:, -1].any()
    assert np.allclose(got["v"].to_numpy(float).reshape(want.shape), want, equal_nan=True)


def test_frame_without_enough_background_is_an_error(spark, skies):
    from starloom.plans import sky

    bright = skies.copy()
    bright[4] += 1000
    px, n = sky_pixels(spark, skies), skies.shape[1]
    stats = sky.statistics(px)
    left = sky.subtracted(sky.background(sky_pixels(spark, bright), stats, 3.0, 2, n, n), stats, sky.components(px, 2), 2)
    with pytest.raises(Exception, match="too few background pixels in frame 4"):
        left.collect()


def test_background_subtract_equals_least_squares(spark):
    import pandas as pd

    from starloom import catalog

    d = "/root/testdata/sf0.001"
    cube = np.stack(pd.read_parquet(f"{d}/embeddings.parquet").sort_values("vec_id")["embedding"]).astype(float).reshape(-1, 8, 8)
    left, good = sky_left(cube, 3, 3.0, 2, np.zeros((8, 8), bool))
    err, rms = left.std(axis=(1, 2)), [f[g].std() for f, g in zip(left, good, strict=True)]
    want = {f"{name}_{c}": f(v) for c, v in (("err", err), ("rms", rms)) for name, f in (("min", np.min), ("max", np.max), ("avg", np.mean))}
    got = catalog.queries()["background_subtract"](spark, d).first().asDict()
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 2e-6 for c in want), (got, want)


def test_background_in_more_tasks_than_frames_or_pixels(spark):
    """Some tasks then have no rows."""
    from starloom.plans import sky

    cube = np.random.default_rng(6).standard_normal((6, 2, 2))
    want, good = sky_left(cube, 1, 3.0, 0, np.zeros((2, 2), bool))
    many = {"spark.sql.shuffle.partitions": "17", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c, None) for c in many}
    try:
        for c, v in many.items():
            spark.conf.set(c, v)
        px = sky_pixels(spark, cube)
        stats = sky.statistics(px)
        got = sky.subtracted(sky.background(px, stats, 3.0, 0, 2, 2), stats, sky.components(px, 1), 1).toPandas().sort_values(["frame_idx", "y", "x"])
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert (got["background"].to_numpy().reshape(good.shape) == good).all() and np.allclose(got["v"].to_numpy().reshape(want.shape), want)
