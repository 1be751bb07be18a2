"""Filters, datasets and commands: what SQL doesn't hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.model import pixels
from starloom.operators import datasets, filters, registration, resample, selection
from starloom.operators.selection import Box
from starloom.plans import commands


def image(spark, arr, frame=0):
    rows = [(frame, 0, int(y), int(x), None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(arr)]
    return spark.createDataFrame(rows, "frame_idx long, ext int, y int, x int, v double")


def values(df, ny, nx):
    out = np.full((ny, nx), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = np.nan if r["v"] is None else r["v"]
    return out


def test_matched_filter_finds_the_scale_at_the_place(spark):
    model = resample.gauss2d(9, 9, 4, 4, 1.0, 1.3) + 0.1 * resample.gauss2d(9, 9, 3, 5, 1.0, 1.0)
    kernel = filters.matched_kernels(image(spark, model), 3.0, 9, 9)
    scene = np.zeros((15, 13))
    y, x = np.mgrid[:9, :9]
    scene[2:11, 3:12] = 2.5 * model * (np.hypot(y - 4, x - 4) <= 3)
    scene[14, 0] = np.nan
    got = values(filters.matched(image(spark, scene), kernel, ["ext"]), 15, 13)
    assert np.isnan(got[14, 0]) and np.unravel_index(np.nanargmax(got), got.shape) == (6, 7) and np.isclose(got[6, 7], 2.5)


def test_matched_kernel_of_a_broken_model_says_so(spark):
    model = np.ones((5, 5))
    model[2, 1] = np.nan
    assert [r["whole"] for r in filters.matched_kernels(image(spark, model), 1.0, 5, 5).collect()] == [False]
    assert [r["whole"] for r in filters.matched_kernels(image(spark, model), 0.5, 5, 5).collect()] == [True]
    assert filters.matched_kernels(image(spark, np.zeros((5, 5))), 1.0, 5, 5).count() == 0


def test_tophat_is_the_mean_of_the_disk(spark):
    arr = np.random.default_rng(1).normal(size=(7, 8))
    got = values(filters.tophat(image(spark, arr), 1.0), 7, 8)
    pad = np.pad(arr, 1)
    assert np.allclose(got, (pad[1:-1, 1:-1] + pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:]) / 5)


def test_measured_grid_goes_on_from_its_checkpoint(spark, tmp_path):
    points = commands.measurement_grid(spark, 5, 10, 2, 8, [0.1], [1], [3], [0], ["a"])
    runs = []

    def work(t):
        return t.assign(time_total_sec=1.0)

    def run(left):
        runs.append(left.count())
        if len(runs) == 2:
            raise RuntimeError("stopped")
        return commands.tasks_run(left, work, left.schema.simpleString()[7:-1].replace(":", " "))

    n, at = points.count(), str(tmp_path / "checkpoint")
    with pytest.raises(RuntimeError):
        commands.measured_grid(points, at, run, batches=3)
    done = spark.read.parquet(at).count()
    assert 0 <= done == runs[0] < n
    got = commands.measured_grid(points, at, run, batches=3)
    assert got.count() == n == got.select("index").distinct().count() and got.where("time_total_sec = 0").count() == 0
    commands.measured_grid(points, at, run, batches=3)
    assert sum(runs[-3:]) == 0


def test_exclusions():
    masks = commands.exclusions(np.arange(10.0), nearest=1, deg=2.0)
    assert [list(np.flatnonzero(m)) for m in masks[:2]] == [[0, 1, 2], [0, 1, 2, 3]]
    assert not any(m.any() for m in commands.exclusions(np.arange(4.0)))
    wrapped = commands.exclusions([358.0, 359.0, 0.0, 1.0], px=(180 / np.pi, 1.01))
    assert list(np.flatnonzero(wrapped[1])) == [0, 1, 2]
    with pytest.raises(ValueError, match="contiguous"):
        commands.exclusions([0.0, 50.0, 0.0], deg=1.0)


def test_dataset_edges(spark):
    with pytest.raises(ValueError, match="readout"):
        datasets.subarray(spark.createDataFrame([(1, 1)], "y int, x int"), (3, 3))
    bad = spark.createDataFrame([(462, 0), (511, 711), (461, 5), (470, 300)], "y int, x int")
    assert sorted(map(tuple, datasets.subarray(bad, (100, 50)).collect())) == [(0, 0), (49, 399)]
    hdus = spark.createDataFrame([(0, None, [1.0], {"A": "1"}), (1, "Mask", [2.0], None)], "ext_idx int, extname string, pix array<double>, header map<string,string>")
    got = datasets.updated_extensions(hdus, {0: F.array(F.lit(9.0))}, {"MASK": {"B": "2"}, 0: {"A": "3"}}).orderBy("ext_idx").collect()
    assert [r["pix"] for r in got] == [[9.0], [2.0]] and got[0]["header"] == {"A": "3"} and (got[1]["header"] or {}) in ({"B": "2"}, {})
    px = image(spark, np.ones((2, 2)))
    assert datasets.extension_mean(px.limit(0)).count() == 0


def frame(spark, arrays):
    ny, nx = arrays[0].shape
    rows = [(k, 0, ny, nx, [None if np.isnan(v) else float(v) for v in a.ravel()]) for k, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "frame_idx long, ext int, ny int, nx int, pix array<double>")


@pytest.mark.parametrize("shape", [(9, 9), (17, 15), (7, 21)])
def test_cutouts_lie_as_the_template_does(spark, shape):
    """Templates smaller and larger than the search box, and a missing pixel."""
    h, w = shape
    template = resample.gauss2d(h, w, (h - 1) / 2, (w - 1) / 2, 1.5, 1.5)
    img = resample.gauss2d(40, 40, 21.4, 18.7, 1.5, 1.5)
    img[3, 3] = np.nan
    got = registration.cutouts(frame(spark, [img]), template, Box(14, 11, 13, 13)).first()
    assert (got["ny"], got["nx"]) == shape
    middle = np.array(got["pix"]).reshape(shape)
    y, x = np.mgrid[:h, :w]
    assert abs((y * middle).sum() / middle.sum() - (h - 1) / 2) < 0.1 and abs((x * middle).sum() / middle.sum() - (w - 1) / 2) < 0.1


def test_frames_are_centred(spark):
    img = resample.gauss2d(30, 30, 12.25, 17.5, 1.5, 1.5)
    centres = spark.createDataFrame([(0, 12.25, 17.5)], "frame_idx long, cy double, cx double")
    got = np.array(registration.centred_frames(frame(spark, [img]), centres, 15, 15).first()["pix"]).reshape(15, 15)
    assert np.abs(got - resample.gauss2d(15, 15, 7, 7, 1.5, 1.5)).max() < 0.02


def test_loaded_signals(spark):
    template = resample.gauss2d(5, 5, 2, 2, 1.0, 1.0)
    sky = [np.full((21, 21), float(k)) for k in range(4)]
    got = commands.loaded(frame(spark, sky), F.lit(0.0), template, [(6.0, 0.0, 3.0), (6.0, 180.0, 0.0)], F.lit(2.0), size=2)
    model, image = (values(got.where((F.col("kind") == kind) & (F.col("frame_idx") == 1)), 21, 21) for kind in ("model", "image"))
    # Position angle 0 is up: 6 pixels from the centre in y; the second companion is in the model alone.
    assert np.isclose(model[16, 10], 2.0) and np.isclose(model[4, 10], 2.0)
    assert np.isclose(image[16, 10], 2.5 + 6.0) and np.isclose(image[4, 10], 2.5)
    with pytest.raises(ValueError, match="missing"):
        commands.loaded(frame(spark, sky), F.lit(0.0), np.full((3, 3), np.nan), [(6.0, 0.0, 1.0)])


def test_stacked_components_are_derotated(spark):
    arr, mask = np.zeros((9, 9)), [(y, x) for y in range(9) for x in range(9) if x > 2]
    arr[4, 7] = 1.0
    inside = spark.createDataFrame(mask, "y int, x int")
    got = commands.components_stacked([(frame(spark, [arr, arr]), inside, 2.0, F.lit(90.0), 0)]).collect()
    at = {(r["y"], r["x"]): r for r in got}
    assert np.isclose(at[7, 4]["v"], 4.0) and np.isclose(at[7, 4]["coverage"], 2.0) and np.isclose(at[0, 4]["coverage"], 0.0)
    assert pixels(frame(spark, [arr])).count() == 81


def test_saved_refuses_what_is_there(spark, tmp_path):
    df = spark.range(3)
    paths = commands.saved(spark, {"residuals": df, "coverage": df}, f"{tmp_path}/out")
    assert [spark.read.parquet(p).count() for p in paths] == [3, 3]
    with pytest.raises(FileExistsError):
        commands.saved(spark, {"new": df, "coverage": df}, f"{tmp_path}/out")
    assert not (tmp_path / "out/new").exists()


def test_numbered_over_many_partitions(spark, tmp_path, monkeypatch):
    """Rows whose counts by partition were taken in another run than the rows themselves."""
    n = 60_000
    monkeypatch.setattr(selection, "RANGE_ROWS", 7_000, raising=False)
    at = (F.col("id") * 7919) % n
    log = spark.range(n).select(F.when(at >= 100, F.format_string("%08d", F.floor(at / 3))).alias("at"), at.alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("more"))
    log.repartition(6).write.parquet(f"{tmp_path}/log")
    got = selection.numbered(spark.read.parquet(f"{tmp_path}/log"), "at", "key").toPandas()
    assert len(got) == n and (got["frame_idx"] == got["key"]).all()


def test_filled_over_shared_and_empty_frames(spark):
    """Windows of frames of several shapes in one batch, without the join of all pixels' neighbours; a frame without extension has none."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for f, (ext, y0, ny, nx) in enumerate([(0, 0, 5, 4), (1, -3, 3, 9), (None, 0, 3, 3), (0, 0, 2, 2), (2, 1_000_000, 4, 4)]):
        img = np.where(rng.random((ny, nx)) < 0.4, np.nan, rng.random((ny, nx)))
        if f == 3:
            img[:] = np.nan
        for y, x in np.ndindex(ny, nx):
            if (y, x) == (1, 1) and f == 1:
                continue  # no such pixel
            rows.append((f, ext, y0 + y, x, None if np.isnan(img[y, x]) else float(img[y, x])))
        if f == 1:
            img[1, 1] = np.nan
        for r in [r for r in rows if r[0] == f]:
            y = r[2] - y0
            near = img[max(y - 1, 0) : y + 3, max(r[3] - 1, 0) : r[3] + 3]
            near = near[~np.isnan(near)] if ext is not None else near[:0, :0]
            want[f, r[2], r[3]] = r[4] if r[4] is not None else near.mean() if near.size else 0.0
    px = spark.createDataFrame(rows, "frame_idx long, ext int, y int, x int, v double").repartition(3)
    got = resample.filled(px)
    assert got.schema.simpleString() == px.schema.simpleString() and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r["frame_idx"], r["y"], r["x"]): r["v"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
