"""FITS and region files, headers, streams and greedy chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import combine, headers
from starloom.sources import fits, regions
from starloom.streaming import chunks


def test_fits_round_trip(spark, tmp_path):
    cube = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    table = np.array([(1, 2.5, b"ab"), (3, -1.0, b"c")], dtype=[("a", "i4"), ("b", "f8"), ("s", "S3")])
    parts = [fits.unit(None, {"OBJECT": "it's", "GAIN": 2.5, "N": 3, "OK": True}), fits.unit(cube, {"BUNIT": "adu"}, False, "SCI"), fits.unit(np.array([[1, -2]], np.int16), {}, False, "DQ"), fits.table_unit(table, "TBL")]
    for k in range(3):
        fits.write(f"{tmp_path}/f{k}.fits", parts)
    with pytest.raises(FileExistsError):
        fits.write(f"{tmp_path}/f0.fits", parts)
    rows = fits.read(spark, f"{tmp_path}/*.fits").where(F.col("path").endswith("f0.fits")).orderBy("ext_idx").collect()
    assert [(r["extname"], r["kind"]) for r in rows] == [("PRIMARY", "primary"), ("SCI", "image"), ("DQ", "image"), ("TBL", "bintable")]
    assert rows[0]["header"]["OBJECT"] == "it's" and rows[0]["header"]["GAIN"] == "2.5" and rows[0]["header"]["OK"] == "True"
    assert rows[1]["shape"] == [2, 3, 4] and rows[1]["pix"] == list(range(24)) and rows[2]["pix"] == [1, -2]
    assert rows[3]["table_json"] == '[{"a":1,"b":2.5,"s":"ab"},{"a":3,"b":-1.0,"s":"c"}]'
    assert fits.read(spark, f"{tmp_path}/*.fits", every=2).select("path").distinct().count() == 2


def test_region_files(spark, tmp_path):
    made = regions.circles(spark.createDataFrame([(3.0, 4.0)], "x double, y double"), F.col("x"), F.col("y"), F.lit(2.0))
    made.write.text(f"{tmp_path}/r")
    assert tuple(regions.read(spark, f"{tmp_path}/r").first())[:4] == ("circle", 3.0, 4.0, 2.0)
    (tmp_path / "c.dat").write_text("# head\n1.0 0.5\n\n 2.0\t0.25\n")
    assert [tuple(r) for r in regions.curve(spark, f"file://{tmp_path}/c.dat").collect()] == [(1.0, 0.5), (2.0, 0.25)]


def test_obs_method():
    nested = headers.parse_obs_method("a.B=1 a.c=x d=2")
    assert nested == {"a": {"b": "1", "c": "x"}, "d": "2"} and headers.parse_obs_method(headers.flatten_obs_method(nested)) == nested


def test_range_chunks(spark):
    rows = [(k, float(90 - 30 * k), chr(65 + k)) for k in range(6)]
    df = spark.createDataFrame([(0, *r) for r in rows], "s int, i int, a double, m string")
    ch = combine.greedy(combine.monotonic(df, ["s"], ["i"], "a"), ["s"], ["i"], F.col("monotonic"), 90)
    got = combine.chunk_table(ch, ["s"], ["i"], ["a"], ["m"]).orderBy("chunk").collect()
    assert [(r["a"], r["m"]) for r in got] == [(60.0, "A"), (-30.0, "D")]


def test_streams(spark, tmp_path):
    px = spark.createDataFrame([(f, 0, 0, x, float(f)) for f in range(10) for x in range(2)], "frame_idx long, ext int, y int, x int, v double")
    px.repartition(3).write.parquet(f"{tmp_path}/px")
    stream = chunks.source(spark, f"{tmp_path}/px", px.schema, 1)
    q = chunks.fixed(stream, 5).writeStream.outputMode("complete").format("memory").queryName("fixed").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r["v"] for r in spark.table("fixed").collect()) == [2.0, 2.0, 7.0, 7.0]
    q = chunks.greedy(chunks.source(spark, f"{tmp_path}/px", px.schema, 9), "x", "v", 4).writeStream.outputMode("append").format("memory").queryName("greedy").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("greedy").collect()) == [(k, c, 4, m) for k in (0, 1) for c, m in ((0, 1.5), (1, 5.5))]


def test_inputs_of_a_directory(spark, tmp_path):
    for name in ("b.fits", "a.fit", "c.fits", "d.txt"):
        (tmp_path / name).write_bytes(fits.unit(np.ones((2, 2)), {"KW": name}) if name != "d.txt" else b"no")
    names = lambda df: sorted(r[0].rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(fits.inputs(spark, str(tmp_path))) == ["a.fit", "b.fits", "c.fits"]
    assert names(fits.inputs(spark, str(tmp_path), 2)) == ["a.fit", "c.fits"]
    assert sorted(r["header"]["KW"] for r in fits.read(spark, f"{tmp_path}/*.fits").collect()) == ["b.fits", "c.fits"]
    with pytest.raises(Exception, match="d.txt"):
        fits.read(spark, f"{tmp_path}/d.txt").collect()
