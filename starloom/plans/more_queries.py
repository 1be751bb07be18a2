"""Queries of registration, maps, sky background and files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from starloom.model import pixels
from starloom.operators import maps, registration
from starloom.plans import sky
from starloom.plans.pixel_queries import N, fr, px, rounded
from starloom.plans.registry import PX, query, r6
from starloom.plans.table_queries import items
from starloom.sources import fits


@query(f"WITH {PX}, h AS (SELECT frame_idx, ext, y, x, CASE WHEN y = 0 OR (x = 1 AND y = 3) THEN NULL ELSE v END AS v FROM px) SELECT frame_idx, ext, y, x, v FROM h WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5")
def crop_missing(spark, d):
    holes = px(spark, d).withColumn("v", F.when(~F.expr("y = 0 or (x = 1 and y = 3)"), F.col("v")))
    return registration.crop(holes, N, N).select("frame_idx", "ext", "y", "x", "v")


SKY = f"""{PX}, s AS (SELECT y, x, stddev_pop(v) AS s FROM px GROUP BY y, x), q AS (SELECT quantile_cont(s, 0.9) AS ps, median(s) AS ms FROM s),
    m AS (SELECT frame_idx, ext, avg(v) AS m FROM px GROUP BY frame_idx, ext),
    bad AS (SELECT px.frame_idx, px.ext, px.y, px.x FROM px JOIN s USING (y, x) JOIN m ON m.frame_idx = px.frame_idx AND m.ext = px.ext, q WHERE s > ps OR v > m + 2 * ms)"""


@query(f"WITH {SKY} SELECT ext, y, x, count(*) AS n FROM px WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.frame_idx = px.frame_idx AND b.ext = px.ext AND abs(b.y - px.y) + abs(b.x - px.x) <= 1) GROUP BY ext, y, x")
def background_mask(spark, d):
    p = px(spark, d)
    s = p.groupBy("y", "x").agg(F.stddev_pop("v").alias("s"))
    mean = p.groupBy("frame_idx", "ext").agg(F.avg("v").alias("m"))
    return sky.background(p, s, 2.0, 1, N, N, mean).where("background").groupBy("ext", "y", "x").agg(F.count("*").alias("n"))


@query()
def background_subtract(spark, d):
    """What is left of the frames, the background's own pixels being two steps from those over the mean sky by 3 median spreads."""
    p = px(spark, d)
    stats = sky.statistics(p)
    left = sky.subtracted(sky.background(p, stats, 3.0, 2, N, N), stats, sky.components(p, 3), 3)
    return rounded(sky.validation(left), "min_err", "max_err", "avg_err", "min_rms", "max_rms", "avg_rms")


@query()
def detection_map(spark, d):
    """snr over place for each parameter, interpolated; radii and angles as in the calibration grid of the other queries."""
    g = items(spark, d).where("scale = 0").select("param", (F.col("r_px") / 15).alias("r"), (F.col("pa_deg") * 50.0).alias("pa"), "snr")
    return rounded(maps.points_to_map(g, ["param"], "r", "pa", "snr", N, N), "v")


@query()
def align_frames(spark, d):
    """Each frame's offset from the mean image, and its size after alignment."""
    mean = np.array([r[0] for r in px(spark, d).groupBy("y", "x").agg(F.avg("v")).orderBy("y", "x").select("avg(v)").collect()]).reshape(N, N)
    out = registration.offsets(fr(spark, d), mean, 0, 0, 10)
    return out.select("frame_idx", "ext", F.round("dy", 3).alias("dy"), F.round("dx", 3).alias("dx"))


@query(f"WITH {PX} SELECT frame_idx, ext, count(*) AS n, {r6('sum(v)')} AS total FROM px GROUP BY frame_idx, ext")
def fits_roundtrip(spark, d):
    """Frames as FITS files in bytes and back, with the frame's number and extension in the header."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def write(i, ext, pix):
        import pandas as pd

        return pd.Series([fits.unit(np.array(p, np.float32).reshape(N, N), {"FRAME": int(k), "LABEL": int(e)}) for k, e, p in zip(i, ext, pix, strict=True)])

    @pandas_udf("frame_idx long, ext int, pix array<double>")
    def read(raw):
        import pandas as pd

        rows = [next(fits.units(bytes(b))) for b in raw]
        return pd.DataFrame({"frame_idx": [h["FRAME"] for h, *_ in rows], "ext": [h["LABEL"] for h, *_ in rows], "pix": [a.astype(float).ravel().tolist() for *_, a in rows]})

    files = fr(spark, d).select(write("frame_idx", "ext", "pix").alias("file"))
    back = files.select(read("file").alias("f")).select("f.*").withColumn("ny", F.lit(N)).withColumn("nx", F.lit(N))
    return rounded(pixels(back).groupBy("frame_idx", "ext").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total")


@query(f"WITH {PX} SELECT ext, y, x, {r6('avg(v)')} AS v, count(*) AS n FROM px GROUP BY ext, y, x")
def cube_repack(spark, d):
    """Frames to pixels and back to frames, then combined."""
    from starloom.model import repacked

    back = pixels(repacked(px(spark, d), N, N))
    return rounded(back.groupBy("ext", "y", "x").agg(F.avg("v").alias("v"), F.count("*").alias("n")), "v")


