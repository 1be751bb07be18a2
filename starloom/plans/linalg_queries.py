"""Queries of the linear-algebra operators: all frames of the embeddings as one cube."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.model import series, unseries
from starloom.plans import linalg, pipeline
from starloom.plans.pixel_queries import N, angle, fr, px, rounded
from starloom.plans.registry import PX, query, r6


def cube(spark, d) -> DataFrame:
    return series(px(spark, d).withColumn("ext", F.lit(0)))


def energy(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each pixel's mean square before and after a subtraction."""
    square = lambda se, name: unseries(se).groupBy("y", "x").agg(F.avg(F.col("v") * F.col("v")).alias(name))
    return rounded(square(before, "before").join(square(after, "after"), ["y", "x"]), "before", "after")


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)), 5) AS g FROM embeddings, range(64) a(i), range(64) b(j) GROUP BY 1, 2")
def gram_matrix(spark, d):
    return linalg.gram_table(fr(spark, d), "pix").select("i", "j", F.round("g", 5).alias("g"))


@query(f"WITH {PX}, m AS (SELECT y, x, avg(v) AS m FROM px GROUP BY y, x) SELECT y, x, {r6('avg((v - m) * (v - m))')} AS variance FROM px JOIN m USING (y, x) GROUP BY y, x")
def mean_subtract(spark, d):
    x = unseries(linalg.centred(cube(spark, d)))
    return rounded(x.groupBy("y", "x").agg(F.avg(F.col("v") * F.col("v")).alias("variance")), "variance")


@query()
def klip_covariance(spark, d):
    se = cube(spark, d)
    return energy(linalg.centred(se), linalg.klip(se, 5))


@query()
def klip_exclusions(spark, d):
    """With the neighbouring two frames on either side left out of each frame's reference."""
    se = cube(spark, d)
    n = len(se.first()["ts"])
    return energy(linalg.centred(se), linalg.klip(se, 5, linalg.excluded(np.arange(n), 2)))


@query()
def klip_downdate(spark, d):
    """The same exclusions, from one basis of all frames."""
    se = cube(spark, d)
    n = len(se.first()["ts"])
    return energy(linalg.centred(se), linalg.klip(se, 5, linalg.excluded(np.arange(n), 2), rank=n))


@query()
def klip_transpose(spark, d):
    se = cube(spark, d)
    return energy(se, linalg.klip_transpose(se, 5))


@query()
def klip_subspace(spark, d):
    se = cube(spark, d)
    return energy(se, linalg.klip_subspace(se, 5))


@query()
def dmd(spark, d):
    se = cube(spark, d)
    return energy(se, linalg.dmd(se, 5))


@query("SELECT 2.0::DOUBLE AS coefficient")
def trap_coeff(spark, d):
    """A signal planted with a coefficient of 2 in two columns of pixels; the modes are those of the others."""
    model = cube(spark, d).withColumn("model", F.transform("ts", lambda v, i: F.when(F.col("x") >= 6, F.cos((i + F.col("y") * 3 + F.col("x")).cast("double")) * 10).otherwise(0.0)))
    planted = model.withColumn("ts", F.zip_with("ts", "model", lambda a, b: a + b * 2.0))
    t = linalg.trap(planted, "model", 3, reference=F.col("x") < 6)
    return spark.range(1).select(F.lit(round(t.coefficient, 2)).alias("coefficient"))


@query("SELECT i::INTEGER AS comp, 1.0::DOUBLE AS norm FROM range(4) t(i)")
def sky_components(spark, d):
    parts, s = linalg.sky_components(cube(spark, d), 4)
    return rounded(parts.select("y", "x", F.posexplode("ts").alias("comp", "c")).groupBy("comp").agg(F.sum(F.col("c") * F.col("c")).alias("norm")), "norm")


@query()
def sky_subtract(spark, d):
    p = px(spark, d)
    parts, _ = linalg.sky_components(cube(spark, d), 4)
    mean = p.groupBy("y", "x").agg(F.avg("v").alias("m"))
    left = linalg.sky_subtracted(p, parts.select("y", "x", F.col("ts").alias("c")), mean, 4)
    return rounded(left.groupBy("frame_idx", "ext").agg(F.avg(F.col("v") * F.col("v")).alias("left")), "left")


@query()
def starlight_subtract_measure(spark, d):
    """Inject, subtract with KLIP at two mode counts, derotate, stack and measure at the place of injection."""
    return rounded(pipeline.inject_and_measure(fr(spark, d).withColumn("ext", F.lit(0)), angle(), [(2.2, 30.0, 2.0)], [1, 5], 2.0, N, N), "signal", "snr")


@query(f"WITH {PX}, b AS (SELECT vec_id AS frame_idx, label AS ext FROM embeddings) SELECT ext, count(*) AS frames, {r6('avg(v)')} AS mean FROM px JOIN b USING (frame_idx, ext) GROUP BY ext")
def frame_join(spark, d):
    """The positional join of pixels with their frames' table."""
    p = px(spark, d)
    return rounded(p.join(fr(spark, d).select("frame_idx", "ext"), ["frame_idx", "ext"]).groupBy("ext").agg(F.count("*").alias("frames"), F.avg("v").alias("mean")), "mean")


