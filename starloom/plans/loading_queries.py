"""Queries of loading, alignment, stacking and joint fits: the embeddings as frames, events as headers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from starloom.functions import geometry
from starloom.model import pixels, unseries
from starloom.operators import headers, registration, resample
from starloom.plans import commands, linalg
from starloom.plans.linalg_queries import cube
from starloom.plans.pixel_queries import N, angle, fr, px, rounded
from starloom.plans.registry import PX, query, r6
from starloom.plans.table_queries import events
from starloom.sources import fits

HOLES = "(frame_idx * 5 + y * 3 + x) % 11 = 0"


@query(
    f"WITH {PX}, p AS (SELECT (frame_idx - 1) // 3 // 4 AS frame_idx, ext, y, x, v / (1 + frame_idx % 4) AS v, (frame_idx * 7.0) % 360 AS a FROM px WHERE frame_idx >= 1 AND (frame_idx - 1) % 3 = 0) "
    f"SELECT frame_idx, ext, y, x, {r6('sum(v)')} AS v, {r6('avg(a)')} AS angle_deg FROM p GROUP BY 1, 2, 3, 4"
)
def load_inputs(spark, d):
    """Every third frame from the second on, each divided by its factor, four at a time added up."""
    got = commands.loaded(fr(spark, d), angle(), np.ones((3, 3)), [(2.0, 30.0, 0.0)], 1 + F.col("frame_idx") % 4, 3, 1, 4)
    return rounded(got.where("kind = 'image'").drop("kind"), "v", "angle_deg")


@query(f"WITH {PX}, m AS (SELECT *, CASE WHEN {HOLES} THEN NULL ELSE v END AS w FROM px), c AS (SELECT 0 AS destination, y, x, CASE WHEN y >= x THEN 2 * w END AS v, CASE WHEN y >= x THEN 1 ELSE 0 END AS n FROM m UNION ALL SELECT 0, y, x, -0.5 * v, 1 FROM px UNION ALL SELECT 1, y, x, v, 1 FROM px) SELECT destination, y, x, {r6('avg(v)')} AS v, CAST(sum(n) AS DOUBLE) AS coverage FROM c GROUP BY 1, 2, 3")
def stack_components(spark, d):
    """Two components for one destination, the first masked and with missing pixels; one for another."""
    f = fr(spark, d)
    gone = F.transform("pix", lambda v, i: F.when((F.col("frame_idx") * 5 + F.floor(i / N) * 3 + i % N) % 11 != 0, v.cast("double")))
    parts = [(f.withColumn("pix", gone), px(spark, d).where("y >= x"), 2.0, None, 0), (f, None, -0.5, None, 0), (f, None, 1.0, None, 1)]
    return rounded(commands.components_stacked(parts, "mean"), "v")


FEATURES = "f AS (SELECT vec_id AS frame_idx, k AS feature, CAST(embedding[2 * k + 1] AS DOUBLE) * 5 AS y, CAST(embedding[2 * k + 2] AS DOUBLE) * 5 AS x FROM embeddings, range(3) t(k)), c AS (SELECT vec_id AS frame_idx, CAST(embedding[11] AS DOUBLE) AS cy, CAST(embedding[12] AS DOUBLE) AS cx FROM embeddings WHERE vec_id % 3 <> 0)"


@query(f"WITH {FEATURES}, o AS (SELECT feature, avg(cy - y) AS dy, avg(cx - x) AS dx FROM f JOIN c USING (frame_idx) GROUP BY feature) SELECT frame_idx, {r6('avg(y + dy)')} AS cy, {r6('avg(x + dx)')} AS cx FROM f JOIN o USING (feature) WHERE frame_idx % 3 = 0 GROUP BY frame_idx")
def obscured_centres(spark, d):
    """The centre of every third frame isn't seen: it is put together from the features' mean offsets in the others."""
    f, at = fr(spark, d), lambda k: F.col("pix")[k].cast("double")
    point = lambda k: F.struct(F.lit(k).cast("long").alias("feature"), (at(2 * k) * 5).alias("y"), (at(2 * k + 1) * 5).alias("x"))
    features = f.select("frame_idx", F.inline(F.array(*map(point, range(3)))))
    seen = f.where("frame_idx % 3 <> 0").select("frame_idx", at(10).alias("cy"), at(11).alias("cx"))
    hidden = features.where("frame_idx % 3 = 0")
    return rounded(registration.obscured_centres(hidden, registration.centre_offsets(features, seen)), "cy", "cx")


@query(f"WITH {PX}, p AS (SELECT *, CAST(floor(sqrt((y - 3) * (y - 3) + (x - 3) * (x - 3)) + 0.5) AS INTEGER) AS r FROM px WHERE y < 7 AND x < 7), g AS (SELECT frame_idx, ext, r FROM p GROUP BY 1, 2, 3 HAVING r < 3 AND count(CASE WHEN {HOLES} THEN 1 END) = 0), f AS (SELECT vec_id AS frame_idx, label AS ext FROM embeddings) SELECT frame_idx, ext, min(r) AS r FROM f LEFT JOIN g USING (frame_idx, ext) GROUP BY 1, 2")
def min_radius(spark, d):
    """The least ring without holes in 7 x 7 pixels."""
    holed = px(spark, d).where("y < 7 and x < 7").withColumn("v", F.when(~F.expr(HOLES), F.col("v")))
    return geometry.min_radius(holed, 7, 7)


@query("SELECT least((SELECT count(DISTINCT label) * 64 FROM embeddings), (SELECT count(DISTINCT vec_id) FROM embeddings)) AS rank")
def max_rank(spark, d):
    return linalg.max_rank(px(spark, d))


@query("WITH t AS (SELECT event_id, 'DET.NAME' AS path, event_type AS v FROM events UNION ALL SELECT event_id, 'DET.USER.id', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'plain', 'a=b' FROM events) SELECT event_id, CASE path WHEN 'DET.NAME' THEN 'DET.name' ELSE path END AS path, v AS value FROM t")
def obs_method_tokens(spark, d):
    text = F.concat(F.lit(" DET.NAME=gone  DET.USER.ID="), F.col("user_id").cast("string"), F.lit(" PLAIN=a=b DET.NAME="), F.col("event_type"))
    return events(spark, d).select("event_id", F.explode(headers.obs_method_tokens(text)).alias("path", "value"))


@query("SELECT event_id, 's3://store/' || event_type || '/' || event_id || '.fits' AS path, event_id || '.fits' AS name FROM events")
def join_paths(spark, d):
    path = fits.joined(F.concat(F.lit("s3://store/"), F.col("event_type"), F.lit("/")), F.concat(F.col("event_id").cast("string"), F.lit(".fits")))
    return events(spark, d).select("event_id", path.alias("path"), fits.basename(path).alias("name"))


@query("SELECT event_id AS path, CASE WHEN event_id % 5 <> 0 THEN event_type END AS value FROM events")
def keyword_sequence(spark, d):
    header = F.when(F.col("event_id") % 5 != 0, F.create_map(F.lit("KIND"), F.col("event_type"))).otherwise(F.create_map(F.lit("OTHER"), F.lit("x")))
    hdus = events(spark, d).select(F.col("event_id").alias("path"), header.alias("header"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ext_idx"))
    return headers.sequence(hdus, "KIND", F.col("ext_idx") == 1)


@query(f"WITH {PX} SELECT frame_idx, ext, y, x, {r6('0.0')} AS v FROM px")
def unsharp_constant(spark, d):
    """Frames of one value each have nothing left when their smoothed selves are taken off."""
    flat = fr(spark, d).withColumn("pix", F.array_repeat(F.col("pix")[0].cast("double"), N * N))
    return rounded(pixels(resample.unsharp_masked(flat, 1.3)), "v")


@query("SELECT 2.0::DOUBLE AS coefficient, 3.0::DOUBLE AS first, -1.0::DOUBLE AS other")
def trap_two_backgrounds(spark, d):
    """A signal of 2 planted in two columns of pixels, and a constant of 3 in their upper and of -1 in their lower half; the frames' own
    part of those pixels is taken out, and the modes are those of the other pixels less their means."""
    wave = F.transform("ts", lambda v, i: F.cos((i + F.col("y") * 3 + F.col("x")).cast("double")) * 10)
    level = F.when(F.col("y") >= 4, F.lit(3.0)).otherwise(F.lit(-1.0))
    se = linalg.centred(cube(spark, d)).withColumn("model", wave)
    inside = se.where("x >= 6").withColumn("ts", F.transform("model", lambda m: m * 2.0 + level))
    basis = linalg.main_modes(se.where("x < 6"), 3)[1]
    t = linalg.trap(inside, "model", 3, basis=basis, split=F.col("y") >= 4)
    names = ("coefficient", "first", "other")
    return spark.range(1).select(*(F.lit(round(v, 4)).alias(n) for n, v in zip(names, (t.coefficient, *t.backgrounds), strict=True)))


@query("SELECT CAST(count(*) // 4 * 2 AS BIGINT) * 64 AS n, true AS smaller FROM embeddings")
def dmd_pair_halves(spark, d):
    """The second half of the pairs by modes of the first: how many values are left, and that they are smaller."""
    se = cube(spark, d)
    ((places, left),) = linalg.dmd_halves(se, 5)
    energy = lambda t: t.agg(F.sum(F.col("v") * F.col("v")).alias("e"), F.count("*").alias("n"))
    before = energy(unseries(se).where((F.col("i") % 4 >= 2) & (F.col("i") <= int(places.max()))))
    return before.crossJoin(energy(unseries(left)).withColumnsRenamed({"e": "e2", "n": "n2"})).select(F.col("n2").alias("n"), (F.col("e2") < F.col("e")).alias("smaller"))  # one row each
