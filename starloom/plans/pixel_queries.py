"""Queries on frames and pixels. The embeddings are frames of 8 x 8 pixels, label their extension."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import geometry, photometry
from starloom.model import frames, grid, pixels
from starloom.operators import apertures, combine, masks, resample, selection
from starloom.plans.registry import PX, query, r6
from starloom.sources import regions

N, C = 8, 3.5


def fr(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "label", "embedding", N, N)


def px(spark: SparkSession, d: str) -> DataFrame:
    return pixels(fr(spark, d))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    zero = lambda c: F.when(F.abs(F.col(c)) < 5e-7, F.lit(0.0)).otherwise(F.round(c, 6))
    return df.withColumns({c: zero(c) for c in cols})


AGG = {"mean": "avg(v)", "sum": "coalesce(sum(v), 0)", "median": "median(v)", "std": "stddev_pop(v)"}
for how, agg in AGG.items():
    query(f"WITH {PX} SELECT ext, y, x, {r6(agg)} AS v FROM px GROUP BY ext, y, x", f"combine_{how}")(lambda s, d, how=how: rounded(combine.combine(px(s, d), how), "v"))
for to, agg in (("peak", "max"), ("total", "sum")):
    query(f"WITH {PX}, m AS (SELECT ext, y, x, avg(abs(v)) AS v FROM px GROUP BY ext, y, x) SELECT ext, y, x, {r6(f'v / {agg}(v) OVER (PARTITION BY ext)')} AS v FROM m", f"combine_normalize_{to}")(
        lambda s, d, to=to: rounded(combine.normalised(combine.combine(px(s, d).withColumn("v", F.abs("v")), "mean"), to), "v")
    )


@query(f"WITH {PX} SELECT ext, CAST(frame_idx // 7 AS BIGINT) AS chunk, y, x, {r6('avg(v)')} AS v FROM px GROUP BY 1, 2, 3, 4")
def downsample_chunks(spark, d):
    return rounded(combine.chunks(px(spark, d), 7), "v")


@query(f"WITH {PX} SELECT ext, frame_idx, y, x, v FROM px WHERE frame_idx >= 3 AND (frame_idx - 3) % 5 = 0")
def decimate_frames(spark, d):
    return combine.decimated(px(spark, d), 5, 3).select("ext", "frame_idx", "y", "x", "v")


@query(f"WITH {PX} SELECT ext, CAST(frame_idx // 2 AS BIGINT) AS pair, y, x, max(CASE WHEN frame_idx % 2 = 0 THEN v END) AS v0, max(CASE WHEN frame_idx % 2 = 1 THEN v END) AS v1 FROM px GROUP BY 1, 2, 3, 4 HAVING count(*) = 2")
def paired_columns(spark, d):
    return combine.paired(px(spark, d))


def _mask(name: str, predicate, sql: str) -> None:
    def run(spark, d):
        return rounded(px(spark, d).where(predicate()).groupBy("y", "x").agg(F.count("*").alias("n"), F.avg("v").alias("v")), "v")

    query(f"WITH {PX} SELECT y, x, count(*) AS n, {r6('avg(v)')} AS v FROM px WHERE {sql} GROUP BY y, x", name)(run)


RHO, PHI = "sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5))", "atan2(y - 3.5, x - 3.5)"
_mask("annulus_mask", lambda: masks.arc(C, C, 1.2, 3.1), f"{RHO} >= 1.2 AND {RHO} <= 3.1")
_mask("arc_mask", lambda: masks.arc(C, C, 1.0, 4.0, 0.3, 2.9, 0.1), f"{RHO} >= 1 AND {RHO} <= 4 AND (({PHI} + 0.1 + 4 * pi()) % (2 * pi())) BETWEEN 0.3 AND 2.9")
_mask("box_mask_rotated", lambda: masks.box(C, C, 3.1, 5.3, 30), f"abs({RHO} * sin({PHI} + radians(30))) <= 1.55 AND abs({RHO} * cos({PHI} + radians(30))) <= 2.65")
_mask("radial_mask", lambda: masks.radial(C, C, 1.1, 3.3), f"{RHO} > 1.1 AND {RHO} < 3.3")
_mask("half_plane_mask", lambda: masks.half_planes(C, C, 25), f"sin({PHI} - radians(25)) > 0")
_mask("dark_hole_mask", lambda: masks.dark_hole(C, C, 3.2, 0.4, 20, True), f"{RHO} <= 3.2 AND (y - 3.5) * cos(radians(20)) - (x - 3.5) * sin(radians(20)) > 0.4")


@query(f"WITH {PX}, m AS (SELECT DISTINCT y, x FROM px WHERE {RHO} <= 3 INTERSECT SELECT DISTINCT y, x FROM px WHERE abs(x - 3.5) > 1 INTERSECT SELECT DISTINCT y, x FROM px WHERE {RHO} > 0.8) SELECT ext, count(*) AS n, {r6('avg(v)')} AS v FROM px SEMI JOIN m USING (y, x) GROUP BY ext")
def mask_composition(spark, d):
    g = grid(spark, N, N)
    m = g.where(masks.arc(C, C, 0, 3)).intersect(g.where(F.abs(F.col("x") - C) > 1)).intersect(g.where(masks.radial(C, C, 0.8)))
    return rounded(masks.applied(px(spark, d), m).groupBy("ext").agg(F.count("*").alias("n"), F.avg("v").alias("v")), "v")


LINES = ["# a region file", "image", "circle(3.0,4.0,1.6)", "box(6.0,6.0,3.0,2.0,30)", "polygon(1,1,2,2,3,1)"]
BOX = "abs((x - 5) * cos(radians(30)) + (y - 5) * sin(radians(30))) <= 1.5 AND abs(-(x - 5) * sin(radians(30)) + (y - 5) * cos(radians(30))) <= 1"
for name, no in (("region_union_mask", ""), ("region_mask_inverted", "NOT ")):

    @query(f"WITH {PX} SELECT y, x, count(*) AS n FROM px WHERE {no}((x - 2) * (x - 2) + (y - 3) * (y - 3) <= 2.56 OR ({BOX})) GROUP BY y, x", name)
    def _regions(spark, d, invert=bool(no)):
        shapes = regions.parse(spark.createDataFrame([(x,) for x in LINES], "value string"))
        return masks.applied(px(spark, d), masks.regions(grid(spark, N, N), shapes, invert)).groupBy("y", "x").agg(F.count("*").alias("n"))


@query("SELECT shape, cx, cy, r, w, h, rot_deg FROM (VALUES ('circle', 2::DOUBLE, 3::DOUBLE, 1.6::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0::DOUBLE), ('box', 5::DOUBLE, 5::DOUBLE, NULL, 3, 2, 30)) t(shape, cx, cy, r, w, h, rot_deg)")
def region_parse(spark, d):
    return regions.parse(spark.createDataFrame([(x,) for x in LINES], "value string"))


DQ = "CAST((frame_idx + 3 * y + x) % 32 AS INTEGER)"
def _dq():
    return F.expr("cast((frame_idx + 3 * y + x) % 32 as int)")


@query(f"WITH {PX} SELECT ext, y, x, count(CASE WHEN ({DQ} & ~8) = 0 THEN v END) AS n, {r6('avg(CASE WHEN (' + DQ + ' & ~8) = 0 THEN v END)')} AS v FROM px GROUP BY ext, y, x")
def dq_masked_data(spark, d):
    v = photometry.permitted(F.col("v"), _dq(), photometry.INTERPOLATED)
    return rounded(px(spark, d).groupBy("ext", "y", "x").agg(F.count(v).alias("n"), F.avg(v).alias("v")), "v")


@query(f"WITH {PX} SELECT ext, y, x, bit_or({DQ}) AS dq FROM px GROUP BY ext, y, x")
def dq_bit_or(spark, d):
    return px(spark, d).groupBy("ext", "y", "x").agg(F.bit_or(_dq()).alias("dq"))


@query(f"WITH {PX} SELECT frame_idx, ext, y, x, CASE WHEN v > 0.2 THEN {DQ} | 2 ELSE {DQ} END AS dq FROM px")
def saturation_flag(spark, d):
    return px(spark, d).select("frame_idx", "ext", "y", "x", photometry.flagged(_dq(), F.col("v") > 0.2, photometry.SATURATED).alias("dq"))


def _linearity_sql() -> str:
    c, (lo, hi) = photometry.LINEARITY, photometry.LINEARITY_DOMAIN
    at = lambda x: sum(k * x**i for i, k in enumerate(c))
    m = f"((c - {lo}) * {(at(hi) - at(lo)) / (hi - lo)!r}::DOUBLE + {at(lo)!r}::DOUBLE)"
    poly = f"((({c[3]!r}::DOUBLE * {m} + {c[2]!r}::DOUBLE) * {m} + {c[1]!r}::DOUBLE) * {m} + {c[0]!r}::DOUBLE)"
    return f"WITH {PX}, k AS (SELECT *, v * 20000 + 30000 AS c FROM px) SELECT frame_idx, ext, y, x, round(CASE WHEN c >= {lo} AND c <= {hi} THEN {poly} ELSE c END, 4) AS v, c > {hi} AS saturated FROM k"


@query(_linearity_sql())
def linearity_correct(spark, d):
    c = F.col("v") * 20000 + 30000
    return px(spark, d).select("frame_idx", "ext", "y", "x", F.round(photometry.linearised(c), 4).alias("v"), (c > photometry.LINEARITY_DOMAIN[1]).alias("saturated"))


@query(f"WITH {PX}, b AS (SELECT y, x, avg(v) AS b FROM px GROUP BY y, x) SELECT frame_idx, ext, y, x, {r6('v - b')} AS v FROM px JOIN b USING (y, x)")
def bias_subtract(spark, d):
    p = px(spark, d)
    bias = p.groupBy("y", "x").agg(F.avg("v").alias("b"))
    return rounded(p.join(bias, ["y", "x"]).select("frame_idx", "ext", "y", "x", (F.col("v") - F.col("b")).alias("v")), "v")


for name, axis in (("global", []), ("row", ["y"]), ("col", ["x"])):
    by = ", ".join(["frame_idx", "ext", *axis])

    @query(f"WITH {PX} SELECT frame_idx, ext, y, x, {r6(f'v - median(v) OVER (PARTITION BY {by})')} AS v FROM px", f"median_subtract_{name}")
    def _median(spark, d, axis=axis):
        keys = ["frame_idx", "ext", *axis]
        return rounded(selection.without_median(px(spark, d), *keys).select("frame_idx", "ext", "y", "x", "v"), "v")


@query(f"WITH {PX}, s AS (SELECT y, x, stddev_pop(v) AS s, max(v) AS m FROM px GROUP BY y, x), q AS (SELECT quantile_cont(s, 0.9) AS qs, quantile_cont(m, 0.95) AS qm FROM s) SELECT y, x, s > qs OR m > qm AS bad FROM s, q")
def empirical_badpix(spark, d):
    return selection.unusual_pixels(px(spark, d), 0.9, 0.95)


@query(f"WITH {PX} SELECT DISTINCT y, x, {r6(RHO)} AS rho, {r6(PHI)} AS phi, {r6('(degrees(' + PHI + ') - 90 + 720) % 360')} AS pa_deg FROM px")
def polar_coords(spark, d):
    g = px(spark, d).select("y", "x").distinct()
    y, x = F.col("y"), F.col("x")
    return rounded(g.select("y", "x", geometry.rho(y, x, C, C).alias("rho"), geometry.phi(y, x, C, C).alias("phi"), geometry.pa_of(y, x, C, C).alias("pa_deg")), "rho", "phi", "pa_deg")


@query(f"SELECT n_nationkey AS k, {r6('(2 + n_nationkey) * cos(radians(90 + n_nationkey * 13.7 - n_nationkey)) + 3.5')} AS x, {r6('(2 + n_nationkey) * sin(radians(90 + n_nationkey * 13.7 - n_nationkey)) + 3.5')} AS y, round(2 + n_nationkey, 6)::DOUBLE AS r_px, {r6('(n_nationkey * 12.7) % 360')} AS pa_deg FROM nation")
def r_pa_roundtrip(spark, d):
    k = F.col("n_nationkey").cast("double")
    t = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), geometry.x_of(2 + k, k * 13.7, C, k).alias("x"), geometry.y_of(2 + k, k * 13.7, C, k).alias("y"))
    return rounded(t.select("k", "x", "y", geometry.rho(F.col("y"), F.col("x"), C, C).alias("r_px"), geometry.pa_of(F.col("y"), F.col("x"), C, C).alias("pa_deg")), "x", "y", "r_px", "pa_deg")


PROFILE = f"""ring AS (SELECT frame_idx, ext, CAST(floor({RHO}) + 1 AS INTEGER) AS n, coalesce(sum(v), 0) AS s, count(*) AS npix FROM px GROUP BY 1, 2, 3),
    profile AS (SELECT frame_idx, ext, n, npix, sum(s) OVER (PARTITION BY frame_idx, ext ORDER BY n) AS encircled, n - 0.5::DOUBLE AS r, s / npix AS profile FROM ring WHERE n < 3)"""


@query(f"WITH {PX}, {PROFILE} SELECT frame_idx, ext, n, npix, {r6('encircled')} AS encircled, r, {r6('profile')} AS profile FROM profile")
def encircled_energy(spark, d):
    return rounded(apertures.profile(px(spark, d), N, N), "encircled", "profile")


@query(f"WITH {PX}, {PROFILE}, f AS (SELECT *, min(CASE WHEN profile < 0 THEN n END) OVER (PARTITION BY frame_idx, ext) AS f FROM profile) SELECT frame_idx, ext, n, {r6('profile')} AS profile FROM f WHERE f IS NULL OR n < f")
def radial_profile_trimmed(spark, d):
    return rounded(apertures.trimmed(apertures.profile(px(spark, d), N, N)).select("frame_idx", "ext", "n", "profile"), "profile")


@query(f"WITH {PX}, {PROFILE}, t AS (SELECT n, avg(abs(profile)) + 1 AS t FROM profile GROUP BY n) SELECT frame_idx, ext, {r6('avg(profile / t)')} AS factor FROM profile JOIN t USING (n) GROUP BY frame_idx, ext")
def template_scale_factor(spark, d):
    p = apertures.profile(px(spark, d), N, N)
    return rounded(apertures.template_factors(p, p.groupBy("n").agg((F.avg(F.abs("profile")) + 1).alias("t"))), "factor")


@query(f"WITH {PX}, w AS (SELECT *, abs(v) AS w FROM px) SELECT frame_idx, ext, {r6('sqrt(sum(w*y*y)/sum(w) - pow(sum(w*y)/sum(w), 2) + sum(w*x*x)/sum(w) - pow(sum(w*x)/sum(w), 2))')} AS radial_std FROM w GROUP BY frame_idx, ext")
def radial_std(spark, d):
    return rounded(apertures.radial_std(px(spark, d).withColumn("v", F.abs("v")), N, N), "radial_std")


@query(f"WITH {PX}, h AS (SELECT ext, floor(v * 20) / 20 + 0.025 AS c, count(*) AS n FROM px GROUP BY 1, 2) SELECT ext, {r6('sqrt(sum(n * c * c) / sum(n) - pow(sum(n * c) / sum(n), 2))')} AS std FROM h GROUP BY ext")
def histogram_std(spark, d):
    h = px(spark, d).groupBy("ext", (F.floor(F.col("v") * 20) / 20 + 0.025).alias("c")).agg(F.count("*").alias("n"))
    m = F.sum(F.col("n") * F.col("c")) / F.sum("n")
    return rounded(h.groupBy("ext").agg(F.sqrt(F.sum(F.col("n") * F.col("c") * F.col("c")) / F.sum("n") - m * m).alias("std")), "std")


MEAN = f"{PX}, im AS (SELECT 0::BIGINT AS frame_idx, ext, y, x, avg(v) AS v FROM px GROUP BY ext, y, x)"


def mean_image(spark, d):
    return combine.combine(px(spark, d), "mean").select(F.lit(0).cast("long").alias("frame_idx"), "ext", "y", "x", "v")


LOC = "loc AS (SELECT n_nationkey AS id, 1.6 + (n_nationkey % 7) * 0.2 AS r_px, n_nationkey * 15.0 AS pa_deg FROM nation)"
RING = """ring AS (SELECT *, CAST(floor(2 * pi() * r_px / 2) AS INTEGER) AS n_apertures FROM loc),
    ap AS (SELECT ring.*, k::INTEGER AS k, r_px * cos(radians(pa_deg + 90) + k * (2 * pi() / n_apertures)) AS ax, r_px * sin(radians(pa_deg + 90) + k * (2 * pi() / n_apertures)) AS ay FROM ring, range(50) t(k) WHERE k < n_apertures)"""


def locations(spark, d):
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{d}/nation.parquet").select(k.alias("id"), (1.6 + (k % 7) * 0.2).alias("r_px"), (k * 15.0).alias("pa_deg"))


@query(f"WITH {LOC}, {RING} SELECT id, k, n_apertures, {r6('ax')} AS ax, {r6('ay')} AS ay FROM ap WHERE k = 0 OR (k > 1 AND k < n_apertures - 1)")
def aperture_locations(spark, d):
    return rounded(apertures.ring(locations(spark, d), 2.0, 1).select("id", "k", "n_apertures", "ax", "ay"), "ax", "ay")


APV = f"""{MEAN}, {LOC}, {RING}, av AS (SELECT frame_idx, ext, id, k, sum(v) / count(v) AS v FROM im JOIN ap ON sqrt((x - ax - 3.5) * (x - ax - 3.5) + (y - ay - 3.5) * (y - ay - 3.5)) <= 1 GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {APV} SELECT frame_idx, ext, id, k, {r6('v')} AS v FROM av")
def aperture_sums(spark, d):
    return rounded(apertures.aperture_means(mean_image(spark, d), apertures.ring(locations(spark, d), 2.0), 2.0, N, N).select("frame_idx", "ext", "id", "k", "v"), "v")


SNR = "(max(CASE WHEN k = 0 THEN v END) - avg(CASE WHEN k > 0 THEN v END)) / (stddev_pop(CASE WHEN k > 0 THEN v END) * sqrt(1 + 1.0 / count(CASE WHEN k > 0 THEN v END)))"


@query(f"WITH {APV} SELECT ext, id, {r6('max(CASE WHEN k = 0 THEN v END)')} AS signal, round({SNR}, 4) AS snr, count(CASE WHEN k > 0 THEN v END) AS n_noise FROM av GROUP BY ext, id")
def snr_mawet(spark, d):
    v = apertures.aperture_means(mean_image(spark, d), apertures.ring(locations(spark, d), 2.0), 2.0, N, N)
    return rounded(apertures.measured(v, ["ext", "id"]), "signal").withColumn("snr", F.round("snr", 4))


KERNEL = resample.tophat(2.0)
TOPHAT = f"k AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b})' for a, b, _ in KERNEL)}) t(dy, dx)), conv AS (SELECT im.frame_idx, im.ext, im.y, im.x, sum(coalesce(s.v, 0)) AS v FROM im, k LEFT JOIN im s ON s.ext = im.ext AND s.frame_idx = im.frame_idx AND s.y = im.y - dy AND s.x = im.x - dx GROUP BY 1, 2, 3, 4)"


@query(f"WITH {MEAN}, {TOPHAT} SELECT ext, y, x, {r6('v')} AS v FROM conv")
def tophat_convolve(spark, d):
    return rounded(resample.convolved(mean_image(spark, d), KERNEL).select("ext", "y", "x", "v"), "v")


IWA, OWA = geometry.working_radii(N, N, 2.0, 0)
SNR_MAP = f"""spot AS (SELECT ext, y AS py, x AS px, {RHO} AS r_px, (degrees({PHI}) - 90 + 720) % 360 AS pa_deg FROM conv WHERE {RHO} >= {IWA!r}::DOUBLE AND {RHO} <= {OWA!r}::DOUBLE),
    rg AS (SELECT *, CAST(floor(2 * pi() * r_px / 2) AS INTEGER) AS m FROM spot),
    ak AS (SELECT rg.*, k, round_even(round(r_px * sin(radians(pa_deg + 90) + k * (2 * pi() / m)) + 3.5, 9), 0) AS ay, round_even(round(r_px * cos(radians(pa_deg + 90) + k * (2 * pi() / m)) + 3.5, 9), 0) AS ax FROM rg, range(50) t(k) WHERE k < m),
    sm AS (SELECT ak.ext, py AS y, px AS x, {SNR} AS snr, count(CASE WHEN k > 0 THEN v END) AS n_noise FROM ak JOIN conv ON conv.ext = ak.ext AND conv.y = ay AND conv.x = ax GROUP BY 1, 2, 3)"""


@query(f"WITH {MEAN}, {TOPHAT}, {SNR_MAP} SELECT ext, y, x, round(snr, 4) AS snr, n_noise FROM sm WHERE n_noise >= 2")
def snr_map(spark, d):
    conv = resample.convolved(mean_image(spark, d), KERNEL)
    return apertures.snr_map(conv, 2.0, IWA, OWA, 0, N, N).select("ext", "y", "x", F.round("snr", 4).alias("snr"), "n_noise")


LOCAL = "NOT EXISTS (SELECT 1 FROM {t} b WHERE b.ext = a.ext AND b.frame_idx = a.frame_idx AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2 AND b.v > a.v) AND a.y BETWEEN 2 AND 5 AND a.x BETWEEN 2 AND 5"


@query(f"WITH {MEAN} SELECT ext, y, x, {r6('v')} AS v FROM im a WHERE {LOCAL.format(t='im')}")
def local_maxima(spark, d):
    return rounded(apertures.local_maxima(mean_image(spark, d), N, N).select("ext", "y", "x", "v"), "v")


@query(f"WITH {PX}, p AS (SELECT frame_idx, ext, y, x, v FROM px a WHERE v > 0.1 AND {LOCAL.format(t='px')}) SELECT frame_idx, ext, y, x, {r6('v')} AS snr, {r6(RHO)} AS r_px, {r6('(degrees(' + PHI + ') - 90 + 720) % 360')} AS pa_deg, CAST(row_number() OVER (PARTITION BY frame_idx, ext ORDER BY v DESC, y, x) AS INTEGER) AS rank FROM p")
def snr_peaks(spark, d):
    return rounded(apertures.peaks(px(spark, d), 0.1, N, N), "snr", "r_px", "pa_deg")


def resample_sql(src: str, sx: str, sy: str, fill: float = 0.0) -> str:
    """CTEs: `to` has the bicubic values of source px at (sx, sy) of each destination pixel of the frames of src."""
    w = lambda t, i: [f"0.5 * (-{t} + 2 * {t}*{t} - {t}*{t}*{t})", f"0.5 * (2 - 5 * {t}*{t} + 3 * {t}*{t}*{t})", f"0.5 * ({t} + 4 * {t}*{t} - 3 * {t}*{t}*{t})", f"0.5 * ({t}*{t}*{t} - {t}*{t})"][i]
    case = lambda k, t: "CASE " + k + " " + " ".join(f"WHEN {i} THEN {w(t, i)}" for i in range(4)) + " END"
    return f"""sxy AS (SELECT frame_idx, ext, y, x, round({sx}, 9) AS sx, round({sy}, 9) AS sy FROM {src}),
    sf AS (SELECT *, floor(sx) AS xi, floor(sy) AS yi, sx - floor(sx) AS tx, sy - floor(sy) AS ty FROM sxy),
    sn AS (SELECT f.frame_idx, f.ext, f.y, f.x, {case('i', 'ty')} AS wy, {case('j', 'tx')} AS wx, p.v AS v FROM sf f, range(4) a(i), range(4) b(j) LEFT JOIN {src} p ON p.frame_idx = f.frame_idx AND p.ext = f.ext AND p.y = f.yi + i - 1 AND p.x = f.xi + j - 1),
    "to" AS (SELECT frame_idx, ext, y, x, CASE WHEN count(v) > 8 THEN sum(wy * wx * coalesce(v, {fill})) END AS v FROM sn GROUP BY 1, 2, 3, 4)"""


ANG = "radians((frame_idx * 7.0) % 360)"
TURN = resample_sql("px", f"cos({ANG}) * x + sin({ANG}) * y + 3.5 - cos({ANG}) * 3.5 - sin({ANG}) * 3.5", f"-sin({ANG}) * x + cos({ANG}) * y + 3.5 + sin({ANG}) * 3.5 - cos({ANG}) * 3.5")


def angle():
    return F.pmod(F.col("frame_idx") * 7.0, F.lit(360.0))


@query(f"WITH {PX}, {TURN} SELECT frame_idx, ext, y, x, round(v, 4) + 0.0 AS v FROM \"to\" WHERE v IS NOT NULL")
def derotate_cube(spark, d):
    return pixels(resample.derotated(fr(spark, d), angle())).where("v is not null").withColumn("v", F.round("v", 4) + F.lit(0.0))


@query(f"WITH {PX}, {TURN} SELECT ext, y, x, round(avg(v), 4) + 0.0 AS v, count(v) AS n FROM \"to\" GROUP BY ext, y, x HAVING count(v) > 2")
def adi_stack(spark, d):
    turned = pixels(resample.derotated(fr(spark, d), angle()))
    return turned.groupBy("ext", "y", "x").agg((F.round(F.avg("v"), 4) + F.lit(0.0)).alias("v"), F.count("v").alias("n")).where("n > 2")


@query(f"WITH {PX}, {resample_sql('px', 'x - 0.3', 'y + 0.4')} SELECT frame_idx, ext, y, x, {r6('v')} AS v FROM \"to\" WHERE v IS NOT NULL")
def shift2(spark, d):
    return rounded(pixels(resample.shifted(fr(spark, d), F.lit(0.3), F.lit(-0.4))).where("v is not null"), "v")


@query(f"WITH {PX}, {resample_sql('px', '(x - 3.5) / 1.3 + 3.5', '(y - 3.5) / 1.3 + 3.5')} SELECT frame_idx, ext, y, x, {r6('v')} AS v FROM \"to\" WHERE v IS NOT NULL")
def rescale_about_center(spark, d):
    return rounded(pixels(resample.rescaled(fr(spark, d), F.lit(1.3))).where("v is not null"), "v")


HOLES = "(frame_idx + y * x) % 7 = 0"


@query(f"WITH {PX}, h AS (SELECT frame_idx, ext, y, x, CASE WHEN {HOLES} THEN NULL ELSE v END AS v FROM px) SELECT a.frame_idx, a.ext, a.y, a.x, {r6('coalesce(a.v, avg(b.v), 0)')} AS v FROM h a LEFT JOIN h b ON a.v IS NULL AND b.frame_idx = a.frame_idx AND b.ext = a.ext AND b.y BETWEEN a.y - 1 AND a.y + 2 AND b.x BETWEEN a.x - 1 AND a.x + 2 GROUP BY a.frame_idx, a.ext, a.y, a.x, a.v")
def interpolate_nonfinite(spark, d):
    holes = px(spark, d).withColumn("v", F.when(~F.expr(HOLES), F.col("v")))
    return rounded(resample.filled(holes), "v").select("frame_idx", "ext", "y", "x", "v")


@query(f"WITH {PX}, m AS (SELECT y, x FROM px GROUP BY y, x HAVING avg(v) > 0.01) SELECT DISTINCT p.y, p.x FROM px p JOIN m ON abs(p.y - m.y) + abs(p.x - m.x) <= 1")
def binary_dilation(spark, d):
    m = px(spark, d).groupBy("y", "x").agg(F.avg("v").alias("v")).where("v > 0.01").select("y", "x")
    return masks.dilated(m, 1, N, N)


@query(f"WITH {PX}, g AS (SELECT DISTINCT y, x FROM px), m AS (SELECT y, x FROM px GROUP BY y, x HAVING avg(v) > 0.01), di AS (SELECT DISTINCT g.y, g.x FROM g JOIN m ON abs(g.y - m.y) + abs(g.x - m.x) <= 1) SELECT y, x FROM di WHERE (SELECT count(*) FROM di e WHERE abs(e.y - di.y) + abs(e.x - di.x) <= 1) = 5")
def binary_closing(spark, d):
    m = px(spark, d).groupBy("y", "x").agg(F.avg("v").alias("v")).where("v > 0.01").select("y", "x")
    return masks.closed(m, grid(spark, N, N), 1, N, N)


@query(f"WITH {PX} SELECT frame_idx, ext, arg_max(y, struct_pack(v := v, n := -(y * 8 + x))) AS peak_y, arg_max(x, struct_pack(v := v, n := -(y * 8 + x))) AS peak_x FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY frame_idx, ext")
def rough_peak_in_box(spark, d):
    first = F.struct("v", -(F.col("y") * N + F.col("x")))
    inside = px(spark, d).where("y between 1 and 6 and x between 1 and 6")
    return inside.groupBy("frame_idx", "ext").agg(F.max_by("y", first).alias("peak_y"), F.max_by("x", first).alias("peak_x"))


@query(f"WITH {PX} SELECT frame_idx, ext FROM px GROUP BY frame_idx, ext HAVING min(v) <> max(v)")
def flat_frame_rejection(spark, d):
    return selection.not_flat(px(spark, d))


@query(f"WITH {PX}, m AS (SELECT *, max(v) OVER (PARTITION BY frame_idx, ext) AS m FROM px) SELECT frame_idx, ext, y, x, CASE WHEN v >= 0.5 * m THEN v ELSE 0 END AS v FROM m")
def trim_model(spark, d):
    return selection.trimmed_model(px(spark, d), 0.5).select("frame_idx", "ext", "y", "x", "v")


@query(f"WITH {PX} SELECT DISTINCT y, x FROM px WHERE (y, x) NOT IN (SELECT (y, x) FROM px GROUP BY y, x HAVING max(v) > 0.35)")
def pixels_without_signal(spark, d):
    return selection.without_signal(px(spark, d), 0.35)


@query(f"SELECT n_nationkey AS k, {r6('5 * log10((10 + n_nationkey) / 10.0) + 1.5')} AS apparent, {r6('-2.5 * log10(0.001 * (1 + n_nationkey))')} AS deltamag, {r6('pow(10, (2 + n_nationkey * 0.1) / -2.5)')} AS contrast, {r6('abs(-2.5 * 0.3 / ((1 + n_nationkey) * ln(10)))')} AS mag_err FROM nation")
def contrast_deltamag(spark, d):
    k = F.col("n_nationkey")
    t = spark.read.parquet(f"{d}/nation.parquet")
    return rounded(t.select(k.alias("k"), photometry.apparent_mag(F.lit(1.5), 10.0 + k).alias("apparent"), photometry.contrast_to_deltamag(0.001 * (1 + k)).alias("deltamag"), photometry.deltamag_to_contrast(2 + k * 0.1).alias("contrast"), photometry.stddev_to_mag_err(1 + k, F.lit(0.3)).alias("mag_err")), "apparent", "deltamag", "contrast", "mag_err")


@query(f"SELECT n_nationkey AS k, {r6('n_nationkey * (3.9e-6 / 6.5 * 180 * 3600 / pi())')} AS arcsec, {r6('n_nationkey * 0.1 / (3.9e-6 / 6.5 * 180 * 3600 / pi())')} AS lamd, {r6('n_nationkey / 0.01585')} AS px FROM nation")
def lambda_over_d(spark, d):
    k = F.col("n_nationkey")
    t = spark.read.parquet(f"{d}/nation.parquet")
    return rounded(t.select(k.alias("k"), photometry.lambda_over_d_to_arcsec(k, 3.9e-6, 6.5).alias("arcsec"), photometry.arcsec_to_lambda_over_d(k * 0.1, 3.9e-6, 6.5).alias("lamd"), photometry.arcsec_to_pixel(k, 0.01585).alias("px")), "arcsec", "lamd", "px")


def _template(n: int = 4):
    return resample.gauss2d(n, n, (n - 1) / 2, (n - 1) / 2, 1.0, 1.0)


def _weights_sql(i: str, t: str) -> str:
    """The bicubic kernel's weight of tap i of 4 at the fraction t."""
    w = [f"0.5 * (-{t} + 2 * {t}*{t} - {t}*{t}*{t})", f"0.5 * (2 - 5 * {t}*{t} + 3 * {t}*{t}*{t})", f"0.5 * ({t} + 4 * {t}*{t} - 3 * {t}*{t}*{t})", f"0.5 * ({t}*{t}*{t} - {t}*{t})"]
    return f"CASE {i} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(w)) + " END"


INJECTED = f"""c AS (SELECT * FROM (VALUES (2.0::DOUBLE, 30.0::DOUBLE, 0.5::DOUBLE), (2.5, 200.0, 0.25)) t(r, pa, scale)),
    tp AS (SELECT i AS ty, j AS tx, exp(-0.5 * ((i - 1.5) * (i - 1.5) + (j - 1.5) * (j - 1.5)))::DOUBLE AS t FROM range(4) a(i), range(4) b(j)),
    s AS (SELECT frame_idx, ext, y, x, r, scale, round(x - (r * cos(radians(90 + pa - (frame_idx * 7.0) % 360)) + 3.5 - 1.5), 9) AS sx, round(y - (r * sin(radians(90 + pa - (frame_idx * 7.0) % 360)) + 3.5 - 1.5), 9) AS sy FROM px, c),
    n AS (SELECT s.*, {_weights_sql('i', '(sy - floor(sy))')} AS wy, {_weights_sql('j', '(sx - floor(sx))')} AS wx, t FROM s, range(4) a(i), range(4) b(j) LEFT JOIN tp ON ty = floor(sy) + i - 1 AND tx = floor(sx) + j - 1),
    one AS (SELECT frame_idx, ext, y, x, r, scale * CASE WHEN count(t) > 8 THEN sum(wy * wx * coalesce(t, 0)) ELSE 0 END AS add_v FROM n GROUP BY frame_idx, ext, y, x, r, scale),
    more AS (SELECT frame_idx, ext, y, x, sum(add_v) AS add_v FROM one GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {PX}, {INJECTED} SELECT frame_idx, ext, y, x, {r6('least(v + add_v, 0.6)')} AS v FROM px JOIN more USING (frame_idx, ext, y, x)")
def inject_signals(spark, d):
    companions = spark.createDataFrame([(2.0, 30.0, 0.5), (2.5, 200.0, 0.25)], "r_px double, pa_deg double, scale double")
    return rounded(pixels(resample.injected(fr(spark, d), companions, _template(), angle(), clip=0.6)), "v")


@query("SELECT vec_id AS frame_idx, label AS ext, 2.0::DOUBLE AS dy, -1.0::DOUBLE AS dx FROM embeddings")
def phase_shift(spark, d):
    """Each frame's offset from itself shifted by a known amount."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("dy double, dx double")
    def measure(pix, ny, nx):
        import pandas as pd

        out = []
        for p, a, b in zip(pix, ny, nx, strict=True):
            img = resample.image(p, a, b)
            out.append(resample.phase_shift(img, resample.fourier_shift(img, 1.0, -2.0)))
        return pd.DataFrame(out, columns=["dy", "dx"])

    return fr(spark, d).withColumn("m", measure("pix", "ny", "nx")).select("frame_idx", "ext", F.round("m.dy", 2).alias("dy"), F.round("m.dx", 2).alias("dx"))


#: The Gaussian's transform back in one direction of 8 pixels, at each wrapped offset.
WRAPPED = ", ".join(f"({k}, {sum(math.exp(-2 * (math.pi * f / 8) ** 2) * math.cos(2 * math.pi * f * k / 8) for f in range(-4, 4)) / 8!r}::DOUBLE)" for k in range(8))


@query(f"WITH {PX}, g AS (SELECT * FROM (VALUES {WRAPPED}) t(o, w)), h AS (SELECT frame_idx, ext, y, (x + o) % 8 AS x, sum(v * w) AS v FROM px, g GROUP BY frame_idx, ext, y, (x + o) % 8) SELECT frame_idx, ext, CAST((y + o) % 8 AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {r6('sum(v * w)')} AS v FROM h, g GROUP BY frame_idx, ext, (y + o) % 8, x")
def gaussian_smooth(spark, d):
    return rounded(pixels(resample.smoothed(fr(spark, d), 1.0)), "v")


assert math.isclose(C, geometry.centre(N))
