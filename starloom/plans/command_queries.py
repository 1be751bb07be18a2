"""Queries of filters, datasets and whole commands: the embeddings as frames, lineitem as a calibration grid, events as observations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from starloom.model import repacked
from starloom.operators import datasets, filters, selection
from starloom.plans import commands
from starloom.plans.pixel_queries import LOCAL, MEAN, PHI, RHO, SNR_MAP, TOPHAT, N, fr, mean_image, px, resample_sql, rounded
from starloom.plans.registry import PX, query, r6
from starloom.plans.table_queries import INDEX, ITEMS, SUMMARY, events, header_rows, items

HOLED = f"{PX}, h AS (SELECT frame_idx, ext, y, x, CASE WHEN (frame_idx + y * x) % 7 <> 0 THEN v END AS v FROM px)"
DISK = ", ".join(f"({a}, {b}, {w!r})" for a, b, w in filters.disk(1.5))


def holed(spark, d):
    return px(spark, d).withColumn("v", F.when(F.expr("(frame_idx + y * x) % 7 <> 0"), F.col("v")))


@query(f"WITH {HOLED}, k AS (SELECT * FROM (VALUES {DISK}) t(dy, dx, w)), s AS (SELECT a.frame_idx, a.ext, a.y, a.x, sum(b.v * w) AS v FROM h a, k JOIN h b ON b.frame_idx = a.frame_idx AND b.ext = a.ext AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4) SELECT frame_idx, ext, y, x, {r6('CASE WHEN h.v IS NOT NULL THEN coalesce(s.v, 0) END')} AS v FROM h LEFT JOIN s USING (frame_idx, ext, y, x)")
def tophat_pre_filter(spark, d):
    return rounded(filters.tophat(holed(spark, d), 1.5), "v")


def moved(r: float, pa: float, angle: str = "0.0") -> tuple[str, str]:
    """Source coordinates of a model whose companion at (r, pa) is moved to the centre."""
    turn = f"radians(90 + {pa!r} - ({angle}))"
    return f"x + {r!r} * cos({turn})", f"y + {r!r} * sin({turn})"


ANGLE = "(frame_idx * 7.0) % 360"
MODELS = "md AS (SELECT frame_idx, ext, y, x, abs(v) AS v FROM px)"


def model_frames(spark, d):
    return fr(spark, d).withColumn("pix", F.transform("pix", lambda v: F.abs(v.cast("double"))))


def kernel_sql(by: str) -> str:
    return f"""nk AS (SELECT frame_idx, ext, y - 3 AS dy, x - 3 AS dx, v FROM "to" WHERE {RHO} <= 1.6), ss AS (SELECT frame_idx, ext, sum(v * v) AS ss, count(v) = count(*) AS whole FROM nk GROUP BY 1, 2 HAVING sum(v * v) > 0),
    kn AS (SELECT frame_idx, ext, dy, dx, coalesce(v, 0) / ss AS w, whole FROM nk JOIN ss USING (frame_idx, ext)),
    mf AS (SELECT a.frame_idx, a.ext, a.y, a.x, min(CAST(whole AS INTEGER)) AS whole, sum(w * coalesce(b.v, 0)) AS v FROM im0 a JOIN kn ON {by} LEFT JOIN im0 b ON b.frame_idx = a.frame_idx AND b.ext = a.ext AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {PX}, {MODELS}, {resample_sql('md', *moved(1.2, 40.0, ANGLE))}, im0 AS (SELECT frame_idx, ext, y, x, v FROM px), {kernel_sql('kn.frame_idx = a.frame_idx AND kn.ext = a.ext')} SELECT frame_idx, ext, y, x, round(v, 4) + 0.0 AS v FROM mf")
def matched_pre_filter(spark, d):
    angle = F.pmod(F.col("frame_idx") * 7.0, F.lit(360.0))
    return filters.pre_matched(px(spark, d), model_frames(spark, d), 1.2, 40.0, 1.6, N, N, angle).withColumn("v", F.round("v", 4) + F.lit(0.0))


DISK1 = ", ".join(f"({a}, {b}, {w!r})" for a, b, w in filters.disk(1.0))


@query(f"""WITH {PX}, im0 AS (SELECT 0 AS frame_idx, ext, y, x, avg(v) AS v FROM px GROUP BY ext, y, x), md AS (SELECT 0 AS frame_idx, ext, y, x, avg(abs(v)) AS v FROM px GROUP BY ext, y, x), {resample_sql('md', *moved(0.9, 70.0))}, {kernel_sql('kn.ext = a.ext')},
    k AS (SELECT * FROM (VALUES {DISK1}) t(dy, dx, w)) SELECT 'matched' AS filter_name, ext, y, x, CASE WHEN whole = 1 THEN round(v, 4) + 0.0 END AS v FROM mf
    UNION ALL SELECT 'tophat', a.ext, a.y, a.x, round(sum(b.v * w), 4) + 0.0 FROM im0 a, k JOIN im0 b ON b.ext = a.ext AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.ext, a.y, a.x""")
def post_filters(spark, d):
    """Both filters of the mean image of each extension; the matched one by the mean model."""
    p = px(spark, d)
    image = datasets.extension_mean(p).withColumn("frame_idx", F.lit(0))
    model = repacked(datasets.extension_mean(p.withColumn("v", F.abs("v"))).withColumn("frame_idx", F.lit(0)), N, N)
    return filters.post_filters(image, model, 0.9, 70.0, 2.0, N, N, 1.6).select("filter_name", "ext", "y", "x", (F.round("v", 4) + F.lit(0.0)).alias("v"))


PER = math.degrees(3.9e-6 / 6.5) * 3600


@query(f"""WITH {MEAN}, {TOPHAT}, {SNR_MAP}, w AS (SELECT im.frame_idx, im.ext, im.y, im.x, CASE WHEN n_noise >= 2 THEN coalesce(snr, 0) ELSE 0 END AS v FROM im LEFT JOIN sm USING (ext, y, x)),
    p AS (SELECT ext, y, x, v FROM w a WHERE v > 0.2 AND {LOCAL.format(t='w')}) SELECT ext, y, x, round(v, 4) AS snr, {r6(RHO)} AS r_px, {r6('(degrees(' + PHI + ') - 90 + 720) % 360')} AS pa_deg, CAST(row_number() OVER (PARTITION BY ext ORDER BY v DESC, y, x) AS INTEGER) AS rank FROM p""")
def evaluate_blind_search(spark, d):
    none = spark.createDataFrame([], "r_px double, pa_deg double")
    found = commands.evaluated(mean_image(spark, d), none, 2.0, 0, N, N, 0.2)[1]
    return rounded(found.select("ext", "y", "x", F.round("snr", 4).alias("snr"), "r_px", "pa_deg", "rank"), "r_px", "pa_deg")


def summarised(spark, d):
    return commands.grid_summarised(items(spark, d), [], ["param"], INDEX, 2.0, 6.0, 0.05, 3.9e-6, 6.5)


@query(f"WITH {SUMMARY} SELECT r_px, pa_deg, l_orderkey, {r6('c')} AS contrast_limit_snr5, {r6('-2.5 * log10(c)')} AS delta_mag, {r6('r_px * 0.05')} AS r_as, {r6(f'r_px * 0.05 / {PER!r}')} AS r_lambda_over_d FROM best SEMI JOIN (SELECT * FROM det WHERE snr < 6) q USING (r_px, pa_deg)")
def grid_command_limits(spark, d):
    got = summarised(spark, d)[0].select("r_px", "pa_deg", "l_orderkey", "contrast_limit_snr5", F.col("delta_mag_contrast_limit_snr5").alias("delta_mag"), "r_as", "r_lambda_over_d")
    return rounded(got, "contrast_limit_snr5", "delta_mag", "r_as", "r_lambda_over_d")


@query(f"""WITH RECURSIVE {SUMMARY}, lr AS (SELECT DISTINCT r_px AS v FROM best SEMI JOIN (SELECT * FROM det WHERE snr < 6) q USING (r_px, pa_deg)),
    sp AS (SELECT 0.0::DOUBLE AS v UNION ALL SELECT (SELECT min(lr.v) FROM lr WHERE lr.v - sp.v >= {PER / 0.05!r}) FROM sp WHERE EXISTS (SELECT 1 FROM lr WHERE lr.v - sp.v >= {PER / 0.05!r}))
    SELECT r_px, pa_deg, param, l_orderkey, {r6('snr')} AS snr, {r6('r_px * 0.05')} AS r_as, {r6(f'r_px * 0.05 / {PER!r}')} AS r_lambda_over_d FROM det WHERE r_px IN (SELECT v FROM sp WHERE v > 0)""")
def grid_command_detections(spark, d):
    return rounded(summarised(spark, d)[1].select("r_px", "pa_deg", "param", "l_orderkey", "snr", "r_as", "r_lambda_over_d"), "snr", "r_as", "r_lambda_over_d")


GRID_SQL = """p AS (SELECT 5.0 + i * 5 AS r_px, CAST(floor(2 * pi() * (5.0 + i * 5) / 6) AS INTEGER) AS n FROM range(3) t(i)), pl AS (SELECT r_px, j * (360.0::DOUBLE / n) AS pa_deg, row_number() OVER (ORDER BY r_px, j) - 1 AS pi FROM p, range(100) t(j) WHERE j < n), pn AS (SELECT count(*) AS pn FROM pl),
    g AS (SELECT ((((((di * pn + pi) * 2 + si) * 2 + ki) * 2 + ai) * 2 + ei) * 2 + fi) AS "index", r_px::DOUBLE AS r_px, pa_deg, ARRAY[1, 4][di + 1] AS decimate_frames_by, ARRAY[0.0, 0.01][si + 1]::DOUBLE AS injected_scale, ARRAY[5, 10][ki + 1] AS k_modes_requested, ARRAY[0.0, 2.0][ai + 1]::DOUBLE AS annulus_resel, ARRAY['left', 'right'][ei + 1] AS ext, ARRAY['tophat', 'matched'][fi + 1] AS filter_name
    FROM pl, pn, range(2) a(di), range(2) b(si), range(2) c(ki), range(2) d(ai), range(2) e(ei), range(2) f(fi))"""


def tasks_grid(spark):
    return commands.measurement_grid(spark, 5, 15, 3, 6, [0.01], [1, 4], [5, 10], [0, 2], ["right", "left"])


@query(f'WITH {GRID_SQL} SELECT "index", 0.0::DOUBLE AS time_total_sec, r_px, {r6("pa_deg")} AS pa_deg, decimate_frames_by, injected_scale, k_modes_requested, annulus_resel, ext, filter_name FROM g')
def measurement_grid(spark, d):
    return rounded(tasks_grid(spark), "pa_deg")


@query(f'WITH {GRID_SQL} SELECT "index", (r_px * k_modes_requested + injected_scale)::DOUBLE AS signal, count(*) OVER (PARTITION BY r_px, pa_deg, annulus_resel, injected_scale, decimate_frames_by) AS n_in_task FROM g')
def grid_tasks(spark, d):
    """One execution for all points of a task."""

    def work(t):
        return t[["index"]].assign(signal=t["r_px"] * t["k_modes_requested"] + t["injected_scale"], n_in_task=len(t))

    return commands.tasks_run(tasks_grid(spark), work, "index long, signal double, n_in_task long")


@query(f"WITH {ITEMS}, k AS (SELECT r_px, scale, avg(r_px * 2 + scale) AS model FROM g GROUP BY r_px, scale) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6('model')} AS model FROM g JOIN k USING (r_px, scale)")
def lookup_by_key(spark, d):
    got = commands.computed_once(items(spark, d), ["r_px", "scale"], lambda keys: keys.withColumn("model", F.col("r_px") * 2 + F.col("scale")))
    return rounded(got.select(*INDEX, "model"), "model")


@query(f"WITH {ITEMS}, r AS (SELECT DISTINCT r_px AS r0 FROM g), n AS (SELECT r0, snr FROM g JOIN r ON abs(r_px - r0) < 2.5 WHERE l_returnflag <> 'R'), m AS (SELECT r0, median(snr) AS m FROM n GROUP BY r0), s AS (SELECT r0, 1.48 * median(abs(snr - m)) AS sigma FROM n JOIN m USING (r0) GROUP BY r0) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6('snr / nullif(sigma, 0)')} AS scaled FROM g LEFT JOIN s ON r0 = r_px")
def ring_scaled_snr(spark, d):
    got = commands.ring_scaled(items(spark, d), "r_px", "snr", 2.5, "scaled", F.col("l_returnflag") == "R")
    return rounded(got.select(*INDEX, "scaled"), "scaled")


@query("WITH a AS (SELECT i, i * 1.5 AS ang FROM range(200) t(i)) SELECT p.i, min(q.i) AS first, max(q.i) AS last, count(*) AS n FROM a p JOIN a q ON abs(q.i - p.i) <= 3 OR abs(10 * radians(q.ang) - 10 * radians(p.ang)) <= 1.1 GROUP BY p.i")
def exclusion_criteria(spark, d):
    """By nearest frames and by pixels of rotation at a radius, through a full turn's wrap."""
    return commands.exclusion_table(spark, commands.exclusions((np.arange(200) * 1.5 + 180) % 360, nearest=3, px=(10.0, 1.1)))


@query("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS frame_idx, event_id, json_extract_string(props, '$.k') AS K, json_extract_string(props, '$.k') IS NULL AS K_missing, CAST(value AS DOUBLE) * 2 + 10 AS derotation_angle_deg FROM events WHERE event_type = 'click'")
def collect_dataset(spark, d):
    files = header_rows(spark, d).withColumn("header", F.map_concat("header", F.create_map(F.lit("DATE-OBS"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))))
    table = datasets.collected(files, "event_id", [("EVTYPE", "eq", "click")], ["K", "EXPTIME"])
    return datasets.with_derotation(table, "EXPTIME", 2.0, 10.0).select("frame_idx", "event_id", "K", "K_missing", "derotation_angle_deg")


@query(f"WITH {PX}, t AS (SELECT vec_id, label, row_number() OVER (ORDER BY (vec_id * 7919) % 10007, vec_id) - 1 AS f FROM embeddings WHERE label <> 1) SELECT f AS frame_idx, ext, y, x, {r6('CAST(CAST(v AS FLOAT) AS DOUBLE)')} AS v FROM px JOIN t ON vec_id = frame_idx AND label = ext")
def collect_pixels(spark, d):
    files = fr(spark, d).select("frame_idx", "ext").withColumn("header", F.create_map(F.lit("DATE-OBS"), F.lpad(((F.col("frame_idx") * 7919) % 10007).cast("string"), 6, "0"), F.lit("EXT"), F.col("ext").cast("string")))
    table = datasets.collected(files.withColumnRenamed("frame_idx", "file"), "file", [("EXT", "ne", "1")], [])
    return rounded(datasets.stacked_pixels(px(spark, d).withColumnRenamed("frame_idx", "file"), table, "file", "float").withColumn("v", F.col("v").cast("double")), "v")


@query("SELECT vec_id AS frame_idx, CASE WHEN label = 2 OR label = 3 THEN 'new' ELSE 'old' END AS kw, CASE WHEN label = 2 THEN 'kept' END AS more, CASE WHEN label = 3 THEN 0.0::DOUBLE ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def update_extensions(spark, d):
    hdus = fr(spark, d).select("frame_idx", F.col("ext").alias("ext_idx"), F.concat(F.lit("Ext_"), F.col("ext")).alias("extname"), F.transform("pix", lambda v: v.cast("double")).alias("pix"), F.create_map(F.lit("KW"), F.lit("old")).alias("header"))
    got = datasets.updated_extensions(hdus, {"EXT_3": F.transform("pix", lambda v: v * 0.0)}, {2: {"KW": "new", "MORE": "kept"}, "ext_3": {"KW": "new"}})
    return got.select("frame_idx", F.col("header")["KW"].alias("kw"), F.try_element_at("header", F.lit("MORE")).alias("more"), (F.round(F.col("pix")[0], 6) + F.lit(0.0)).alias("first"))


@query("SELECT vec_id AS frame_idx, label AS ext, CASE WHEN label < 3 THEN round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def filter_in_place(spark, d):
    return datasets.filtered_in_place(fr(spark, d).select("frame_idx", "ext", F.round(F.col("pix")[0].cast("double"), 6).alias("first")), F.col("ext") < 3, "first")


@query(f"WITH {PX} SELECT ext, y, x, {r6('avg(CASE WHEN (frame_idx + y * x) % 7 <> 0 THEN v END)')} AS v FROM px GROUP BY ext, y, x")
def extension_mean(spark, d):
    return rounded(datasets.extension_mean(holed(spark, d)), "v")


@query("SELECT DISTINCT CAST(l_orderkey % 512 - 312 AS INTEGER) AS y, CAST(CASE WHEN l_partkey % 1024 < 512 THEN l_partkey % 1024 ELSE l_partkey % 1024 - 312 END AS INTEGER) AS x FROM lineitem WHERE l_orderkey % 512 >= 312 AND (l_partkey % 1024 < 200 OR l_partkey % 1024 BETWEEN 512 AND 711)")
def readout_badpix(spark, d):
    """A detector's bad pixels in its 200 x 400 readout."""
    bad = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 512).alias("y"), (F.col("l_partkey") % 1024).alias("x")).distinct()
    return datasets.subarray(bad, (200, 400))


@query(f"WITH {PX}, s AS (SELECT *, 'a' AS input_id FROM px WHERE y < 4 UNION ALL SELECT *, 'b' FROM px WHERE y >= 4), e AS (SELECT * FROM (VALUES ('a', 'left'), ('b', 'left'), ('b', 'right')) t(input_id, destination)) SELECT destination, input_id, y, x, {r6('avg(v)')} AS v FROM s JOIN e USING (input_id) GROUP BY 1, 2, 3, 4")
def stack_inputs(spark, d):
    """Two inputs as one matrix, split back and sent to their destinations."""
    p = px(spark, d)
    both = datasets.inputs_stacked({"a": p.where("y < 4"), "b": p.where("y >= 4")})
    again = datasets.inputs_stacked({k: datasets.input_of(both, k) for k in ("a", "b")})
    out = datasets.to_destinations(again, {"a": ["left"], "b": ["left", "right"]})
    return rounded(out.groupBy("destination", "input_id", "y", "x").agg(F.avg("v").alias("v")), "v")


@query(f"WITH {PX}, r AS (SELECT 5 AS k, frame_idx % 3 AS chunk, ext, f AS filter_name, y, x, avg(CASE WHEN (frame_idx + y * x) % 7 <> 0 THEN v END) AS v, count(CASE WHEN (frame_idx + y * x) % 7 <> 0 THEN v END) AS n FROM px, (VALUES ('unfiltered'), ('tophat')) t(f) GROUP BY ALL) SELECT k, ext, filter_name, y, x, {r6('CASE WHEN filter_name = ' + chr(39) + 'unfiltered' + chr(39) + ' THEN coalesce(sum(v), 0) ELSE avg(v) END')} AS v, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3, 4, 5")
def combine_chunk_results(spark, d):
    one = holed(spark, d).withColumn("filter_name", F.explode(F.array(F.lit("unfiltered"), F.lit("tophat")))).withColumn("chunk", F.col("frame_idx") % 3)
    results = one.groupBy(F.lit(5).alias("k"), "chunk", "ext", "filter_name", "y", "x").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    return rounded(datasets.chunks_combined(results), "v")


@query("WITH p AS (SELECT vec_id AS frame_idx, label AS ext, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i) WHERE i // 8 BETWEEN 1 AND 5 AND i % 8 BETWEEN 2 AND 6), b AS (SELECT frame_idx, ext, y, x FROM p QUALIFY row_number() OVER (PARTITION BY frame_idx, ext ORDER BY v DESC, y, x) = 1) SELECT frame_idx, ext, CASE WHEN y BETWEEN 2 AND 4 AND x BETWEEN 3 AND 5 THEN y ELSE 3 END AS peak_y, CASE WHEN y BETWEEN 2 AND 4 AND x BETWEEN 3 AND 5 THEN x ELSE 4 END AS peak_x, y BETWEEN 2 AND 4 AND x BETWEEN 3 AND 5 AS found FROM b")
def peak_in_box(spark, d):
    return selection.peak_in_box(px(spark, d), selection.Box(1, 2, 5, 5), N, N)


@query("SELECT vec_id AS frame_idx, label AS ext, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first, 2.5::DOUBLE AS factor FROM embeddings")
def zip_items(spark, d):
    f = fr(spark, d)
    got = datasets.zipped(f.select("frame_idx", "ext"), f.select("frame_idx", (F.round(F.col("pix")[0].cast("double"), 6) + F.lit(0.0)).alias("first")), "frame_idx", {"factor": 2.5})
    return got.select("frame_idx", "ext", "first", "factor")
