"""Queries on tables: events as observation logs (a user a sequence), lineitem and orders as calibration grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import combine, grid, headers
from starloom.plans.pixel_queries import rounded
from starloom.plans.registry import query, r6
from starloom.sources import regions

DAY3 = 3 * 86400


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def items(spark, d):
    """A calibration grid: quantity the radius, line number the angle, tax the injected scale, discount a parameter, price the snr."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("r_px"), F.col("l_linenumber").alias("pa_deg"), F.col("l_tax").alias("scale"), F.col("l_discount").alias("param"), (F.col("l_extendedprice") / 10000).alias("snr"), "l_returnflag")


ITEMS = "g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS r_px, l_linenumber AS pa_deg, l_tax AS scale, l_discount AS param, l_extendedprice / 10000 AS snr, l_returnflag FROM lineitem)"
INDEX = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def greedy_sql(source: str, delta: float) -> str:
    """`ch` has the rows of source (seq, k, t) with their chunk; k counts a sequence's rows from 1."""
    return f"""ch AS (SELECT seq, k, t, t AS t0, 0::BIGINT AS chunk FROM {source} WHERE k = 1 UNION ALL
    SELECT s.seq, s.k, s.t, CASE WHEN s.t - c.t0 >= {delta} THEN s.t ELSE c.t0 END, c.chunk + CASE WHEN s.t - c.t0 >= {delta} THEN 1 ELSE 0 END FROM ch c JOIN {source} s ON s.seq = c.seq AND s.k = c.k + 1)"""


@query(f"WITH RECURSIVE s AS (SELECT user_id AS seq, event_type, value, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), {greedy_sql('s', DAY3)} SELECT seq AS user_id, chunk, count(*) AS n, {r6('avg(value)')} AS value, arg_min(event_type, k) AS event_type FROM ch JOIN s USING (seq, k) GROUP BY seq, chunk")
def combine_wall_time(spark, d):
    e = events(spark, d)
    ch = combine.greedy(e, ["user_id"], ["ts", "event_id"], headers.posix(F.col("ts")), DAY3)
    return rounded(combine.chunk_table(ch, ["user_id"], ["ts", "event_id"], ["value"], ["event_type"]), "value")


UNWRAP = """f AS (SELECT DISTINCT vec_id, label, (vec_id * 47.0) % 360 AS a FROM embeddings),
    j AS (SELECT *, a - lag(a) OVER (PARTITION BY label ORDER BY vec_id) AS jump FROM f),
    u AS (SELECT vec_id, label, a + sum(CASE WHEN jump > 180 THEN -360.0 WHEN jump < -180 THEN 360.0 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS unwrapped FROM j)"""


def angles(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.pmod(F.col("vec_id") * 47.0, F.lit(360.0)).alias("a"))


@query(f"WITH {UNWRAP} SELECT vec_id, label, {r6('unwrapped')} AS unwrapped FROM u")
def unwrap_angles(spark, d):
    return rounded(combine.unwrapped(angles(spark, d), ["label"], ["vec_id"], "a").select("vec_id", "label", "unwrapped"), "unwrapped")


MONO = f"{UNWRAP}, m AS (SELECT vec_id, label, (unwrapped - first(unwrapped ORDER BY vec_id) OVER w) * CASE WHEN last(unwrapped ORDER BY vec_id) OVER w < first(unwrapped ORDER BY vec_id) OVER w THEN -1 ELSE 1 END AS monotonic FROM u WINDOW w AS (PARTITION BY label))"


@query(f"WITH RECURSIVE {MONO}, s AS (SELECT label AS seq, monotonic AS t, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM m), {greedy_sql('s', 300)} SELECT seq AS label, chunk, count(*) AS n, {r6('avg(t)')} AS monotonic FROM ch GROUP BY seq, chunk")
def combine_angle_range(spark, d):
    m = combine.monotonic(angles(spark, d), ["label"], ["vec_id"], "a")
    ch = combine.greedy(m, ["label"], ["vec_id"], F.col("monotonic"), 300)
    return rounded(combine.chunk_table(ch, ["label"], ["vec_id"], ["monotonic"], []), "monotonic")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING) AS n_excluded FROM events")
def frame_exclusion_counts(spark, d):
    return combine.exclusion_counts(events(spark, d), ["user_id"], F.floor(headers.posix(F.col("ts"))), 3600).select("user_id", "event_id", "n_excluded")


@query("WITH g AS (SELECT user_id, event_id, lead(event_id) OVER w AS next_event_id, epoch_us(lead(ts) OVER w) / 1e6 - epoch_us(ts) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), m AS (SELECT user_id, median(gap) AS m FROM g WHERE gap IS NOT NULL GROUP BY user_id) SELECT user_id, event_id, next_event_id, round(gap, 4) AS gap FROM g JOIN m USING (user_id) WHERE gap <= 2 * m")
def time_contiguous_pairs(spark, d):
    return combine.contiguous_pairs(events(spark, d), ["user_id"], ["event_id"], headers.posix(F.col("ts")), 2.0).withColumn("gap", F.round("gap", 4))


@query("SELECT i AS chunk, i * 3 AS lo, least(i * 3 + 5, n) AS hi FROM (SELECT count(*) AS n FROM nation), range(100) t(i) WHERE i * 3 < n")
def chunk_slices_overlap(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").count()
    return combine.overlapping(n, 5, 3, spark)


KW = """kws AS (SELECT event_id, 'EVTYPE' AS kw, event_type AS value FROM events UNION ALL SELECT event_id, 'K', json_extract_string(props, '$.k') FROM events
    UNION ALL SELECT event_id, 'EXPTIME', CAST(value AS VARCHAR) FROM events UNION ALL SELECT event_id, 'TELESCOP', 'ALPHA' FROM events)"""


def header_rows(spark, d):
    head = F.create_map(F.lit("EVTYPE"), F.col("event_type"), F.lit("K"), F.get_json_object("props", "$.k"), F.lit("EXPTIME"), F.col("value").cast("string"), F.lit("TELESCOP"), F.lit("ALPHA"), F.lit("NAXIS1"), F.lit("8"))
    return events(spark, d).withColumn("header", head)


@query(f"WITH {KW} SELECT kw, count(DISTINCT coalesce(value, chr(1))) AS n_values, count(DISTINCT coalesce(value, chr(1))) > 1 AS varying, CASE WHEN count(DISTINCT coalesce(value, chr(1))) = 1 THEN min(value) END AS static_value FROM kws GROUP BY kw")
def static_varying_keywords(spark, d):
    return headers.split_keywords(headers.keywords(header_rows(spark, d), "event_id"))


@query(f"WITH {KW} SELECT kw, CASE WHEN bool_and(value IS NULL OR (try_cast(value AS BIGINT) IS NOT NULL AND NOT regexp_matches(value, '[.eE]'))) THEN 'int' WHEN bool_and(value IS NULL OR try_cast(value AS DOUBLE) IS NOT NULL) THEN 'float' ELSE 'string' END AS type FROM kws GROUP BY kw")
def keyword_types(spark, d):
    return headers.inferred(headers.keywords(header_rows(spark, d), "event_id"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS K, event_type AS EVTYPE FROM events")
def obs_table(spark, d):
    kws = headers.keywords(header_rows(spark, d), "event_id").where(F.col("kw").isin("K", "EVTYPE"))
    return headers.observations(kws, "event_id", ["K", "EVTYPE"])


@query("SELECT event_id, 'BETA' AS telescope, event_type AS evtype, 'x' AS observer FROM events")
def update_headers(spark, d):
    h = headers.updated(header_rows(spark, d), "header", {"TELESCOP": "BETA", "OBSERVER": "x"})
    return h.select("event_id", F.col("header")["TELESCOP"].alias("telescope"), F.col("header")["EVTYPE"].alias("evtype"), F.col("header")["OBSERVER"].alias("observer"))


@query(f"SELECT event_id, {r6('value * 2.5 + 90')} AS derotation_angle_deg, {r6('epoch_us(ts) / 1e6')} AS ts_sec FROM events")
def derotation_angle(spark, d):
    return rounded(events(spark, d).select("event_id", headers.derotation(F.col("value"), 2.5, 90.0).alias("derotation_angle_deg"), headers.posix(F.col("ts")).alias("ts_sec")), "derotation_angle_deg", "ts_sec")


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT DISTINCT FROM 'click' AND nullif(user_id, 3) IS DISTINCT FROM 8")
def header_filter_eq_ne(spark, d):
    e = events(spark, d).withColumn("u", F.expr("nullif(user_id, 3)"))
    return grid.kept(e, [("event_type", "eq", "click"), ("u", "ne", 8)]).select("event_id", "event_type")


@query(f"WITH {ITEMS} SELECT r_px, count(*) AS n FROM g WHERE r_px > 5 AND r_px <= 40 AND scale >= 0.01 AND param < 0.09 AND l_returnflag = 'R' GROUP BY r_px")
def predicate_ops(spark, d):
    k = grid.kept(items(spark, d), [("r_px", "gt", 5), ("r_px", "le", 40), ("scale", "ge", 0.01), ("param", "lt", 0.09), ("l_returnflag", "eq", "R")])
    return k.groupBy("r_px").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS}, done AS (SELECT DISTINCT r_px, pa_deg, scale FROM g WHERE l_returnflag = 'R') SELECT DISTINCT r_px, pa_deg, scale FROM g WHERE (r_px, pa_deg, scale) NOT IN (SELECT (r_px, pa_deg, scale) FROM done)")
def grid_pending_antijoin(spark, d):
    g = items(spark, d)
    keys = ["r_px", "pa_deg", "scale"]
    return grid.pending(g.select(*keys).distinct(), g.where("l_returnflag = 'R'").withColumn("time_total_sec", F.lit(1.0)), keys)


@query("WITH RECURSIVE dummy AS (SELECT 1), r AS (SELECT 5.0 + i * 2.5 AS r_px FROM range(5) t(i)), n AS (SELECT r_px, CAST(floor(2 * pi() * r_px / 4) AS INTEGER) AS n FROM r) SELECT r_px::DOUBLE AS r_px, round((10 + j * (360.0::DOUBLE / n)) % 360, 6) AS pa_deg, s::DOUBLE AS scale FROM n, range(200) t(j), (VALUES (0.0), (0.001), (0.01)) v(s) WHERE j < n")
def probe_grid(spark, d):
    return grid.probes(spark, 5, 15, 5, 4, [0.0, 0.001, 0.01], 10).withColumn("pa_deg", F.round("pa_deg", 6))


@query("SELECT n_nationkey AS r, r_regionkey AS k, s::DOUBLE AS scale FROM nation, region, (VALUES (0.0), (0.5)) v(s)")
def grid_product(spark, d):
    scales = spark.createDataFrame([(0.0,), (0.5,)], "scale double")
    return grid.product(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("r")), spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("k")), scales)


@query(f"WITH {ITEMS}, s AS (SELECT r_px, param, stddev_pop(snr) AS sd FROM g WHERE scale = 0 GROUP BY r_px, param) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6('snr / nullif(coalesce(sd, 1), 0)')} AS snr, {r6('snr')} AS unnormalized_snr FROM g LEFT JOIN s USING (r_px, param)")
def normalize_snr_for_grid(spark, d):
    return rounded(grid.normalised(items(spark, d), ["r_px", "param"], "snr", "scale").select(*INDEX, "snr", "unnormalized_snr"), "snr", "unnormalized_snr")


SUMMARY = f"""{ITEMS}, best AS (SELECT * FROM (SELECT *, scale / snr * 5 AS c, row_number() OVER (PARTITION BY r_px, pa_deg ORDER BY scale / snr * 5, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM g WHERE scale > 0 AND snr > 2) WHERE k = 1),
    none AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r_px, pa_deg, param ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM g WHERE NOT scale > 0) WHERE k = 1),
    det AS (SELECT none.*, best.c FROM none JOIN best USING (r_px, pa_deg, param))"""


def summary(spark, d):
    return grid.summarised(items(spark, d), "r_px", "pa_deg", "snr", "scale", ["param"], INDEX, 2.0, 6.0)


@query(f"WITH {SUMMARY} SELECT r_px, pa_deg, l_orderkey, {r6('c')} AS contrast_limit_snr5, {r6('-2.5 * log10(c)')} AS delta_mag FROM best SEMI JOIN (SELECT * FROM det WHERE snr < 6) q USING (r_px, pa_deg)")
def summarize_grid_limits(spark, d):
    limits = summary(spark, d)[0].select("r_px", "pa_deg", "l_orderkey", "contrast_limit_snr5", (-2.5 * F.log10("contrast_limit_snr5")).alias("delta_mag"))
    return rounded(limits, "contrast_limit_snr5", "delta_mag")


@query(f"WITH {SUMMARY} SELECT r_px, pa_deg, param, l_orderkey, {r6('snr')} AS snr FROM det")
def summarize_grid_detections(spark, d):
    return rounded(summary(spark, d)[1].select("r_px", "pa_deg", "param", "l_orderkey", "snr"), "snr")


@query(f"WITH {ITEMS}, m AS (SELECT param, median(snr) AS m FROM g GROUP BY param) SELECT param, {r6('1.48 * median(abs(snr - m))')} AS sigma FROM g JOIN m USING (param) GROUP BY param")
def sigma_mad(spark, d):
    return rounded(grid.sigma_mad(items(spark, d), ["param"], "snr"), "sigma")


@query(f"WITH {ITEMS}, r AS (SELECT DISTINCT r_px AS r0 FROM g), n AS (SELECT r0, snr FROM g JOIN r ON abs(r_px - r0) < 2.5), m AS (SELECT r0, median(snr) AS m FROM n GROUP BY r0) SELECT r0, {r6('1.48 * median(abs(snr - m))')} AS sigma FROM n JOIN m USING (r0) GROUP BY r0")
def ring_noise_scale(spark, d):
    return rounded(grid.ring_sigmas(items(spark, d), "r_px", "snr", 2.5), "sigma")


@query("WITH RECURSIVE r AS (SELECT DISTINCT l_quantity AS v FROM lineitem WHERE l_extendedprice > 60000), s AS (SELECT 0.0::DOUBLE AS v UNION ALL SELECT (SELECT min(r.v) FROM r WHERE r.v - s.v >= 4) FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.v - s.v >= 4)) SELECT v AS r_px FROM s WHERE v > 0")
def radial_spacing(spark, d):
    return grid.spaced(items(spark, d).where("snr > 6"), "r_px", 4.0)


@query(f"SELECT user_id, event_id, i, {r6('value + coalesce(lead(value) OVER w - value, value - lag(value) OVER w, 0) * i / 4')} AS value FROM events, range(4) t(i) WINDOW w AS (PARTITION BY user_id, i ORDER BY event_id)".replace(", i, ", ", i::INTEGER AS i, ", 1))
def split_interpolated(spark, d):
    return rounded(headers.interpolated(events(spark, d), ["user_id"], ["event_id"], "value", 4).select("user_id", "event_id", "i", "value"), "value")


@query("SELECT n_nationkey AS k, -(n_nationkey * 0.5)::DOUBLE AS scale, n_nationkey::DOUBLE AS r_px, 10.5::DOUBLE AS pa_deg FROM nation")
def parse_companion(spark, d):
    text = F.concat(F.lit("invert,"), (F.col("n_nationkey") * 0.5).cast("string"), F.lit(","), F.col("n_nationkey").cast("string"), F.lit(",10.5"))
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), headers.parse_companion(text).alias("c")).select("k", "c.*")


@query("SELECT r_px, pa_deg, n, lines FROM (SELECT l_quantity AS r_px, l_linenumber AS pa_deg, count(*) AS n, min('circle(' || format('{:.4f}', l_quantity + 1) || ',' || format('{:.4f}', l_linenumber + 1.0) || ',2.0000)') AS lines FROM lineitem GROUP BY 1, 2)")
def region_lines(spark, d):
    g = items(spark, d).groupBy("r_px", "pa_deg").agg(F.count("*").alias("n"))
    return regions.circles(g, F.col("r_px"), F.col("pa_deg").cast("double"), F.lit(2.0), "r_px", "pa_deg", "n").withColumnRenamed("value", "lines")
