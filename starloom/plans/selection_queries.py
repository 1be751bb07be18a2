"""Queries of operators.selection: the embeddings as frames, lineitem as a calibration grid, events as an observation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.model import grid as cells
from starloom.operators import selection
from starloom.plans.pixel_queries import N, fr, px, rounded
from starloom.plans.registry import PX, query, r6
from starloom.plans.table_queries import ITEMS, events, items

CELLS = "c AS (SELECT CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x FROM range(64) t(i))"
RHO = "sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5))"


@query(f"WITH {PX} SELECT frame_idx, ext, y, x, v FROM px WHERE NOT (y >= 2 AND y < 4) AND NOT (x >= 2 AND x < 4)")
def drop_index_range(spark, d):
    return selection.without_range(px(spark, d), 2, 4, "y", "x")


@query(f"WITH {PX} SELECT frame_idx, ext, y, x, v FROM px WHERE frame_idx >= 10 AND frame_idx < 90 AND (frame_idx - 10) % 3 = 0")
def slice_frames(spark, d):
    return selection.frame_range(px(spark, d), 10, 90, 3)


@query(f"WITH {ITEMS}, n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'N' THEN CAST('nan' AS DOUBLE) ELSE snr END AS snr FROM g) SELECT l_orderkey, l_linenumber, snr FROM n WHERE snr IS NOT NULL AND NOT isnan(snr)")
def drop_missing_rows(spark, d):
    flag = F.col("l_returnflag")
    snr = F.when(flag == "A", F.lit(None).cast("double")).when(flag == "N", F.lit(float("nan"))).otherwise(F.col("snr"))
    return selection.with_value(items(spark, d).select("l_orderkey", "l_linenumber", snr.alias("snr")), "snr")


@query("SELECT vec_id AS frame_idx, len(embedding) AS n, CASE WHEN vec_id % 2 = 0 THEN vec_id % 7 ELSE 0 END AS bits FROM embeddings")
def ensure_dq(spark, d):
    some = fr(spark, d).withColumn("dq", F.when(F.col("frame_idx") % 2 == 0, F.array_repeat((F.col("frame_idx") % 7).cast("int"), N * N)))
    return selection.with_dq(some).select("frame_idx", F.size("dq").cast("long").alias("n"), F.array_max("dq").cast("long").alias("bits"))


@query(f"WITH {CELLS} SELECT y, x, 'inner' AS kind FROM c WHERE {RHO} >= 2 UNION ALL SELECT y, x, 'outer' FROM c WHERE {RHO} <= 3 AND x >= y UNION ALL SELECT y, x, 'both' FROM c")
def good_pixel_mask(spark, d):
    g = cells(spark, N, N)
    some = selection.good_pixels(g, N, N, outer=3.0, existing=g.where("x >= y"))
    parts = {"inner": selection.good_pixels(g, N, N, inner=2.0), "outer": some, "both": selection.good_pixels(g, N, N, 2.0, 3.0)}
    out = None
    for kind, part in parts.items():
        part = part.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {CELLS} SELECT {r6(RHO)} AS r_px, {r6('(degrees(atan2(y - 3.5, x - 3.5)) - 90 + 720) % 360')} AS pa_deg, x, y FROM c WHERE y % 2 = 0 AND x % 2 = 0 AND {RHO} <= 4")
def downsampled_grid(spark, d):
    mask = selection.good_pixels(cells(spark, N, N), N, N, outer=4.0)
    return rounded(selection.coarse(mask, 2, N, N), "r_px", "pa_deg")


@query(f"WITH {PX}, b AS (SELECT DISTINCT frame_idx, ext FROM px) SELECT frame_idx, ext, y, x, v FROM px UNION ALL SELECT frame_idx, ext, CAST(i // 9 AS INTEGER), CAST(i % 9 AS INTEGER), 0.0 FROM b, range(90) t(i) WHERE i // 9 >= 8 OR i % 9 >= 8")
def pad_to_match(spark, d):
    return selection.padded(px(spark, d), N, N, 10, 9)


@query(f"WITH {PX} SELECT frame_idx, ext, y - 5 AS y, x AS x, v FROM px WHERE y >= 5 AND y < 8 AND x < 4")
def box_overlap(spark, d):
    return selection.Box(5, -2, 6, 6).of(px(spark, d), N, N)


@query(f"WITH {CELLS} SELECT y, x, {r6('(cos(0.3) * (x - 3.5) - sin(0.3) * (y - 3) + 3.5 - 2) / 1.5 + 2 + 0.25')} AS to_x, {r6('(sin(0.3) * (x - 3.5) + cos(0.3) * (y - 3) + 3 - 1) / 0.8 + 1 - 1.5')} AS to_y FROM c")
def moved_grid(spark, d):
    return rounded(selection.moved_grid(cells(spark, N, N), 0.3, (3.5, 3.0), (1.5, 0.8), (2.0, 1.0), (0.25, -1.5)), "to_x", "to_y")


@query(f"WITH {PX}, u AS (SELECT frame_idx, y, x, v AS l, NULL AS r FROM px WHERE y >= x UNION ALL SELECT frame_idx, y, x, NULL, -v FROM px WHERE y <= x) SELECT frame_idx, y, x, coalesce(max(r), max(l)) AS v FROM u GROUP BY 1, 2, 3")
def paired_stitch(spark, d):
    p = px(spark, d)
    return selection.stitched(p.where("y >= x"), p.where("y <= x").withColumn("v", -F.col("v")), ["frame_idx", "y", "x"])


@query(f"SELECT {r6('5 + k / 6.0 * 12')} AS r_px, {r6('arm * 180.0 + degrees(k * 0.7) + 10')} AS pa_deg, ((k + 1) * 0.5)::DOUBLE AS scale FROM (SELECT i // 2 AS k, i % 2 AS arm FROM range(12) t(i))")
def companion_spiral(spark, d):
    return rounded(selection.spiral(spark, 5.0, 17.0, 6, 0.7, [0.5 * (k + 1) for k in range(6)], 2, 10.0), "r_px", "pa_deg", "scale")


@query(f"WITH {ITEMS} SELECT r_px, pa_deg, max(param) AS param FROM g GROUP BY r_px, pa_deg ORDER BY r_px, pa_deg LIMIT 20")
def first_benchmark_points(spark, d):
    return selection.first_points(items(spark, d), 20, "param", "r_px", "pa_deg")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS frame_idx FROM events")
def order_by_date(spark, d):
    return selection.numbered(events(spark, d).select("event_id", "ts"), "ts", "event_id").select("event_id", "frame_idx")


@query(f"WITH {ITEMS} SELECT l_orderkey, l_linenumber, l_partkey, snr FROM g WHERE l_partkey IN (3, 17, 99, 150)")
def only_indices(spark, d):
    return items(spark, d).where(F.col("l_partkey").isin(3, 17, 99, 150)).select("l_orderkey", "l_linenumber", "l_partkey", "snr")


@query("SELECT (n_nationkey * 1.5)::DOUBLE AS r_px, (n_nationkey * 10.0)::DOUBLE AS pa_deg, 0.25::DOUBLE AS scale FROM nation")
def specs_round_trip(spark, d):
    k = F.col("n_nationkey").cast("double")
    table = spark.read.parquet(f"{d}/nation.parquet").select((k * 1.5).alias("r_px"), (k * 10).alias("pa_deg"), F.lit(0.25).alias("scale"))
    return selection.specs_table(spark, selection.specs_of(table))
