"""Datasets of many observations: collection from headers, extensions, stacked inputs, detector cut-outs, results of chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators import grid, headers, selection

#: Readout shape -> the (first row, first column, rows, columns) of the detector that lie side by side in it.
SUBARRAYS = {
    (512, 1024): [(0, 0, 512, 1024)],
    (300, 1024): [(212, 0, 300, 1024)],
    (200, 400): [(312, 0, 200, 200), (312, 512, 200, 200)],
    (100, 50): [(462, 0, 200, 200), (462, 512, 200, 200)],
}
DETECTOR = (512, 1024)


def collected(files: DataFrame, key: str, predicates: list[tuple[str, str, object]], varying: list[str], date: str = "DATE-OBS", header: str = "header") -> DataFrame:
    """The observation table of files with a header map: those that satisfy the predicates on keywords, frame_idx from 0 by
    their date (ties by key), a column for each varying keyword and one, <keyword>_missing, for its mask."""
    wanted = {c for c, _, _ in predicates}
    rows = files.select(key, header, F.col(header)[date].alias("_date"), *(F.col(header)[c].alias(f"_p_{c}") for c in sorted(wanted)))
    rows = grid.kept(rows, [(f"_p_{c}", op, value) for c, op, value in predicates])
    rows = selection.numbered(rows, "_date", key)
    return rows.select("frame_idx", key, *(F.col(header)[c].alias(c) for c in varying), *(F.col(header)[c].isNull().alias(f"{c}_missing") for c in varying))


def with_derotation(table: DataFrame, keyword: str, scale: float, constant: float) -> DataFrame:
    """The observation table with derotation_angle_deg."""
    return table.withColumn("derotation_angle_deg", headers.derotation(F.col(keyword).cast("double"), scale, constant))


def stacked_pixels(px: DataFrame, table: DataFrame, key: str, dtype: str = "double") -> DataFrame:
    """Pixels (key, ext, y, x, v) of the files that the table kept, by its frame_idx, values of the wanted type."""
    return px.join(table.select(key, "frame_idx"), key).select("frame_idx", "ext", "y", "x", F.col("v").cast(dtype).alias("v"))


def is_extension(which: str | int, name: str = "extname", index: str = "ext_idx") -> Column:
    """Whether a row is of the extension of that name, in any case, or number."""
    return F.lower(name) == which.lower() if isinstance(which, str) else F.col(index) == which


def updated_extensions(hdus: DataFrame, data: dict[str | int, Column] | None = None, header: dict[str | int, dict[str, str]] | None = None) -> DataFrame:
    """HDUs with new data (`pix`) and header keywords for the extensions named; a later entry for the same one wins."""
    out = hdus
    for which, new in (data or {}).items():
        out = out.withColumn("pix", F.when(is_extension(which), new).otherwise(F.col("pix")))
    pairs = header or {}
    if pairs:
        more = F.lit(None).cast("map<string,string>")
        for which, kws in pairs.items():
            more = F.when(is_extension(which), F.create_map(*(F.lit(x) for kv in kws.items() for x in kv))).otherwise(more)
        kept = F.map_filter("header", lambda k, _: ~F.coalesce(F.map_contains_key("_m", k), F.lit(False)))
        out = out.withColumn("_m", more).withColumn("header", F.when(F.col("_m").isNull(), F.col("header")).otherwise(F.map_concat(kept, F.col("_m")))).drop("_m")
    return out


def filtered_in_place(items: DataFrame, keep: Column, *columns: str) -> DataFrame:
    """All rows, the columns of those not kept NULL: positions stay."""
    return items.withColumns({c: F.when(keep, F.col(c)) for c in columns})


def extension_mean(px: DataFrame) -> DataFrame:
    """The mean image of each extension, missing values left out."""
    return px.groupBy("ext", "y", "x").agg(F.avg("v").alias("v"))


def zipped(left: DataFrame, right: DataFrame, key: str, scalars: dict[str, object]) -> DataFrame:
    """Items of equal position side by side, the scalars the same for all."""
    return left.join(right, key).withColumns({k: F.lit(v) for k, v in scalars.items()})


def subarray(bad: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(y, x) in a readout of that shape of a detector's bad pixels (y, x): its parts side by side, cut at the detector's edge."""
    if shape not in SUBARRAYS:
        raise ValueError(f"unknown readout shape {shape}")
    out, at = [], 0
    for y0, x0, h, w in SUBARRAYS[shape]:
        y1, x1 = min(y0 + h, DETECTOR[0]), min(x0 + w, DETECTOR[1])
        inside = bad.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
        out.append(inside.select((F.col("y") - y0).cast("int").alias("y"), (F.col("x") - x0 + at).cast("int").alias("x")))
        at += x1 - x0
    return reduce(DataFrame.unionByName, out)


def inputs_stacked(inputs: dict[str, DataFrame]) -> DataFrame:
    """Pixels of several inputs as one matrix's rows, told apart by input_id."""
    return reduce(DataFrame.unionByName, (px.withColumn("input_id", F.lit(name)) for name, px in inputs.items()))


def input_of(stacked: DataFrame, name: str) -> DataFrame:
    """One input's pixels again."""
    return stacked.where(F.col("input_id") == name).drop("input_id")


def to_destinations(outputs: DataFrame, destinations: dict[str, list[str]], column: str = "input_id") -> DataFrame:
    """A row for each destination extension of its input (a config's few names)."""
    names = F.create_map(*(x for k, v in destinations.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return outputs.withColumn("destination", F.explode(F.try_element_at(names, F.col(column))))


def chunks_combined(results: DataFrame) -> DataFrame:
    """Chunks' images (k, ext, filter_name, y, x, v, n) as one: filtered ones averaged, unfiltered ones added up, coverage added up."""
    value = F.when(F.col("filter_name") == "unfiltered", F.coalesce(F.sum("v"), F.lit(0.0))).otherwise(F.avg("v"))
    return results.groupBy("k", "ext", "filter_name", "y", "x").agg(value.alias("v"), F.sum("n").alias("n"))
