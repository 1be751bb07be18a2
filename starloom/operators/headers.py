"""Header tables: static and varying keywords, inferred types, updates, joins of outputs, interpolation across cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Structural keywords that no table of observations has.
IGNORED = ("BITPIX", "COMMENT", "HISTORY", "SIMPLE", "XTENSION", "EXTEND", "GCOUNT", "PCOUNT", "EXTNAME")


def keywords(df: DataFrame, key: str, header: str = "header") -> DataFrame:
    """(key, kw, value) of a map column, without structural keywords."""
    out = df.select(key, F.explode(header).alias("kw", "value"))
    return out.where(~F.col("kw").isin(*IGNORED) & ~F.col("kw").startswith("NAXIS"))


def split_keywords(kws: DataFrame) -> DataFrame:
    """(kw, n_values, varying, static_value): a keyword with one value is static."""
    n = F.countDistinct(F.coalesce("value", F.lit("\0")))
    return kws.groupBy("kw").agg(n.alias("n_values"), F.min("value").alias("one")).select("kw", "n_values", (F.col("n_values") > 1).alias("varying"), F.when(F.col("n_values") == 1, F.col("one")).alias("static_value"))


def inferred(kws: DataFrame) -> DataFrame:
    """(kw, type): float if a value has a fraction or exponent, int if all are whole numbers, date if all are, else string."""
    v = F.col("value")
    whole, number, date = F.expr("try_cast(value as bigint)").isNotNull() & ~v.rlike("[.eE]"), F.expr("try_cast(value as double)").isNotNull(), F.expr("try_to_timestamp(value)").isNotNull()
    every = lambda c: F.every(v.isNull() | c)
    kind = F.when(every(whole), "int").when(every(number), "float").when(every(date), "date").otherwise("string")
    return kws.groupBy("kw").agg(kind.alias("type"))


def observations(kws: DataFrame, key: str, varying: list[str]) -> DataFrame:
    """A row for each key with the varying keywords as columns, NULL where a header lacks one; pivots over a given list."""
    return kws.groupBy(key).pivot("kw", varying).agg(F.first("value"))


def updated(df: DataFrame, header: str, more: dict[str, str]) -> DataFrame:
    """Headers with keywords set, a later one over an earlier one."""
    new = F.map_from_arrays(F.array(*map(F.lit, more)), F.array(*map(F.lit, more.values())))
    keep = F.map_filter(header, lambda k, _: ~k.isin(*more))
    return df.withColumn(header, F.map_concat(keep, new))


def derotation(angle: Column, scale: float = 1.0, constant: float = 0.0) -> Column:
    return angle * scale + constant


def posix(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def interpolated(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """n frames for each cube, the value going evenly from the cube's to the next one's; the last cube goes on as the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    nxt, prev = F.lead(value).over(w), F.lag(value).over(w)
    step = F.coalesce(nxt - F.col(value), F.col(value) - prev, F.lit(0.0))
    return df.withColumn("_step", step).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(value, F.col(value) + F.col("_step") * F.col("i") / n).drop("_step")


def parse_obs_method(text: str) -> dict:
    """Dotted tokens a.b=c as nested dictionaries; the last part of a key is lower-cased."""
    out: dict = {}
    for token in text.split():
        path, _, value = token.partition("=")
        *parts, last = path.split(".")
        at = out
        for p in parts:
            at = at.setdefault(p, {})
        at[last.lower()] = value
    return out


def obs_method_tokens(text: Column) -> Column:
    """The same of a column, flat: a map of dotted paths, their last part lower-cased, to values; of a repeated path the last counts."""
    path = lambda t: F.split_part(t, F.lit("="), F.lit(1))
    last = lambda t: F.lower(F.split_part(path(t), F.lit("."), F.lit(-1)))
    key = lambda t: F.concat(F.substring(path(t), F.lit(1), F.length(path(t)) - F.length(last(t))), last(t))
    value = lambda t: F.substring(t, F.length(path(t)) + 2, F.length(t))
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    keys = F.transform(tokens, key)
    latest = F.filter(F.transform(tokens, lambda t, i: F.struct(key(t).alias("key"), value(t).alias("value"), i.alias("i"))), lambda e: F.array_position(F.reverse(keys), e.key) == F.size(keys) - e.i)
    return F.map_from_entries(F.transform(latest, lambda e: F.struct(e.key, e.value)))


def sequence(hdus: DataFrame, keyword: str, ext: Column, key: str = "path", header: str = "header") -> DataFrame:
    """(key, value): a keyword of one extension of each file, NULL where the header lacks it."""
    return hdus.where(ext).select(key, F.try_element_at(F.col(header), F.lit(keyword)).alias("value"))


def flatten_obs_method(nested: dict, before: str = "") -> str:
    tokens = []
    for k, v in nested.items():
        tokens.append(flatten_obs_method(v, f"{before}{k}.") if isinstance(v, dict) else f"{before}{k}={v}")
    return " ".join(tokens)


def parse_companion(text: Column) -> Column:
    """`[invert,]scale,r,pa`, an unknown scale `?` being 0: a struct."""
    parts = F.split(F.trim(text), ",")
    minus = F.when(F.element_at(parts, 1) == "invert", -1.0).otherwise(1.0)
    from_end = lambda k: F.trim(F.try_element_at(parts, F.lit(k)))
    scale = F.when(from_end(-3) == "?", F.lit(0.0)).otherwise(F.expr("0D") + from_end(-3).try_cast("double"))
    return F.struct((minus * scale).alias("scale"), from_end(-2).try_cast("double").alias("r_px"), from_end(-1).try_cast("double").alias("pa_deg"))
