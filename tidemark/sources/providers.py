"""Decoders of gauge metadata and single-pixel weather bodies, interval files, manifests and ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import FEET
from tidemark.sources.decoders import strict

GAUGE = "struct<lid:string,usgsId:string,flood:struct<categories:map<string,struct<stage:string>>>>"
# Series of a pixel body, their names and units.
PIXEL = (
    ("prcp (mm/day)", "precipitation_mm_day", "mm/day"), ("tmax (deg c)", "temperature_max_c", "degC"),
    ("tmin (deg c)", "temperature_min_c", "degC"), ("swe (kg/m^2)", "snow_water_equivalent_kg_m2", "kg/m2"),
)
CATALOG = "site long, episode long, onset_lower long, onset_upper long, peak_t long, peak_value decimal(18,2), end_t long, duration long, left_censored boolean, right_censored boolean, max_category string"
# What a selected series must be, and the instants and claims a manifest must make.
SELECTED = {"parameter_code": "00060", "statistic_id": "00003", "unit": "ft^3/s", "computation_period": "Daily", "computation": "Mean", "primary": "Primary"}
MANIFEST = "struct<sites:array<struct<site_id:string,series_id:string,parameter_code:string,statistic_id:string,unit:string,computation_period:string,computation:string,primary:string>>,pages:array<string>,raw:array<date>,calendar:array<date>,reference:array<date>,issues:array<date>,availability:string>"


def finite(text: Column) -> Column:
    """A finite double of a text, else NULL."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def gauge_stages(pages: DataFrame, body: str = "body") -> DataFrame:
    """(site, category, value_m) of the positive flood stages of gauge bodies; a body without an id or categories raises."""
    g = F.from_json(body, GAUGE)
    rows = pages.select(g.alias("g")).select(F.coalesce(F.nullif("g.usgsId", F.lit("")), F.nullif("g.lid", F.lit(""))).alias("site"), F.col("g.flood.categories").alias("c"))
    sound = strict(rows, F.col("site").isNotNull() & (F.coalesce(F.size("c"), F.lit(0)) > 0), "gauge body without identifier or categories")
    each = sound.select("site", F.explode("c").alias("category", "s")).withColumn("feet", finite(F.col("s.stage")))
    return each.filter("feet > 0").select("site", "category", F.round(F.col("feet") * FEET, 4).alias("value_m"))


def pixel_days(pages: DataFrame, body: str = "body", keys: Sequence[str] = ("site",)) -> DataFrame:
    """(keys, local_date, parameter, value, unit) of weather bodies: parallel arrays by year and day of the year.

    Bodies whose years and days do not align, or that have none, raise; values that are no
    finite numbers are left out, shorter series end early.
    """
    fields = ",".join(f"`{x}`:array<string>" for x in ("year", "yday", *[name for name, *_ in PIXEL]))
    rows = pages.select(*keys, F.from_json(body, f"struct<data:struct<{fields}>>")["data"].alias("d"))
    sound = strict(rows, (F.size("d.year") > 0) & (F.size("d.year") == F.size("d.yday")), "pixel body without aligned years and days")
    day = lambda i: F.date_add(F.make_date(F.get("d.year", i).cast("int"), F.lit(1), F.lit(1)), F.get("d.yday", i).cast("int") - 1)
    place = sound.select(*keys, "d", F.explode(F.sequence(F.lit(0), F.size("d.year") - 1)).alias("i"))
    cells = F.array(*[F.struct(F.lit(p).alias("parameter"), finite(F.get(F.col("d").getField(name), F.col("i"))).alias("value"), F.lit(u).alias("unit")) for name, p, u in PIXEL])
    out = place.select(*keys, day(F.col("i")).alias("local_date"), F.explode(cells).alias("c")).filter("c.value is not null")
    return out.select(*keys, "local_date", "c.parameter", F.round("c.value", 4).alias("value"), "c.unit")


def write_catalog(episodes: DataFrame, path: str) -> None:
    """An event catalogue as snappy Parquet and as CSV, side by side below `path`."""
    episodes.write.option("compression", "snappy").parquet(f"{path}/parquet")
    episodes.write.option("header", True).csv(f"{path}/csv")


def read_catalog(spark: SparkSession, path: str, form: str) -> DataFrame:
    """The catalogue by either form, with the same declared types."""
    reader = spark.read.schema(CATALOG)
    return reader.parquet(f"{path}/parquet") if form == "parquet" else reader.option("header", True).option("enforceSchema", False).csv(f"{path}/csv")


def event_intervals(spark: SparkSession, source: str | DataFrame | Sequence[Mapping[str, Any]], schema: str) -> DataFrame:
    """Event intervals from a CSV path, a table or rows in memory, typed alike."""
    if isinstance(source, str):
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(source)
    if isinstance(source, DataFrame):
        return source.select(*[F.col(name).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))])
    return spark.createDataFrame([dict(x) for x in source], schema)


def manifest_problem(manifest: Column) -> Column:
    """The first reason why a capture manifest (JSON) cannot be replayed, else NULL."""
    # bound by a lambda, so that a manifest is parsed once and not again for each field and rule
    return F.get(F.transform(F.array(F.from_json(manifest, MANIFEST)), _problem), 0)


def _problem(m: Column) -> Column:
    sites, at = m["sites"], lambda name, i: F.get(m[name], i)
    ids, series = F.transform(sites, lambda s: s["site_id"]), F.transform(sites, lambda s: s["series_id"])
    empty = lambda a: F.exists(a, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    other = F.exists(sites, lambda s: ~F.coalesce(F.lit(True) & _all([s[k] == v for k, v in SELECTED.items()]), F.lit(False)))
    pairs = _all([F.size(m[x]) == 2 for x in ("raw", "calendar", "reference", "issues")])
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(no(F.size(m["pages"]) > 0), "pages_missing").when(no(F.size(sites) > 0), "sites_missing").when(empty(ids) | empty(series), "identity_empty")
        .when(F.size(ids) != F.size(F.array_distinct(ids)), "site_repeated").when(F.size(series) != F.size(F.array_distinct(series)), "series_repeated").when(other, "series_unsupported")
        .when(no(m["availability"] == "unknown"), "availability_claimed").when(no(pairs), "window_endpoints").when(no(at("raw", 0) <= at("raw", 1)), "raw_reversed")
        .when(no((at("calendar", 0) == at("raw", 0)) & (at("calendar", 1) == F.date_add(at("raw", 1), 1))), "calendar_not_raw")
        .when(no((at("calendar", 0) <= at("reference", 0)) & (at("reference", 0) < at("reference", 1)) & (at("reference", 1) <= at("calendar", 1))), "reference_window")
        .when(no((at("calendar", 0) <= at("issues", 0)) & (at("issues", 0) <= at("issues", 1)) & (at("issues", 1) < at("calendar", 1))), "issue_window")
        .when(no(at("reference", 1) <= at("issues", 0)), "reference_overlaps_issues")
    )


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out &= p
    return out


def write_ledger(rows: DataFrame, path: str) -> None:
    """A replay's rows as gzipped JSON lines; a path that exists is refused, never written over."""
    rows.write.mode("error").option("compression", "gzip").json(path)


def unique_records(rows: DataFrame, key: str) -> DataFrame:
    """rows, raising where a key is null or in more than one row."""
    n = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    met = rows.join(n, F.col(key).eqNullSafe(F.col("__key")))
    return strict(met, (F.col("__n") == 1) & F.col(key).isNotNull(), "a record id is missing or repeated").drop("__key", "__n")
