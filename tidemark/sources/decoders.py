"""Decoders of provider bodies: whole pages in, validated long rows or reason codes out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import CUBIC_FEET, FEET, decimal_value, quality_class
from tidemark.sources.strict_json import json_problem

FEATURES = "struct<type:string,numberReturned:int,features:array<struct<id:string,properties:string>>>"


def strict(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df, raising at run time on the first row that is not ok (NULL is not)."""
    return df.filter(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def collection_problem(body: Column) -> Column:
    """Reason why a page is no sound feature collection, else NULL: strict JSON at any depth, type, count."""
    c = F.from_json(body, FEATURES)
    syntax = json_problem(body)
    return (
        F.when(syntax.isNotNull(), syntax).when(F.json_object_keys(body).isNull(), "invalid_json")
        .when(~c["type"].eqNullSafe(F.lit("FeatureCollection")), "not_a_feature_collection").when(c["features"].isNull(), "features_missing")
        .when(~c["numberReturned"].eqNullSafe(F.size(c["features"])), "count_mismatch")
    )


def features(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row a feature of sound pages: the page's columns, row_index, feature_id, properties (JSON)."""
    sound = strict(pages, collection_problem(F.col(body)).isNull(), "unsound feature collection")
    rest = [c for c in pages.columns if c != body]
    out = sound.select(*rest, F.posexplode(F.from_json(body, FEATURES)["features"]).alias("row_index", "f"))
    return out.select(*rest, "row_index", F.col("f.id").alias("feature_id"), F.col("f.properties").alias("properties"))


def continuous(pages: DataFrame) -> DataFrame:
    """15-minute rows (page columns site, sha256, body): SI value and the reason why a row is not used, never a guess."""
    hashed = strict(pages, F.sha2("body", 256) == F.col("sha256"), "raw hash mismatch")
    p = lambda name: F.get_json_object("properties", f"$.{name}")
    rows = features(hashed.select("site", "sha256", "body"))
    rows = strict(rows, (p("site") == F.col("site").cast("string")) & (p("unit") == "ft^3/s"), "source identity or unit mismatch")
    value = p("value").try_cast("double")
    rows = strict(rows, p("value").isNull() | (value >= 0), "invalid value")
    exclusion = F.when(p("value").isNull(), "missing_value").when(~F.coalesce(p("approval_status").isin("Approved", "Provisional"), F.lit(False)), "unknown_approval").when(p("qualifier").isNotNull(), "qualifier_requires_review")
    return rows.select(
        "site", F.concat_ws(":", "sha256", "row_index").alias("record_id"), "row_index", "feature_id", p("t").cast("long").alias("t"),
        (value * CUBIC_FEET).alias("value_si"), exclusion.alias("exclusion"), exclusion.isNull().alias("usable"),
    )


def daily_features(rows: DataFrame) -> DataFrame:
    """Value and quality of daily features (properties JSON): text that is no value keeps its status."""
    return rows.withColumns({"quality": quality_class(F.col("properties")), "number": decimal_value(F.get_json_object("properties", "$.value"))})


def strict_quality(props: str | Column) -> Column:
    """Strict class: only documented shapes; an absent qualifier differs from a null one and is unknown, as is its text form."""
    props = F.col(props) if isinstance(props, str) else props
    approval, raw = F.get_json_object(props, "$.approval_status"), F.get_json_object(props, "$.qualifier")
    present = F.array_contains(F.json_object_keys(props), "qualifier")
    approved = F.coalesce(approval.isin("Approved", '["Approved"]'), F.lit(False))
    return (
        F.when(approval.isNull() | approval.isin("", "[]"), "unknown_approval").when(~approved, "not_approved_or_unknown_status")
        .when(present & (raw.isNull() | raw.isin("", "[]")), "approved_unflagged").when(raw == '["ESTIMATED"]', "approved_estimated").otherwise("approved_unknown_qualifier")
    )


def thresholds(records: DataFrame, provider: str) -> DataFrame:
    """(site, category, value_si, value_raw in feet) from records whose parameter is flood_stage_<category>_m; a conflict raises."""
    parts = F.split("parameter", "_")
    rows = records.filter((F.col("provider") == provider) & F.col("parameter").startswith("flood_stage_") & (F.size(parts) >= 4))
    each = rows.select("site", parts[2].alias("category"), F.col("value_si").cast("double").alias("value_si")).groupBy("site", "category").agg(F.max("value_si").alias("value_si"), F.countDistinct("value_si").alias("n"))
    return strict(each, F.col("n") == 1, "conflicting thresholds").select("site", "category", "value_si", F.round(F.col("value_si") / FEET, 2).alias("value_raw"))


def route(manifest: DataFrame, decoders: dict) -> DataFrame:
    """Rows of a manifest (provider, ...) through their provider's decoder, united; an unknown provider raises."""
    known = strict(manifest, F.col("provider").isin(*decoders), "unknown provider")
    return reduce(DataFrame.unionByName, [decode(known.filter(F.col("provider") == name)) for name, decode in decoders.items()])


def exact_rows(df: DataFrame, key: str) -> DataFrame:
    """df without exact repeats; two different rows of one key raise."""
    once = df.dropDuplicates()
    return strict(once.withColumn("__n", F.count("*").over(_window(key))), F.col("__n") == 1, "conflicting rows of one key").drop("__n")


def _window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def read_csv(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """CSV under a declared schema whose header must match (a different one raises), with unique keys."""
    return exact_rows(spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path), key)


def capture_problems(pages: DataFrame, key: str = "site") -> DataFrame:
    """Pages (site, sequence, url, next_url, body, sha256, bytes) with a broken hash, size or next link, one row a reason."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("sequence")
    following = F.lead("url").over(w)
    rules = {"hash": F.sha2("body", 256) == F.col("sha256"), "size": F.octet_length("body") == F.col("bytes"), "next_link": F.col("next_url").eqNullSafe(following)}
    rows = pages.withColumns(rules)
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(n), F.lit(False)), F.lit(n)) for n in rules]))
    return rows.select(key, "sequence", F.explode(broken).alias("reason"))
