"""Decoder queries: provider bodies are made from the driver's tables and decoded again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.shared import shared_path
from tidemark.operators.series import micros
from tidemark.plans.records import _FORMS
from tidemark.sources import decoders as X
from tidemark.sources.views import observations, table

#: Observation ids that one page may hold.
PAGE_IDS = 4096


def _pages(spark, sf_dir):
    """Continuous feature pages of at most PAGE_IDS observations of a site; every seventh value is missing, every fifth flagged."""
    rows = observations(spark, sf_dir).withColumn("t", micros("ts"))
    props = F.to_json(F.struct(
        F.col("site").cast("string").alias("site"), F.lit("ft^3/s").alias("unit"), "t", F.when(F.col("obs_id") % 7 != 0, F.col("value").cast("string")).alias("value"),
        F.when(F.col("obs_id") % 11 == 0, "Working").otherwise("Approved").alias("approval_status"), F.when(F.col("obs_id") % 5 == 0, F.lit("ICE")).alias("qualifier"),
    ))
    packed = rows.select("site", F.floor(F.col("obs_id") / PAGE_IDS).cast("long").alias("page"), F.struct(F.col("obs_id").cast("string").alias("id"), props.alias("properties")).alias("f")).groupBy("site", "page").agg(F.array_sort(F.collect_list("f")).alias("features"))
    body = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.size("features").alias("numberReturned"), "features"))
    return packed.select("site", "page", body.alias("body")).withColumn("sha256", F.sha2("body", 256))


def src_continuous(spark, sf_dir):
    out = X.continuous(_pages(spark, sf_dir))
    return out.select("site", F.col("feature_id").cast("long").alias("obs_id"), "t", F.round("value_si", 6).alias("value_si"), "exclusion", "usable")


def src_featurecollection(spark, sf_dir):
    """Pages spoilt in ten ways, some of them deep inside, and what is found wrong with each."""
    body = F.col("body")
    inside = lambda text: F.replace(body, F.lit('"features":['), F.lit(text + ',"features":['))
    spoilt = [body, F.concat(F.lit('{"type":"x",'), F.expr("substring(body, 2)")), F.replace(body, F.lit('"FeatureCollection"'), F.lit('"Other"')), F.regexp_replace(body, '"numberReturned":\\d+', '"numberReturned":-1'), F.substring("body", 1, 20),
        inside('"links":[{"rel":"next","href":"a","rel":"prev"}]'), inside('"meta":{"a":{"b":[1,{"k":0,"\\u006b":1}]}}'), inside('"meta":[1,NaN]'), inside('"meta":{"high":1e999}'), inside('"meta":{"a":{"k":1},"b":{"k":1},"c":"{\\"k\\":1,\\"k\\":2}"}')]
    one = F.element_at(F.array(*spoilt), (F.col("site") % 10 + 1).cast("int"))
    return _pages(spark, sf_dir).select("site", "page", X.collection_problem(one).alias("problem"))


def prj_quality_strict(spark, sf_dir):
    props = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.strict_quality(props).alias("quality"))


def src_capture(spark, sf_dir):
    """A paged capture (conversations as pages) with some hashes and links spoilt."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("site"), F.col("turn").alias("sequence"), F.concat_ws("/", "conv_id", "turn").alias("url"), F.concat_ws("/", "conv_id", F.col("turn") + 1).alias("next_url"), F.coalesce("text", F.lit("")).alias("body"))
    last = rows.groupBy("site").agg(F.max("sequence").alias("last"))
    rows = rows.join(last, "site").withColumn("next_url", F.when(F.col("sequence") < F.col("last"), F.col("next_url")))
    rows = rows.withColumns({"sha256": F.when(F.col("site") % 17 == 0, "0").otherwise(F.sha2("body", 256)), "bytes": F.octet_length("body") + F.when(F.col("site") % 19 == 0, 1).otherwise(0)})
    return X.capture_problems(rows).select("site", "sequence", "reason")


def src_thresholds(spark, sf_dir):
    """Four stage thresholds a supplier as records among others of another provider."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"))
    kinds = spark.createDataFrame([("A", "flood_stage_action_m", 1.0), ("A", "flood_stage_minor_m", 2.0), ("A", "flow_m", 9.0), ("B", "flood_stage_major_m", 4.0)], "provider string, parameter string, base double")
    records = s.crossJoin(F.broadcast(kinds)).withColumn("value_si", F.col("base") + F.col("site") % 10)
    return X.thresholds(records, "A")


def src_manifest_route(spark, sf_dir):
    """A JSONL manifest routed by provider to its decoder and united."""
    path = shared_path(spark, "manifest")
    observations(spark, sf_dir).select("site", "obs_id", F.when(F.col("obs_id") % 2 == 0, "metric").otherwise("imperial").alias("provider"), F.col("value").cast("double").alias("value")).write.json(path)
    manifest = spark.read.schema("site long, obs_id long, provider string, value double").json(path)
    return X.route(manifest, {"metric": lambda d: d.select("obs_id", F.round("value", 6).alias("value_si")), "imperial": lambda d: d.select("obs_id", F.round(F.col("value") * 0.3048, 6).alias("value_si"))})


def src_cohort_csv(spark, sf_dir):
    """A cohort written twice over to CSV: exact repeats collapse under the key."""
    path = shared_path(spark, "cohort")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows.unionByName(rows).write.option("header", True).csv(path)
    return X.read_csv(spark, path, "doc_id long, quality int, toxic int", "doc_id")


QUERIES = {f.__name__: f for f in (src_continuous, src_featurecollection, prj_quality_strict, src_capture, src_thresholds, src_manifest_route, src_cohort_csv)}
SQL = {
    "src_continuous": "SELECT user_id AS site, event_id AS obs_id, epoch_us(ts) AS t, CASE WHEN event_id % 7 <> 0 THEN round(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) * 0.028316846592, 6) END AS value_si, CASE WHEN event_id % 7 = 0 THEN 'missing_value' WHEN event_id % 11 = 0 THEN 'unknown_approval' WHEN event_id % 5 = 0 THEN 'qualifier_requires_review' END AS exclusion, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0 AS usable FROM events",
    "src_featurecollection": f"""SELECT DISTINCT user_id AS site, event_id // {PAGE_IDS} AS page, CASE user_id % 10 WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'not_a_feature_collection' WHEN 3 THEN 'count_mismatch' WHEN 4 THEN 'invalid_json'
        WHEN 5 THEN 'duplicate_key' WHEN 6 THEN 'duplicate_key' WHEN 7 THEN 'non_finite_number' WHEN 8 THEN 'non_finite_number' END AS problem FROM events""",
    "prj_quality_strict": "SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'approved_estimated' WHEN 3 THEN 'not_approved_or_unknown_status' WHEN 5 THEN 'approved_unflagged' ELSE 'approved_unknown_qualifier' END AS quality FROM events",
    "src_capture": """WITH r AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations)
        SELECT conv_id AS site, turn AS sequence, 'hash' AS reason FROM r WHERE conv_id % 17 = 0 UNION ALL SELECT conv_id, turn, 'size' FROM r WHERE conv_id % 19 = 0 UNION ALL SELECT conv_id, turn, 'next_link' FROM r WHERE nt IS NOT NULL AND nt <> turn + 1""",
    "src_thresholds": "SELECT s_suppkey AS site, c AS category, b + s_suppkey % 10 AS value_si, round((b + s_suppkey % 10) / 0.3048, 2) AS value_raw FROM supplier, (VALUES ('action', CAST(1 AS DOUBLE)), ('minor', CAST(2 AS DOUBLE))) t(c, b)",
    "src_manifest_route": "SELECT event_id AS obs_id, round(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) * CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.3048 END, 6) AS value_si FROM events",
    "src_cohort_csv": "SELECT DISTINCT doc_id, quality, toxic FROM labels",
}
