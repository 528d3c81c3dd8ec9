"""Queries of provider bodies, catalogues, ledgers, whole audits, curves and further joins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions.shared import shared_path
from tidemark.operators import cohorts as C
from tidemark.operators import daily as D
from tidemark.operators import fitting, metrics, series
from tidemark.plans.daily import A, B, days
from tidemark.plans.metrics import YEAR, by_year, tenths
from tidemark.plans.series import SQL as SERIES_SQL
from tidemark.plans.series import THRESHOLD, timed, win_episodes
from tidemark.sources import providers as P
from tidemark.sources.views import DAILY_SQL, PRED_SQL, daily_values, observations, predictions, table


def src_nwps_json(spark, sf_dir):
    """A gauge body a supplier, with stages that are missing, negative, not numbers or not finite, decoded to metres."""
    stage = lambda x: F.struct(x.cast("string").alias("stage"))
    odd = F.element_at(F.array(F.lit("12.5"), F.lit("NaN"), F.lit("high"), F.lit(None).cast("string")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    categories = F.create_map(F.lit("action"), stage(F.col("s_acctbal")), F.lit("minor"), stage(odd), F.lit("major"), stage(F.col("s_suppkey") + F.lit(0.25)))
    ids = F.struct(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("G"), "s_suppkey")).alias("usgsId"), F.concat(F.lit("L"), "s_suppkey").alias("lid"), F.struct(categories.alias("categories")).alias("flood"))
    out = P.gauge_stages(table(spark, sf_dir, "supplier").select(F.to_json(ids).alias("body")))
    return out.withColumn("value_m", F.round("value_m", 4))


def src_daymet_json(spark, sf_dir):
    """A weather body a site and month: parallel arrays, some values null or not numbers, unpivoted to dated rows of each parameter."""
    rows = daily_values(spark, sf_dir)
    cells = F.struct(
        F.year("local_date").alias("year"), F.dayofyear("local_date").alias("yday"), F.col("value").cast("string").alias("prcp (mm/day)"),
        F.when(F.col("quality") == "approved_unflagged", (F.col("value") / 2).cast("string")).otherwise("NaN").alias("tmax (deg c)"),
    )
    packed = rows.groupBy("site", F.date_format("local_date", "yyyy-MM").alias("month")).agg(F.collect_list(cells).alias("c"))
    body = F.struct(F.struct(*[F.col("c").getField(x).alias(x) for x in ("year", "yday", "prcp (mm/day)", "tmax (deg c)")]).alias("data"))
    return P.pixel_days(packed.select("site", F.to_json(body).alias("body"))).drop("unit").withColumn("value", F.round("value", 3))


def _catalog(spark, sf_dir):
    path = shared_path(spark, "events")
    P.write_catalog(win_episodes(spark, sf_dir), path)
    return path


def src_catalog(spark, sf_dir):
    """The event catalogue as both its files have it: what the CSV and the Parquet form share, row by row."""
    path = _catalog(spark, sf_dir)
    return P.read_catalog(spark, path, "csv").intersectAll(P.read_catalog(spark, path, "parquet"))


def sink_catalog(spark, sf_dir):
    """Rows of the two forms of the event catalogue that differ, and those they share."""
    path = _catalog(spark, sf_dir)
    both = P.read_catalog(spark, path, "csv").withColumn("form", F.lit("csv")).unionByName(P.read_catalog(spark, path, "parquet").withColumn("form", F.lit("parquet")))
    return both.groupBy("form").agg(F.count("*").alias("n"), F.count("end_t").alias("n_closed"), F.sum("peak_value").cast("decimal(18,2)").alias("peaks"), F.count_if("left_censored").alias("n_left"))


def src_events_any(spark, sf_dir):
    """Event intervals from a CSV file, a table and rows in memory, typed alike."""
    rows = series.episodes(timed(spark, sf_dir), THRESHOLD).select("site", F.col("episode").alias("event_id"), "onset_lower", "onset_upper")
    schema, path = "site long, event_id long, onset_lower long, onset_upper long", shared_path(spark, "intervals")
    rows.filter("event_id % 2 = 0").write.option("header", True).csv(path)
    out = P.event_intervals(spark, path, schema).unionByName(P.event_intervals(spark, rows.filter("event_id % 2 = 1").withColumn("site", F.col("site").cast("string")), schema))
    return out.unionByName(P.event_intervals(spark, [{"site": -1, "event_id": 1, "onset_lower": None, "onset_upper": 5}], schema))


def src_manifest_validate(spark, sf_dir):
    """A capture manifest a customer, most of them spoilt in one of twelve ways, and the reason why each is refused."""
    k = F.col("c_custkey") % 13
    text = lambda x: F.lit(x).cast("string")
    site = lambda ident, series: F.struct(
        ident.alias("site_id"), series.alias("series_id"), *[F.when((k == 5) & F.lit(name == "unit"), "ft").otherwise(value).alias(name) for name, value in P.SELECTED.items()]
    )
    first, second = F.concat(F.lit("S"), "c_custkey"), F.concat(F.lit("T"), "c_custkey")
    sites = F.when(k == 2, F.array(site(F.lit(" "), first))).otherwise(F.array(site(first, first), site(F.when(k == 3, first).otherwise(second), F.when(k == 4, first).otherwise(second))))
    span = lambda a, b, *spoilt: F.array(*[F.when(k == n, text(x)).otherwise(text(y)) for (n, x), y in zip(spoilt or ((-1, None), (-1, None)), (a, b), strict=True)])
    manifest = F.struct(
        F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("p1"))).alias("pages"), sites.alias("sites"), F.when(k == 6, "known").otherwise("unknown").alias("availability"),
        span("2000-01-01", "2000-12-31", (7, "2001-01-01"), (-1, None)).alias("raw"), span("2000-01-01", "2001-01-01", (-1, None), (8, "2000-12-31")).alias("calendar"),
        F.when(k == 12, F.array(text("2000-01-01"))).otherwise(span("2000-01-01", "2000-06-01", (9, "1999-01-01"), (11, "2000-09-01"))).alias("reference"),
        span("2000-07-01", "2000-12-30", (-1, None), (10, "2001-02-01")).alias("issues"),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism * 4, "c_custkey")  # a small file a core
    return rows.select("c_custkey", P.manifest_problem(F.to_json(manifest)).alias("problem"))


def sink_replay(spark, sf_dir):
    """A replay ledger written once, its second writing refused, and read back."""
    path, rows = shared_path(spark, "replay"), daily_values(spark, sf_dir).withColumn("value", F.col("value").cast("string"))
    P.write_ledger(rows, path)
    refused = 0
    try:
        P.write_ledger(rows.limit(0), path)
    except AnalysisException:
        refused = 1
    back = spark.read.schema("site long, local_date date, value string, quality string").json(path)
    return back.withColumns({"value": F.col("value").cast("decimal(20,2)"), "refused": F.lit(refused)})


def prj_native(spark, sf_dir):
    """(sample_id, score) pairs from a ranking score, and from a calibrated probability that every sample must have."""
    rows = predictions(spark, sf_dir).select("sample_id", F.col("k").cast("double").alias("ranking_score"), (F.col("k") / 10).alias("probability"))
    return native(rows, False).withColumn("form", F.lit("score")).unionByName(native(rows, True).withColumn("form", F.lit("probability")))


def native(rows, use_probability: bool):
    """sample_id and score of rows; a missing probability raises, as a ranking score is none."""
    if not use_probability:
        return rows.select("sample_id", F.col("ranking_score").alias("score"))
    score = F.coalesce("probability", F.raise_error(F.concat(F.lit("no calibrated probability for "), "sample_id")).cast("double"))
    return rows.select("sample_id", score.alias("score"))


def agg_latency(spark, sf_dir):
    """Latency figures of each kind of event, its values taken as milliseconds, without the first ten."""
    out = C.latency(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("event_type", "n")})


def ml_cusum_fit(spark, sf_dir):
    """Mean and population spread of each kind's finite training observations; a constant reference raises."""
    rows = observations(spark, sf_dir).filter(F.col("ts") < F.expr("timestamp_ntz'2024-01-16 00:00:00'"))
    out = fitting.control_reference(rows.withColumn("value", F.col("value").cast("double")), ["kind"], "value")
    return out.withColumns({"mean": F.round("mean", 6), "scale": F.round("scale", 6)})


def agg_calibration_curve(spark, sf_dir):
    """Bins of both kinds of calibration curve by year, empty ones included."""
    g = by_year(spark, sf_dir)
    parts = [metrics.calibration_curve(g, YEAR, tenths(), 5, s).withColumn("strategy", F.lit(s)) for s in ("uniform", "quantile")]
    out = parts[0].unionByName(parts[1])
    return out.withColumns({c: F.round(c, 7) for c in ("low", "high", "confidence", "observed")})


def _cohort(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    o = F.col("o_orderkey")
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("o_custkey") % 3 + 1).cast("int"))
    cohort = orders.select(
        F.when(o % 499 == 0, "").otherwise(F.when(o % 251 == 0, "again").otherwise(o.cast("string"))).alias("sample_id"),
        F.when(o % 307 == 0, "2").otherwise(F.substring("o_orderpriority", 1, 1).isin("1", "2").cast("int").cast("string")).alias("label"),
        F.when(F.col("o_custkey") % 97 == 0, None).otherwise(F.col("o_custkey").cast("string")).alias("group_id"),
        F.when(o % 401 == 0, "holdout").when(o % 101 == 0, "test").otherwise(split).alias("split"),
        F.when(o % 211 == 0, "").otherwise(F.concat(o.cast("string"), F.lit("|"), (o % 50).cast("string"), F.when(o % 173 == 0, F.lit("|gone")).otherwise(""))).alias("source_ids"),
    )
    return cohort, orders.select(o.cast("string").alias("record_id")).unionByName(spark.range(50).select(F.col("id").cast("string").alias("record_id")))


def agg_cohort_audit(spark, sf_dir):
    """All checks of a cohort of orders in which each kind of fault is planted."""
    return C.cohort_audit(*_cohort(spark, sf_dir), least_class=2000, least_groups=2)


def agg_causality(spark, sf_dir):
    """Records of each site by the reason why they must not feed its issue at noon of 15 January, some planted."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.when(e % 503 == 0, F.lit(0)).otherwise(e).cast("string").alias("record_id"), F.when(e % 97 == 0, F.col("ts") + F.expr("INTERVAL '1' HOUR")).when(e % 101 == 0, None).otherwise(F.col("ts") - F.expr("INTERVAL '15' MINUTE")).alias("start"),
        F.col("ts").alias("end"), F.when(e % 89 == 0, None).when(e % 83 == 0, F.col("ts") - F.expr("INTERVAL '1' MINUTE")).otherwise(F.col("ts") + F.expr("INTERVAL '2' HOUR")).alias("available"),
        F.when(e % 7 == 0, "assumed").otherwise("observed").alias("basis"), F.when(F.col("event_type") == "purchase", "flood_stage_minor_m").otherwise("flow").alias("parameter"),
    )
    return C.causality(rows.filter("record_id <> '0'"), "user_id", F.expr("timestamp_ntz'2024-01-15 12:00:00'"), 24 * 10)


def st_t_crit(spark, sf_dir):
    """Critical value and interval of each year's mean discount, by its own degrees of freedom."""
    by = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("yr")).agg(F.countDistinct(F.month("l_shipdate")).alias("months"))
    return fitting.with_t_critical(by.withColumn("df", F.col("months") - 1), "df", 0.95).select("yr", "df", F.round("critical", 3).alias("critical"))


def agg_type8_exact(spark, sf_dir):
    """Exact type-8 quantile of each site's usable values as numerator over denominator; of a single value it is that value."""
    t = D.type8(days(spark, sf_dir).filter(D.usable(F.lit("primary"))), ("site",), "value", A, B)
    return t.select("site", F.col("n").cast("long").alias("n"), ((F.col("lo") * (F.col("g_den") - F.col("g_num")) + F.col("hi") * F.col("g_num"))).cast("double").alias("numerator"), F.col("g_den").cast("long").alias("denominator"))


def src_records_csv(spark, sf_dir):
    """Records from CSV with the declared schema; an id that two rows have raises."""
    path = shared_path(spark, "records")
    observations(spark, sf_dir).select("obs_id", "site", "value", "kind").write.option("header", True).csv(path)
    return P.unique_records(spark.read.schema("obs_id long, site long, value decimal(18,2), kind string").option("header", True).option("enforceSchema", False).csv(path), "obs_id")


def sink_cohort(spark, sf_dir):
    """A cohort with its sources as a list in one field, written to CSV ordered by sample and read back."""
    path, (cohort, _) = shared_path(spark, "cohort"), _cohort(spark, sf_dir)
    rows = cohort.filter("sample_id not in ('', 'again') and group_id is not null and source_ids <> ''")
    rows.repartitionByRange("sample_id").sortWithinPartitions("sample_id").write.option("header", True).csv(path)
    return spark.read.schema(cohort.schema).option("header", True).option("enforceSchema", False).csv(path)


def src_jsonl_gz(spark, sf_dir):
    """Gzipped JSON lines, some broken, read with the declared schema: broken lines are counted, never repaired."""
    path = shared_path(spark, "lines")
    rows = observations(spark, sf_dir)
    line = F.when(F.col("obs_id") % 41 == 0, F.lit('{"site": 1, "obs')).otherwise(F.to_json(F.struct("site", "obs_id", F.col("value").cast("string").alias("value"))))
    rows.select(line.alias("value")).write.option("compression", "gzip").text(path)
    back = spark.read.schema("site long, obs_id long, value string, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return back.groupBy(F.col("broken").isNotNull().alias("is_broken")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(20,2)").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        src_nwps_json, src_daymet_json, src_catalog, sink_catalog, src_events_any, src_manifest_validate, sink_replay, prj_native, agg_latency, ml_cusum_fit, agg_calibration_curve, agg_cohort_audit,
        agg_causality, st_t_crit, agg_type8_exact, src_jsonl_gz, src_records_csv, sink_cohort,
    )
}

_PROBLEMS = {1: "pages_missing", 2: "identity_empty", 3: "site_repeated", 4: "series_repeated", 5: "series_unsupported", 6: "availability_claimed", 7: "raw_reversed", 8: "calendar_not_raw", 9: "reference_window", 10: "issue_window", 11: "reference_overlaps_issues", 12: "window_endpoints"}
_T = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201}
_EPISODES = SERIES_SQL["win_episodes"]


def _bins(strategy: str) -> str:
    cuts = [f"{i / 5}" for i in range(6)] if strategy == "uniform" else [f"quantile_cont(k / 10.0, {i / 5})" for i in range(6)]
    chain, grown = f"SELECT yr, {', '.join(f'CAST({c} AS DOUBLE) AS c{i}' for i, c in enumerate(cuts))} FROM pred GROUP BY yr", ["c0 AS e0"]
    out = f"SELECT *, {grown[0]} FROM ({chain})"
    for i in range(1, 6):
        out = f"SELECT *, CASE WHEN c{i} <= e{i - 1} THEN e{i - 1} + 1e-6 ELSE c{i} END AS e{i} FROM ({out})"
    edges = "[e0, e1, e2, e3, e4, e5]"
    return f"""SELECT e.yr, b AS bin, round({edges}[b + 1], 7) AS low, round({edges}[b + 2], 7) AS high, count(p.k) AS n, round(coalesce(avg(p.k / 10.0), ({edges}[b + 1] + {edges}[b + 2]) / 2), 7) AS confidence,
        round(coalesce(avg(p.y), 0), 7) AS observed, '{strategy}' AS strategy FROM ({out}) e CROSS JOIN (SELECT unnest(range(0, 5)) AS b) LEFT JOIN pred p ON p.yr = e.yr AND (p.k / 10.0 >= e1)::INT + (p.k / 10.0 >= e2)::INT + (p.k / 10.0 >= e3)::INT + (p.k / 10.0 >= e4)::INT = b GROUP BY e.yr, b, e0, e1, e2, e3, e4, e5"""


_COHORT = """c AS (SELECT CASE WHEN o_orderkey % 499 = 0 THEN '' WHEN o_orderkey % 251 = 0 THEN 'again' ELSE CAST(o_orderkey AS VARCHAR) END AS sample_id, CASE WHEN o_orderkey % 307 = 0 THEN '2' WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN '1' ELSE '0' END AS label,
  CASE WHEN o_custkey % 97 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS group_id, CASE WHEN o_orderkey % 401 = 0 THEN 'holdout' WHEN o_orderkey % 101 = 0 THEN 'test' WHEN o_custkey % 3 = 0 THEN 'train' WHEN o_custkey % 3 = 1 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN o_orderkey % 211 = 0 THEN '' ELSE o_orderkey || '|' || (o_orderkey % 50) || CASE WHEN o_orderkey % 173 = 0 THEN '|gone' ELSE '' END END AS source_ids FROM orders),
g AS (SELECT group_id, count(DISTINCT split) AS k, max(split = 'test') AS tested FROM c WHERE group_id IS NOT NULL GROUP BY 1),
s AS (SELECT source_id, count(DISTINCT split) AS k FROM (SELECT split, unnest(string_split(source_ids, '|')) AS source_id FROM c) WHERE source_id <> '' GROUP BY 1),
known AS (SELECT CAST(o_orderkey AS VARCHAR) AS r FROM orders UNION SELECT CAST(unnest(range(0, 50)) AS VARCHAR)),
cells AS (SELECT split, label, count(*) AS n FROM c WHERE split <> 'holdout' AND label <> '2' GROUP BY 1, 2)"""
_CHECKS = {
    "sample_id_empty_or_repeated": "SELECT count(*) FILTER (sample_id = '') + count(*) - count(DISTINCT sample_id) FROM c", "label_invalid": "SELECT count(*) FROM c WHERE label = '2'", "split_invalid": "SELECT count(*) FROM c WHERE split = 'holdout'",
    "group_missing": "SELECT count(*) FROM c WHERE group_id IS NULL", "source_missing": "SELECT count(*) FROM c WHERE source_ids = ''", "class_floor": "SELECT 6 - count(*) FILTER (n >= 2000) FROM cells", "group_leakage": "SELECT count(*) FROM g WHERE k > 1",
    "test_group_floor": "SELECT CASE WHEN count(*) FILTER (tested) < 2 THEN 1 ELSE 0 END FROM g", "phantom_sources": "SELECT count(*) FROM s WHERE source_id NOT IN (SELECT r FROM known)", "source_leakage": "SELECT count(*) FROM s WHERE k > 1",
}
SQL = {
    "src_nwps_json": """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'G' ELSE 'L' END || s_suppkey AS site, c AS category, round(CASE c WHEN 'action' THEN CAST(s_acctbal AS DOUBLE) WHEN 'minor' THEN 12.5 ELSE s_suppkey + 0.25 END * 0.3048, 4) AS value_m
        FROM supplier, (VALUES ('action'), ('minor'), ('major')) t(c) WHERE (c = 'action' AND s_acctbal > 0) OR (c = 'minor' AND s_suppkey % 4 = 0) OR c = 'major'""",
    "src_daymet_json": f"WITH {DAILY_SQL} SELECT site, local_date, 'precipitation_mm_day' AS parameter, round(CAST(value AS DOUBLE), 3) AS value FROM daily UNION ALL SELECT site, local_date, 'temperature_max_c', round(CAST(value AS DOUBLE) / 2, 3) FROM daily WHERE quality = 'approved_unflagged'",
    "src_catalog": _EPISODES,
    "sink_catalog": f"SELECT form, count(*) AS n, count(end_t) AS n_closed, CAST(sum(peak_value) AS DECIMAL(18,2)) AS peaks, count(*) FILTER (left_censored) AS n_left FROM ({_EPISODES}) CROSS JOIN (VALUES ('csv'), ('parquet')) f(form) GROUP BY 1",
    "src_events_any": f"SELECT site, episode AS event_id, onset_lower, onset_upper FROM ({_EPISODES}) UNION ALL SELECT -1, 1, NULL, 5",
    "src_manifest_validate": "SELECT c_custkey, CASE c_custkey % 13 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in _PROBLEMS.items()) + " END AS problem FROM customer",
    "sink_replay": f"WITH {DAILY_SQL} SELECT site, local_date, value, quality, 1 AS refused FROM daily",
    "prj_native": f"WITH {PRED_SQL} SELECT sample_id, CAST(k AS DOUBLE) AS score, 'score' AS form FROM pred UNION ALL SELECT sample_id, k / 10.0, 'probability' FROM pred",
    "agg_latency": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)
        SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(stddev_pop(value), 6) AS sd_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms,
        round(CASE WHEN avg(value) > 0 THEN 1000 / avg(value) ELSE 0 END, 6) AS per_second FROM r WHERE i > 10 GROUP BY 1""",
    "ml_cusum_fit": "SELECT event_type AS kind, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS scale FROM (SELECT event_type, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16') GROUP BY 1",
    "agg_calibration_curve": f"WITH {PRED_SQL} {_bins('uniform')} UNION ALL {_bins('quantile')}",
    "agg_cohort_audit": f"WITH {_COHORT} " + " UNION ALL ".join(f"""SELECT '{name}' AS "check", ({sql}) AS n""" for name, sql in _CHECKS.items()),
    "agg_causality": """WITH r AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN ts + INTERVAL 1 HOUR WHEN event_id % 101 <> 0 THEN ts - INTERVAL 15 MINUTE END AS b, CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts + INTERVAL 2 HOUR END AS av, TIMESTAMP '2024-01-15 12:00:00' AS issue FROM events WHERE event_id % 503 <> 0)
        SELECT user_id, CASE WHEN b IS NULL THEN 'interval_missing' WHEN b > ts THEN 'interval_inverted' WHEN event_id % 7 = 0 THEN 'release_evidence_missing' WHEN av IS NULL THEN 'release_time_missing' WHEN ts > issue THEN 'observed_after_issue'
          WHEN event_type <> 'purchase' AND ts < issue - INTERVAL 14415 MINUTE THEN 'before_lookback' WHEN av < ts THEN 'released_before_closure' WHEN av > issue THEN 'released_after_issue' END AS reason, count(*) AS n, min(ts) AS earliest, max(ts) AS latest FROM r GROUP BY 1, 2""",
    "st_t_crit": "SELECT yr, df, CASE df " + " ".join(f"WHEN {k} THEN {x}" for k, x in _T.items()) + " END AS critical FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, count(DISTINCT month(l_shipdate)) - 1 AS df FROM lineitem GROUP BY 1)",
    "agg_type8_exact": f"""WITH {DAILY_SQL}, ref AS (SELECT site, value, row_number() OVER (PARTITION BY site ORDER BY value) AS i, count(*) OVER (PARTITION BY site) AS n FROM days WHERE value IS NOT NULL),
        pos AS (SELECT *, least(greatest({A} * (3 * n + 1) + {B}, {3 * B}), n * {3 * B}) AS num FROM ref)
        SELECT site, n, CAST(max(CASE WHEN i = num // {3 * B} THEN value END) * ({3 * B} - max(num % {3 * B})) + max(CASE WHEN i = least(num // {3 * B} + 1, n) THEN value END) * max(num % {3 * B}) AS DOUBLE) AS numerator, {3 * B} AS denominator FROM pos GROUP BY site, n""",
    "src_records_csv": "SELECT event_id AS obs_id, user_id AS site, CAST(value AS DECIMAL(18,2)) AS value, event_type AS kind FROM events",
    "sink_cohort": f"WITH {_COHORT} SELECT sample_id, label, group_id, split, source_ids FROM c WHERE sample_id NOT IN ('', 'again') AND group_id IS NOT NULL AND source_ids <> ''",
    "src_jsonl_gz": "SELECT event_id % 41 = 0 AS is_broken, count(*) AS n, CAST(sum(CASE WHEN event_id % 41 <> 0 THEN CAST(value AS DECIMAL(18,2)) END) AS DECIMAL(20,2)) AS total FROM events GROUP BY 1",
}
