"""Record queries: decoders, scalar rules, audits, scaling, vectors, graphs, round trips of sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.functions.shared import shared_path
from tidemark.operators import audits as A
from tidemark.operators import graph, quantiles
from tidemark.operators.series import micros
from tidemark.sources.views import DAILY_SQL, daily_values, observations, table

UNITS = ("ft", "ft3/s", "degC", "m")


def prj_units(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("unit", F.element_at(F.array(*map(F.lit, UNITS)), (F.col("event_id") % 4 + 1).cast("int")))
    si = C.to_si(F.col("value"), F.col("unit"))
    return rows.select("event_id", si.alias("si")).select("event_id", F.round("si.value", 6).alias("value_si"), F.col("si.unit").alias("unit_si"))


def prj_iso_utc(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("-0530"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", C.iso_utc(text).alias("utc"))


_FORMS = ('{"approval_status":"Approved"}', '{"approval_status":"Approved","qualifier":" ESTIMATED ,"}', '{"approval_status":["Approved"],"qualifier":["ESTIMATED"]}', '{"approval_status":"Provisional"}', '{"approval_status":"Approved","qualifier":["ICE","ESTIMATED"]}', '{"approval_status":"Approved","qualifier":null}')
_CLASSES = ("approved_unflagged", "estimated_flagged", "estimated_flagged", "unusable_quality", "unusable_quality", "approved_unflagged")


def prj_quality_lenient(spark, sf_dir):
    props = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", C.quality_class(props).alias("quality"))


def prj_numeric(spark, sf_dir):
    text = F.element_at(F.array(F.lit("12.5"), F.lit("-3"), F.lit("NaN"), F.lit("1e3"), F.lit(None).cast("string"), F.lit("1.2x")), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", C.decimal_value(text).alias("d")).select("event_id", F.col("d.value").alias("value"), F.col("d.status").alias("status"))


def prj_season(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(C.season(F.month("o_orderdate")).alias("season")).agg(F.count("*").alias("n"))


def prj_ident(spark, sf_dir):
    text = F.concat(F.element_at(F.array(F.lit("AG-"), F.lit(""), F.lit("x ")), (F.col("c_custkey") % 3 + 1).cast("int")), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.canonical_site(text, "AG").alias("site"))


def win_day_window(spark, sf_dir):
    """Every day with an order as a civil day of three zones, with the ones that cannot be mapped (compared in tests with known cases)."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    out = None
    for zone in ("America/New_York", "America/Sao_Paulo", "America/Havana"):
        d = C.civil_day(F.col("day"), zone)
        part = days.select(F.lit(zone).alias("zone"), "day", d.alias("d")).select("zone", "day", F.col("d.status").alias("status"), ((F.unix_seconds("d.end") - F.unix_seconds("d.start")) / 3600).alias("hours"))
        out = part if out is None else out.unionByName(part)
    return out


_IV = "struct<timeSeries:array<struct<variable:string,unit:string,values:array<struct<value:string,t:bigint>>>>>"


def src_iv_json(spark, sf_dir):
    """Nested series documents (one a site and day), made from events and decoded to long rows in SI."""
    rows = observations(spark, sf_dir).withColumns({"t": micros("ts"), "variable": F.when(F.col("kind") == "view", "stage").when(F.col("kind") == "click", "flow").otherwise("other")})
    rows = rows.withColumn("unit", F.when(F.col("variable") == "stage", "ft").otherwise("ft3/s"))
    series = rows.groupBy("site", F.to_date("ts").alias("day"), "variable", "unit").agg(F.collect_list(F.struct(F.col("value").cast("string").alias("value"), "t")).alias("values"))
    pages = series.groupBy("site", "day").agg(F.to_json(F.struct(F.collect_list(F.struct("variable", "unit", "values")).alias("timeSeries"))).alias("body"))
    long = pages.select("site", F.inline(F.from_json("body", _IV)["timeSeries"])).filter(F.col("variable").isin("stage", "flow")).select("site", "variable", "unit", F.inline("values"))
    si = C.to_si(F.col("value").try_cast("double"), F.col("unit"))
    return long.withColumn("si", si).filter("si.value is not null").select("site", "variable", "t", F.round("si.value", 6).alias("value_si"), F.col("si.unit").alias("unit_si"))


def src_columns_json(spark, sf_dir):
    """Parallel column arrays of a year (yday, value) as JSON, unpivoted to dated rows."""
    daily = daily_values(spark, sf_dir).withColumn("yday", F.dayofyear("local_date"))
    packed = daily.groupBy("site").agg(F.to_json(F.struct(F.collect_list("yday").alias("yday"), F.collect_list(F.col("value").cast("string")).alias("value"))).alias("body"))
    data = F.from_json("body", "struct<yday:array<int>,value:array<string>>")
    # both lists are collected from the same rows in the same order
    rows = packed.select("site", data.alias("d")).select("site", F.inline(F.arrays_zip(F.col("d.yday").alias("yday"), F.col("d.value").alias("value"))))
    return rows.select("site", F.date_add(F.make_date(F.lit(2024), F.lit(1), F.lit(1)), F.col("yday") - 1).alias("local_date"), F.col("value").try_cast("decimal(20,2)").alias("value"))


def src_daily_pages(spark, sf_dir):
    """Date slots of daily features: absent, one record, or conflicting (different canonical hashes)."""
    rows = observations(spark, sf_dir).withColumn("feature", F.to_json(F.struct("kind", F.col("value").cast("string").alias("v"))))
    slots = rows.groupBy("site", F.to_date("ts").alias("local_date")).agg(F.countDistinct(F.sha2("feature", 256)).alias("n_hashes"), F.count("*").alias("n"))
    dates = rows.select("site").distinct().select("site", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-30')")).alias("local_date"))
    out = dates.join(slots, ["site", "local_date"], "left")
    status = F.when(F.col("n_hashes").isNull(), "absent").when(F.col("n_hashes") == 1, "one_record").otherwise("conflicting")
    return out.select("site", "local_date", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def src_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


def sink_records(spark, sf_dir):
    """Records to CSV, the first of each (site, minute) winning by ingest order, and read back with the declared schema."""
    rows = observations(spark, sf_dir).withColumn("minute", F.floor(micros("ts") / 60_000_000))
    first = rows.groupBy("site", "minute").agg(F.min_by(F.struct("obs_id", "value"), "obs_id").alias("r")).select("site", "minute", "r.*")
    path = shared_path(spark, "records")
    first.repartitionByRange("site", "minute").sortWithinPartitions("site", "minute").write.option("header", True).csv(path)
    return spark.read.schema("site long, minute long, obs_id long, value decimal(18,2)").option("header", True).option("enforceSchema", False).csv(path)


def sink_table(spark, sf_dir):
    """A typed Parquet catalogue, written with snappy by site bucket and read back."""
    path = shared_path(spark, "catalog")
    daily_values(spark, sf_dir).withColumn("part", F.col("site") % 4).write.option("compression", "snappy").partitionBy("part").parquet(path)
    return spark.read.parquet(path).select("site", "local_date", "value", "quality")


def sink_jsonl_gz(spark, sf_dir):
    path = shared_path(spark, "ledger")
    daily_values(spark, sf_dir).withColumn("value", F.col("value").cast("string")).write.option("compression", "gzip").json(path)
    return spark.read.schema("site long, local_date date, value string, quality string").json(path).withColumn("value", F.col("value").cast("decimal(20,2)"))


def agg_group_leak(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("split", F.when(F.year("l_shipdate") < 1996, "train").otherwise("test"))
    return A.leaking_groups(rows, "l_orderkey", "split")


def jn_phantom(spark, sf_dir):
    return A.phantoms(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0"), "l_orderkey", "o_orderkey")


def jn_source_bridge(spark, sf_dir):
    packed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_set(F.col("l_partkey").cast("string")), "|").alias("source_ids"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source_id"), "p_partkey")
    return A.bridged(packed, "source_ids", parts.withColumnRenamed("source_id", "record_id"), "record_id").groupBy("l_orderkey").agg(F.count("*").alias("n_sources"), F.min("p_partkey").alias("first_part"))


def jn_embargo(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("cluster"), F.col("o_orderkey").alias("part"), F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("split"), micros("o_orderdate").alias("t_start"))
    rows = rows.withColumn("t_end", F.col("t_start") + 20 * 86_400_000_000)
    return A.embargo(rows, ("train", "validation", "test"), 24)


def jn_pred_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    left = rows.filter("o_orderkey % 11 <> 0").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    right = rows.filter("o_orderkey % 13 <> 0").select("o_orderkey", (F.col("o_totalprice").cast("decimal(18,2)") + F.when(F.col("o_orderkey") % 101 == 0, F.lit(1)).otherwise(F.lit(0))).alias("v"))
    return A.compare(left, right, "o_orderkey", "v", 1e-6).withColumn("max_diff", F.col("max_diff").cast("double"))


def agg_ancestry(spark, sf_dir):
    line = F.concat_ws(":", F.col("event_id").cast("string"), F.sha2("props", 256))
    return A.ancestry(table(spark, sf_dir, "events"), "user_id", line, "ts")


def val_record_invariants(spark, sf_dir):
    rules = {"quantity_positive": F.col("l_quantity") > 0, "discount_in_range": F.col("l_discount").between(0, 0.09), "tax_below_price": F.col("l_tax") < 0.08, "flag_known": F.col("l_returnflag").isin("A", "R")}
    rows = table(spark, sf_dir, "lineitem").withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return A.violations(rows, "line_id", rules).groupBy("rule").agg(F.count("*").alias("n"))


def normalizer(spark, sf_dir):
    cents = (F.col("value") * 100).cast("long")
    rows = observations(spark, sf_dir).withColumn("c", cents)
    n = F.count("*")
    s = rows.groupBy("kind").agg(n.alias("n"), (F.sum("c") / n / 100).alias("mean"), F.sum("c").alias("s1"), F.sum(F.col("c").cast("decimal(38,0)") * F.col("c")).cast("double").alias("s2"))
    m = quantiles.quantiles(rows, ["kind"], "c", [0.5]).select("kind", F.col("q")[0].alias("m"))
    return s.join(m, "kind").select("kind", "n", "mean", F.sqrt(F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) * (F.col("s1") / F.col("n"))).alias("sd100"), (F.col("m") / 100).alias("median"))


def agg_normalizer(spark, sf_dir):
    return normalizer(spark, sf_dir).select("kind", "n", F.round("mean", 5).alias("mean"), F.round(F.col("sd100") / 100, 5).alias("sd"), F.round("median", 5).alias("median"))


def ml_normalize(spark, sf_dir):
    """z-scores with the fitted mean and spread of each kind; a missing value takes the median and keeps its mask."""
    rows = observations(spark, sf_dir).withColumn("seen", F.when(F.col("obs_id") % 9 != 0, F.col("value").cast("double")))
    p = normalizer(spark, sf_dir).select("kind", "mean", (F.col("sd100") / 100).alias("sd"), "median")
    z = (F.coalesce("seen", "median") - F.col("mean")) / F.col("sd")
    return rows.join(F.broadcast(p), "kind").select("obs_id", F.round(z, 4).alias("z"), F.col("seen").isNotNull().alias("observed"))


def robust(spark, sf_dir):
    q = quantiles.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.25, 0.5, 0.75])
    return q.select("event_type", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def agg_robust(spark, sf_dir):
    return robust(spark, sf_dir).select("event_type", F.round("median", 5).alias("median"), F.round("iqr", 5).alias("iqr"))


def ml_robust_z(spark, sf_dir):
    rows = table(spark, sf_dir, "events").join(F.broadcast(robust(spark, sf_dir)), "event_type")
    return rows.select("event_id", F.round((F.col("value") - F.col("median")) / F.col("iqr"), 4).alias("z"))


def win_latent_step(spark, sf_dir):
    """Euclidean step between vectors that follow each other in a label's sequence."""
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("before", F.lag("embedding").over(w))
    square = F.zip_with("embedding", "before", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return rows.select("vec_id", F.round(F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)), 4).alias("step"))


def ml_mahalanobis(spark, sf_dir):
    """Squared distance to the mean under full shrinkage: squared norm over the mean variance of a coordinate."""
    e = table(spark, sf_dir, "embeddings")
    flat = e.select(F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    by_i = flat.groupBy("i").agg(F.avg("x").alias("mu"), F.var_samp("x").alias("var"))
    ref = by_i.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mu"))), lambda s: s["mu"]).alias("mu"), F.avg("var").alias("target"))
    square = F.zip_with("embedding", "mu", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return e.crossJoin(F.broadcast(ref)).select("vec_id", F.round(F.aggregate(square, F.lit(0.0), lambda s, x: s + x) / F.col("target"), 3).alias("distance"))


def gr_components(spark, sf_dir):
    """Suppliers that share a part, as components."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    least = rows.groupBy("l_partkey").agg(F.min("l_suppkey").alias("b"))
    edges = rows.join(least, "l_partkey").select(F.col("l_suppkey").alias("a"), "b").filter("a <> b")
    return graph.components(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), edges)


def set_union_cells(spark, sf_dir):
    daily = daily_values(spark, sf_dir)
    cells = [daily.filter(F.col("quality") == q).select("site", "local_date", F.lit(q).alias("cell")) for q in ("approved_unflagged", "estimated_flagged")]
    return cells[0].unionByName(cells[1]).groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("site").alias("n_sites"))


QUERIES = {
    f.__name__: f
    for f in (prj_units, prj_iso_utc, prj_quality_lenient, prj_numeric, prj_season, prj_ident, win_day_window, src_iv_json, src_columns_json, src_daily_pages, src_props_json, sink_records, sink_table, sink_jsonl_gz, agg_group_leak, jn_phantom, jn_source_bridge, jn_embargo, jn_pred_compare, agg_ancestry, val_record_invariants, agg_normalizer, ml_normalize, agg_robust, ml_robust_z, win_latent_step, ml_mahalanobis, gr_components, set_union_cells)
}

_NORM = """norm AS (SELECT event_type AS kind, count(*) AS n, CAST(sum(c) AS DOUBLE) / count(*) / 100 AS mean, sqrt(CAST(sum(CAST(c AS HUGEINT) * c) AS DOUBLE) / count(*) - (CAST(sum(c) AS DOUBLE) / count(*)) * (CAST(sum(c) AS DOUBLE) / count(*))) AS sd100, quantile_cont(c, 0.5) / 100 AS median
  FROM (SELECT event_type, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM events) GROUP BY 1)"""
_ROB = "rob AS (SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1)"
_PICK = lambda values, i: f"list_extract([{', '.join(values)}], CAST({i} AS INTEGER))"
SQL = {
    "prj_units": "SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN value * 0.3048 WHEN 1 THEN value * 0.028316846592 WHEN 2 THEN value + 273.15 ELSE value END, 6) AS value_si, CASE event_id % 4 WHEN 1 THEN 'm3/s' WHEN 2 THEN 'K' ELSE 'm' END AS unit_si FROM events",
    "prj_iso_utc": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN strftime(date_trunc('second', ts) - CASE event_id % 4 WHEN 0 THEN INTERVAL 0 MINUTE WHEN 1 THEN INTERVAL 120 MINUTE ELSE INTERVAL (-330) MINUTE END, '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM events",
    "prj_quality_lenient": "SELECT event_id, " + _PICK([f"'{c}'" for c in _CLASSES], "event_id % 6 + 1") + " AS quality FROM events",
    "prj_numeric": "SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN 12.5 WHEN 3 THEN 1000 END AS DECIMAL(20,6)) AS value, CASE event_id % 6 WHEN 0 THEN 'usable' WHEN 3 THEN 'usable' WHEN 4 THEN 'missing_value' ELSE 'unusable_quality' END AS status FROM events",
    "prj_season": "SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) <= 5 THEN 'MAM' WHEN month(o_orderdate) <= 8 THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n FROM orders GROUP BY 1",
    "prj_ident": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS site FROM customer",
    "src_iv_json": "SELECT user_id AS site, CASE WHEN event_type = 'view' THEN 'stage' ELSE 'flow' END AS variable, epoch_us(ts) AS t, round(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) * CASE WHEN event_type = 'view' THEN 0.3048 ELSE 0.028316846592 END, 6) AS value_si, CASE WHEN event_type = 'view' THEN 'm' ELSE 'm3/s' END AS unit_si FROM events WHERE event_type IN ('view', 'click')",
    "src_columns_json": f"WITH {DAILY_SQL} SELECT site, local_date, value FROM daily",
    "src_daily_pages": f"WITH {DAILY_SQL}, h AS (SELECT user_id AS site, CAST(ts AS DATE) AS local_date, count(DISTINCT (event_type, CAST(value AS DECIMAL(18,2)))) AS k, count(*) AS n FROM events GROUP BY 1, 2) SELECT d.site, d.local_date, CASE WHEN k IS NULL THEN 'absent' WHEN k = 1 THEN 'one_record' ELSE 'conflicting' END AS status, coalesce(n, 0) AS n FROM days d LEFT JOIN h ON h.site = d.site AND h.local_date = d.local_date",
    "src_props_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "sink_records": "SELECT user_id AS site, epoch_us(ts) // 60000000 AS minute, min(event_id) AS obs_id, arg_min(CAST(value AS DECIMAL(18,2)), event_id) AS value FROM events GROUP BY 1, 2",
    "sink_table": f"WITH {DAILY_SQL} SELECT site, local_date, value, quality FROM daily",
    "sink_jsonl_gz": f"WITH {DAILY_SQL} SELECT site, local_date, value, quality FROM daily",
    "agg_group_leak": "SELECT l_orderkey, count(DISTINCT year(l_shipdate) < 1996) AS n_splits, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT year(l_shipdate) < 1996) > 1",
    "jn_phantom": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)",
    "jn_source_bridge": "SELECT l_orderkey, count(DISTINCT p_partkey) AS n_sources, min(p_partkey) AS first_part FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "jn_embargo": """WITH p AS (SELECT o_custkey % 500 AS cluster, o_orderkey AS part, CASE o_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, epoch_us(o_orderdate) AS t_start, epoch_us(o_orderdate) + 1728000000000 AS t_end FROM orders),
        g AS (SELECT a.cluster, a.part, a.split, (a.t_start - max(b.t_end)) / 3600000000.0 AS gap FROM p a JOIN p b ON b.cluster = a.cluster AND b.split <> a.split AND (b.t_start, b.part) < (a.t_start, a.part) GROUP BY a.cluster, a.part, a.split, a.t_start)
        SELECT cluster, part, split, round(gap, 3) AS gap_hours, gap <= 0 AS overlaps FROM g WHERE gap < 24""",
    "jn_pred_compare": """WITH a AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 13 <> 0)
        SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_common, count(*) FILTER (b.k IS NULL) AS n_missing, count(*) FILTER (a.k IS NULL) AS n_extra, CAST(max(abs(a.v - b.v)) AS DOUBLE) AS max_diff, false AS within FROM a FULL JOIN b ON a.k = b.k""",
    "agg_ancestry": "SELECT user_id, min(t0) AS earliest, max(t1) AS latest, CAST(sum(k) AS BIGINT) AS n_sources, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM (SELECT user_id, b, min(ts) AS t0, max(ts) AS t1, count(*) AS k, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM (SELECT *, substr(sha256(line), 1, 3) AS b FROM (SELECT *, event_id || ':' || sha256(props) AS line FROM events)) GROUP BY 1, 2) GROUP BY 1",
    "val_record_invariants": "SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT l_quantity > 0 THEN 'quantity_positive' END, CASE WHEN NOT l_discount BETWEEN 0 AND 0.09 THEN 'discount_in_range' END, CASE WHEN NOT l_tax < 0.08 THEN 'tax_below_price' END, CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'flag_known' END]) AS rule FROM lineitem) WHERE rule IS NOT NULL GROUP BY 1",
    "agg_normalizer": f"WITH {_NORM} SELECT kind, n, round(mean, 5) AS mean, round(sd100 / 100, 5) AS sd, round(median, 5) AS median FROM norm",
    "ml_normalize": f"WITH {_NORM} SELECT event_id AS obs_id, round((coalesce(CASE WHEN event_id % 9 <> 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END, median) - mean) / (sd100 / 100), 4) AS z, event_id % 9 <> 0 AS observed FROM events JOIN norm ON kind = event_type",
    "agg_robust": f"WITH {_ROB} SELECT event_type, round(median, 5) AS median, round(iqr, 5) AS iqr FROM rob",
    "ml_robust_z": f"WITH {_ROB} SELECT event_id, round((value - median) / iqr, 4) AS z FROM events JOIN rob USING (event_type)",
    "win_latent_step": "WITH s AS (SELECT vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), f AS (SELECT vec_id, sqrt(sum(pow(CAST(e[i] AS DOUBLE) - CAST(b[i] AS DOUBLE), 2))) AS d FROM s, (SELECT unnest(range(1, 65)) AS i) WHERE b IS NOT NULL GROUP BY vec_id) SELECT s.vec_id, round(d, 4) AS step FROM s LEFT JOIN f USING (vec_id)",
    "ml_mahalanobis": "WITH f AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), m AS (SELECT i, avg(x) AS mu, var_samp(x) AS v FROM f GROUP BY i) SELECT vec_id, round(sum((x - mu) * (x - mu)) / (SELECT avg(v) FROM m), 3) AS distance FROM f JOIN m USING (i) GROUP BY vec_id",
    "gr_components": """WITH RECURSIVE r AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT a.s AS a, b.s AS b FROM r a JOIN r b ON a.p = b.p),
        walk(node, seen) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT w.node, e.b FROM walk w JOIN e ON e.a = w.seen) SELECT node, min(seen) AS root FROM walk GROUP BY node""",
    "set_union_cells": f"WITH {DAILY_SQL} SELECT quality AS cell, count(*) AS n, count(DISTINCT site) AS n_sites FROM daily GROUP BY 1",
}
