"""Label, exposure, support and remaining queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.shared import shared_path
from tidemark.operators import series as S
from tidemark.plans import daily as P
from tidemark.plans.series import _SLOTS, DAY_THRESHOLD, slots, timed
from tidemark.sources import releases
from tidemark.sources.views import CALENDAR, DAILY_SQL, PRED_SQL, REFERENCE_END, daily_values, observations, predictions, table

HORIZON = 3


def _labels(spark, sf_dir):
    rows = slots(spark, sf_dir)
    return S.onset_labels(rows, S.onsets(rows, DAY_THRESHOLD), HORIZON)


def lb_labels_rows(spark, sf_dir):
    return _labels(spark, sf_dir).select("site", "issue", "label", "reason")


def ex_exposure(spark, sf_dir):
    return _labels(spark, sf_dir).select("site", "issue", "first_status", "lead_lower", "lead_upper")


def jn_coverage(spark, sf_dir):
    w = Window.partitionBy("site").orderBy("day").rowsBetween(0, HORIZON)
    return slots(spark, sf_dir).select("site", "day", (F.sum(F.col("usable").cast("long")).over(w) == HORIZON + 1).alias("complete"))


def win_causal_conv(spark, sf_dir):
    out = S.causal_filter(timed(spark, sf_dir), (0.5, 0.25, 0.25), 2)
    return out.select("site", "obs_id", F.round("filtered", 4).alias("filtered"))


def win_issue_calendar(spark, sf_dir):
    """The noon issues of every site that has observations."""
    sites = observations(spark, sf_dir).select("site").distinct()
    days = F.explode(F.sequence(F.lit(REFERENCE_END).cast("date"), F.date_sub(F.lit(CALENDAR[1]).cast("date"), 1))).alias("d")
    return sites.select("site", days).select("site", (F.unix_date("d").cast("long") * 86_400 + 43_200).alias("issue_s"))


def win_expected_closures(spark, sf_dir):
    """Dates that close in (issue, issue + h] of the noon issue of each day with an event."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("issue_date")).distinct()
    d = days.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (24, 48, 72)])))
    return d.select("issue_date", F.col("horizon").cast("long").alias("horizon"), F.explode(F.sequence(F.lit(0), (F.col("horizon") / 24).cast("int") - 1)).alias("k")).select("issue_date", "horizon", F.date_add("issue_date", F.col("k")).alias("closing"))


def win_pagination(spark, sf_dir):
    """Breaks of the turn chain: the next turn of a conversation must be one more."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("next_turn", F.lead("turn").over(w))
    return rows.groupBy((F.col("next_turn") == F.col("turn") + 1).alias("linked")).agg(F.count("*").alias("n"))


def prj_truth_lane(spark, sf_dir):
    q = F.col("quality")
    return P.days(spark, sf_dir).select("site", "local_date", (q.isin("approved_unflagged", "estimated_flagged")).alias("primary_truth"), (q == "approved_unflagged").alias("input_usable"))


def agg_type8_float(spark, sf_dir):
    """The reference thresholds as doubles for display."""
    t = P.thresholds(spark, sf_dir)
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    return t.select("site", "ref_lane", F.round(lo + (hi - lo) * F.col("g_num") / F.col("g_den"), 4).alias("threshold"))


def agg_primary_support(spark, sf_dir):
    rows = P.labels(spark, sf_dir).filter("ref_lane = 'primary' and lane = 'primary'").join(P.jn_prev_closed_day(spark, sf_dir).select("site", "issue_date", (F.col("status") == "scored").alias("scored")), ["site", "issue_date"])
    return rows.groupBy(F.col("horizon").cast("long").alias("horizon")).agg(F.count_if(F.col("issue_state") == "armed").alias("eligible"), F.count_if(F.col("status") == "unknown").alias("unknown_n"), F.count_if(F.col("scored") & (F.col("status") != "unknown")).alias("scoreable"), F.count_if(F.col("status") == "positive").alias("positive"))


def set_panel_equal(spark, sf_dir):
    """Keys that one of two panels has and the other lacks; the positive panel lacks those of issues without a known label."""
    keys = P.labels(spark, sf_dir).select("ref_lane", "lane", "site", "issue_date", "horizon", "status")
    sides = F.when(F.col("lane") == "primary", 1).otherwise(0), F.when((F.col("lane") == "unflagged") & (F.col("status") != "unknown"), 1).otherwise(0)
    both = keys.groupBy("ref_lane", "site", "issue_date", "horizon").agg(F.sum(sides[0]).alias("a"), F.sum(sides[1]).alias("b"))
    return both.agg(F.count_if(F.col("a") > F.col("b")).alias("n_left_only"), F.count_if(F.col("a") < F.col("b")).alias("n_right_only"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))


def prj_family(spark, sf_dir):
    """First matching family of a name in fixed order."""
    p = F.col("o_orderpriority")
    family = F.when(p.contains("URGENT"), "urgent").when(p.contains("HIGH"), "high").when(p.contains("-"), "graded").otherwise("other")
    return table(spark, sf_dir, "orders").groupBy(family.alias("family")).agg(F.count("*").alias("n"))


def prj_sample_meta(spark, sf_dir):
    """Site and instant from a sample id 'site_yyyyMMddTHHmmssZ'."""
    sid = F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    parts = F.split(sid, "_")
    return table(spark, sf_dir, "events").select("event_id", parts[0].cast("long").alias("site"), F.unix_seconds(F.to_timestamp(parts[1], "yyyyMMdd'T'HHmmss'Z'")).alias("issue_s"))


def jn_seed_pair(spark, sf_dir):
    """Contrast of two families paired on the year, complete on both sides."""
    rows = predictions(spark, sf_dir).groupBy("family", "yr").agg(F.sum("y").cast("long").alias("s"), F.count("*").alias("n"))
    a, b = (rows.filter(F.col("family") == f).select("yr", (F.col("s") / F.col("n")).alias(f.lower())) for f in ("F", "O"))
    return a.join(b, "yr").select("yr", F.round(F.col("f") - F.col("o"), 6).alias("difference"))


def jn_label_horizon(spark, sf_dir):
    """Completions ahead of each issue within 72 hours, one row each: a bounded equi-join by date."""
    done = P.traced(spark, sf_dir, P.CELLS[:1]).filter("completion").select("site", F.col("local_date").alias("target"))
    seen = done.select("site", "target", F.explode(F.sequence(F.date_sub("target", 2), F.col("target"))).alias("issue_date"))
    return seen.filter("issue_date >= date'2024-01-16' and issue_date < date'2024-01-31'").select("site", "issue_date", "target", (24 * F.datediff("target", "issue_date") + 12).cast("long").alias("lead_hours"))


def sink_params(spark, sf_dir):
    """Fitted parameters as JSON and back."""
    path = shared_path(spark, "params")
    fitted = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("largest"))
    fitted.write.json(path)
    return spark.read.schema(fitted.schema).json(path)


def sink_release(spark, sf_dir):
    """A release of one file a weekday verified against a manifest that knows one too many, lacks one and has a wrong digest of a third."""
    path = shared_path(spark, "release")
    rows = daily_values(spark, sf_dir).select(F.dayofweek("local_date").alias("day"), "site", F.col("value").cast("string").alias("value"))
    rows.repartition("day").write.partitionBy("day").option("header", True).csv(path)
    found = releases.manifest(spark, path).withColumn("rank", F.row_number().over(Window.orderBy("name")))  # a row a file
    spoilt = found.filter("rank <> 1").withColumn("sha256", F.when(F.col("rank") == 2, "0").otherwise(F.col("sha256"))).drop("rank")
    declared = spoilt.unionByName(found.filter("rank = 1").select(F.lit("part-gone").alias("name"), "bytes", "sha256"))
    return releases.verify(declared, found.drop("rank")).groupBy("status").agg(F.count("*").alias("n"))


def agg_obs_coverage(spark, sf_dir):
    """Observed and masked slots of each channel (weekday)."""
    return slots(spark, sf_dir).groupBy(F.dayofweek("day").cast("long").alias("channel")).agg(F.count("value").alias("observed"), F.count_if(F.col("value").isNull()).alias("masked"))


def agg_raw_matrix(spark, sf_dir):
    """Distinct training values by kind, as a matrix with a column a kind."""
    rows = table(spark, sf_dir, "events").filter("ts < timestamp_ntz'2024-01-16 00:00:00'").select("user_id", "event_type", "value").distinct()
    return rows.groupBy("user_id").pivot("event_type", ["view", "click", "error"]).agg(F.count("value")).na.fill(0)


QUERIES = {
    f.__name__: f
    for f in (lb_labels_rows, ex_exposure, jn_coverage, win_causal_conv, win_issue_calendar, win_expected_closures, win_pagination, prj_truth_lane, agg_type8_float, agg_primary_support, set_panel_equal, prj_family, prj_sample_meta, jn_seed_pair, jn_label_horizon, sink_params, sink_release, agg_obs_coverage, agg_raw_matrix)
}

_D, _T, _TR, _L, _I = P._D, P._T, P._TR, P._L, P._I
_ON = _SLOTS + f""", k AS (SELECT *, CASE WHEN NOT usable OR value IS NULL THEN 'U' WHEN value <= {DAY_THRESHOLD} THEN 'L' ELSE 'H' END AS class FROM slots),
i AS (SELECT *, sum(CASE WHEN class <> 'L' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY day) AS island FROM k),
m AS (SELECT *, CASE WHEN class = 'H' THEN 'H' WHEN class = 'L' AND day - min(CASE WHEN class = 'L' THEN day END) OVER (PARTITION BY site, island) >= 3 THEN 'R' END AS marker FROM i),
f AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'R') = 'R' AS free_before,
  coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS UNBOUNDED PRECEDING), 'R') = 'R' AS free_now,
  last_value(CASE WHEN class = 'L' THEN day END IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_before FROM m),
ons AS (SELECT site, day AS upper, low_before AS lower FROM f WHERE class = 'H' AND free_before),
lab AS (
  SELECT f.site, f.day AS issue, f.class = 'L' AND f.free_now AS known,
    coalesce(bool_or(o.lower >= f.day AND o.upper <= f.day + {HORIZON}), false) AS definite,
    coalesce(bool_or(o.upper IS NOT NULL AND NOT coalesce(o.lower >= f.day AND o.upper <= f.day + {HORIZON}, false) AND (o.lower IS NULL OR o.lower < f.day + {HORIZON})), false) AS amb,
    (SELECT count(*) FROM slots s WHERE s.site = f.site AND s.usable AND s.day BETWEEN f.day AND f.day + {HORIZON}) = {HORIZON + 1} AS complete,
    count(o.upper) AS n_future, coalesce(bool_or(o.lower IS NULL OR o.lower < f.day), false) AS unbounded, min(o.upper) AS up, arg_min(o.lower, o.upper) AS lo
  FROM f LEFT JOIN ons o ON o.site = f.site AND o.upper > f.day GROUP BY f.site, f.day, f.class, f.free_now)"""
SQL = {
    "lb_labels_rows": f"WITH {_ON}, r AS (SELECT *, CASE WHEN NOT known THEN 'current_state_unknown_or_ongoing' WHEN definite THEN 'definite_future_onset' WHEN amb THEN 'onset_boundary_ambiguous' WHEN NOT complete THEN 'incomplete_future_monitoring' ELSE 'complete_sampled_future_monitoring' END AS reason FROM lab) SELECT site, issue, CASE reason WHEN 'definite_future_onset' THEN 1 WHEN 'complete_sampled_future_monitoring' THEN 0 END AS label, reason FROM r",
    "ex_exposure": f"WITH {_ON} SELECT site, issue, CASE WHEN n_future = 0 THEN 'no_future_onset' WHEN unbounded THEN 'unknown_interval_may_precede_issue' ELSE 'bounded_interval' END AS first_status, CAST(CASE WHEN n_future > 0 AND NOT unbounded THEN 24 * (lo - issue) END AS BIGINT) AS lead_lower, CAST(CASE WHEN n_future > 0 AND NOT unbounded THEN 24 * (up - issue) END AS BIGINT) AS lead_upper FROM lab",
    "jn_coverage": f"WITH {_SLOTS} SELECT a.site, a.day, count(*) FILTER (b.usable) = {HORIZON + 1} AS complete FROM slots a JOIN slots b ON b.site = a.site AND b.day BETWEEN a.day AND a.day + {HORIZON} GROUP BY 1, 2",
    "win_causal_conv": "SELECT user_id AS site, event_id AS obs_id, round(0.5 * v + 0.25 * lag(v, 2, 0.0) OVER w + 0.25 * lag(v, 4, 0.0) OVER w, 4) AS filtered FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_issue_calendar": "SELECT site, CAST(epoch(d) AS BIGINT) + 43200 AS issue_s FROM (SELECT DISTINCT user_id AS site FROM events), (SELECT unnest(generate_series(TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d)",
    "win_expected_closures": "SELECT CAST(d AS DATE) AS issue_date, CAST(h AS BIGINT) AS horizon, CAST(c AS DATE) AS closing FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), (SELECT unnest([24, 48, 72]) AS h), LATERAL (SELECT unnest(generate_series(d - INTERVAL 3 DAY, d + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS c) WHERE c + INTERVAL 24 HOUR > d + INTERVAL 12 HOUR AND c + INTERVAL 24 HOUR <= d + INTERVAL 12 HOUR + to_hours(h)",
    "win_pagination": "SELECT linked, count(*) AS n FROM (SELECT lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) = turn + 1 AS linked FROM conversations) GROUP BY 1",
    "prj_truth_lane": f"WITH {DAILY_SQL} SELECT site, local_date, quality IN ('approved_unflagged', 'estimated_flagged') AS primary_truth, quality = 'approved_unflagged' AS input_usable FROM days",
    "agg_type8_float": f"WITH {_D},{_T} SELECT site, ref_lane, round(CAST(lo AS DOUBLE) + (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) * g_num / g_den, 4) AS threshold FROM thr",
    "agg_primary_support": f"WITH {_D},{_T},{_TR},{_L},{_I} SELECT horizon, count(*) FILTER (issue_state = 'armed') AS eligible, count(*) FILTER (l.status = 'unknown') AS unknown_n, count(*) FILTER (i.status = 'scored' AND l.status <> 'unknown') AS scoreable, count(*) FILTER (l.status = 'positive') AS positive FROM labels4 l JOIN inputs i USING (site, issue_date) WHERE ref_lane = 'primary' AND lane = 'primary' GROUP BY horizon",
    "set_panel_equal": f"WITH {_D},{_T},{_TR},{_L}, a AS (SELECT ref_lane, site, issue_date, horizon FROM labels4 WHERE lane = 'primary'), b AS (SELECT ref_lane, site, issue_date, horizon FROM labels4 WHERE lane = 'unflagged' AND status <> 'unknown') SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS n_left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS n_right_only, (SELECT count(*) FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)) AS n_equal",
    "prj_family": "SELECT CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'urgent' WHEN contains(o_orderpriority, 'HIGH') THEN 'high' WHEN contains(o_orderpriority, '-') THEN 'graded' ELSE 'other' END AS family, count(*) AS n FROM orders GROUP BY 1",
    "prj_sample_meta": "SELECT event_id, user_id AS site, epoch_us(ts) // 1000000 AS issue_s FROM events",
    "jn_seed_pair": f"WITH {PRED_SQL}, r AS (SELECT family, yr, CAST(sum(y) AS DOUBLE) / count(*) AS v FROM pred GROUP BY 1, 2) SELECT a.yr, round(a.v - b.v, 6) AS difference FROM r a JOIN r b ON b.yr = a.yr WHERE a.family = 'F' AND b.family = 'O'",
    "jn_label_horizon": f"WITH {_D},{_T},{_TR} SELECT c.site, i.local_date AS issue_date, c.local_date AS target, CAST(24 * (c.local_date - i.local_date) + 12 AS BIGINT) AS lead_hours FROM trace c JOIN days i ON i.site = c.site AND i.local_date BETWEEN c.local_date - 2 AND c.local_date WHERE c.completion AND c.ref_lane = 'primary' AND c.lane = 'primary' AND i.local_date >= DATE '2024-01-16'",
    "sink_params": "SELECT event_type, count(*) AS n, max(value) AS largest FROM events GROUP BY 1",
    "sink_release": "SELECT status, CASE status WHEN 'ok' THEN n - 2 ELSE 1 END AS n FROM (SELECT count(DISTINCT dayofweek(ts)) AS n FROM events) CROSS JOIN (VALUES ('ok'), ('missing'), ('undeclared'), ('changed')) t(status)",
    "agg_obs_coverage": f"WITH {_SLOTS} SELECT CAST(dayofweek(day) + 1 AS BIGINT) AS channel, count(value) AS observed, count(*) FILTER (value IS NULL) AS masked FROM slots GROUP BY 1",
    "agg_raw_matrix": "WITH r AS (SELECT DISTINCT user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-16') SELECT user_id, count(*) FILTER (event_type = 'view') AS \"view\", count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM r GROUP BY 1",
}
