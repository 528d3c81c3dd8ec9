"""Daily queries: thresholds, trace, labels in four cells, support and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import written
from tidemark.operators import daily as D
from tidemark.sources.views import CALENDAR, DAILY_SQL, REFERENCE_END, daily_values

#: Quantile of the reference threshold.
A, B = 3, 4
#: Lane of the reference threshold and lane of the evaluated truth.
CELLS = [(r, t) for r in ("primary", "unflagged") for t in ("primary", "unflagged")]


def days(spark, sf_dir) -> DataFrame:
    """The daily table, written once for each query, so that the branches of a plan read it and do not make it again."""
    return written(D.calendarize(daily_values(spark, sf_dir), *CALENDAR), "daily")


def thresholds(spark, sf_dir, daily: DataFrame | None = None) -> DataFrame:
    lanes = spark.createDataFrame([("primary",), ("unflagged",)], "ref_lane string")
    ref = (daily or days(spark, sf_dir)).filter(F.col("local_date") < F.lit(REFERENCE_END).cast("date")).crossJoin(F.broadcast(lanes)).filter(D.usable(F.col("ref_lane")))
    return D.type8(ref, ("site", "ref_lane"), "value", A, B)


def classed(spark, sf_dir, cells=CELLS) -> DataFrame:
    params = spark.createDataFrame(cells, "ref_lane string, lane string")
    daily = days(spark, sf_dir)
    rows = daily.crossJoin(F.broadcast(params)).join(thresholds(spark, sf_dir, daily), ["site", "ref_lane"])
    klass = F.when(~D.usable(F.col("lane")), "U").when(D.above(F.col("value")), "H").otherwise("L")
    return rows.withColumn("class", klass)


KEYS = ("site", "ref_lane", "lane")


def traced(spark, sf_dir, cells=CELLS) -> DataFrame:
    return D.state_trace(classed(spark, sf_dir, cells), KEYS)


def labels(spark, sf_dir) -> DataFrame:
    out = D.issue_labels(traced(spark, sf_dir), KEYS)
    return out.filter((F.col("issue_date") >= F.lit(REFERENCE_END).cast("date")) & (F.col("issue_date") < F.lit(CALENDAR[1]).cast("date")))


def win_state_trace(spark, sf_dir):
    return traced(spark, sf_dir).select("site", "ref_lane", "lane", "local_date", "class", "state_before", "state_after", "transition", F.col("below_run").cast("long").alias("below_run"), F.when(F.col("completion"), F.col("ordinal")).cast("long").alias("completion_no"))


def win_lineage(spark, sf_dir):
    """Completions with the three days before, which armed them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy("local_date").rowsBetween(-3, -1)
    rows = traced(spark, sf_dir).withColumn("before", F.concat_ws(",", F.collect_list(F.concat(F.col("local_date").cast("string"), F.col("class"))).over(w)))
    return rows.filter("completion").select("site", "ref_lane", "lane", "local_date", F.col("before").alias("arming"))


def win_calendarize(spark, sf_dir):
    return days(spark, sf_dir).select("site", "local_date", "value", "quality")


def agg_ref_threshold(spark, sf_dir):
    t = thresholds(spark, sf_dir)
    return t.select("site", "ref_lane", F.col("n").cast("long").alias("n"), "lo", "hi", F.col("g_num").cast("long").alias("g_num"), "g_den")


def win_issue_labels(spark, sf_dir):
    return labels(spark, sf_dir).select("site", "ref_lane", "lane", "issue_date", F.col("horizon").cast("long").alias("horizon"), "issue_state", "status", "reason", F.col("n_targets").cast("long").alias("n_targets"), F.col("n_unusable").cast("long").alias("n_unusable"), "lead_hours")


def jn_asof_latest(spark, sf_dir):
    return D.latest_admissible(days(spark, sf_dir), ("site",))


def jn_prev_closed_day(spark, sf_dir):
    return D.previous_closed_day(days(spark, sf_dir), ("site",))


def agg_input_age(spark, sf_dir):
    """Age of the latest admissible value at each issue: minimum, median, maximum by site."""
    return jn_asof_latest(spark, sf_dir).groupBy("site").agg(F.count("age_hours").alias("n"), F.min("age_hours").alias("min_age"), F.percentile("age_hours", F.lit(0.5)).alias("median_age"), F.max("age_hours").alias("max_age"))


def agg_no_score(spark, sf_dir):
    return jn_prev_closed_day(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def agg_threshold_support(spark, sf_dir):
    ref = days(spark, sf_dir).filter(F.col("local_date") < F.lit(REFERENCE_END).cast("date"))
    return ref.groupBy("site").agg(
        F.count("*").alias("n_days"), F.count_if(F.col("quality") == "approved_unflagged").alias("n_approved"),
        F.count_if(F.col("quality") == "estimated_flagged").alias("n_estimated"), F.count_if(F.col("quality") == "missing_date").alias("n_missing"),
    )


def agg_support_cells(spark, sf_dir):
    return labels(spark, sf_dir).groupBy("ref_lane", "lane", F.col("horizon").cast("long").alias("horizon")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "positive").alias("n_positive"), F.count_if(F.col("status") == "negative").alias("n_negative"),
        F.count_if(F.col("status") == "unknown").alias("n_unknown"), F.count_if(F.col("issue_state") == "armed").alias("n_eligible"),
    )


def jn_panel_pair(spark, sf_dir):
    """Label status of the primary lane against the unflagged lane, same reference: a full-outer panel."""
    some = labels(spark, sf_dir).filter("ref_lane = 'primary'").select("site", "issue_date", "horizon", "lane", "status")
    left = some.filter("lane = 'primary'").drop("lane").withColumnRenamed("status", "left_status")
    right = some.filter("lane = 'unflagged'").drop("lane").withColumnRenamed("status", "right_status")
    return left.join(right, ["site", "issue_date", "horizon"], "full_outer").groupBy("left_status", "right_status", F.col("horizon").cast("long").alias("horizon")).agg(F.count("*").alias("n"))


def agg_transition(spark, sf_dir):
    """Counts of each step between states of each cell, by site and over all sites."""
    steps = traced(spark, sf_dir)
    return steps.rollup("ref_lane", "lane", "state_before", "state_after", "site").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).filter("g in (0, 1)").drop("g")


def agg_crosstab(spark, sf_dir):
    """Label status by input status: is there a previous-day score for what is to be known?"""
    scores = jn_prev_closed_day(spark, sf_dir).select("site", "issue_date", F.col("status").alias("input_status"))
    return labels(spark, sf_dir).join(scores, ["site", "issue_date"]).groupBy("ref_lane", "lane", F.col("horizon").cast("long").alias("horizon"), "status", "issue_state", "input_status").agg(F.count("*").alias("n"))


def set_completion_diff(spark, sf_dir):
    """Completions of the primary lane that the unflagged lane has not, the other way, and both."""
    done = traced(spark, sf_dir).filter("completion and ref_lane = 'primary'")
    lanes = done.groupBy("site", "local_date").agg(F.bool_or(F.col("lane") == "primary").alias("l"), F.bool_or(F.col("lane") == "unflagged").alias("r"))
    kind = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only")
    return lanes.select("site", "local_date", kind.alias("kind"))


def agg_event_inputs(spark, sf_dir):
    """For each completion: do any and all issues that see it have a previous-day score?"""
    seen = labels(spark, sf_dir).filter("ref_lane = 'primary' and lane = 'primary' and n_targets > 0 and status = 'positive'")
    scores = jn_prev_closed_day(spark, sf_dir).select("site", "issue_date", (F.col("status") == "scored").alias("has"))
    seen = seen.join(scores, ["site", "issue_date"]).withColumn("target", F.expr("date_add(issue_date, cast((lead_hours - 12) / 24 as int))"))
    return seen.groupBy("site", "target").agg(F.bool_or("has").alias("any_input"), F.bool_and("has").alias("all_inputs"), F.count("*").alias("n"))


THRESHOLD_SQL = f"""
lanes AS (SELECT unnest(['primary', 'unflagged']) AS ref_lane),
ref AS (
  SELECT d.site, l.ref_lane, d.value, row_number() OVER (PARTITION BY d.site, l.ref_lane ORDER BY d.value) AS i,
         count(*) OVER (PARTITION BY d.site, l.ref_lane) AS n
  FROM days d CROSS JOIN lanes l
  WHERE d.local_date < DATE '2024-01-16' AND d.value IS NOT NULL
    AND (d.quality = 'approved_unflagged' OR (d.quality = 'estimated_flagged' AND l.ref_lane = 'primary'))),
pos AS (SELECT *, least(greatest({A} * (3 * n + 1) + {B}, {3 * B}), n * {3 * B}) AS num FROM ref WHERE n >= 2),
thr AS (
  SELECT site, ref_lane, n, max(CASE WHEN i = num // {3 * B} THEN value END) AS lo,
         max(CASE WHEN i = least(num // {3 * B} + 1, n) THEN value END) AS hi,
         CAST(max(num - (num // {3 * B}) * {3 * B}) AS BIGINT) AS g_num, CAST({3 * B} AS BIGINT) AS g_den
  FROM pos GROUP BY site, ref_lane, n)"""

TRACE_SQL = f"""
classed AS (
  SELECT d.site, t.ref_lane, l.ref_lane AS lane, d.local_date,
         CASE WHEN d.value IS NULL OR NOT (d.quality = 'approved_unflagged' OR (d.quality = 'estimated_flagged' AND l.ref_lane = 'primary')) THEN 'U'
              WHEN t.g_den * (d.value - t.lo) > t.g_num * (t.hi - t.lo) THEN 'H' ELSE 'L' END AS class
  FROM days d JOIN thr t ON t.site = d.site CROSS JOIN lanes l),
isl AS (SELECT *, sum(CASE WHEN class <> 'L' THEN 1 ELSE 0 END) OVER (PARTITION BY site, ref_lane, lane ORDER BY local_date) AS island FROM classed),
runs AS (
  SELECT *, CASE WHEN class = 'L' THEN row_number() OVER (PARTITION BY site, ref_lane, lane, island ORDER BY local_date) - CASE WHEN island > 0 THEN 1 ELSE 0 END ELSE 0 END AS low_run
  FROM isl),
comp AS (
  SELECT *, class = 'H' AND lag(low_run, 1, 0) OVER w >= 3 AS completion
  FROM runs WINDOW w AS (PARTITION BY site, ref_lane, lane ORDER BY local_date)),
anch AS (
  SELECT *, last_value(CASE WHEN completion THEN 'C' WHEN class = 'U' THEN 'U' END IGNORE NULLS) OVER w AS anchor,
         sum(CASE WHEN class = 'H' THEN 1 ELSE 0 END) OVER w AS highs, sum(CASE WHEN completion THEN 1 ELSE 0 END) OVER w AS ordinal
  FROM comp WINDOW w AS (PARTITION BY site, ref_lane, lane ORDER BY local_date ROWS UNBOUNDED PRECEDING)),
stated AS (
  SELECT *, CASE WHEN class = 'U' THEN 'unresolved' WHEN class = 'L' AND low_run >= 3 THEN 'armed'
                 WHEN anchor = 'C' AND class = 'H' THEN 'active' WHEN anchor = 'C' THEN 'recovering'
                 WHEN anchor = 'U' OR highs > 0 THEN 'unresolved' ELSE 'unarmed_initial' END AS state_after FROM anch),
moved AS (
  SELECT *, lag(state_after, 1, 'unarmed_initial') OVER (PARTITION BY site, ref_lane, lane ORDER BY local_date) AS state_before FROM stated),
trace AS (
  SELECT *, CASE
    WHEN class = 'U' THEN 'missing_or_unusable_break'
    WHEN class = 'H' AND state_before = 'armed' THEN 'qualifying_completion'
    WHEN class = 'H' AND state_before IN ('active', 'recovering') THEN 'same_disarmed_episode'
    WHEN class = 'H' THEN 'censored_high_without_armed_predecessor'
    WHEN state_before = 'armed' THEN 'remain_armed'
    WHEN state_before IN ('active', 'recovering') AND state_after = 'armed' THEN 'rearmed_after_three_below'
    WHEN state_before IN ('active', 'recovering') THEN 'recovery_below_day'
    WHEN state_after = 'armed' THEN 'armed_after_three_below'
    WHEN state_before = 'unarmed_initial' THEN 'initial_below_accumulation' ELSE 'unresolved_below_accumulation' END AS transition
  FROM moved)"""

LABEL_SQL = """
horizons AS (SELECT unnest([24, 48, 72]) AS horizon),
future AS (
  SELECT i.site, i.ref_lane, i.lane, i.local_date AS issue_date, CAST(h.horizon AS BIGINT) AS horizon, i.state_before AS issue_state,
         CAST(sum(CASE WHEN f.completion THEN 1 ELSE 0 END) AS BIGINT) AS n_targets,
         CAST(h.horizon // 24 - count(*) + sum(CASE WHEN f.class = 'U' OR f.transition = 'censored_high_without_armed_predecessor' THEN 1 ELSE 0 END) AS BIGINT) AS n_unusable,
         CAST(24 * (min(CASE WHEN f.completion THEN f.local_date END) - i.local_date) + 12 AS BIGINT) AS lead_hours
  FROM trace i CROSS JOIN horizons h
  JOIN trace f ON f.site = i.site AND f.ref_lane = i.ref_lane AND f.lane = i.lane AND f.local_date >= i.local_date AND f.local_date < i.local_date + CAST(h.horizon // 24 AS INTEGER)
  WHERE i.local_date >= DATE '2024-01-16'
  GROUP BY i.site, i.ref_lane, i.lane, i.local_date, h.horizon, i.state_before),
labels4 AS (
  SELECT *, CASE WHEN issue_state <> 'armed' THEN 'unknown' WHEN n_targets > 0 THEN 'positive' WHEN n_unusable > 0 THEN 'unknown' ELSE 'negative' END AS status,
         CASE WHEN issue_state <> 'armed' THEN 'issue_state_not_armed:' || issue_state WHEN n_targets > 0 THEN 'definite_completion'
              WHEN n_unusable > 0 THEN 'future_truth_incomplete' ELSE 'complete_closures' END AS reason
  FROM future)"""

INPUT_SQL = """
prev AS (
  SELECT site, local_date AS issue_date, lag(local_date) OVER w AS b, lag(quality) OVER w AS q, lag(value) OVER w AS v
  FROM days WINDOW w AS (PARTITION BY site ORDER BY local_date)),
inputs AS (
  SELECT site, issue_date, CASE WHEN b IS NULL THEN 'no_score_no_expected_closed_day' WHEN q = 'missing_date' THEN 'no_score_missing_latest_expected_row'
         WHEN q <> 'approved_unflagged' THEN 'no_score_latest_row_quality_' || q ELSE 'scored' END AS status, v
  FROM prev),
latest AS (
  SELECT d.site, d.local_date AS issue_date, max(s.local_date) AS source_date
  FROM days d LEFT JOIN days s ON s.site = d.site AND s.local_date < d.local_date AND s.quality = 'approved_unflagged' AND s.value IS NOT NULL
  GROUP BY d.site, d.local_date)"""

_D, _T, _TR, _L, _I = DAILY_SQL, THRESHOLD_SQL, TRACE_SQL, LABEL_SQL, INPUT_SQL
ASOF = "SELECT l.site, l.issue_date, s.value AS score, l.source_date, CAST(24 * (l.issue_date - l.source_date) - 12 AS BIGINT) AS age_hours FROM latest l LEFT JOIN days s ON s.site = l.site AND s.local_date = l.source_date"

QUERIES = {
    f.__name__: f
    for f in (win_state_trace, win_lineage, win_calendarize, agg_ref_threshold, win_issue_labels, jn_asof_latest, jn_prev_closed_day, agg_input_age, agg_no_score, agg_threshold_support, agg_support_cells, jn_panel_pair, agg_transition, agg_crosstab, set_completion_diff, agg_event_inputs)
}
SQL = {
    "win_state_trace": f"WITH {_D},{_T},{_TR} SELECT site, ref_lane, lane, local_date, class, state_before, state_after, transition, CAST(least(low_run, 3) AS BIGINT) AS below_run, CAST(CASE WHEN completion THEN ordinal END AS BIGINT) AS completion_no FROM trace",
    "win_lineage": f"WITH {_D},{_T},{_TR} SELECT c.site, c.ref_lane, c.lane, c.local_date, string_agg(CAST(b.local_date AS VARCHAR) || b.class, ',' ORDER BY b.local_date) AS arming FROM trace c JOIN trace b ON b.site = c.site AND b.ref_lane = c.ref_lane AND b.lane = c.lane AND b.local_date BETWEEN c.local_date - 3 AND c.local_date - 1 WHERE c.completion GROUP BY ALL",
    "win_calendarize": f"WITH {_D} SELECT site, local_date, value, quality FROM days",
    "agg_ref_threshold": f"WITH {_D},{_T} SELECT site, ref_lane, n, lo, hi, g_num, g_den FROM thr",
    "win_issue_labels": f"WITH {_D},{_T},{_TR},{_L} SELECT site, ref_lane, lane, issue_date, horizon, issue_state, status, reason, n_targets, n_unusable, lead_hours FROM labels4",
    "jn_asof_latest": f"WITH {_D},{_I} {ASOF}",
    "jn_prev_closed_day": f"WITH {_D},{_I} SELECT site, issue_date, status, CASE WHEN status = 'scored' THEN v END AS score, CAST(CASE WHEN status = 'scored' THEN 12 END AS BIGINT) AS age_hours FROM inputs",
    "agg_input_age": f"WITH {_D},{_I}, a AS ({ASOF}) SELECT site, count(age_hours) AS n, min(age_hours) AS min_age, quantile_cont(age_hours, 0.5) AS median_age, max(age_hours) AS max_age FROM a GROUP BY site",
    "agg_no_score": f"WITH {_D},{_I} SELECT status, count(*) AS n FROM inputs GROUP BY status",
    "agg_threshold_support": f"WITH {_D} SELECT site, count(*) AS n_days, count(*) FILTER (quality = 'approved_unflagged') AS n_approved, count(*) FILTER (quality = 'estimated_flagged') AS n_estimated, count(*) FILTER (quality = 'missing_date') AS n_missing FROM days WHERE local_date < DATE '2024-01-16' GROUP BY site",
    "agg_support_cells": f"WITH {_D},{_T},{_TR},{_L} SELECT ref_lane, lane, horizon, count(*) AS n, count(*) FILTER (status = 'positive') AS n_positive, count(*) FILTER (status = 'negative') AS n_negative, count(*) FILTER (status = 'unknown') AS n_unknown, count(*) FILTER (issue_state = 'armed') AS n_eligible FROM labels4 GROUP BY ALL",
    "jn_panel_pair": f"WITH {_D},{_T},{_TR},{_L} SELECT a.status AS left_status, b.status AS right_status, horizon, count(*) AS n FROM (SELECT * FROM labels4 WHERE ref_lane = 'primary' AND lane = 'primary') a FULL JOIN (SELECT * FROM labels4 WHERE ref_lane = 'primary' AND lane = 'unflagged') b USING (site, issue_date, horizon) GROUP BY ALL",
    "agg_transition": f"WITH {_D},{_T},{_TR} SELECT ref_lane, lane, state_before, state_after, site, count(*) AS n FROM trace GROUP BY GROUPING SETS ((ref_lane, lane, state_before, state_after, site), (ref_lane, lane, state_before, state_after))",
    "agg_crosstab": f"WITH {_D},{_T},{_TR},{_L},{_I} SELECT ref_lane, lane, horizon, l.status, issue_state, i.status AS input_status, count(*) AS n FROM labels4 l JOIN inputs i USING (site, issue_date) GROUP BY ALL",
    "set_completion_diff": f"""WITH {_D},{_T},{_TR},
        a AS (SELECT site, local_date FROM trace WHERE completion AND ref_lane = 'primary' AND lane = 'primary'), b AS (SELECT site, local_date FROM trace WHERE completion AND ref_lane = 'primary' AND lane = 'unflagged')
        SELECT site, local_date, 'left_only' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT site, local_date, 'right_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT site, local_date, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""",
    "agg_event_inputs": f"WITH {_D},{_T},{_TR},{_L},{_I} SELECT site, issue_date + CAST((lead_hours - 12) // 24 AS INTEGER) AS target, bool_or(i.status = 'scored') AS any_input, bool_and(i.status = 'scored') AS all_inputs, count(*) AS n FROM labels4 l JOIN inputs i USING (site, issue_date) WHERE ref_lane = 'primary' AND lane = 'primary' AND l.status = 'positive' GROUP BY ALL",
}
