"""Series queries over events: episodes, onsets, alerts, visibility and control charts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.shared import shared_path, written
from tidemark.operators import daily as D
from tidemark.operators import series as S
from tidemark.streaming.charts import OUTPUT, run_available, stream_control_chart
from tidemark.sources.views import CALENDAR, DAILY_SQL, daily_values, observations

THRESHOLD, DAY_THRESHOLD = 80, 120
MEAN, SCALE, ALPHA, SLACK = 50.0, 40.0, 0.25, 0.25


def timed(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("t", S.micros("ts"))


def slots(spark, sf_dir):
    rows = D.calendarize(daily_values(spark, sf_dir), *CALENDAR)
    return rows.select("site", F.col("local_date").alias("day"), "value", (F.col("quality") == "approved_unflagged").alias("usable"))


def win_episodes(spark, sf_dir):
    """Episodes with the greatest category that their peak reaches."""
    peak = F.col("peak_value")
    out = S.episodes(timed(spark, sf_dir), THRESHOLD)
    return out.withColumn("max_category", F.when(peak >= 99, "major").when(peak >= 95, "moderate").when(peak >= 90, "minor").otherwise("action"))


def win_onsets(spark, sf_dir):
    return S.onsets(slots(spark, sf_dir), DAY_THRESHOLD)


def win_persist_alert(spark, sf_dir):
    return S.first_persistent(slots(spark, sf_dir), DAY_THRESHOLD, 2)


def jn_asof_filter(spark, sf_dir):
    """Observations become available six hours after they end; issues are the noons of the calendar."""
    obs = timed(spark, sf_dir).select("site", F.col("t").alias("t_end"), (F.col("t") + 6 * S.HOUR).alias("t_available"), "value")
    noon = F.explode(F.sequence(F.lit(0), F.lit(29))).alias("d")
    issues = obs.select("site").distinct().select("site", noon).select("site", (F.lit(1_704_067_200_000_000) + F.col("d") * 24 * S.HOUR + 12 * S.HOUR).alias("t_issue"))
    return S.visible(obs, issues)


def win_cooldown(spark, sf_dir):
    return S.cooldown(timed(spark, sf_dir).filter(F.col("value") >= THRESHOLD), 48)


def win_ewma_cusum(spark, sf_dir):
    out = S.ewma_cusum(timed(spark, sf_dir), MEAN, SCALE, ALPHA, SLACK)
    return out.withColumns({"ewma": F.round("ewma", 9), "cusum": F.round("cusum", 9)})


def win_continuous_spc(spark, sf_dir):
    out = S.control_chart(slots(spark, sf_dir).withColumn("value", F.when(F.col("usable"), F.col("value"))), MEAN * 2, SCALE * 2)
    return out.withColumns({c: F.round(c, 6) for c in ("ewma", "cusum", "score")})


def win_stream_spc(spark, sf_dir):
    """The same chart as an event-time stream: days come shuffled in waves, and the query starts three times from its checkpoint."""
    days = slots(spark, sf_dir).select("site", "day", F.when(F.col("usable"), F.col("value").cast("double")).alias("value"))
    place = F.datediff("day", F.lit(CALENDAR[0]).cast("date"))
    wave = F.floor((place + F.pmod(F.xxhash64("site", "day"), F.lit(10))) / 10).cast("int")  # up to ten days late
    waves = written(days.withColumn("wave", wave), "waves")
    source, out, state = (shared_path(spark, x) for x in ("slots", "chart", "chart_state"))
    heartbeat = spark.range(1).select(F.lit(None).cast("long").alias("site"), F.lit("2024-03-31").cast("date").alias("day"), F.lit(None).cast("double").alias("value"))
    for batch in (waves.filter("wave <= 1"), waves.filter("wave > 1"), heartbeat):
        batch.select("site", "day", "value").write.mode("append").parquet(source)
        stream = spark.readStream.schema("site long, day date, value double").parquet(source)
        run_available(spark, stream_control_chart(stream, MEAN * 2, SCALE * 2), out, state)
    return spark.read.schema(OUTPUT).parquet(out).withColumns({c: F.round(c, 6) for c in ("ewma", "cusum", "score")})


def win_roc(spark, sf_dir):
    """Rate of change an hour between neighbouring observations of a site."""
    w = Window.partitionBy("site").orderBy("t", "obs_id")
    rows = timed(spark, sf_dir)
    rate = (F.col("value").cast("double") - F.lag(F.col("value").cast("double")).over(w)) * S.HOUR / (F.col("t") - F.lag("t").over(w))
    return rows.select("site", "obs_id", F.round(rate, 4).alias("rate"))


def win_unique_rows(spark, sf_dir):
    """Exact repeats collapse, conflicting versions of a (site, minute) are told: rows and distinct values each."""
    rows = timed(spark, sf_dir).withColumn("minute", F.expr("t div 60000000"))
    return rows.groupBy("site", "minute").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_versions")).filter("n > 1")


def win_calendar(spark, sf_dir):
    """Half-open hourly calendar of one day for every site."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h")
    return observations(spark, sf_dir).select("site").distinct().select("site", hours).select("site", F.col("h").cast("long").alias("h"))


def ml_persistence(spark, sf_dir):
    """Latest value of each site, carried over three steps; exact repeats of a time take the larger id."""
    last = timed(spark, sf_dir).groupBy("site").agg(F.max_by("value", F.struct("t", "obs_id")).alias("forecast"))
    return last.select("site", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step"), "forecast").withColumn("step", F.col("step").cast("long"))


def agg_tabular_features(spark, sf_dir):
    """Window statistics of each site and week: first, last, smallest, largest, spread, relative to the first."""
    rows = timed(spark, sf_dir).withColumn("week", F.expr(f"(t - 1704067200000000) div {7 * 24 * S.HOUR}"))
    key = F.struct("t", "obs_id")
    out = rows.groupBy("site", "week").agg(F.min_by("value", key).alias("first_v"), F.max_by("value", key).alias("last_v"), F.min("value").alias("min_v"), F.max("value").alias("max_v"), F.count("*").alias("n"))
    return out.withColumn("rise", F.col("last_v") - F.col("first_v"))


_OBS = "obs AS (SELECT user_id AS site, event_id AS obs_id, epoch_us(ts) AS t, CAST(value AS DECIMAL(18,2)) AS value FROM events)"
_SLOTS = DAILY_SQL + ", slots AS (SELECT site, local_date AS day, value, quality = 'approved_unflagged' AS usable FROM days)"

QUERIES = {
    f.__name__: f
    for f in (win_episodes, win_onsets, win_persist_alert, jn_asof_filter, win_cooldown, win_ewma_cusum, win_continuous_spc, win_stream_spc, win_roc, win_unique_rows, win_calendar, ml_persistence, agg_tabular_features)
}
SQL = {
    "win_episodes": f"""WITH {_OBS}, r AS (SELECT *, value >= {THRESHOLD} AS above, lag(t) OVER w AS previous FROM obs WINDOW w AS (PARTITION BY site ORDER BY t, obs_id)),
        c AS (SELECT *, sum(CAST(above AS INTEGER)) OVER (PARTITION BY site ORDER BY t, obs_id ROWS UNBOUNDED PRECEDING) AS nth FROM r),
        e AS (SELECT site, nth, max(t) FILTER (above) AS t, max(value) FILTER (above) AS value, max(previous) FILTER (above) AS previous, max(t) FILTER (NOT above) - min(t) FILTER (NOT above) AS dip FROM c WHERE nth > 0 GROUP BY 1, 2),
        s AS (SELECT *, CASE WHEN nth = 1 OR coalesce(lag(dip) OVER (PARTITION BY site ORDER BY nth), 0) >= 86400000000 THEN 1 ELSE 0 END AS starts FROM e),
        g AS (SELECT *, sum(starts) OVER (PARTITION BY site ORDER BY nth ROWS UNBOUNDED PRECEDING) AS episode FROM s),
        a AS (SELECT site, CAST(episode AS BIGINT) AS episode, arg_min(t, nth) AS onset_upper, max(t) AS last_t, max(value) AS pv, max(nth) AS nl, min(nth) AS nf FROM g GROUP BY 1, 2)
        SELECT a.site, a.episode, f.previous AS onset_lower, a.onset_upper, (SELECT max(t) FROM g WHERE g.site = a.site AND g.episode = a.episode AND g.value = a.pv) AS peak_t, a.pv AS peak_value,
          CASE WHEN coalesce(l.dip, 0) >= 86400000000 THEN a.last_t END AS end_t, CASE WHEN coalesce(l.dip, 0) >= 86400000000 THEN a.last_t - a.onset_upper END AS duration,
          f.previous IS NULL AS left_censored, NOT coalesce(l.dip, 0) >= 86400000000 AS right_censored,
          CASE WHEN a.pv >= 99 THEN 'major' WHEN a.pv >= 95 THEN 'moderate' WHEN a.pv >= 90 THEN 'minor' ELSE 'action' END AS max_category
        FROM a JOIN g f ON f.site = a.site AND f.nth = a.nf JOIN g l ON l.site = a.site AND l.nth = a.nl""",
    "win_onsets": f"""WITH {_SLOTS}, k AS (SELECT *, CASE WHEN NOT usable OR value IS NULL THEN 'U' WHEN value <= {DAY_THRESHOLD} THEN 'L' ELSE 'H' END AS class FROM slots),
        i AS (SELECT *, sum(CASE WHEN class <> 'L' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY day) AS island FROM k),
        m AS (SELECT *, CASE WHEN class = 'H' THEN 'H' WHEN class = 'L' AND day - min(CASE WHEN class = 'L' THEN day END) OVER (PARTITION BY site, island) >= 3 THEN 'R' END AS marker FROM i),
        f AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'R') = 'R' AS free_before,
          coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS UNBOUNDED PRECEDING), 'R') = 'R' AS free_now,
          last_value(CASE WHEN class = 'L' THEN day END IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_before FROM m)
        SELECT site, day, class, class = 'H' AND free_before AS is_onset, CASE WHEN class = 'H' AND free_before THEN low_before END AS onset_lower,
          CASE WHEN class = 'H' THEN false WHEN class = 'L' THEN free_now END AS at_risk FROM f""",
    "win_persist_alert": f"WITH {_SLOTS}, p AS (SELECT *, lag(value) OVER (PARTITION BY site ORDER BY day) AS v1 FROM slots) SELECT site, min(day) AS alert_day FROM p WHERE value >= {DAY_THRESHOLD} AND v1 >= {DAY_THRESHOLD} GROUP BY site",
    "jn_asof_filter": f"""WITH {_OBS}, iss AS (SELECT site, 1704067200000000 + d * 86400000000 + 43200000000 AS t_issue FROM (SELECT DISTINCT site FROM obs), (SELECT unnest(range(0, 30)) AS d))
        SELECT i.site, i.t_issue, count(o.t) AS n_visible, max(o.t) AS latest_t, arg_max(o.value, (o.t, o.value)) AS latest_value FROM iss i LEFT JOIN obs o ON o.site = i.site AND o.t + 21600000000 <= i.t_issue GROUP BY 1, 2""",
    "win_cooldown": f"""WITH RECURSIVE {_OBS}, al AS (SELECT site, t, obs_id, row_number() OVER (PARTITION BY site ORDER BY t, obs_id) AS i FROM obs WHERE value >= {THRESHOLD}),
        walk AS (SELECT site, t, obs_id, i, t AS kept, true AS keep FROM al WHERE i = 1
          UNION ALL SELECT a.site, a.t, a.obs_id, a.i, CASE WHEN a.t - w.kept >= 172800000000 THEN a.t ELSE w.kept END, a.t - w.kept >= 172800000000 FROM walk w JOIN al a ON a.site = w.site AND a.i = w.i + 1)
        SELECT site, t, obs_id FROM walk WHERE keep""",
    "win_ewma_cusum": f"""WITH RECURSIVE {_OBS}, o AS (SELECT site, t, obs_id, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY site ORDER BY t, obs_id) AS i FROM obs),
        walk AS (SELECT site, t, obs_id, i, {ALPHA} * v + {1 - ALPHA} * {MEAN} AS e, greatest(0.0, ({ALPHA} * v + {1 - ALPHA} * {MEAN} - {MEAN}) / {SCALE} - {SLACK}) AS c FROM o WHERE i = 1
          UNION ALL SELECT o.site, o.t, o.obs_id, o.i, {ALPHA} * o.v + {1 - ALPHA} * w.e, greatest(0.0, w.c + ({ALPHA} * o.v + {1 - ALPHA} * w.e - {MEAN}) / {SCALE} - {SLACK}) FROM walk w JOIN o ON o.site = w.site AND o.i = w.i + 1)
        SELECT site, t, obs_id, round(e, 9) AS ewma, round(c, 9) AS cusum FROM walk""",
    "win_continuous_spc": f"""WITH RECURSIVE {_SLOTS}, o AS (SELECT site, day, CAST(CASE WHEN usable THEN value END AS DOUBLE) AS v, row_number() OVER (PARTITION BY site ORDER BY day) AS i FROM slots),
        walk AS (SELECT site, day, i, e, CASE WHEN v IS NULL THEN 0.0 ELSE greatest(0.0, (e - {2 * MEAN}) / ({2 * SCALE} * sqrt(0.3 / 1.7)) - 0.5) END AS c, v IS NULL AS missing
            FROM (SELECT *, CASE WHEN v IS NULL THEN {2 * MEAN} ELSE 0.3 * v + 0.7 * {2 * MEAN} END AS e FROM o WHERE i = 1)
          UNION ALL SELECT site, day, i, e, CASE WHEN v IS NULL THEN 0.9 * c0 ELSE greatest(0.0, 0.9 * c0 + (e - {2 * MEAN}) / ({2 * SCALE} * sqrt(0.3 / 1.7)) - 0.5) END, v IS NULL
            FROM (SELECT o.site, o.day, o.i, o.v, w.c AS c0, CASE WHEN o.v IS NULL THEN 0.15 * {2 * MEAN} + 0.85 * w.e ELSE 0.3 * o.v + 0.7 * w.e END AS e FROM walk w JOIN o ON o.site = w.site AND o.i = w.i + 1))
        SELECT site, day, round(e, 6) AS ewma, round(c, 6) AS cusum, CASE WHEN NOT missing THEN round(0.5 * (e - {2 * MEAN}) / ({2 * SCALE} * sqrt(0.3 / 1.7)) + 0.5 * c, 6) END AS score FROM walk""",
    "win_roc": f"WITH {_OBS} SELECT site, obs_id, round((CAST(value AS DOUBLE) - lag(CAST(value AS DOUBLE)) OVER w) * 3600000000 / (t - lag(t) OVER w), 4) AS rate FROM obs WINDOW w AS (PARTITION BY site ORDER BY t, obs_id)",
    "win_unique_rows": f"WITH {_OBS} SELECT site, t // 60000000 AS minute, count(*) AS n, count(DISTINCT value) AS n_versions FROM obs GROUP BY 1, 2 HAVING count(*) > 1",
    "win_calendar": f"WITH {_OBS} SELECT site, h FROM (SELECT DISTINCT site FROM obs), (SELECT unnest(range(0, 24)) AS h)",
    "ml_persistence": f"WITH {_OBS} SELECT site, step, arg_max(value, (t, obs_id)) AS forecast FROM obs, (SELECT unnest(range(1, 4)) AS step) GROUP BY 1, 2",
    "agg_tabular_features": f"WITH {_OBS} SELECT site, (t - 1704067200000000) // 604800000000 AS week, arg_min(value, (t, obs_id)) AS first_v, arg_max(value, (t, obs_id)) AS last_v, min(value) AS min_v, max(value) AS max_v, count(*) AS n, arg_max(value, (t, obs_id)) - arg_min(value, (t, obs_id)) AS rise FROM obs GROUP BY 1, 2",
}

SQL["win_stream_spc"] = SQL["win_continuous_spc"]
