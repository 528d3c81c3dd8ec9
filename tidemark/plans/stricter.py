"""Guards with planted faults, and the whole forms of features, support and contrasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import guards, windows
from tidemark.operators.series import HOUR, visible
from tidemark.plans.daily import days
from tidemark.plans.series import timed
from tidemark.sources.views import CALENDAR, DAILY_SQL, REFERENCE_END, table


def _basis():
    i = F.col("obs_id")
    return F.when(i % 97 == 0, "unknown").when(i % 89 == 0, None).when(i % 5 == 0, "assumed").otherwise("measured")


def _available():
    i = F.col("obs_id")
    return F.when(i % 83 == 0, None).when(i % 79 == 0, F.col("t") - 1).otherwise(F.col("t") + 6 * HOUR)


def _observed(spark, sf_dir):
    rows = timed(spark, sf_dir).withColumns({"basis": _basis(), "t_available": _available()})
    return rows.select("site", F.col("obs_id").alias("record_id"), F.col("t").alias("t_end"), "t_available", "basis", "value")


def jn_asof_guard(spark, sf_dir):
    """Observations that no as-of selection may take, with the reason, when assumed availability is not allowed and when it is."""
    rows = _observed(spark, sf_dir)
    out = None
    for allowed in (False, True):
        some = rows.withColumn("problem", guards.availability_problem(allowed)).filter("problem is not null").select("record_id", "problem", F.lit(allowed).alias("allow_assumed"))
        out = some if out is None else out.unionByName(some)
    return out


def jn_asof_admissible(spark, sf_dir):
    """Visible observations at each noon, from verified or assumed rows alone: the guard lets them pass or raises."""
    sound = _observed(spark, sf_dir).filter(guards.availability_problem(True).isNull())
    obs = guards.admissible(sound, allow_assumed=True)
    noons = F.explode(F.sequence(F.lit(0), F.lit(29))).alias("d")
    issues = sound.select("site").distinct().select("site", noons).select("site", (F.lit(1_704_067_200_000_000) + F.col("d") * 24 * HOUR + 12 * HOUR).alias("t_issue"))
    return visible(obs, issues).select("site", "t_issue", "n_visible", "latest_t", "latest_value")


def _versions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.col("user_id").alias("site"), F.col("event_type").alias("series"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"), "value")
    return rows.unionByName(rows.filter("record_id % 7 = 0")).unionByName(rows.filter("record_id % 35 = 0"))


def win_unique_collapse(spark, sf_dir):
    """Rows, some of them three times, collapsed; conflicts would raise."""
    return guards.unique_rows(_versions(spark, sf_dir), ["site", "series", "t"])


def val_version_conflicts(spark, sf_dir):
    """Planted conflicts: other values under an id, and other ids of one site, series and time."""
    rows = _versions(spark, sf_dir)
    other = rows.filter("record_id % 101 = 0").withColumn("value", F.col("value") + 1)
    again = rows.filter("record_id % 103 = 0").withColumn("record_id", F.col("record_id") + 1_000_000_000)
    return guards.version_conflicts(rows.unionByName(other).unionByName(again), ["site", "series", "t"])


def prj_numeric_strict(spark, sf_dir):
    """Event values as provider JSON: texts, negatives, exponents, nothing, numbers, words and what is not finite."""
    i, v = F.col("event_id"), F.col("value").cast("decimal(18,2)").cast("string")
    raw = F.element_at(F.array(v, F.concat(F.lit("-"), v), F.concat(v, F.lit("e2")), F.lit(None).cast("string"), v, F.lit("Ice"), F.lit("NaN"), F.lit("-Infinity"), F.lit("1e60"), F.lit("")), (i % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumns(guards.strict_number(F.col("raw"), i % 10 != 4)).drop("raw")


def gr_network(spark, sf_dir):
    """Nations and their regions' first nation as a verified network."""
    nations = table(spark, sf_dir, "nation")
    first = nations.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("b"))
    edges = nations.join(first, "n_regionkey").select(F.col("n_nationkey").alias("a"), "b")
    return guards.network_components(nations.select(F.col("n_nationkey").alias("node")), edges, topology_verified=True)


def agg_tabular_window(spark, sf_dir):
    """Stage (clicks and views) and flow (all other kinds) figures of each site and week; errors are not observed."""
    rows = timed(spark, sf_dir).withColumn("week", F.expr(f"(t - 1704067200000000) div {7 * 24 * HOUR}"))
    channel = F.when(F.col("kind").isin("click", "view"), "stage").otherwise("flow")
    rows = rows.withColumns({"channel": channel, "value": F.when(F.col("kind") != "error", F.col("value"))})
    out = windows.tabular_features(rows, ["site", "week"], ["t", "obs_id"])
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c not in ("site", "week")})


def agg_threshold_years(spark, sf_dir):
    return windows.reference_support(days(spark, sf_dir), CALENDAR[0], REFERENCE_END)


def st_contrast_years(spark, sf_dir):
    """For every year the months' shares of returns under high discounts less those under low ones: interval, sign flips, decision."""
    y, hi = (F.col("l_returnflag") == "R").cast("long"), F.round(F.col("l_discount") * 100) >= 5
    m = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("m")).agg(F.sum(F.when(hi, y)).alias("a"), F.count_if(hi).alias("na"), F.sum(F.when(~hi, y)).alias("b"), F.count_if(~hi).alias("nb"))
    out = windows.paired_contrast(m.select("yr", (F.col("a") / F.col("na") - F.col("b") / F.col("nb")).alias("d")), "yr")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("yr", "n", "decision")})


_OBSERVED = f"""obs AS (
  SELECT user_id AS site, event_id AS record_id, epoch_us(ts) AS t_end, CAST(value AS DECIMAL(18,2)) AS value,
    CASE WHEN event_id % 97 = 0 THEN 'unknown' WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'assumed' ELSE 'measured' END AS basis,
    CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 79 = 0 THEN epoch_us(ts) - 1 ELSE epoch_us(ts) + {6 * HOUR} END AS t_available FROM events),
judged AS (
  SELECT obs.*, a.allow_assumed, CASE WHEN basis IS NULL THEN 'not_a_basis' WHEN basis = 'unknown' THEN 'unknown_basis' WHEN basis = 'assumed' AND NOT allow_assumed THEN 'assumed_basis'
    WHEN t_available IS NULL THEN 'no_availability' WHEN t_available < t_end THEN 'available_before_its_end' END AS problem FROM obs, (VALUES (TRUE), (FALSE)) a(allow_assumed))"""
_V = "v AS (SELECT event_id AS record_id, user_id AS site, event_type AS series, epoch_us(ts) AS t, value FROM events)"


def _figures(channel: str, wanted: tuple[str, ...]) -> str:
    agg = lambda f, extra="": f"{f}(CAST(value AS DOUBLE){extra}) FILTER (channel = '{channel}')"
    first, last = agg("arg_min", ", (t, obs_id)"), agg("arg_max", ", (t, obs_id)")
    made = {"delta": f"{last} - {first}", "std": agg("stddev_pop"), "min": f"{agg('min')} - {first}", "max": f"{agg('max')} - {first}", "range": f"{agg('max')} - {agg('min')}", "latest": f"{last} - {agg('avg')}"}
    return ", ".join(f"round(CASE WHEN {agg('count')} > 1 THEN {made[k]} ELSE 0.0 END, 5) AS {channel}_{k}" for k in wanted)


#: Two-sided 95 % Student-t values of 1 to 11 degrees of freedom (fixed values).
_T = "[12.706204736432095, 4.302652729911275, 3.182446305284263, 2.7764451051977987, 2.570581835636314, 2.4469118511449692, 2.3646242515927844, 2.306004135204166, 2.2621571628540993, 2.2281388519649385, 2.200985160082949]"

QUERIES = {f.__name__: f for f in (jn_asof_guard, jn_asof_admissible, win_unique_collapse, val_version_conflicts, prj_numeric_strict, gr_network, agg_tabular_window, agg_threshold_years, st_contrast_years)}
SQL = {
    "jn_asof_guard": f"WITH {_OBSERVED} SELECT record_id, problem, allow_assumed FROM judged WHERE problem IS NOT NULL",
    "jn_asof_admissible": f"""WITH {_OBSERVED}, sound AS (SELECT *, greatest(t_end, t_available) AS seen FROM judged WHERE allow_assumed AND problem IS NULL),
        iss AS (SELECT site, 1704067200000000 + d * 86400000000 + 43200000000 AS t_issue FROM (SELECT DISTINCT site FROM sound), (SELECT unnest(range(0, 30)) AS d))
        SELECT i.site, i.t_issue, count(s.t_end) AS n_visible, max(s.t_end) AS latest_t, arg_max(s.value, (s.t_end, s.value)) AS latest_value FROM iss i LEFT JOIN sound s ON s.site = i.site AND s.seen <= i.t_issue GROUP BY 1, 2""",
    "win_unique_collapse": f"WITH {_V} SELECT * FROM v",
    "val_version_conflicts": f"WITH {_V} SELECT 'conflicting_rows' AS kind, CAST(record_id AS VARCHAR) AS id FROM v WHERE record_id % 101 = 0 UNION ALL SELECT 'several_versions', site || ':' || series || ':' || t FROM v WHERE record_id % 103 = 0",
    "prj_numeric_strict": """SELECT event_id, CAST(CASE event_id % 10 WHEN 0 THEN CAST(value AS DECIMAL(18,2)) WHEN 1 THEN -CAST(value AS DECIMAL(18,2)) WHEN 2 THEN CAST(value AS DECIMAL(18,2)) * 100 END AS DECIMAL(38,6)) AS number,
        CASE event_id % 10 WHEN 1 THEN CASE WHEN CAST(value AS DECIMAL(18,2)) > 0 THEN 'negative_value_preserved' END WHEN 3 THEN 'null_value' WHEN 4 THEN 'non_string_value' WHEN 5 THEN 'invalid_decimal_value'
          WHEN 6 THEN 'non_finite_value' WHEN 7 THEN 'non_finite_value' WHEN 8 THEN 'beyond_the_declared_range' WHEN 9 THEN 'invalid_decimal_value' END AS number_problem FROM events""",
    "gr_network": "SELECT n_nationkey AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS root FROM nation",
    "agg_tabular_window": f"""WITH o AS (SELECT user_id AS site, event_id AS obs_id, epoch_us(ts) AS t, CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(18,2)) END AS value, CASE WHEN event_type IN ('click', 'view') THEN 'stage' ELSE 'flow' END AS channel FROM events),
        seen AS (SELECT site, (t - 1704067200000000) // 604800000000 AS week, obs_id, t, value, channel FROM o WHERE value IS NOT NULL),
        every AS (SELECT DISTINCT site, (t - 1704067200000000) // 604800000000 AS week FROM o),
        f AS (SELECT site, week, {_figures('stage', ('delta', 'std', 'min', 'max', 'range', 'latest'))}, {_figures('flow', ('delta', 'std', 'range', 'latest'))} FROM seen GROUP BY 1, 2)
        SELECT e.site, e.week, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in [*[f'stage_{k}' for k in ('delta', 'std', 'min', 'max', 'range', 'latest')], *[f'flow_{k}' for k in ('delta', 'std', 'range', 'latest')]])} FROM every e LEFT JOIN f USING (site, week)""",
    "agg_threshold_years": f"""WITH {DAILY_SQL}, u AS (
          SELECT d.site, l.ref_lane, d.quality, d.value IS NOT NULL AND (d.quality = 'approved_unflagged' OR (d.quality = 'estimated_flagged' AND l.ref_lane = 'primary')) AS ok
          FROM days d, (SELECT unnest(['primary', 'unflagged']) AS ref_lane) l WHERE d.local_date < DATE '2024-01-16')
        SELECT site, ref_lane, 2024 AS year, count(*) FILTER (ok) AS n_usable, count(*) FILTER (quality = 'approved_unflagged') AS n_unflagged, count(*) FILTER (quality = 'estimated_flagged') AS n_estimated,
          count(*) FILTER (NOT ok) AS n_unusable, count(*) FILTER (ok) > 0 AS all_years_supported FROM u GROUP BY 1, 2""",
    "st_contrast_years": f"""WITH m AS (
          SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, month(l_shipdate) AS m, round(l_discount * 100) >= 5 AS hi, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS share FROM lineitem GROUP BY 1, 2, 3),
        diffs AS (SELECT yr, m, max(share) FILTER (hi) - max(share) FILTER (NOT hi) AS d FROM m GROUP BY 1, 2),
        s AS (SELECT yr, count(d) AS n, avg(d) AS mean_d, stddev_samp(d) AS sd_d, list(d ORDER BY m) AS ds FROM diffs GROUP BY 1),
        flips AS (SELECT yr, ds, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS mask FROM s),
        sums AS (SELECT yr, abs(list_sum(list_transform(ds, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN -x ELSE x END))) AS t, abs(list_sum(ds)) AS seen FROM flips),
        p AS (SELECT yr, CAST(count(*) FILTER (t >= seen - 1e-12) AS DOUBLE) / count(*) AS p_value FROM sums GROUP BY 1),
        c AS (SELECT s.*, p_value, sd_d / sqrt(n) AS se_d, {_T}[CAST(n - 1 AS INTEGER)] * sd_d / sqrt(n) AS reach FROM s JOIN p USING (yr))
        SELECT yr, n, round(mean_d, 6) AS mean_d, round(sd_d, 6) AS sd_d, round(se_d, 6) AS se_d, round(mean_d / sd_d, 6) AS dz, round(mean_d - reach, 6) AS ci_low, round(mean_d + reach, 6) AS ci_high, round(p_value, 6) AS p_value,
          CASE WHEN p_value > 0.05 THEN 'inconclusive' WHEN mean_d - reach > 0 THEN 'superiority' WHEN mean_d + reach < 0 THEN 'inferiority' ELSE 'inconclusive' END AS decision FROM c""",
}
