"""Whole panels and bound outputs: both crosstabs, transition matrices, exact display, handoff archives, replay sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.digits import fraction_text
from tidemark.functions.shared import shared_path, written
from tidemark.operators import daily as D
from tidemark.operators import panels
from tidemark.plans.daily import CELLS, INPUT_SQL, KEYS, LABEL_SQL, THRESHOLD_SQL, TRACE_SQL, jn_prev_closed_day, thresholds, traced
from tidemark.sources import archives, replays
from tidemark.sources.views import CALENDAR, DAILY_SQL, REFERENCE_END, daily_values


def agg_type8_display(spark, sf_dir):
    """The exact reference thresholds as decimal text of 50 significant digits."""
    t = thresholds(spark, sf_dir)
    hundredths = lambda c: (c * 100).cast("decimal(24,0)")
    numerator = hundredths(F.col("lo")) * F.col("g_den") + hundredths(F.col("hi") - F.col("lo")) * F.col("g_num")
    return t.select("site", "ref_lane", fraction_text(numerator, F.col("g_den") * 100).alias("threshold"))


def _panel(spark, sf_dir):
    """The trace of all four cells, written once, and its labels."""
    trace = written(traced(spark, sf_dir), "trace")
    labels = D.issue_labels(trace, KEYS)
    return trace, labels.filter((F.col("issue_date") >= F.lit(REFERENCE_END).cast("date")) & (F.col("issue_date") < F.lit(CALENDAR[1]).cast("date")))


def agg_crosstab_issues(spark, sf_dir):
    _, labels = _panel(spark, sf_dir)
    return panels.issue_crosstab(labels, jn_prev_closed_day(spark, sf_dir)).withColumn("horizon", F.col("horizon").cast("long"))


def agg_crosstab_targets(spark, sf_dir):
    trace, labels = _panel(spark, sf_dir)
    out = panels.target_crosstab(labels, jn_prev_closed_day(spark, sf_dir), panels.completion_targets(trace))
    return out.withColumn("horizon", F.col("horizon").cast("long"))


def agg_transition_matrices(spark, sf_dir):
    trace, labels = _panel(spark, sf_dir)
    return panels.transitions(written(labels, "labels"), panels.completion_targets(trace), CELLS).withColumn("horizon", F.col("horizon").cast("long"))


def sink_handoff(spark, sf_dir):
    """A site's days are a member. Two archives of the same members have one digest; a third, with members changed, lost and added, is held against the first one's index."""
    line = F.concat_ws(",", F.col("local_date").cast("string"), F.col("value").cast("string"), "quality")
    days = daily_values(spark, sf_dir).groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))  # a row a calendar day at most
    members = written(days.select("site", F.format_string("days/%d.csv", "site").alias("name"), "content"), "members")
    paths = [shared_path(spark, "handoff") for _ in range(3)]
    digests = [archives.pack(members, p, volume_bytes=1 << 16) for p in paths[:2]]
    changed = members.filter("site % 50 <> 8").withColumn("content", F.when(F.col("site") % 50 == 7, F.concat("content", F.lit("\n"))).otherwise(F.col("content")))
    extra = members.filter("site % 50 = 9").select("site", F.format_string("extra/%d.csv", "site").alias("name"), "content")
    archives.pack(changed.unionByName(extra), paths[2], volume_bytes=1 << 16)
    found = archives.verify_archive(spark, paths[2], digests[0], archives.read_index(spark, paths[0]))
    sound = archives.verify_archive(spark, paths[1], digests[0]).filter("status = 'ok'").select(F.col("name").alias("of"), F.lit(digests[0] == digests[1]).alias("same"))
    sizes = archives.read_index(spark, paths[0]).select(F.col("name").alias("packed"), "bytes", "sha256")
    out = found.join(sound, F.col("name") == F.col("of"), "left").join(sizes, F.col("name") == F.col("packed"), "left")
    return out.select("name", "status", F.coalesce("same", F.lit(False)).alias("rebuilt_same"), "bytes", "sha256")


def sink_replay_set(spark, sf_dir):
    """The daily rows of a replay set read back, with what became of a second writing, of a manifest changed meanwhile and of a failure on the way."""
    manifest = shared_path(spark, "replay_manifest")

    def declare(horizon: int) -> None:
        text = spark.range(1).coalesce(1).select(F.to_json(F.struct(F.lit("noon").alias("issue_time"), F.lit(horizon).alias("horizon"))))
        text.write.mode("overwrite").text(manifest)

    def derive(_):
        ledger = jn_prev_closed_day(spark, sf_dir)
        return {"source_rows": daily_values(spark, sf_dir).withColumn("value", F.col("value").cast("string")), "input_ledger": ledger, "input_status": ledger.groupBy("status").count()}

    def derive_and_replace(path):
        declare(48)
        return derive(path)

    def fail(path):
        return derive(path) | {"broken": spark.range(4).select(F.raise_error(F.lit("stopped on the way")).alias("x"))}

    declare(24)
    outs = [f"{shared_path(spark, 'replay_set')}/set" for _ in range(3)]
    replays.write_replay_set(spark, manifest, derive, outs[0])
    before = replays.verify_replay_set(spark, outs[0], manifest).groupBy("status").count().collect()
    seen = {}
    for name, how, out in (("second", derive, outs[0]), ("failure", fail, outs[1]), ("replaced", derive_and_replace, outs[2])):
        try:
            replays.write_replay_set(spark, manifest, how, out)
            seen[name] = "written"
        except FileExistsError:
            seen[name] = "refused"
        except Exception:  # whatever stopped it: what counts is that nothing is there
            seen[name] = "visible" if replays.exists(spark, out) else "nothing"
    after = replays.verify_replay_set(spark, outs[0], manifest).filter("status <> 'ok'").collect()
    states = {r["status"] for r in before}, {(r["name"], r["status"]) for r in after}
    rows = spark.read.schema("site long, local_date date, value string, quality string").json(f"{outs[0]}/source_rows")
    sound = states == ({"ok"}, {("manifest", "changed")})
    return rows.withColumns({"value": F.col("value").cast("decimal(20,2)"), "sound": F.lit(sound), **{k: F.lit(v) for k, v in seen.items()}})


_BASE = f"WITH {DAILY_SQL},{THRESHOLD_SQL},{TRACE_SQL},{LABEL_SQL},{INPUT_SQL}"
_SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'DJF' WHEN month({0}) IN (3, 4, 5) THEN 'MAM' WHEN month({0}) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
_ISSUE = f"CAST(year(l.issue_date) AS INTEGER) AS issue_year, {_SEASON.format('l.issue_date')} AS issue_season"
_TARGETS = """targets AS (
  SELECT l.*, c.local_date AS target_date, c.site || ':' || CAST(c.local_date AS VARCHAR) AS record_id FROM labels4 l
  JOIN trace c ON c.completion AND c.site = l.site AND c.ref_lane = l.ref_lane AND c.lane = l.lane AND c.local_date >= l.issue_date AND c.local_date < l.issue_date + CAST(l.horizon // 24 AS INTEGER)
  WHERE l.status = 'positive')"""
_CELLS = "cells AS (SELECT * FROM (VALUES ('primary', 'primary', 1), ('primary', 'unflagged', 2), ('unflagged', 'primary', 3), ('unflagged', 'unflagged', 4)) t(ref, lane, i))"
_PAIRS = """pairs AS (
  SELECT a.ref AS l_ref, a.lane AS l_lane, b.ref AS r_ref, b.lane AS r_lane, CASE WHEN a.ref = b.ref THEN 'truth' WHEN a.lane = b.lane THEN 'reference' ELSE 'both' END AS contrast
  FROM cells a JOIN cells b ON a.i < b.i)"""
_P = "l_ref, l_lane, r_ref, r_lane, contrast"
_MATRICES = f"""
{_TARGETS}, {_CELLS}, {_PAIRS},
met AS (
  SELECT p.*, l.site, l.horizon, l.status AS ls, r.status AS rs, l.issue_state AS lt, r.issue_state AS rt
  FROM pairs p JOIN labels4 l ON l.ref_lane = p.l_ref AND l.lane = p.l_lane
  JOIN labels4 r ON r.ref_lane = p.r_ref AND r.lane = p.r_lane AND r.site = l.site AND r.issue_date = l.issue_date AND r.horizon = l.horizon),
entries AS (
  SELECT {_P}, site, horizon, 'status' AS matrix, ls AS left_value, rs AS right_value FROM met
  UNION ALL SELECT {_P}, site, horizon, 'eligible', CAST(lt = 'armed' AS VARCHAR), CAST(rt = 'armed' AS VARCHAR) FROM met
  UNION ALL SELECT {_P}, site, horizon, 'issue_state', lt, rt FROM met
  UNION ALL SELECT {_P}, site, horizon, 'known_status', ls, rs FROM met WHERE ls <> 'unknown' AND rs <> 'unknown'),
counted AS (
  SELECT {_P}, matrix, left_value, right_value, site, horizon, count(*) AS n FROM entries GROUP BY ALL
  UNION ALL SELECT {_P}, matrix, left_value, right_value, NULL, NULL, count(*) FROM entries GROUP BY ALL),
vals AS (
  SELECT 'status' AS matrix, a AS left_value, b AS right_value FROM (SELECT unnest(['positive', 'negative', 'unknown']) AS a), (SELECT unnest(['positive', 'negative', 'unknown']) AS b)
  UNION ALL SELECT 'eligible', a, b FROM (SELECT unnest(['false', 'true']) AS a), (SELECT unnest(['false', 'true']) AS b)
  UNION ALL SELECT 'known_status', a, b FROM (SELECT unnest(['positive', 'negative']) AS a), (SELECT unnest(['positive', 'negative']) AS b)),
groups AS (SELECT DISTINCT {_P}, site, horizon FROM met UNION ALL SELECT DISTINCT {_P}, NULL, NULL FROM met),
dense AS (
  SELECT {_P}, matrix, left_value, right_value, site, horizon, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT * FROM counted UNION ALL SELECT {_P}, matrix, left_value, right_value, site, horizon, 0 FROM groups, vals) GROUP BY ALL),
sided AS (
  SELECT {_P}, t.site, t.horizon, record_id, bool_or(t.ref_lane = l_ref AND t.lane = l_lane) AS l, bool_or(t.ref_lane = r_ref AND t.lane = r_lane) AS r
  FROM targets t JOIN pairs p ON (t.ref_lane = l_ref AND t.lane = l_lane) OR (t.ref_lane = r_ref AND t.lane = r_lane) GROUP BY ALL),
marked AS (SELECT * FROM sided UNION ALL SELECT {_P}, NULL, NULL, record_id, bool_or(l), bool_or(r) FROM sided GROUP BY ALL)
SELECT {_P}, matrix, left_value, right_value, site, horizon, n FROM dense
UNION ALL SELECT {_P}, 'completions', CASE WHEN l AND r THEN 'both' WHEN l THEN 'left_only' ELSE 'right_only' END, NULL, site, horizon, count(*) FROM marked GROUP BY ALL"""

#: The denominator is 12 * 100: behind four places the digits are all equal.
_DISPLAY = """
parts AS (
  SELECT site, ref_lane, CAST(lo * 100 AS HUGEINT) * g_den + CAST((hi - lo) * 100 AS HUGEINT) * g_num AS n, CAST(100 * g_den AS HUGEINT) AS d FROM thr),
divided AS (SELECT *, CAST(n // d AS VARCHAR) AS whole, lpad(CAST((n % d) * 10000 // d AS VARCHAR), 4, '0') AS four, (n % d) * 10000 % d AS left_over FROM parts),
told AS (SELECT *, CAST(left_over * 10 // d AS INTEGER) AS again, 50 - length(whole) AS places FROM divided)
SELECT site, ref_lane, CASE
    WHEN left_over = 0 THEN whole || CASE WHEN rtrim(four, '0') = '' THEN '' ELSE '.' || rtrim(four, '0') END
    ELSE whole || '.' || four || repeat(CAST(again AS VARCHAR), CAST(places - 5 AS BIGINT)) || CASE WHEN again >= 5 THEN again + 1 ELSE again END END AS threshold
FROM told"""

_MEMBERS = """members AS (
  SELECT site, 'days/' || site || '.csv' AS name, string_agg(CAST(local_date AS VARCHAR) || ',' || CAST(value AS VARCHAR) || ',' || quality, chr(10) ORDER BY local_date) AS content FROM daily GROUP BY site)"""

QUERIES = {f.__name__: f for f in (agg_type8_display, agg_crosstab_issues, agg_crosstab_targets, agg_transition_matrices, sink_handoff, sink_replay_set)}
SQL = {
    "agg_type8_display": f"WITH {DAILY_SQL},{THRESHOLD_SQL},{_DISPLAY}",
    "agg_crosstab_issues": f"""{_BASE} SELECT ref_lane, lane, l.site, {_ISSUE}, horizon, l.status, i.status = 'scored' AS input_available, i.status AS input_reason, count(*) AS n
        FROM labels4 l JOIN inputs i USING (site, issue_date) GROUP BY ALL""",
    "agg_crosstab_targets": f"""{_BASE},{_TARGETS} SELECT ref_lane, lane, l.site, {_ISSUE}, {_SEASON.format('target_date')} AS target_season, horizon, i.status = 'scored' AS input_available, i.status AS input_reason,
        count(*) AS n, count(DISTINCT record_id) AS n_ids, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS ids FROM targets l JOIN inputs i USING (site, issue_date) GROUP BY ALL""",
    "agg_transition_matrices": f"{_BASE},{_MATRICES}",
    "sink_handoff": f"""WITH {DAILY_SQL},{_MEMBERS} SELECT name, CASE site % 50 WHEN 7 THEN 'changed' WHEN 8 THEN 'missing' ELSE 'ok' END AS status, TRUE AS rebuilt_same, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM members
        UNION ALL SELECT 'extra/' || site || '.csv', 'undeclared', FALSE, NULL, NULL FROM members WHERE site % 50 = 9""",
    "sink_replay_set": f"WITH {DAILY_SQL} SELECT site, local_date, value, quality, TRUE AS sound, 'refused' AS second, 'nothing' AS failure, 'nothing' AS replaced FROM daily",
}
