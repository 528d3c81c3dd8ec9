"""Evaluation queries that compose operators: sample grids, replay ledgers, out-of-fold calibration, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fitting, metrics
from tidemark.operators.audits import violations
from tidemark.plans.series import _SLOTS, slots
from tidemark.operators.audits import line_digest
from tidemark.sources.views import PRED_SQL, predictions, table

LOOKBACK = 6


def jn_grid_slot(spark, sf_dir):
    """Values and mask of the seven days up to each issue, as arrays in grid order; a slot without a value is null."""
    rows = slots(spark, sf_dir)
    issues = rows.filter("day >= date'2024-01-24'").select("site", F.col("day").alias("issue"), F.posexplode(F.sequence(F.date_sub("day", LOOKBACK), F.col("day"))).alias("i", "day"))
    bound = issues.join(rows.select("site", "day", "value"), ["site", "day"], "left")
    packed = bound.groupBy("site", "issue").agg(F.array_sort(F.collect_list(F.struct("i", F.col("value").cast("string").alias("v")))).alias("g"))
    return packed.select("site", "issue", F.array_join(F.transform("g", lambda s: F.coalesce(s["v"], F.lit("-"))), "|").alias("window"), F.aggregate("g", F.lit(0), lambda a, s: a + s["v"].isNotNull().cast("int")).cast("long").alias("n_observed"))


def agg_replay_metric(spark, sf_dir):
    """The whole suite of a group in one row: ranking, alerts, Brier, exact and clipped log-loss."""
    pred, keys = predictions(spark, sf_dir), ("family", "yr")
    g = metrics.grouped(pred, keys)
    p = F.col("k") / 10
    loss = metrics.probability(g, keys, p, 1e-7).select(*keys, "n", "brier", F.col("log_loss").alias("log_loss_clipped"), F.when(F.col("exact_is_infinite"), "infinite").otherwise("finite").alias("exact_status"))
    rank = metrics.ranking(g, keys).select(*keys, "n_pos", "auroc", "ap", "pr_auc")
    alerts = metrics.confusion(pred, keys, F.col("k") >= 6).select(*keys, "tp", "fp", "precision", "recall", "f1")
    out = loss.join(rank, list(keys)).join(alerts, list(keys))
    return out.withColumns({c: F.round(c, 6) for c in ("brier", "log_loss_clipped", "auroc", "ap", "pr_auc", "precision", "recall", "f1")})


def jn_replay_ledger(spark, sf_dir):
    """Predictions against a saved ledger on their key: a row too few, too many or other than saved is told; each kind is planted."""
    nth = F.col("grp") * 7 + F.col("k")
    rows = predictions(spark, sf_dir)
    saved = rows.filter(nth % 50 != 1).select("sample_id", (F.col("k") + F.when(nth % 70 == 3, 1).otherwise(0)).alias("saved_k"), F.col("y").alias("saved_y"))
    extra = rows.filter(nth % 90 == 5).select(F.concat("sample_id", F.lit("-x")).alias("sample_id"), F.col("k").alias("saved_k"), F.col("y").alias("saved_y"))
    ledger = saved.unionByName(extra)
    met = predictions(spark, sf_dir).join(ledger, "sample_id", "full_outer")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("saved_k").isNull() | F.col("k").isNull()).alias("n_unmatched"), F.count_if((F.col("k") != F.col("saved_k")) | (F.col("y") != F.col("saved_y"))).alias("n_different"))


def jn_cohort_meta(spark, sf_dir):
    """Samples with their split from the cohort table, counted."""
    split = F.when(F.col("o_orderkey") % 10 < 7, "train").when(F.col("o_orderkey") % 10 < 9, "validation").otherwise("test")
    cohort = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), split.alias("split"))
    return table(spark, sf_dir, "lineitem").join(cohort, "l_orderkey", "left").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_groups"))


def cal_oof(spark, sf_dir):
    """Two folds by hash of the sample: each is calibrated by the fit of the other; Brier before and after."""
    pred = predictions(spark, sf_dir).withColumn("fold", F.pmod(F.crc32(F.col("sample_id").cast("binary")), F.lit(2)))
    g = metrics.grouped(pred, ("fold",)).withColumn("p", F.col("k") / 10)
    other = fitting.platt(g, "fold").select((1 - F.col("fold")).alias("fold"), "w", "b")
    q = 1 / (1 + F.exp(-(F.col("w") * F.col("p") + F.col("b"))))
    rows = g.join(F.broadcast(other), "fold").withColumn("q", q)
    brier = lambda p: F.round(F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p) / F.sum(F.col("pos") + F.col("neg")), 6)
    return rows.groupBy("fold").agg(brier(F.col("p")).alias("brier_raw"), brier(F.col("q")).alias("brier_calibrated"))


def agg_pred_digest(spark, sf_dir):
    """Digest of each group's sorted prediction lines, scores in tenths."""
    line = F.concat_ws(":", "sample_id", F.col("k").cast("string"), F.col("y").cast("string"))
    return line_digest(predictions(spark, sf_dir), ["grp"], line)


def prj_file_category(spark, sf_dir):
    """Routing of names by prefix, in fixed order."""
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("source/", "docs/", "tests/", "data/", "x")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_partkey").cast("string"))
    kind = F.when(name.startswith("source/"), "code").when(name.startswith("docs/"), "documentation").when(name.startswith("tests/"), "test").when(name.startswith("data/"), "data").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def val_numeric(spark, sf_dir):
    """Numbers that are no finite reals, told by rule; none are repaired."""
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 101 == 0, F.lit(float("inf"))).when(F.col("event_id") % 103 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").withColumn("v", v)
    rules = {"present": F.col("v").isNotNull(), "not_nan": ~F.isnan("v"), "finite": F.abs("v") < float("inf")}
    return violations(rows, "event_id", rules).groupBy("rule").agg(F.count("*").alias("n"))


def agg_unique_normalizer(spark, sf_dir):
    """Mean of distinct permitted records, each with one weight however many windows show it."""
    shown = table(spark, sf_dir, "events").select("event_id", "event_type", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))).alias("window"), (F.col("value").cast("decimal(18,2)") * 100).cast("long").alias("cents"))
    once = shown.filter("event_id % 2 = 0").select("event_id", "event_type", "cents").distinct()
    return once.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("cents") / F.count("*") / 100, 5).alias("mean"))


QUERIES = {f.__name__: f for f in (jn_grid_slot, agg_replay_metric, jn_replay_ledger, jn_cohort_meta, cal_oof, agg_pred_digest, prj_file_category, val_numeric, agg_unique_normalizer)}

_G2 = PRED_SQL + ", g AS (SELECT family, yr, k, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg, k / 10.0 AS p FROM pred GROUP BY 1, 2, 3)"
SQL = {
    "jn_grid_slot": f"WITH {_SLOTS} SELECT i.site, i.day AS issue, string_agg(coalesce(CAST(s.value AS VARCHAR), '-'), '|' ORDER BY s.day) AS \"window\", count(s.value) AS n_observed FROM slots i JOIN slots s ON s.site = i.site AND s.day BETWEEN i.day - {LOOKBACK} AND i.day WHERE i.day >= DATE '2024-01-24' GROUP BY 1, 2",
    "agg_replay_metric": f"""WITH {_G2}, c AS (SELECT *, sum(pos) OVER w AS tpc, sum(neg) OVER w AS fpc, sum(pos) OVER (PARTITION BY family, yr) AS np, sum(neg) OVER (PARTITION BY family, yr) AS nn FROM g WINDOW w AS (PARTITION BY family, yr ORDER BY k DESC ROWS UNBOUNDED PRECEDING)),
        d AS (SELECT *, CAST(tpc AS DOUBLE) / (tpc + fpc) AS prec, CAST(tpc AS DOUBLE) / nullif(np, 0) AS rec FROM c),
        e AS (SELECT *, lag(prec, 1, 1.0) OVER w AS p0, lag(rec, 1, 0.0) OVER w AS r0 FROM d WINDOW w AS (PARTITION BY family, yr ORDER BY k DESC))
        SELECT family, yr, CAST(sum(pos + neg) AS BIGINT) AS n, round(CAST(sum(pos * (10 - k) * (10 - k) + neg * k * k) AS DOUBLE) / 100.0 / sum(pos + neg), 6) AS brier,
          round(-sum(pos * ln(greatest(least(CAST(p AS DOUBLE), 1 - 1e-7), 1e-7)) + neg * ln(1 - greatest(least(CAST(p AS DOUBLE), 1 - 1e-7), 1e-7))) / sum(pos + neg), 6) AS log_loss_clipped,
          CASE WHEN bool_or((k = 0 AND pos > 0) OR (k = 10 AND neg > 0)) THEN 'infinite' ELSE 'finite' END AS exact_status, CAST(max(np) AS BIGINT) AS n_pos,
          round(CAST(sum(pos * (2 * (nn - fpc) + neg)) AS DOUBLE) / nullif(2.0 * CAST(max(np) AS DOUBLE) * CAST(max(nn) AS DOUBLE), 0), 6) AS auroc, round(sum(pos * prec) / nullif(max(np), 0), 6) AS ap, round(sum((rec - r0) * (prec + p0) / 2), 6) AS pr_auc,
          CAST(coalesce(sum(pos) FILTER (k >= 6), 0) AS BIGINT) AS tp, CAST(coalesce(sum(neg) FILTER (k >= 6), 0) AS BIGINT) AS fp, round(CAST(sum(pos) FILTER (k >= 6) AS DOUBLE) / nullif(sum(pos + neg) FILTER (k >= 6), 0), 6) AS precision,
          round(CAST(coalesce(sum(pos) FILTER (k >= 6), 0) AS DOUBLE) / nullif(max(np), 0), 6) AS recall, round(coalesce(2 * CAST(coalesce(sum(pos) FILTER (k >= 6), 0) AS DOUBLE) / nullif(coalesce(sum(pos + neg) FILTER (k >= 6), 0) + max(np), 0), 0.0), 6) AS f1
        FROM e GROUP BY family, yr""",
    "jn_replay_ledger": f"WITH {PRED_SQL}, c AS (SELECT *, grp * 7 + k AS nth FROM pred) SELECT count(*) + count(*) FILTER (nth % 90 = 5) AS n, count(*) FILTER (nth % 50 = 1) + count(*) FILTER (nth % 90 = 5) AS n_unmatched, count(*) FILTER (nth % 50 <> 1 AND nth % 70 = 3) AS n_different FROM c",
    "jn_cohort_meta": "SELECT CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT l_orderkey) AS n_groups FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "agg_pred_digest": f"WITH {PRED_SQL} SELECT grp, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest, CAST(sum(k) AS BIGINT) AS n FROM (SELECT grp, b, count(*) AS k, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM (SELECT grp, line, substr(sha256(line), 1, 3) AS b FROM (SELECT grp, sample_id || ':' || k || ':' || y AS line FROM pred)) GROUP BY 1, 2) GROUP BY 1",
    "prj_file_category": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'documentation' WHEN 2 THEN 'test' WHEN 3 THEN 'data' ELSE 'other' END AS category, count(*) AS n FROM part GROUP BY 1",
    "val_numeric": "WITH v AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'nan' WHEN event_id % 101 = 0 THEN 'inf' WHEN event_id % 103 = 0 THEN 'null' ELSE 'ok' END AS s FROM events) SELECT rule, count(*) AS n FROM (SELECT unnest(CASE s WHEN 'nan' THEN ['not_nan', 'finite'] WHEN 'inf' THEN ['finite'] WHEN 'null' THEN ['present', 'finite'] ELSE [] END) AS rule FROM v) GROUP BY rule",
    "agg_unique_normalizer": "SELECT event_type, count(*) AS n, round(CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)) AS DOUBLE) / count(*) / 100, 5) AS mean FROM events WHERE event_id % 2 = 0 GROUP BY 1",
}
