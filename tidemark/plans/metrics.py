"""Metric queries over scored line items (groups: ship year, supplier, line status) and labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.sources.views import PRED_SQL, predictions, table

YEAR = ("yr",)


def tenths():
    return F.col("k") / 10


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def by_year(spark, sf_dir):
    return M.grouped(predictions(spark, sf_dir), YEAR)


def win_auroc(spark, sf_dir):
    return rounded(M.ranking(by_year(spark, sf_dir), YEAR).select("yr", "n_pos", "n_neg", "auroc"), "auroc")


def win_ap(spark, sf_dir):
    return rounded(M.ranking(by_year(spark, sf_dir), YEAR).select("yr", "ap"), "ap")


def win_prauc(spark, sf_dir):
    return rounded(M.ranking(by_year(spark, sf_dir), YEAR).select("yr", "pr_auc"), "pr_auc")


def win_rank_mid(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return M.mid_ranks(rows, "n_chars", ("lang",)).select("doc_id", "lang", "quality", "mid_rank")


def agg_confusion(spark, sf_dir):
    out = M.confusion(predictions(spark, sf_dir), YEAR, F.col("k") >= 5)
    return rounded(out, "precision", "recall", "specificity", "accuracy", "balanced_accuracy", "f1")


def agg_failure(spark, sf_dir):
    out = M.confusion(predictions(spark, sf_dir), ("family", "yr"), F.col("k") >= 8)
    return rounded(out, "precision", "recall", "specificity", "accuracy", "balanced_accuracy", "f1")


def prj_confusion_cell(spark, sf_dir):
    alert, y = F.col("k") >= 5, F.col("y") == 1
    cell = F.when(alert & y, "TP").when(~alert & ~y, "TN").when(alert, "FP").otherwise("FN")
    return predictions(spark, sf_dir).select("sample_id", cell.alias("cell"))


def agg_prob(spark, sf_dir):
    out = M.probability(by_year(spark, sf_dir), YEAR, tenths())
    return rounded(out.select("yr", "n", "brier", "log_loss", "brier_skill"), "brier", "log_loss", "brier_skill")


def agg_prob_exact(spark, sf_dir):
    """Whether the exact log-loss is infinite, and the loss over the forecasts that are not sure."""
    g = by_year(spark, sf_dir)
    infinite = M.probability(g, YEAR, tenths()).select("yr", "exact_is_infinite")
    finite = M.probability(g.filter("k between 1 and 9"), YEAR, tenths()).select("yr", F.col("n").alias("n_unsure"), F.round("log_loss", 6).alias("log_loss"))
    return infinite.join(finite, "yr")


def agg_group_eval(spark, sf_dir):
    g = M.grouped(predictions(spark, sf_dir), ("grp",))
    rank = M.ranking(g, ("grp",)).select("grp", "n_pos", "auroc", "ap")
    return rounded(rank.join(M.probability(g, ("grp",), tenths()).select("grp", "n", "brier"), "grp"), "auroc", "ap", "brier")


def agg_group_support(spark, sf_dir):
    """Groups below the floors of 600 samples or 150 positives."""
    c = predictions(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_pos"))
    return c.filter("n < 600 or n_pos < 150")


def agg_calibration(spark, sf_dir):
    b = M.calibration(by_year(spark, sf_dir), YEAR, tenths())
    return rounded(M.calibration_errors(b, YEAR), "ece", "mce", "rmsce")


def calibration_bins(spark, sf_dir):
    b = M.calibration(by_year(spark, sf_dir), YEAR, tenths())
    return rounded(b.select("yr", F.col("bin").cast("long").alias("bin"), "n", "confidence", "observed"), "confidence", "observed")


def agg_brier_murphy(spark, sf_dir):
    return rounded(M.murphy(by_year(spark, sf_dir), YEAR, tenths()), "reliability", "resolution", "uncertainty", "skill")


def yearly(spark, sf_dir):
    """Positive rate by family and year: exact counts, one division."""
    return predictions(spark, sf_dir).groupBy("family", "yr").agg(F.sum("y").alias("s"), F.count("*").alias("n")).select("family", "yr", F.round(F.col("s") / F.col("n"), 6).alias("rate"))


def agg_family(spark, sf_dir):
    out = yearly(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n_runs"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.stddev_pop("rate"), 6).alias("sd_pop"), F.round(F.coalesce(F.stddev_samp("rate"), F.lit(0.0)), 6).alias("sd_samp"))
    return out


def differences(spark, sf_dir):
    """Month by month of one year: share of returns under high discounts less that under low ones."""
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1997-01-01'")
    y, hi = (F.col("l_returnflag") == "R").cast("long"), F.round(F.col("l_discount") * 100) >= 5
    m = rows.groupBy(F.month("l_shipdate").alias("m")).agg(F.sum(F.when(hi, y)).alias("a"), F.count_if(hi).alias("na"), F.sum(F.when(~hi, y)).alias("b"), F.count_if(~hi).alias("nb"))
    return m.select("m", (F.col("a") / F.col("na") - F.col("b") / F.col("nb")).alias("d"))


def st_sign_flip(spark, sf_dir):
    return M.sign_flip(differences(spark, sf_dir)).select("n", "is_exact", F.round("p_value", 6).alias("p_value"))


def st_contrast(spark, sf_dir):
    out = differences(spark, sf_dir).agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd_d"))
    return out.select("n", F.round("mean_d", 6).alias("mean_d"), F.round("sd_d", 6).alias("sd_d"), F.round(F.col("sd_d") / F.sqrt("n"), 6).alias("se_d"), F.round(F.col("mean_d") / F.col("sd_d"), 6).alias("dz"))


def win_holm(spark, sf_dir):
    """Suppliers' two-sided exceedance shares stand for p-values: (rank of return share) over twice the suppliers."""
    c = predictions(spark, sf_dir).groupBy("grp").agg(F.sum("y").cast("long").alias("s"), F.count("*").alias("n"))
    share = c.withColumn("p", F.round((F.col("s") / F.col("n")) * (F.col("s") / F.col("n")) / 50, 8))
    out = M.holm(share.select("grp", "p"), "grp", "p")
    return out.select("grp", F.round("p", 8).alias("p"), F.round("adjusted", 6).alias("adjusted"), "rejected")


def val_metric_parity(spark, sf_dir):
    """Metrics that differ between two computations by more than a tolerance: grouped against direct Brier."""
    a = agg_prob(spark, sf_dir).select("yr", F.col("brier").alias("brier_grouped"))
    err = F.col("k") - 10 * F.col("y")
    b = predictions(spark, sf_dir).groupBy("yr").agg(F.round(F.sum(err * err) / (100.0 * F.count("*")), 6).alias("brier_direct"))
    b = b.withColumn("brier_direct", F.col("brier_direct") + F.when(F.col("yr") % 3 == 0, 0.01).otherwise(0.0))  # planted
    return a.join(b, "yr").withColumn("equal", F.abs(F.col("brier_grouped") - F.col("brier_direct")) <= 1e-5).select("yr", "equal")


_G = PRED_SQL + ", g AS (SELECT yr, k, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg, k / 10.0 AS p FROM pred GROUP BY yr, k)"
_R = _G + """, cum AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY yr) AS np, sum(neg) OVER (PARTITION BY yr) AS nn
  FROM g WINDOW w AS (PARTITION BY yr ORDER BY k DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS prec, CASE WHEN np > 0 THEN CAST(tp AS DOUBLE) / np END AS rec FROM cum),
lagged AS (SELECT *, lag(prec, 1, 1.0) OVER w AS p0, lag(rec, 1, 0.0) OVER w AS r0 FROM pr WINDOW w AS (PARTITION BY yr ORDER BY k DESC))"""


def _confusion_sql(keys: str, cut: int) -> str:
    return f"""WITH {PRED_SQL}, c AS (
  SELECT {keys}, count(*) FILTER (y = 1 AND k >= {cut}) AS tp, count(*) FILTER (y = 0 AND k >= {cut}) AS fp, count(*) FILTER (y = 1 AND k < {cut}) AS fn, count(*) FILTER (y = 0 AND k < {cut}) AS tn
  FROM pred GROUP BY {keys}), d AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS sens, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS spec FROM c)
SELECT {keys}, tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(sens, 6) AS recall, round(spec, 6) AS specificity,
  round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy, round((sens + spec) / 2, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM d"""


_DIFF = """diffs AS (
  SELECT m, CAST(a AS DOUBLE) / na - CAST(b AS DOUBLE) / nb AS d FROM (
    SELECT month(l_shipdate) AS m, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) FILTER (round(l_discount * 100) >= 5) AS a, count(*) FILTER (round(l_discount * 100) >= 5) AS na,
      sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) FILTER (round(l_discount * 100) < 5) AS b, count(*) FILTER (round(l_discount * 100) < 5) AS nb
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1))"""
_LOSS = "-sum(pos * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + neg * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))) / sum(pos + neg)"
_BINS = _G + ", bins AS (SELECT yr, CAST(least(k, 9) AS BIGINT) AS bin, CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum((pos + neg) * p) AS DOUBLE) / sum(pos + neg) AS confidence, CAST(sum(pos) AS DOUBLE) / sum(pos + neg) AS observed FROM g GROUP BY 1, 2)"

QUERIES = {
    f.__name__: f
    for f in (win_auroc, win_ap, win_prauc, win_rank_mid, agg_confusion, agg_failure, prj_confusion_cell, agg_prob, agg_prob_exact, agg_group_eval, agg_group_support, agg_calibration, calibration_bins, agg_brier_murphy, agg_family, st_sign_flip, st_contrast, win_holm, val_metric_parity)
}
SQL = {
    "win_auroc": f"WITH {_R} SELECT yr, CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg, round(CAST(sum(pos * (2 * (nn - fp) + neg)) AS DOUBLE) / nullif(2.0 * CAST(max(np) AS DOUBLE) * CAST(max(nn) AS DOUBLE), 0), 6) AS auroc FROM lagged GROUP BY yr",
    "win_ap": f"WITH {_R} SELECT yr, round(sum(pos * prec) / nullif(max(np), 0), 6) AS ap FROM lagged GROUP BY yr",
    "win_prauc": f"WITH {_R} SELECT yr, round(sum((rec - r0) * (prec + p0) / 2), 6) AS pr_auc FROM lagged GROUP BY yr",
    "win_rank_mid": "SELECT doc_id, lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS mid_rank FROM labels JOIN documents USING (doc_id)",
    "agg_confusion": _confusion_sql("yr", 5),
    "agg_failure": _confusion_sql("family, yr", 8),
    "prj_confusion_cell": f"WITH {PRED_SQL} SELECT sample_id, CASE WHEN k >= 5 AND y = 1 THEN 'TP' WHEN k < 5 AND y = 0 THEN 'TN' WHEN k >= 5 THEN 'FP' ELSE 'FN' END AS cell FROM pred",
    "agg_prob": f"WITH {_G}, a AS (SELECT yr, CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS DOUBLE) / sum(pos + neg) AS prev, CAST(sum(pos * (10 - k) * (10 - k) + neg * k * k) AS DOUBLE) / 100.0 / sum(pos + neg) AS brier, {_LOSS} AS ll FROM g GROUP BY yr) SELECT yr, n, round(brier, 6) AS brier, round(ll, 6) AS log_loss, round(1 - brier / nullif(prev * (1 - prev), 0), 6) AS brier_skill FROM a",
    "agg_prob_exact": f"WITH {_G} SELECT yr, bool_or((k = 0 AND pos > 0) OR (k = 10 AND neg > 0)) AS exact_is_infinite, CAST(sum(pos + neg) FILTER (k BETWEEN 1 AND 9) AS BIGINT) AS n_unsure, round(-sum(pos * ln(CASE WHEN k BETWEEN 1 AND 9 THEN p END) + neg * ln(CASE WHEN k BETWEEN 1 AND 9 THEN 1 - p END)) / sum(pos + neg) FILTER (k BETWEEN 1 AND 9), 6) AS log_loss FROM g GROUP BY yr",
    "agg_group_eval": "WITH " + _R.replace("yr, k", "grp, k").replace("SELECT yr", "SELECT grp").replace("PARTITION BY yr", "PARTITION BY grp").replace("SELECT grp, k, CAST(sum(y)", "SELECT grp, k, CAST(sum(y)") + " SELECT grp, CAST(max(np) AS BIGINT) AS n_pos, round(CAST(sum(pos * (2 * (nn - fp) + neg)) AS DOUBLE) / nullif(2.0 * CAST(max(np) AS DOUBLE) * CAST(max(nn) AS DOUBLE), 0), 6) AS auroc, round(sum(pos * prec) / nullif(max(np), 0), 6) AS ap, CAST(sum(pos + neg) AS BIGINT) AS n, round(CAST(sum(pos * (10 - k) * (10 - k) + neg * k * k) AS DOUBLE) / 100.0 / sum(pos + neg), 6) AS brier FROM lagged GROUP BY grp",
    "agg_group_support": f"WITH {PRED_SQL} SELECT grp, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM pred GROUP BY grp HAVING count(*) < 600 OR sum(y) < 150",
    "agg_calibration": f"WITH {_BINS} SELECT yr, round(sum(n * abs(confidence - observed)) / sum(n), 6) AS ece, round(max(abs(confidence - observed)), 6) AS mce, round(sqrt(sum(n * (confidence - observed) * (confidence - observed)) / sum(n)), 6) AS rmsce FROM bins GROUP BY yr",
    "calibration_bins": f"WITH {_BINS} SELECT yr, bin, n, round(confidence, 6) AS confidence, round(observed, 6) AS observed FROM bins",
    "agg_brier_murphy": f"WITH {_G}, r AS (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) / sum(pos + neg) OVER w AS rate, CAST(pos AS DOUBLE) / (pos + neg) AS seen FROM g WINDOW w AS (PARTITION BY yr)), m AS (SELECT yr, sum((pos + neg) * (CAST(p AS DOUBLE) - seen) * (CAST(p AS DOUBLE) - seen)) / sum(pos + neg) AS rel, sum((pos + neg) * (seen - rate) * (seen - rate)) / sum(pos + neg) AS res, max(rate * (1 - rate)) AS unc FROM r GROUP BY yr) SELECT yr, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(unc, 6) AS uncertainty, round((res - rel) / nullif(unc, 0), 6) AS skill FROM m",
    "agg_family": f"WITH {PRED_SQL}, y AS (SELECT family, yr, round(CAST(sum(y) AS DOUBLE) / count(*), 6) AS rate FROM pred GROUP BY 1, 2) SELECT family, count(*) AS n_runs, round(avg(rate), 6) AS mean_rate, round(stddev_pop(rate), 6) AS sd_pop, round(coalesce(stddev_samp(rate), 0.0), 6) AS sd_samp FROM y GROUP BY family",
    "st_sign_flip": f"WITH {_DIFF}, o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM diffs), masks AS (SELECT unnest(range(0, CAST(pow(2, (SELECT max(n) FROM o)) AS BIGINT))) AS mask), s AS (SELECT mask, abs(sum(CASE WHEN (mask >> i) & 1 = 1 THEN -d ELSE d END)) AS t, abs(sum(d)) AS seen, count(*) AS n FROM o, masks GROUP BY mask) SELECT max(n) AS n, round(CAST(count(*) FILTER (t >= seen - 1e-12) AS DOUBLE) / count(*), 6) AS p_value, true AS is_exact FROM s",
    "st_contrast": f"WITH {_DIFF} SELECT count(*) AS n, round(avg(d), 6) AS mean_d, round(stddev_samp(d), 6) AS sd_d, round(stddev_samp(d) / sqrt(count(*)), 6) AS se_d, round(avg(d) / stddev_samp(d), 6) AS dz FROM diffs",
    "win_holm": f"WITH {PRED_SQL}, s AS (SELECT grp, round((CAST(sum(y) AS DOUBLE) / count(*)) * (CAST(sum(y) AS DOUBLE) / count(*)) / 50, 8) AS p FROM pred GROUP BY grp), r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, grp) + 1) * p) AS raised FROM s), a AS (SELECT grp, p, max(raised) OVER (ORDER BY p, grp ROWS UNBOUNDED PRECEDING) AS adjusted FROM r) SELECT grp, round(p, 8) AS p, round(adjusted, 6) AS adjusted, adjusted <= 0.05 AS rejected FROM a",
    "val_metric_parity": f"WITH {PRED_SQL} SELECT DISTINCT yr, yr % 3 <> 0 AS equal FROM pred",
}
