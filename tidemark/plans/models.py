"""Model and lead-time queries; what only a fit can give has no oracle and is tested against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fitting as M
from tidemark.operators import leadtime, series
from tidemark.operators.metrics import grouped
from tidemark.plans.series import THRESHOLD, timed
from tidemark.sources.views import PRED_SQL, predictions, table


def by_year(spark, sf_dir):
    return grouped(predictions(spark, sf_dir), ("yr",))


def win_pava(spark, sf_dir):
    return M.isotonic(by_year(spark, sf_dir), "yr").withColumn("fitted", F.round("fitted", 6))


def win_pava_prices(spark, sf_dir):
    """The isotonic fit over continuous scores: a group has nearly as many distinct scores as rows."""
    scored = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("yr"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("long").alias("y"))
    counts = scored.groupBy("yr", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return M.isotonic(counts, "yr", "score").withColumn("fitted", F.round("fitted", 6))


def win_step_predict(spark, sf_dir):
    fitted = M.isotonic(by_year(spark, sf_dir), "yr").filter("k % 2 = 1").withColumnRenamed("yr", "key")
    scores = predictions(spark, sf_dir).select(F.col("yr").alias("key"), "k", F.col("sample_id").alias("id"))
    return M.step_predict(scores, fitted).groupBy("key", "k").agg(F.round(F.max("p"), 6).alias("p"), F.count("*").alias("n"))


def cal_platt(spark, sf_dir):
    g = by_year(spark, sf_dir).withColumn("p", F.col("k") / 10)
    return M.platt(g, "yr").select("yr", F.round("w", 6).alias("w"), F.round("b", 6).alias("b"))


def ml_ridge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_extendedprice") / 100_000).alias("y"))
    w = M.ridge(rows, ("q", "d"), "y", l2=0.01)
    return spark.createDataFrame([(n, round(float(x), 6)) for n, x in zip(("q", "d", "intercept"), w, strict=True)], "name string, weight double")


def agg_covariance(spark, sf_dir):
    """Squared distances under half shrinkage."""
    vectors = table(spark, sf_dir, "embeddings")
    mean, factor = M.covariance_reference(vectors, "embedding", 0.5)
    return M.mahalanobis(vectors, "vec_id", "embedding", mean, factor).select("vec_id", F.round("distance", 4).alias("distance"))


def st_bootstrap(spark, sf_dir):
    means = predictions(spark, sf_dir).groupBy(F.col("grp").alias("cluster")).agg((F.sum("y") / F.count("*")).alias("value"))
    return M.cluster_bootstrap(means, 200, 11)


def _episodes(spark, sf_dir):
    return series.episodes(timed(spark, sf_dir), THRESHOLD).select("site", F.col("episode").alias("event_id"), "onset_lower", "onset_upper")


def _alerts(spark, sf_dir):
    return series.cooldown(timed(spark, sf_dir).filter("value >= 60 and kind = 'error'"), 12)


def jn_event_match(spark, sf_dir):
    out = leadtime.match(_alerts(spark, sf_dir), _episodes(spark, sf_dir), 72)
    return out.withColumns({c: F.round(c, 3) for c in ("lead_lower", "lead_upper")})


def agg_lead_summary(spark, sf_dir):
    out = leadtime.summary(leadtime.match(_alerts(spark, sf_dir), _episodes(spark, sf_dir), 72), _episodes(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_lead", "median_lead", "min_lead", "max_lead", "recall", "false_alert_rate")})


def agg_lead_categories(spark, sf_dir):
    """Recall and leads by category of event, told by the episode's peak."""
    peaks = series.episodes(timed(spark, sf_dir), THRESHOLD).select("site", F.col("episode").alias("event_id"), F.when(F.col("peak_value") >= 99, "major").when(F.col("peak_value") >= 95, "moderate").when(F.col("peak_value") >= 90, "minor").otherwise("action").alias("category"))
    out = leadtime.by_category(leadtime.match(_alerts(spark, sf_dir), _episodes(spark, sf_dir), 72), peaks, ("action", "minor", "moderate", "major"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_lead", "median_lead", "min_lead", "max_lead", "recall")})


QUERIES = {f.__name__: f for f in (agg_lead_categories, win_pava, win_pava_prices, win_step_predict, cal_platt, ml_ridge, agg_covariance, st_bootstrap, jn_event_match, agg_lead_summary)}

_ISO = PRED_SQL + """, g AS (SELECT yr, k, sum(y) AS pos, count(*) AS n FROM pred GROUP BY yr, k),
means AS (SELECT a.yr, a.k AS lo, b.k AS hi, CAST(sum(c.pos) AS DOUBLE) / sum(c.n) AS m FROM g a JOIN g b ON b.yr = a.yr AND b.k >= a.k JOIN g c ON c.yr = a.yr AND c.k BETWEEN a.k AND b.k GROUP BY 1, 2, 3),
iso AS (SELECT yr, k, max(least_m) AS fitted FROM (SELECT g.yr, g.k, m.lo, min(m.m) AS least_m FROM g JOIN means m ON m.yr = g.yr AND m.lo <= g.k AND m.hi >= g.k GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
SQL = {
    "win_pava": f"WITH {_ISO} SELECT yr, k, round(fitted, 6) AS fitted FROM iso",
    "win_step_predict": f"WITH {_ISO}, t AS (SELECT * FROM iso WHERE k % 2 = 1) SELECT g.yr AS key, g.k, round(coalesce((SELECT arg_max(fitted, t.k) FROM t WHERE t.yr = g.yr AND t.k <= g.k), (SELECT arg_min(fitted, t.k) FROM t WHERE t.yr = g.yr)), 6) AS p, CAST(g.n AS BIGINT) AS n FROM g",
}
