"""Adapter views: the driver's tables in the shape that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALENDAR = ("2024-01-01", "2024-01-31")
REFERENCE_END = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: site, obs_id, ts, value (exact), kind."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site"), F.col("event_id").alias("obs_id"), "ts", F.col("value").cast("decimal(18,2)").alias("value"), F.col("event_type").alias("kind")
    )


def daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact daily sums; a day with an error is estimated, any other approved."""
    return (
        observations(spark, sf_dir).groupBy("site", F.to_date("ts").alias("local_date"))
        .agg(F.sum("value").cast("decimal(20,2)").alias("value"), F.bool_or(F.col("kind") == "error").alias("flagged"))
        .select("site", "local_date", "value", F.when(F.col("flagged"), "estimated_flagged").otherwise("approved_unflagged").alias("quality"))
    )


#: The same in SQL, for oracles.
DAILY_SQL = """
daily AS (
  SELECT user_id AS site, CAST(ts AS DATE) AS local_date, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS value,
         CASE WHEN bool_or(event_type = 'error') THEN 'estimated_flagged' ELSE 'approved_unflagged' END AS quality
  FROM events GROUP BY 1, 2),
days AS (
  SELECT s.site, CAST(c.d AS DATE) AS local_date, v.value, coalesce(v.quality, 'missing_date') AS quality
  FROM (SELECT DISTINCT site FROM daily) s
  CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d) c
  LEFT JOIN daily v ON v.site = s.site AND v.local_date = CAST(c.d AS DATE))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored samples: y, k (a probability in tenths), group, part of the year."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("sample_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.round(F.col("l_discount") * 100).cast("long").alias("k"),
        F.col("l_suppkey").alias("grp"),
        F.col("l_linestatus").alias("family"),
        F.year("l_shipdate").alias("yr"),
    )


PRED_SQL = """
pred AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS sample_id,
         CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(round(l_discount * 100) AS BIGINT) AS k,
         l_suppkey AS grp, l_linestatus AS family, CAST(year(l_shipdate) AS INTEGER) AS yr
  FROM lineitem)"""
