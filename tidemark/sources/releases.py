"""Release manifests: sizes and digests of files, declared against actual."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """(name, bytes, sha256) of the files below path, by their paths below it; contents stay in their tasks."""
    folder = path.rstrip("/").rpartition("/")[2]
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", f"/{folder}/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """One row a file: ok, changed, missing or undeclared."""
    a = actual.select("name", F.col("sha256").alias("found"), F.col("bytes").alias("size"))
    met = declared.join(a, "name", "full_outer")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "undeclared").when((F.col("found") == F.col("sha256")) & (F.col("size") == F.col("bytes")), "ok").otherwise("changed")
    return met.select("name", status.alias("status"))
