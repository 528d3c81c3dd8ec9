"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


@functools.cache
def _private_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir, deleted when the driver ends; a private folder only in local mode where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _private_dir()
    path = f"{base.rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the session is gone already; the folder is scratch space
            return


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table read back, in folders by a column if one is named: lineage ends here."""
    path = shared_path(df.sparkSession, label)
    df.write.partitionBy(*([by] if by else [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
