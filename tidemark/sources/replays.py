"""Replay sets: several outputs bound to the manifest they came from, visible at once or not at all.

Outputs are written into a hidden folder beside the destination. The manifest's digest is
taken before the run and again before the one rename that makes the set visible; a
manifest that changed in between, or a failure on the way, leaves nothing at the
destination. A destination that exists is never written over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import releases

SUMS = "name string, bytes long, sha256 string"


def digest_of(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, fs = _path(spark, path)
    return fs.exists(found)


def write_replay_set(spark: SparkSession, manifest: str, derive: Callable[[str], dict[str, DataFrame]], out: str) -> str:
    """Derive outputs from a manifest file and write each as JSON lines below `out`, with a list of their digests; returns the manifest's digest."""
    target, fs = _path(spark, out)
    if fs.exists(target):
        raise FileExistsError(f"a replay set is there already: {out}")
    consumed = digest_of(spark, manifest)
    staged = f"{out.rstrip('/').rpartition('/')[0]}/.staged-{uuid.uuid4().hex}"
    try:
        for name, rows in derive(manifest).items():
            rows.write.mode("error").json(f"{staged}/{name}")
        sums = releases.manifest(spark, staged)
        sums.write.mode("error").json(f"{staged}/_sums")
        bound = spark.range(1).select(F.lit(consumed).alias("manifest_sha256"))
        bound.write.mode("error").json(f"{staged}/_manifest")
        if digest_of(spark, manifest) != consumed:
            raise ValueError("the manifest changed after it was consumed")
        # a rename onto a folder that came up meanwhile would move into it
        if fs.exists(target) or not fs.rename(_path(spark, staged)[0], target):
            raise FileExistsError(f"a replay set is there already: {out}")
    finally:
        fs.delete(_path(spark, staged)[0], True)
    return consumed


def verify_replay_set(spark: SparkSession, out: str, manifest: str) -> DataFrame:
    """(name, status) of each file of a set: ok, changed, missing or undeclared; `manifest`, ok or changed, is a row as well."""
    declared = spark.read.schema(SUMS).json(f"{out}/_sums")
    # Spark's readers pass over names that start with an underscore, so only outputs are listed
    actual = releases.manifest(spark, out)
    bound = spark.read.schema("manifest_sha256 string").json(f"{out}/_manifest").first()[0]
    same = "ok" if bound == digest_of(spark, manifest) else "changed"
    return releases.verify(declared, actual).unionByName(spark.range(1).select(F.lit("manifest").alias("name"), F.lit(same).alias("status")))
