"""Shared helpers of the corpus operators: stashed tables, word handling, Arrow batches."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space (Java and Python read it alike).
WORD = r"[^\x20\x09-\x0D]+"

_stashed: list[tuple[SparkSession, str]] = []


@functools.cache
def _private_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a private one only in local mode where none is configured (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _private_dir()
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    _stashed.append((spark, path))
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the table read back.

    This cuts lineage (a lost executor re-reads files, it recomputes nothing), fixes
    values such as row ids, and gives the planner true sizes to choose joins by.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_stashed() -> None:
    for spark, path in _stashed:
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the session is gone already; the folder is scratch space
            return


def with_checked_size(stashed: DataFrame, rows: int = 500_000) -> DataFrame:
    """A stashed table of narrow rows, broadcast if it has at most `rows` of them (some 30 MB), else as it is."""
    return F.broadcast(stashed) if stashed.count() <= rows else stashed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about `most` bytes of `column`, one row at least.

    Working memory of the numpy steps then follows `most` or the longest single text,
    not Spark's batch size.
    """
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the elements whose 64-bit value occurs at least twice in the array."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) < 2:
        return out
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        at = np.searchsorted(twice, keys)
        out = twice[np.minimum(at, len(twice) - 1)] == keys
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Odd multiplier of the rolling polynomial hashes (golden ratio times 2^64).
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each run of n word hashes, by doubling: log2(n) vector steps."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out, have = None, 0
    power, width = words, 1
    while True:
        if n & width:
            out = power[: len(words) - width + 1] if out is None else out[: len(words) - have - width + 1] * _pow(width) + power[have : have + len(words) - have - width + 1]
            have += width
        if have == n:
            return mixed(out)
        power = power[: len(power) - width] * _pow(width) + power[width:]
        width *= 2


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))
