"""Handoff archives: members packed into tar volumes by Spark's own writer, verified in tasks.

A volume is a tar file: for each member, sorted by name, a header of 512 bytes with fixed
owner, mode and time, the content, and zeros up to the next 512. Which volume a member
goes to follows from its name and the total size alone, so two builds of the same members
have the same bytes. A volume is one row of the text writer, whose line end, a zero byte,
is the last of the volume's closing zeros; no task holds more than a volume or its
largest member. Contents are UTF-8 texts.

Beside the volumes lies an index (name, volume, bytes, sha256); its digest is the archive's.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import written
from tidemark.sources.decoders import strict
from tidemark.sources.releases import verify

#: Bytes of a volume, about.
VOLUME_BYTES = 64 << 20
BLOCK = 512
NUL = "\0"
INDEX = "name string, volume int, bytes long, sha256 string"


def _octal(n: Column | int, digits: int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.lpad(F.conv(n.cast("string"), 10, 8), digits, "0"), F.lit(NUL))


def tar_header(name: Column, size: Column) -> Column:
    """The ustar header of a plain file (ASCII name of at most 100 characters), always with the same owner, mode and time."""
    before = F.concat(F.rpad(name, 100, NUL), _octal(0o644, 7), _octal(0, 7), _octal(0, 7), _octal(size, 11), _octal(0, 11))
    after = F.concat(F.lit("0" + NUL * 100 + "ustar" + NUL + "00" + NUL * 64), _octal(0, 7), _octal(0, 7), F.lit(NUL * 167))
    # the sum of the header's bytes, those of the sum itself being blanks
    total = F.aggregate(F.split(F.concat(before, F.lit(" " * 8), after), ""), F.lit(0), lambda a, c: a + F.ascii(c))
    return F.concat(before, F.lpad(F.conv(total.cast("string"), 10, 8), 6, "0"), F.lit(NUL + " "), after)


def _padded(name: Column, content: Column) -> Column:
    size = F.octet_length(content)
    return F.concat(tar_header(name, size), content, F.repeat(F.lit(NUL), F.pmod(-size, F.lit(BLOCK)).cast("int")))


def pack(members: DataFrame, path: str, volume_bytes: int = VOLUME_BYTES) -> str:
    """Write members (name, content) as an archive below `path`, which must not exist, and return its digest.

    A null content is empty. A null, repeated or too long name, or one that is not ASCII, raises.
    """
    spark = members.sparkSession
    rows = written(members.select("name", F.coalesce("content", F.lit("")).alias("content")), "members")
    fits = F.col("name").isNotNull() & F.col("name").rlike(r"^[\x21-\x7E]{1,100}$")
    total = strict(rows, fits, "a member's name is missing, too long or not ASCII").agg(F.sum(2 * BLOCK + F.octet_length("content"))).first()[0] or 0
    volumes = max(1, -(-total // volume_bytes))
    placed = rows.select("name", "content", F.pmod(F.xxhash64("name"), F.lit(volumes)).cast("int").alias("volume"))
    index = written(placed.select("name", "volume", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")), "index")
    if not index.groupBy("name").count().filter("count > 1").isEmpty():
        raise ValueError("a member's name comes more than once")
    parts = F.array_sort(F.collect_list(F.struct("name", _padded(F.col("name"), F.col("content")).alias("bytes"))))
    volume = placed.groupBy("volume").agg(F.concat(F.array_join(F.transform(parts, lambda m: m["bytes"]), ""), F.lit(NUL * (2 * BLOCK - 1))).alias("value"))
    volume.write.mode("error").option("lineSep", NUL).partitionBy("volume").text(f"{path}/volumes")
    index.write.mode("error").json(f"{path}/index")
    return archive_digest(index)


def archive_digest(index: DataFrame) -> str:
    """SHA-256 over the members in the order of their names, in two levels: ranges of names are hashed in tasks, few digests on the driver."""
    line = F.concat_ws(":", "name", "sha256", F.col("bytes").cast("string"))
    leading = F.substring(F.sha2("name", 256), 1, 2)  # 256 groups, so an archive of any size has the same levels
    groups = index.groupBy(leading.alias("group")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))
    return hashlib.sha256("".join(r["group"] + r["sha256"] for r in sorted(groups.collect())).encode()).hexdigest()


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """(name, volume, bytes, sha256, intact) of every member found in the volumes; a volume that cannot be read to its end gives a row without a name."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found: list[tuple] = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(raw.as_py()), mode="r:") as tar:
                        for member in tar:
                            content = tar.extractfile(member).read()
                            found.append((member.name, number, len(content), hashlib.sha256(content).hexdigest(), True))
                except (tarfile.TarError, EOFError, AttributeError):
                    found.append((None, number, None, None, False))
                columns = zip(*found, strict=True) if found else [[]] * 5
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", "volume", "bytes", "sha256", "intact"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(f"{path}/volumes")
    number = F.regexp_extract("path", r"volume=(\d+)/", 1).cast("int")
    return files.select(number.alias("volume"), "content").mapInArrow(scan, f"{INDEX}, intact boolean")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).json(f"{path}/index")


def verify_archive(spark: SparkSession, path: str, digest: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """(name, status) of each member: ok, changed, missing or undeclared; a broken volume is a row `volume=N`, broken.

    The index is the archive's own or the one given. With `digest`, that the archive had
    when it was packed, an index that differs raises.
    """
    index = index if index is not None else read_index(spark, path)
    if digest is not None and archive_digest(index) != digest:
        raise ValueError("the archive's index is not the one that was packed")
    found = written(unpacked(spark, path), "unpacked")
    broken = found.filter("not intact").select(F.concat(F.lit("volume="), "volume").alias("name"), F.lit("broken").alias("status"))
    return verify(index.select("name", "bytes", "sha256"), found.filter("intact").select("name", "bytes", "sha256")).unionByName(broken)
