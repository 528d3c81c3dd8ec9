"""WARC archives of pages, and a merged index of their captures.

Writing: one record a page. Of equal payloads that of the smallest page_id is a response,
the others are revisits without payload. Records are rows of text that end in the
format's own terminator, so Spark's writer makes the files: on any file system, with its
commit protocol, a task's retry replacing what a lost executor had written.

Reading: each archive is scanned record by record by Content-Length and gives one run of
index rows, sorted by URL key and timestamp. Runs are then merged: a range partition gets
its slice of every run, and a loser tree yields them in order, so that the index is
globally ordered by partition.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_path, stash, table

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads of at least so many bytes are deduplicated.
LEAST_BYTES = 0
#: Bytes of an archive's records, about: what a reader holds inflated. Records are written by classes of size, so
#: that a class's greatest record times its number of records is within it; a greater record has its own archive.
ARCHIVE_BYTES = 64 << 20
CLASSES = (1 << 15, 1 << 18, 1 << 21)
#: Index rows that one merging task should have.
MERGE_ROWS = 100_000
#: Captures have no time of their own here: page_id seconds after this instant.
EPOCH = 1_704_067_200

INDEX = (
    "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, run string, offset long, intact boolean, nth int"
)


def digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of 20 bits, each four digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n, s in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">")) for x in (F.substring(h, a, n), F.lit(s))])


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, most: int = ARCHIVE_BYTES) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files below `path`.

    Null html is an empty payload, a null url leaves its header out, white space and
    controls in a url are escaped. A null page_id is written as such; it revisits the
    smallest page_id of its payload, and is a response where all are null. Repeated rows
    of the smallest page_id are all responses. Very long pages have archives of their own.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumns({"digest": digest(html), "bytes": F.octet_length(html).cast("long")})
    # only payloads that occur more than once are looked up; with a written table Spark knows whether it is small enough to
    # broadcast, and html is shuffled only where it is not
    twice = keyed.groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    rows = keyed.join(stash(twice.select("of", "least"), "payloads"), F.col("digest") == F.col("of"), "left")
    rows = rows.withColumn("first_id", F.when(F.col("of").isNull(), F.col("page_id")).otherwise(F.col("least"))).drop("least")
    revisit = (F.col("bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            line("WARC-Refers-To", record_id(F.col("first_id"))), line("X-Refers-To-Page", F.col("first_id")),
        )).otherwise(F.lit("")),
        line("X-Page", F.col("page_id")),
        line("X-Payload-Length", F.col("bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(body) + len(HTTP)),
        F.lit("\r\n" + HTTP), body,
    )
    sized = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    kind = sum((F.when(sized > x, 1).otherwise(0) for x in CLASSES), F.lit(0))
    # revisits and responses are told apart on narrow rows; only the classes that occur are written
    biggest = {r["kind"]: r["count"] for r in pages.select(sum((F.when(F.octet_length("html") > x, 1).otherwise(0) for x in CLASSES), F.lit(0)).alias("kind")).groupBy("kind").count().collect()}
    out = rows.withColumn("revisit", revisit).select(kind.alias("kind"), record.alias("value"))
    for k in sorted(set(biggest) | {0}):
        records = max(1, most // CLASSES[k]) if k < len(CLASSES) else 1
        of_kind = out.filter(F.col("kind") == k).select("value") if len(biggest) > 1 else out.select("value")
        of_kind.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query in lower case; no scheme, www, port or fragment."""
    rest = (url or "").strip().partition("#")[0].lower()
    rest = rest.partition("://")[2] or rest
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].partition(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def scan_archive(raw: bytes, run: str) -> list[tuple]:
    """The index rows of one archive, as a sorted run; `offset` is that in the inflated archive."""
    data, at, out = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw, 0, []
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:head_end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = memoryview(data)[head_end + 4 : head_end + 4 + size]
        named, kind, page = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], head.get("X-Page")
        if kind == "response":
            payload = bytes(block[bytes(block[:4096]).index(b"\r\n\r\n") + 4 :])
            length, found = len(payload), base32(payload)
        else:
            length, found = int(head["X-Payload-Length"]), named
        refers = head.get("X-Refers-To-Page")
        stamp = head["WARC-Date"].translate({ord(c): None for c in "-T:Z"})
        out.append((url_key(head.get("WARC-Target-URI")), stamp, int(page) if page else None, length, found, kind, int(refers) if refers else None, run, at, found == named))
        at = head_end + 4 + size + 4
    return [(*row, i) for i, row in enumerate(sorted(out, key=order))]


def order(row: tuple) -> tuple:
    return (row[0], row[1], row[2] is None, row[2] or 0)


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: inner nodes keep the loser of their match, the winner goes up and out."""
    k = len(runs)
    if not k:
        return
    done = ("\U0010ffff" * 2, "", True, 0)
    at, heads = [0] * k, [(order(r[0]), i) if r else (done, i) for i, r in enumerate(runs)]
    losers, winner = [-1] * k, -1
    for i in range(k):  # play every leaf up until it meets an empty node
        node, now = (i + k) // 2, i
        while node and losers[node] >= 0:
            if heads[losers[node]] < heads[now]:
                losers[node], now = now, losers[node]
            node //= 2
        if node:
            losers[node] = now
        else:
            winner = now
    left = sum(map(len, runs))
    while left:
        run = runs[winner]
        yield run[at[winner]]
        left -= 1
        at[winner] += 1
        heads[winner] = (order(run[at[winner]]), winner) if at[winner] < len(run) else (done, winner)
        node, now = (winner + k) // 2, winner
        while node:
            if heads[losers[node]] < heads[now]:
                losers[node], now = now, losers[node]
            node //= 2
        winner = now


def _rows(batch_rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*batch_rows, strict=True)) if batch_rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
_INDEX = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in INDEX.split(", "))])


def read_archives(spark, path: str) -> DataFrame:
    """Index rows of the archives below `path`, one sorted run an archive."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _rows(scan_archive(raw.as_py(), name.rpartition("/")[2]), _INDEX)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(scan, INDEX)


def merged_index(index: DataFrame) -> DataFrame:
    """Index rows in global order of URL key, timestamp and page_id; `index` must be a stashed table.

    A hot URL is cut between tasks by timestamp and page. Each task gets its slice of every
    run, a run's rows together and in the run's own order, which the loser tree merges; it
    holds about MERGE_ROWS narrow rows. Rows equal in all three keys stay in the order of
    their runs.
    """
    parts = max(1, -(-index.count() // MERGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[tuple]] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not runs or runs[-1][-1][7] != row[7]:
                    runs.append([])
                runs[-1].append(row)
        out = []
        for row in loser_tree(runs):
            out.append(row)
            if len(out) == 10_000:
                yield _rows(out, _INDEX)
                out = []
        if out:
            yield _rows(out, _INDEX)

    ranged = index.repartitionByRange(parts, F.col("url_key"), F.col("ts"), F.col("page_id").asc_nulls_last())
    return ranged.sortWithinPartitions("run", "nth").mapInArrow(merge, INDEX)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Write all `pages` as archives, read them back and merge their index.

    One row a page: page_id, payload_bytes, payload_digest, record_type, refers_to, and
    its key in the capture index (url_key, ts). A record whose payload does not have the
    digest that its header names raises. Null html, url and page_id
    are described at write_archives; an empty table gives no rows.
    """
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    index = stash(read_archives(spark, path), "runs")
    sound = F.when(F.col("intact"), F.lit(True)).otherwise(F.raise_error(F.lit("payload differs from its digest")).cast("boolean"))
    return merged_index(index).filter(sound).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")
