"""Compression of vectors to codes: one byte a part, the index of the part's nearest codebook entry.

Each part position has its own codebook of at most 64 entries and a vantage-point tree
over them. A batch of parts goes down the tree together: at a node the integer distances
to the vantage entry are taken, then each half is visited by the parts whose ball around
their best distance so far can reach it. Radii are kept as doubles rounded outwards and a
half is visited also where the bound is only met, so that an equally near entry of a
lower index is never passed over; what decides is always the integer distance.

Spark partitions the vectors. A round of refinement is one pass that sends one row a part
position, entry and task, with the count and the sums of its parts, to an aggregate; the
codebooks (16 x 64 entries) are all that passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash, table, with_checked_size

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a tree's leaf, which are compared one by one.
LEAF = 8
#: Vectors that go down a tree together.
BATCH = 8192
#: Integer components beyond this raise: a part's squared distances must fit 64 bits.
MOST = 1 << 28

SUMS = "part int, entry int, n long, sums array<long>"


@dataclass
class Node:
    """A vantage entry with the entries within its radius (inner) and beyond it (outer), or a leaf."""

    entries: np.ndarray  # of a leaf: indices in the codebook; of an inner node: the vantage entry alone
    inner: Node | None = None
    outer: Node | None = None
    #: No inner entry is farther from the vantage entry than inner_far, no outer one nearer than outer_near.
    inner_far: float = 0.0
    outer_near: float = 0.0


def squared(queries: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = queries - entry
    return (gap * gap).sum(axis=-1)


def up(d2: np.ndarray | int) -> np.ndarray:
    """A double that is at least the square root."""
    return np.nextafter(np.sqrt(np.nextafter(np.asarray(d2, dtype=np.float64), np.inf)), np.inf)


def down(d2: np.ndarray | int) -> np.ndarray:
    """A double that is at most the square root, and not below zero."""
    return np.maximum(np.nextafter(np.sqrt(np.maximum(np.nextafter(np.asarray(d2, dtype=np.float64), -np.inf), 0.0)), -np.inf), 0.0)


def grown(codebook: np.ndarray, members: np.ndarray) -> Node | None:
    """The tree over codebook[members]; the vantage entry is that farthest from the members' middle."""
    if not len(members):
        return None
    if len(members) <= LEAF:
        return Node(members)
    points = codebook[members]
    at = int(np.argmax(squared(points, points.sum(axis=0) // len(points))))
    rest = np.delete(members, at)
    d2 = squared(codebook[rest], codebook[members[at]])
    ranked = np.argsort(d2, kind="stable")
    half = len(rest) // 2
    near, far = ranked[:half], ranked[half:]
    return Node(
        members[at : at + 1], grown(codebook, rest[np.sort(near)]), grown(codebook, rest[np.sort(far)]), float(up(d2[near].max())), float(down(d2[far].min()))
    )


class Search:
    """Nearest entries of a batch of parts, ties to the lower index."""

    def __init__(self, codebook: np.ndarray, tree: Node | None, queries: np.ndarray):
        self.codebook, self.queries = codebook, queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max, dtype=np.int64)
        self.index = np.full(len(queries), len(codebook), dtype=np.int64)
        self.compared = 0
        self.visit(tree, np.arange(len(queries)))

    def compare(self, entry: int, rows: np.ndarray) -> np.ndarray:
        d2 = squared(self.queries[rows], self.codebook[entry])
        self.compared += len(rows)
        won = (d2 < self.best[rows]) | ((d2 == self.best[rows]) & (entry < self.index[rows]))
        self.best[rows[won]], self.index[rows[won]] = d2[won], entry
        return d2

    def visit(self, node: Node | None, rows: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        if node.inner is None:
            for entry in node.entries.tolist():
                self.compare(entry, rows)
            return
        d2 = self.compare(int(node.entries[0]), rows)
        low, high = down(d2), up(d2)
        inside = low <= node.inner_far
        for first in (True, False):  # each part goes to its own side first
            mine = inside if first else ~inside
            some, some_low, some_high = rows[mine], low[mine], high[mine]
            for inner in (first, not first):
                reach = up(self.best[some])
                near = some_low <= node.inner_far + reach if inner else node.outer_near <= some_high + reach
                self.visit(node.inner if inner else node.outer, some[near])


def nearest(codebook: np.ndarray, queries: np.ndarray, tree: Node | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each query's nearest entry."""
    tree = tree or grown(codebook, np.arange(len(codebook)))
    found = [Search(codebook, tree, queries[i : i + BATCH]) for i in range(0, len(queries), BATCH)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x.index for x in found]), np.concatenate([x.best for x in found])


def integers(column: pa.Array, width: int | None) -> np.ndarray:
    """floor(256 x) of a batch's vectors, one row each; all must have `width` components."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) * SCALE
    lengths = np.asarray(column.value_lengths())
    if len(lengths) and (lengths != (width if width is not None else lengths[0])).any():
        raise ValueError(f"vectors must all have {width} components")
    if len(values) and np.abs(values).max() > MOST:
        raise ValueError(f"a component is beyond {MOST // SCALE}")
    return np.floor(values).astype(np.int64).reshape(len(column), -1)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has components and holds neither null nor a value that is not finite."""
    x: Column = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select("vec_id", "embedding", "label").filter(x.isNotNull() & (F.size(x) > 0) & finite)


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Parts of the vectors of the smallest vec_ids; of equal ones, that of the smaller vector. Null ids come last."""
    first = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow()
    if not first.num_rows:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    column = first.column("embedding").combine_chunks()
    rows = integers(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, None)
    if rows.shape[1] % parts:
        raise ValueError(f"vectors of {rows.shape[1]} components cannot be cut into {parts} equal parts")
    return np.ascontiguousarray(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def assigned(rows: np.ndarray, codebooks: np.ndarray, trees: list[Node | None]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances, one row a vector and one column a part."""
    parts = rows.reshape(len(rows), len(codebooks), -1)
    both = [nearest(codebooks[p], np.ascontiguousarray(parts[:, p]), trees[p]) for p in range(len(codebooks))]
    return np.stack([x[0] for x in both], axis=1), np.stack([x[1] for x in both], axis=1)


def refined(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored mean of their parts; entries without parts stay."""
    width = codebooks.shape[0] * codebooks.shape[2]

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [grown(c, np.arange(len(c))) for c in codebooks]
        n = np.zeros(codebooks.shape[:2], dtype=np.int64)
        sums = np.zeros(codebooks.shape, dtype=np.int64)
        for batch in batches:
            rows = integers(batch.column(0), width)
            found, _ = assigned(rows, codebooks, trees)
            for p in range(len(codebooks)):
                n[p] += np.bincount(found[:, p], minlength=n.shape[1])
                np.add.at(sums[p], found[:, p], rows.reshape(len(rows), len(codebooks), -1)[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"]
        )

    partial = kept.select("embedding").mapInArrow(part_sums, SUMS)
    totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(codebooks.shape[2])]
    out = codebooks.copy()
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # at most parts x entries rows
        out[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(codebooks.shape[2])]
    return out


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def fitted_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as an array (part, entry, component), fitted on all kept vectors."""
    kept = kept_vectors(vectors)
    codebooks = first_codebooks(kept, parts, entries)
    for _ in range(rounds if codebooks.shape[1] else 0):
        codebooks = refined(kept, codebooks)
    return codebooks


def encoded(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each kept vector."""
    kept = kept_vectors(vectors)
    types = {f.name: f.dataType for f in kept.schema.fields}
    schema = f"vec_id {types['vec_id'].simpleString()}, label {types['label'].simpleString()}, code string, error long"
    width = codebooks.shape[0] * codebooks.shape[2]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [grown(c, np.arange(len(c))) for c in codebooks]
        for batch in batches:
            found, d2 = assigned(integers(batch.column(1), width), codebooks, trees)
            hexed = [bytes(x).hex() for x in found.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hexed, pa.string()), pa.array(d2.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(codes, schema)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector.

    Rows whose vector is null, empty or holds null, NaN or an infinity are left out. A null
    vec_id or label is kept as such; null labels are one label. Repeated rows are encoded
    each. Fewer vectors than entries make smaller codebooks, an empty table gives no rows.
    Kept vectors of different lengths, of a length that the parts do not divide, or with a
    component beyond 2^20 raise. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    codebooks = fitted_codebooks(vectors, parts, entries, rounds)
    coded = stash(encoded(vectors, codebooks), "codes")
    by_label = with_checked_size(stash(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label_errors"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all kept `embeddings`; see compressed."""
    return compressed(table(spark, sf_dir, "embeddings"))


def _assign(codebook: str) -> str:
    return f"""SELECT r, p, arg_min(j, d * 64 + j) AS j, min(d) AS d FROM (
    SELECT v.r, v.p, e.j, list_sum(list_transform(v.x, lambda a, i: (a - e.x[i]) * (a - e.x[i]))) AS d FROM part v JOIN {codebook} e USING (p)) GROUP BY r, p"""


def _refine(k: int) -> str:
    return f"""a{k} AS MATERIALIZED ({_assign(f"e{k}")}),
m{k} AS (SELECT p, j, list(m ORDER BY i) AS x FROM (
  SELECT a.p, a.j, i, CAST(floor(CAST(sum(v.x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{k} a JOIN part v USING (r, p), (SELECT unnest(range(1, 5)) AS i) GROUP BY a.p, a.j, i) GROUP BY p, j),
e{k + 1} AS MATERIALIZED (SELECT e.p, e.j, coalesce(m.x, e.x) AS x FROM e{k} e LEFT JOIN m{k} m USING (p, j))"""


OP11_SQL = f"""
WITH ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS (SELECT *, row_number() OVER (ORDER BY vec_id, x) AS r FROM ok),
part AS MATERIALIZED (SELECT r, p, x[p * 4 + 1 : p * 4 + 4] AS x FROM kept, (SELECT unnest(range(0, 16)) AS p)),
e0 AS MATERIALIZED (SELECT p, r - 1 AS j, x FROM part WHERE r <= 64),
{_refine(0)},
{_refine(1)},
a2 AS MATERIALIZED ({_assign("e2")}),
coded AS (SELECT r, string_agg(printf('%02x', CAST(j AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
book AS (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY p, j, i)) AS h FROM e2, (SELECT unnest(range(1, 5)) AS i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), book
"""
