"""Near-duplicates by SimHash: tiled exact comparison of fingerprints.

Documents become 64-bit fingerprints, equal fingerprints one row. If two fingerprints
differ in at most r bits, then of any cut into `blocks` runs of bits at least
blocks - r runs are equal; so pairs are looked for among those that share such a set of
runs, for every choice of the set, and none is lost. Inside such a bucket fingerprints
are sorted by population count and cut into tiles; tiles are compared with numpy
exclusive-or and bit counts, and tile pairs whose population counts lie further apart
than the radius are skipped. A bucket of more than one tile is dealt to tasks by tile
pairs, so no task holds a bucket. Tiles emit a spanning forest of their links, never all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stash, table, texts, with_checked_size
from tidemark.llm.components import components
from tidemark.llm.near_texts import rooted_rows

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Runs of bits of the candidate search: C(7, 3) = 35 buckets a fingerprint, keys of 27 or 28 bits.
BLOCKS = 7
#: Fingerprints of a tile.
TILE = 2048


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Majority of each bit over the shingles' hashes; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -shingle]))
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, row_hash: Column | None = None) -> DataFrame:
    """doc_id, text_hash, row_hash (if given) and fp (signed 64 bits) of every row; null texts are empty."""
    more = [] if row_hash is None else [row_hash.alias("row_hash")]
    names = ["doc_id", "text_hash", *["row_hash" for _ in more], "fp"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = np.array([fingerprint(x, shingle, seed) for x in texts(piece, "text")], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(found.view(np.int64))], names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), *more, "text")
    return read.mapInArrow(measure, ", ".join(f"{c} long" for c in names))


def keys(radius: int, blocks: int) -> list[np.uint64]:
    """One mask of bits for each choice of blocks - radius runs."""
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [np.uint64(sum(x)) for x in combinations(runs, blocks - radius)]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs within the radius (right None: inside left)."""
    nodes = left if right is None else np.concatenate((left, right))
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    base = 0 if right is None else len(left)
    other = left if right is None else right
    for i in range(0, len(left), 256):
        near = np.bitwise_count(left[i : i + 256, None] ^ other[None, :]) <= radius
        for a, b in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            a, b = find(a + i), find(b + base)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[a]), int(nodes[b])))
    return out


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span all pairs within the radius; `fps` is stashed, one row each."""
    masks = keys(radius, blocks)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, mask in enumerate(masks):
                part = (fp.view(np.uint64) & mask).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(part), pa.array(fp)], ["k", "part", "fp"])

    spread = fps.select("fp").mapInArrow(candidates, "k int, part long, fp long")
    counts = stash(spread.groupBy("k", "part").count().filter("count > 1"), "buckets")
    spread = spread.join(counts, ["k", "part"])  # drops the buckets of one; large ones are split by AQE
    tiles = F.ceil(F.col("count") / tile).cast("int")
    # a fingerprint's tile in its bucket: by population count, then by a hash; no sort of a bucket is needed
    spread = spread.withColumn("tiles", tiles).withColumn("ones", F.bit_count("fp"))
    mine = F.when(F.col("tiles") == 1, F.lit(0)).otherwise(F.col("ones") * F.col("tiles") + F.pmod(F.xxhash64("fp"), F.col("tiles")))
    spread = stash(spread.withColumn("mine", mine.cast("int")), "spread")
    heads = spread.groupBy("k", "part", "tiles", "mine", "ones").agg(F.lit(1).alias("one")).drop("one")
    other = heads.select(F.col("k").alias("k2"), F.col("part").alias("part2"), F.col("mine").alias("theirs"), F.col("ones").alias("ones2"))
    small = spread.filter("tiles = 1").select("k", "part", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "fp")
    big = heads.filter("tiles > 1")
    pairs = big.join(other, (F.col("k") == F.col("k2")) & (F.col("part") == F.col("part2")) & (F.col("mine") <= F.col("theirs")) & (F.col("ones2") - F.col("ones") <= radius))
    pairs = pairs.select("k", "part", F.col("mine").alias("x"), F.col("theirs").alias("y"))
    big_rows = spread.filter("tiles > 1").select("k", "part", "mine", "fp")
    as_left = big_rows.join(pairs, ["k", "part"]).filter(F.col("mine") == F.col("x")).select("k", "part", "x", "y", F.lit(0).alias("side"), "fp")
    as_right = big_rows.join(pairs, ["k", "part"]).filter((F.col("mine") == F.col("y")) & (F.col("x") < F.col("y"))).select("k", "part", "x", "y", F.lit(1).alias("side"), "fp")
    dealt = small.unionByName(as_left).unionByName(as_right)
    dealt = dealt.repartition("k", "part", "x", "y").sortWithinPartitions("k", "part", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> list[tuple[int, int]]:
            fp, side = np.concatenate([x for x, _ in rows]), np.concatenate([x for _, x in rows])
            left, right = fp[side == 0].view(np.uint64), fp[side == 1].view(np.uint64)
            return forest(left, None if held[2] == held[3] else right, radius)

        for batch in batches:
            group = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            side, fp = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            found: list[tuple[int, int]] = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
                key = tuple(group[a].tolist())
                if held is not None and key != held:
                    found += close()
                    rows = []
                held = key
                rows.append((fp[a:b], side[a:b]))
            yield _pairs(found)
        if rows:
            yield _pairs(close())

    return dealt.mapInArrow(compare, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    array = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(array[:, 0]), pa.array(array[:, 1])], ["a", "b"])


def simhash_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, fp and component_id (smallest doc_id of all that links reach) of every row.

    Null and empty texts have fingerprint 0 and are linked as any other. Repeated rows
    are in one group. A null doc_id gets its group's smallest doc_id, or null if the
    group has none. An empty table gives no rows; other columns are not read.
    """
    marked = stash(fingerprints(docs, shingle, seed), "fingerprints")
    of = groups_of(marked, radius)
    return marked.join(of, F.col("fp") == F.col("of")).select("doc_id", "text_hash", "fp", "component_id")


def groups_of(marked: DataFrame, radius: int) -> DataFrame:
    """of (each fingerprint of the stashed `marked`), root of its group and component_id, stashed."""
    distinct = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct, radius))
    joined = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return stash(joined.join(least, "root").select(F.col("fp").alias("of"), "root", "component_id"), "groups")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every row of `documents`."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def group_heads(docs: DataFrame) -> DataFrame:
    """docs with exactly one document of each near-duplicate group, all columns kept.

    Groups are those of `near_texts`: texts linked by a Jaccard similarity of 0.8 or more
    of their five-word shingles, by an exact set join. The one that stays is the group's first by doc_id (null last), then by text hash, then by a hash of all
    columns; rows equal in all three are copies, of which one stays. Rows without a doc_id
    are grouped by their texts as any other.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    row_hash = F.xxhash64(*own, *[c.isNull() for c in own])  # xxhash64 alone passes over nulls
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row_hash")
    rows = rooted_rows(docs, row_hash, order)
    first = rows.groupBy(F.col("root").alias("r")).agg(F.min("o").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = rows.join(with_checked_size(stash(first, "first")), F.col("root") == F.col("r"))
    key = [F.col("o.doc_id").alias("__doc"), F.col("o.text_hash").alias("__hash"), F.col("o.row_hash").alias("__row")]
    others = with_checked_size(stash(met.filter("o != first").select(*key).distinct(), "others"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__hash")) & (row_hash == F.col("__row"))
    heads = docs.join(others, same, "left_anti")
    # heads that come more than once, as a rule none
    again = stash(met.filter("o = first").groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1"), "repeated")
    if again.isEmpty():
        return heads
    copies = heads.join(again, same, "left")
    once = copies.filter("__n is null").select(*own)
    return once.unionByName(copies.filter("__n > 1").dropDuplicates(["__doc", "__hash", "__row"]).select(*own))
