"""A Merkle manifest of a table: a leaf a row, a tree a group, a tree over the groups' roots.

Levels are DataFrames. Nodes have their index in their group; floor-division by the fanout
names the parent, whose children are gathered as a sorted array of at most `fanout` nodes
and hashed. Each level is written once. Proofs go the other way, from the root down: a
node's path is its parent's path with the node's siblings before it, so a level's join
has as many rows as the level has parents, and all levels together as many as there are
leaves. (Appending to every leaf at every level would shuffle all rows once a level.)

Leaves are ranked in slices of a range partitioning: row_number within (slice, group) plus
the group's rows in earlier slices, so no window holds a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stash, table

FANOUT = 2
#: Rows of a slice in which leaves are numbered, about.
SLICE_ROWS = 100_000
#: Levels of more nodes than this are joined by shuffle; for smaller ones Spark chooses by size.
WIDE = 50_000
#: Rows of a task that writes a small level, about.
LEVEL_ROWS = 10_000
#: Levels of the way down in one plan: its size, and what a lost executor repeats at most.
STRIDE = 4
PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value as `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def group_key(value: Column) -> Column:
    """A group's name as a non-null key that sorts as the name does, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def numbered(leaves: DataFrame, order: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """leaves (a stashed table with `grp`) with `idx`, their place in the group from 0, and `n`, the group's size.

    Rows equal in all of `order` are told apart by `uid`.
    """
    keys = ["grp", *[F.col(c).asc_nulls_first() for c in order], "uid"]
    parts = max(1, -(-leaves.count() // slice_rows))
    sliced = stash(leaves.repartitionByRange(parts, *keys).withColumn("slice", F.spark_partition_id()), "slices")
    sizes = sliced.groupBy("grp", "slice").agg(F.count("*").alias("rows"))
    by_group = Window.partitionBy("grp").orderBy("slice")  # a row a slice
    sizes = stash(
        sizes.select(
            F.col("grp").alias("of_grp"), F.col("slice").alias("of_slice"), (F.sum("rows").over(by_group) - F.col("rows")).alias("earlier"), F.sum("rows").over(Window.partitionBy("grp")).alias("n")
        ),
        "slice_sizes",
    )
    within = F.row_number().over(Window.partitionBy("slice", "grp").orderBy(*keys[1:]))
    placed = sliced.withColumn("nth", within).join(sizes, (F.col("grp") == F.col("of_grp")) & (F.col("slice") == F.col("of_slice")))
    return placed.withColumn("idx", F.col("nth") - 1 + F.col("earlier")).drop("slice", "of_grp", "of_slice", "nth", "earlier", "uid")


def parents(nodes: DataFrame, fanout: int, payload: list[str]) -> DataFrame:
    """The level above nodes (grp, n, idx, digest): grp, n, idx, digest and the sorted `children`."""
    above = nodes.groupBy("grp", F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.floor(F.col("idx") / fanout).cast("long").alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), "digest", *payload))).alias("children")
    )
    return above.withColumn("digest", F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256))


def level_sizes(nodes: DataFrame, fanout: int) -> list[int]:
    """Nodes of all groups in each level above the nodes, up to the last that a group of more than one node needs."""
    groups = nodes.filter("idx = 0").select("n")
    most = groups.agg(F.max("n")).first()[0] or 0
    spans, span = [], 1
    while most > span:
        span *= fanout
        spans.append(span)
    if not spans:
        return []
    # a group that is alone in the level below has no node here
    return list(groups.agg(*[F.sum(F.when(F.col("n") > s // fanout, F.ceil(F.col("n") / s)).otherwise(0)).cast("long").alias(f"s{s}") for s in spans]).first())


def levels(nodes: DataFrame, fanout: int, payload: list[str], label: str) -> list[tuple[DataFrame, int]]:
    """The levels above the nodes, each a written table with its number of rows."""
    out, at = [], nodes
    for size in level_sizes(nodes, fanout):
        level = parents(at.filter("n > 1"), fanout, payload)
        at = stash(level.coalesce(max(1, -(-size // LEVEL_ROWS))) if size < WIDE else level, f"{label}{len(out)}")
        payload = []
        out.append((at, size))
    return out


def roots(nodes: DataFrame, above: list[tuple[DataFrame, int]]) -> DataFrame:
    """(grp, digest, height) of each group: the node that is alone in its level, and how many levels that is above the nodes."""
    found = nodes.filter("n = 1").select("grp", "digest", F.lit(0).alias("height"))
    for i, (level, _) in enumerate(above, 1):
        found = found.unionByName(level.filter("n = 1").select("grp", "digest", F.lit(i).alias("height")))
    return found


def step(siblings: Column, mine: Column) -> Column:
    """The siblings of a child before it and after it, each joined."""

    def joined(side: Column) -> Column:
        return F.array_join(F.transform(side, lambda c: c["digest"]), "")

    return F.struct(joined(F.filter(siblings, lambda c: c["at"] < mine)).alias("before"), joined(F.filter(siblings, lambda c: c["at"] > mine)).alias("after"))


def descended(paths: DataFrame, level: DataFrame, size: int, payload: list[str]) -> DataFrame:
    """Paths of a level's children from those of its nodes: (grp, idx, path, carried columns)."""
    carried = [c for c in paths.columns if c not in ("grp", "idx", "path")]
    inner = level.select(F.col("grp").alias("of_grp"), F.col("idx").alias("of_idx"), "children")
    if size > WIDE:
        inner = inner.hint("merge")
    joined = paths.join(inner, (F.col("grp") == F.col("of_grp")) & (F.col("idx") == F.col("of_idx")))
    each = joined.select("grp", *carried, "path", "children", F.explode("children").alias("c"))
    path = F.concat(F.array(step(F.col("children"), F.col("c.at"))), F.col("path")).cast(PATH)
    return each.select("grp", F.col("c.at").alias("idx"), path.alias("path"), *carried, *[F.col(f"c.{p}").alias(p) for p in payload])


def proofs(nodes: DataFrame, above: list[tuple[DataFrame, int]], tops: DataFrame, payload: list[str], label: str) -> DataFrame:
    """The path of every node; tops (grp, height, path, carried columns) has the path of each group's root."""
    at = tops.withColumn("idx", F.lit(0).cast("long"))
    lone = nodes.filter("n = 1").select(F.col("grp").alias("of_grp"), *payload)
    lone = at.filter("height = 0").drop("height").join(lone, F.col("grp") == F.col("of_grp")).drop("of_grp")
    down: DataFrame | None = None
    for i in range(len(above), 0, -1):
        level, size = above[i - 1]
        starting = at.filter(F.col("height") == i).drop("height")  # groups join the way down where their root is
        down = descended(starting if down is None else down.unionByName(starting), level, size, payload if i == 1 else [])
        if i > 1 and i % STRIDE == 1:
            down = stash(down, f"{label}{i}")
    return lone if down is None else down.unionByName(lone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def manifest(leaves: DataFrame, order: list[str], payload: list[str], fanout: int = FANOUT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The payload of each leaf with `digest`, `subroot`, `root` and `path`.

    leaves: grp (see group_key), digest (hex text), the order and payload columns. Leaves
    ascend by `order` in their group, nulls first, equal ones by digest; equal rows have
    each their own place. An empty table gives no rows.
    """
    first = stash(leaves.withColumn("uid", F.monotonically_increasing_id()), "leaves")
    nodes = stash(numbered(first, [*order, "digest"], slice_rows).select("grp", "n", "idx", "digest", *payload), "nodes")
    above = levels(nodes, fanout, payload, "level")
    sub = roots(nodes, above).select(F.lit("").alias("grp"), "digest", F.col("grp").alias("name"), F.col("height").alias("of_height"))
    sub = stash(sub.withColumn("uid", F.monotonically_increasing_id()), "subroots")
    tops = stash(numbered(sub, ["name"], slice_rows), "tops")
    over = levels(tops, fanout, ["name", "of_height"], "top")
    root = roots(tops, over).select("grp", "height", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    paths = proofs(tops, over, root, ["digest", "name", "of_height"], "toppath")
    paths = stash(paths.select(F.col("name").alias("grp"), F.col("of_height").alias("height"), "path", "root", F.col("digest").alias("subroot")), "subpaths")
    whole = proofs(nodes, above, paths, ["digest", *payload], "path")
    return whole.drop("grp", "idx")


def documents_manifest(docs: DataFrame, fanout: int = FANOUT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Leaf, subroot, root, digest of the proof, and the root folded from a tampered leaf, of each document.

    Groups are the languages, null one of its own. Null doc_ids come first; rows of equal
    doc_id ascend by leaf. Where 7 divides the crc32 of the doc_id as decimal text, n_chars
    is raised by one before the leaf is folded; a null n_chars stays, a null doc_id is never
    tampered with. An empty table gives no rows; other columns are not read.
    """
    of = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    bent = [(c.cast("decimal(20,0)") + 1).cast("decimal(20,0)") if i == 3 else c for i, c in enumerate(of)]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaves = docs.select(group_key(F.col("lang")).alias("grp"), "doc_id", leaf_of(of).alias("digest"), F.when(tampered, leaf_of(bent)).alias("bent"))
    found = manifest(leaves, ["doc_id"], ["doc_id", "bent"], fanout, slice_rows)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = fold(F.coalesce("bent", "digest"), F.col("path"))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all `documents`; see documents_manifest."""
    return documents_manifest(table(spark, sf_dir, "documents"))
