"""Refusals: availability that nobody verified, conflicting versions, unverified topology, numbers that are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.sources.decoders import strict

BASES = ("measured", "assumed", "unknown")


def availability_problem(allow_assumed: bool) -> Column:
    """Why an observation (basis, t_end, t_available) is no evidence of what was known when, else NULL."""
    basis, end, available = F.col("basis"), F.col("t_end"), F.col("t_available")
    out = F.when(~F.coalesce(basis.isin(*BASES), F.lit(False)), "not_a_basis").when(basis == "unknown", "unknown_basis")
    if not allow_assumed:
        out = out.when(basis == "assumed", "assumed_basis")
    return out.when(available.isNull(), "no_availability").when(available < end, "available_before_its_end")


def admissible(obs: DataFrame, allow_assumed: bool = False) -> DataFrame:
    """obs, raising on a row whose availability is unverified or impossible, and on a record_id that comes twice."""
    once = obs.groupBy("record_id").agg(F.count("*").alias("n")).select(F.col("record_id").alias("__id"), "n")
    sound = strict(obs, availability_problem(allow_assumed).isNull(), "availability is unverified")
    met = sound.join(once, F.col("record_id").eqNullSafe(F.col("__id")))
    return strict(met, (F.col("n") == 1) & F.col("record_id").isNotNull(), "a record id is missing or repeated").drop("__id", "n")


def version_conflicts(rows: DataFrame, version: list[str], ident: str = "record_id") -> DataFrame:
    """(kind, id) of each conflict: an id with different rows, or a version key (site, series, time) with several ids."""
    once = rows.distinct()
    ids = once.groupBy(ident).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("conflicting_rows").alias("kind"), F.col(ident).cast("string").alias("id"))
    keys = once.select(*version, ident).distinct().groupBy(*version).agg(F.count("*").alias("n")).filter("n > 1")
    return ids.unionByName(keys.select(F.lit("several_versions").alias("kind"), F.concat_ws(":", *version).alias("id")))


def unique_rows(rows: DataFrame, version: list[str], ident: str = "record_id") -> DataFrame:
    """rows without exact repeats; conflicting rows of an id, and several ids of one version key, raise."""
    once = rows.distinct()
    by_id = Window.partitionBy(ident)
    by_key = Window.partitionBy(*version)
    marked = once.withColumns({"__n": F.count("*").over(by_id), "__k": F.size(F.collect_set(ident).over(by_key))})
    sound = strict(marked, F.col("__n") == 1, "conflicting rows of one record id")
    return strict(sound, F.col("__k") == 1, "several versions of one observation").drop("__n", "__k")


def network_components(nodes: DataFrame, edges: DataFrame, topology_verified: bool) -> DataFrame:
    """graph.components, refused unless the topology was verified; an edge to an unknown node raises."""
    if topology_verified is not True:
        raise ValueError("the physical topology is not verified")
    known = nodes.select(F.col("node").alias("__node")).distinct()
    for end in ("a", "b"):
        edges = strict(edges.join(known, F.col(end) == F.col("__node"), "left"), F.col("__node").isNotNull(), "an edge to an unknown node").drop("__node")
    return graph.components(nodes, edges)


def strict_number(raw: Column, is_text: Column) -> dict[str, Column]:
    """`number` and `number_problem` of a provider's value: negatives are kept and told, what is no finite decimal text is none."""
    text = F.trim(raw)
    plain = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    endless = text.rlike(r"(?i)^[+-]?(inf|infinity|s?nan[0-9]*)$")
    number = F.when(is_text & plain, text.try_cast("decimal(38,6)"))
    problem = (
        F.when(raw.isNull(), "null_value").when(~is_text, "non_string_value").when(endless, "non_finite_value").when(~plain, "invalid_decimal_value")
        .when(number.isNull(), "beyond_the_declared_range").when(number < 0, "negative_value_preserved")
    )
    return {"number": number, "number_problem": problem}
