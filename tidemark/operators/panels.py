"""Panels of labels: crosstabs of labels and inputs, and transitions between cells.

Ids are counted in two levels, distinct (group, id) rows first, so no group gathers its
occurrences. Matrices come from one pass: each pair of labels is a row a matrix, counted
by grouping sets, and zeros are filled in from the few known values.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import season

CELL = ("ref_lane", "lane")
STATUSES = ("positive", "negative", "unknown")


def completion_targets(trace: DataFrame, horizons: Sequence[int] = (24, 48, 72)) -> DataFrame:
    """(site, cell, issue_date, horizon, target_date, record_id) of every completion and issue whose horizon it closes in."""
    done = trace.filter("completion").select("site", *CELL, F.col("local_date").alias("target_date"), F.concat_ws(":", "site", "local_date").alias("record_id"))
    frames = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("before")) for h in horizons for k in range(h // 24)])).alias("f")
    return done.select("*", frames).select("site", *CELL, F.date_sub("target_date", F.col("f.before")).alias("issue_date"), F.col("f.horizon").alias("horizon"), "target_date", "record_id")


def _keys(date: Column) -> dict[str, Column]:
    return {"issue_year": F.year(date), "issue_season": season(F.month(date))}


def issue_crosstab(labels: DataFrame, inputs: DataFrame) -> DataFrame:
    """Labels by cell, site, year, season, horizon, status and whether, or why not, there was an input; inputs: site, issue_date, status."""
    scored = inputs.select("site", "issue_date", (F.col("status") == "scored").alias("input_available"), F.col("status").alias("input_reason"))
    met = labels.join(scored, ["site", "issue_date"]).withColumns(_keys(F.col("issue_date")))
    return met.groupBy(*CELL, "site", "issue_year", "issue_season", "horizon", "status", "input_available", "input_reason").agg(F.count("*").alias("n"))


def target_crosstab(labels: DataFrame, inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """Positive labels by cell, site, year, season of issue and of target, horizon and input, with the distinct completions they see."""
    scored = inputs.select("site", "issue_date", (F.col("status") == "scored").alias("input_available"), F.col("status").alias("input_reason"))
    positive = labels.filter("status = 'positive'").select("site", *CELL, "issue_date", "horizon")
    seen = positive.join(targets, ["site", *CELL, "issue_date", "horizon"]).join(scored, ["site", "issue_date"])
    seen = seen.withColumns(_keys(F.col("issue_date")) | {"target_season": season(F.month("target_date"))})
    keys = [*CELL, "site", "issue_year", "issue_season", "target_season", "horizon", "input_available", "input_reason"]
    each = seen.groupBy(*keys, "record_id").agg(F.count("*").alias("k"))
    return each.groupBy(*keys).agg(F.sum("k").alias("n"), F.count("*").alias("n_ids"), F.array_join(F.array_sort(F.collect_list("record_id")), ",").alias("ids"))


def cell_pairs(cells: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str, str]]:
    """Every pair of cells with what differs between them."""
    out = []
    for (a, b), (c, d) in combinations(cells, 2):
        kind = "truth" if a == c else "reference" if b == d else "both"
        out.append((a, b, c, d, kind))
    return out


def paired(labels: DataFrame, cells: Sequence[tuple[str, str]]) -> DataFrame:
    """Labels of both cells of each pair by site, issue and horizon, where both have one; two of one cell raise.

    A cell has no panel of a site whose reference gives it no threshold.
    """
    spark = labels.sparkSession
    pairs = spark.createDataFrame(cell_pairs(cells), "l_ref string, l_lane string, r_ref string, r_lane string, contrast string")
    facts = labels.select("site", "issue_date", "horizon", *CELL, "status", "issue_state", (F.col("issue_state") == "armed").alias("eligible"))
    # both cells of a pair meet in one group of a row each, so that no row is joined with all pairs twice
    sides = F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"{x}_ref").alias("ref"), F.col(f"{x}_lane").alias("of_lane")) for x in ("l", "r")])
    wanted = pairs.select("*", F.inline(sides))
    rows = facts.join(F.broadcast(wanted), (F.col("ref_lane") == F.col("ref")) & (F.col("lane") == F.col("of_lane")))
    pair = ["l_ref", "l_lane", "r_ref", "r_lane", "contrast", "site", "issue_date", "horizon"]
    one = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    met = rows.groupBy(*pair).agg(F.count_if(F.col("side") == "l").alias("n_l"), F.count_if(F.col("side") == "r").alias("n_r"), *[one(s, c).alias(f"{s}_{c}") for s in ("l", "r") for c in ("status", "eligible", "issue_state")])
    # one expression, so that no filter is moved before the check
    repeated = F.raise_error(F.lit("a cell's panel repeats a key")).cast("boolean")
    return met.filter(F.when((F.col("n_l") > 1) | (F.col("n_r") > 1), repeated).otherwise((F.col("n_l") == 1) & (F.col("n_r") == 1))).drop("n_l", "n_r")


def transitions(labels: DataFrame, targets: DataFrame, cells: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair of cells, contrast, matrix, left_value, right_value, site, horizon, n) of all matrices, over all (site and horizon NULL) and by site and horizon.

    Matrices: status, eligible, known_status (both known), all with their zeros; issue_state
    as it occurs; completions, whose left_value is both, left_only or right_only and whose n
    counts distinct completions that a cell's positive labels see.
    """
    spark = labels.sparkSession
    both = paired(labels, cells)
    known = (F.col("l_status") != "unknown") & (F.col("r_status") != "unknown")
    entry = lambda m, a, b: F.struct(F.lit(m).alias("matrix"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"))
    entries = F.array_compact(F.array(
        entry("status", F.col("l_status"), F.col("r_status")), entry("eligible", F.col("l_eligible"), F.col("r_eligible")),
        entry("issue_state", F.col("l_issue_state"), F.col("r_issue_state")), F.when(known, entry("known_status", F.col("l_status"), F.col("r_status"))),
    ))
    pair = ["l_ref", "l_lane", "r_ref", "r_lane", "contrast"]
    rows = both.select(*pair, "site", "horizon", F.inline(entries))
    every = [F.col(c) for c in (*pair, "matrix", "left_value", "right_value")]
    sets = [every, [*every, F.col("site"), F.col("horizon")]]
    counted = rows.groupingSets(sets, *every, "site", "horizon").agg(F.count("*").alias("n"))
    # zeros: every combination of the known values for every group there is
    values = [("status", a, b) for a in STATUSES for b in STATUSES] + [("eligible", a, b) for a in ("false", "true") for b in ("false", "true")]
    values += [("known_status", a, b) for a in STATUSES[:2] for b in STATUSES[:2]]
    dense = F.broadcast(spark.createDataFrame(values, "matrix string, left_value string, right_value string"))
    groups = both.groupingSets([[F.col(c) for c in pair], [F.col(c) for c in (*pair, "site", "horizon")]], *pair, "site", "horizon").agg(F.lit(0).cast("long").alias("n"))
    zeros = groups.crossJoin(dense).select(*counted.columns)  # seventeen rows a group
    matrices = counted.unionByName(zeros).groupBy(*[c for c in counted.columns if c != "n"]).agg(F.sum("n").alias("n"))
    # completions: distinct (pair, site, horizon, id) with the sides that see it
    positive = labels.filter("status = 'positive'").select("site", *CELL, "issue_date", "horizon").join(targets, ["site", *CELL, "issue_date", "horizon"])
    seen = positive.select("site", "horizon", *CELL, "record_id").distinct()
    wanted = spark.createDataFrame(cell_pairs(cells), "l_ref string, l_lane string, r_ref string, r_lane string, contrast string")
    left = (F.col("ref_lane") == F.col("l_ref")) & (F.col("lane") == F.col("l_lane"))
    right = (F.col("ref_lane") == F.col("r_ref")) & (F.col("lane") == F.col("r_lane"))
    sided = seen.join(F.broadcast(wanted), left | right).select(*pair, "site", "horizon", "record_id", left.alias("l"), right.alias("r"))
    keys = [F.col(c) for c in (*pair, "record_id")]
    marked = sided.groupingSets([keys, [*keys, F.col("site"), F.col("horizon")]], *keys, "site", "horizon").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    kind = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only")
    none = F.lit(None).cast("string")
    ids = marked.select(*pair, F.lit("completions").alias("matrix"), kind.alias("left_value"), none.alias("right_value"), "site", "horizon").groupBy(*pair, "matrix", "left_value", "right_value", "site", "horizon").agg(F.count("*").alias("n"))
    return matrices.unionByName(ids)
