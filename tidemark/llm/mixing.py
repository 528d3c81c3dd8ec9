"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a size. Its target is its share of the total, but at most
`max_epochs` times its size; what a clamped source cannot take is shared again by weight
among the others until no target is above its cap. The clamped set is a function of one
number, the water level (words per unit of weight), so each round is one small aggregate
over the table of sources and the driver holds two sums, never the sources.

A source's target then becomes whole repetitions of all its documents and one fractional
repetition: documents in the order of a seeded hash, up to the one that the remaining
words end in. The place of that cut is found by refining hash prefixes, so no task sorts
a whole source, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stash, table, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Rounds of prefix refinement, each by two hexadecimal digits (256 buckets a source).
LEVELS = 3


def seeded_key(doc_id: str, text: str, seed: int) -> Column:
    """Place of a document in its source's order; rows of one doc_id, or of none, are told apart by their texts."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def ranked(df: DataFrame, by: str) -> DataFrame:
    """Add `rank` (0-based, by code point, null last) without gathering the rows in one task."""
    spark = df.sparkSession
    order = F.col(by).asc_nulls_last()
    parts = stash(df.repartitionByRange(8, order).withColumn("part", F.spark_partition_id()), "ranked")
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}  # 8 rows at most
    offset, offsets = 0, [(-1, 0)]
    for part in sorted(counts):
        offsets.append((part, offset))
        offset += counts[part]
    starts = spark.createDataFrame(offsets, "part int, offset long")
    return parts.withColumn("within", within).join(F.broadcast(starts), "part").withColumn("rank", F.col("within") + F.col("offset")).drop("part", "within", "offset")


def water_level(sources: DataFrame, total: int, max_epochs: int) -> float:
    """Words per unit of weight at which the capped targets add up to `total`.

    Clamping only raises the level and the level only clamps more, so the rounds end
    when the clamped sums stop changing.
    """
    cap = F.col("source_size") * max_epochs
    clamped, free = 0, sources.agg(F.sum("weight")).first()[0] or 0
    while free:
        level = (total - clamped) / free
        above = cap < F.lit(level) * F.col("weight")
        row = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if (row[0], row[1]) == (clamped, free):
            return level
        clamped, free = row
    return 0.0


def mix_cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, whole repetitions and where the fractional one ends.

    That is `cut_key`: smaller keys are taken once more, of the `cut_rows` rows with this
    key `cut_take`. A document is taken if its middle is before the end of the words that
    remain. `sized` has source, key (seeded hash) and size, which is one for all rows of a key.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = stash(ranked(sources, "source").withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total, max_epochs)
    cap, filled = F.col("source_size") * max_epochs, F.lit(level) * F.col("weight")
    target = F.when(cap < filled, cap.cast("double")).otherwise(filled)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cuts = sources.withColumn("target", target).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = cuts.select(F.col("source").alias("of"), "source_size", "target", "whole", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))

    for digits in range(2, 2 * LEVELS + 1, 2):
        inside = sized.join(cuts, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("key").startswith(F.col("prefix")))
        # rest and before are one value a source
        buckets = inside.groupBy("of", "rest", "before", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"))
        # the first bucket that ends beyond the remaining words; a window of 256 rows a source at most
        running = F.sum("words").over(Window.partitionBy("of").orderBy("bucket"))
        ended = buckets.withColumn("upto", F.col("before") + running).filter(F.col("upto") > F.col("rest"))
        first = ended.groupBy("of").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("start")), "bucket").alias("first")).withColumnRenamed("of", "found")
        cuts = stash(
            cuts.join(first, F.col("of").eqNullSafe(F.col("found")), "left").select(
                "of", "source_size", "target", "whole", "rest",
                F.coalesce("first.bucket", F.lit("~")).alias("prefix"), F.coalesce("first.start", "before").alias("before"),
            ),
            "cuts",
        )

    inside = sized.join(cuts, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("key").startswith(F.col("prefix")))
    keys = inside.groupBy("of", "before", "rest", "key", "size").agg(F.count("*").alias("rows"))
    # a bucket's keys; repeated rows are one of them
    running = F.sum(F.col("rows") * F.col("size")).over(Window.partitionBy("of").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    left = F.col("rest") - F.col("before") - running + F.col("rows") * F.col("size")
    fit = F.when(F.col("size") > 0, F.ceil(left / F.col("size") + 0.5) - 1).otherwise(F.when(left > 0, F.col("rows")).otherwise(0))
    keys = keys.withColumn("take", F.greatest(F.lit(0), F.least(fit, F.col("rows"))).cast("long")).filter(F.col("take") < F.col("rows"))
    last = keys.groupBy("of").agg(F.min(F.struct("key", "rows", "take")).alias("cut")).withColumnRenamed("of", "found")
    # none of the bucket's documents is left out: all keys behind it are greater than its prefix and this
    return stash(
        cuts.join(last, F.col("of").eqNullSafe(F.col("found")), "left").select(
            F.col("of").alias("mix_source"), "source_size", "target", "whole",
            F.when(F.col("rest") <= 0, "").otherwise(F.coalesce("cut.key", F.concat("prefix", F.lit("~")))).alias("cut_key"),
            F.when(F.col("rest") > 0, F.coalesce("cut.rows", F.lit(0))).otherwise(0).alias("cut_rows"), F.when(F.col("rest") > 0, F.coalesce("cut.take", F.lit(0))).otherwise(0).alias("cut_take"),
        ),
        "mix",
    )


def sized_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select("doc_id", "source", word_count("text").alias("size"), seeded_key("doc_id", "text", seed).alias("key"))


def with_copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (with __mix_source and __mix_key) and how many copies of each the mix takes, as __mix_copies.

    Where the cut falls among several rows of one key, which have one doc_id and text, its
    rows are counted by all their columns and as many as fit are taken once more, in the
    order of a hash of the columns.
    """
    cuts = cuts.select(*[F.col(c).alias(f"__mix_{c}") for c in cuts.columns])
    met = rows.join(cuts, F.col("__mix_source").eqNullSafe(F.col("__mix_mix_source"))).drop("__mix_mix_source")
    more = F.when(F.col("__mix_key") < F.col("__mix_cut_key"), 1).otherwise(0)
    plain = met.withColumn("__mix_copies", (F.col("__mix_whole") + more).cast("int"))
    tied = F.col("__mix_cut_take") > 0
    if cuts.filter(tied).isEmpty():
        return plain
    at_cut = tied & (F.col("__mix_key") == F.col("__mix_cut_key"))
    kinds = met.filter(at_cut).groupBy(*[F.col(f"`{c}`") for c in met.columns]).agg(F.count("*").alias("__mix_n"))
    order = Window.partitionBy("__mix_source").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("__mix_before", F.coalesce(F.sum("__mix_n").over(order), F.lit(0)))
    place = kinds.withColumn("__mix_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n"))))
    one = F.when(F.col("__mix_before") + F.col("__mix_i") <= F.col("__mix_cut_take"), 1).otherwise(0)
    return plain.filter(~at_cut).unionByName(place.withColumn("__mix_copies", (F.col("__mix_whole") + one).cast("int")).select(plain.columns))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Documents repeated as the mix takes them, with `repetition` (1, 2, ..; named
    mix_repetition where docs has such a column).

    docs needs doc_id, text and source; other columns pass through. Null texts have size 0
    and count as their source's documents; null sources are one source, ranked last. A
    null doc_id is hashed as an empty string. Rows that repeat doc_id and text are ties:
    as many of them are taken as fit. Texts of any length count whole. An empty table
    gives an empty one.
    """
    cuts = mix_cuts(stash(sized_documents(docs, seed), "sized"), weights, max_epochs)
    taken = with_copies(docs.withColumns({"__mix_source": F.col("source"), "__mix_key": seeded_key("doc_id", "text", seed)}), cuts).filter("__mix_copies > 0")
    name = "repetition" if "repetition" not in docs.columns else "mix_repetition"
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias(name))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, copies.

    Null text: size 0, taken 0. Null source: a source of its own, last in code-point order.
    Of rows that repeat doc_id and text as many are taken as fit. Empty table: no rows.
    Columns other than doc_id, text and source are not read.
    """
    sized = stash(sized_documents(table(spark, sf_dir, "documents")), "sized")
    found = with_copies(sized.withColumns({"__mix_source": F.col("source"), "__mix_key": F.col("key")}), mix_cuts(sized))
    return found.select(
        "doc_id", "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"),
        (F.col("size") * F.col("__mix_copies")).cast("long").alias("taken"), F.col("__mix_copies").cast("long").alias("copies"),
    )


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM src),
prefix AS (
  SELECT *, row_number() OVER o AS nth,
         coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
         sum(source_size) OVER () AS total
  FROM weighted WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
water AS (
  SELECT arg_min(CAST(total - clamped AS DOUBLE) / CAST(free AS DOUBLE), nth) AS level
  FROM prefix WHERE cap >= CAST(total - clamped AS DOUBLE) / CAST(free AS DOUBLE) * weight),
targets AS (
  SELECT source, source_size, CASE WHEN cap < level * weight THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target
  FROM weighted, water),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT s.doc_id, s.k, s.size, p.source, p.source_size, p.target, p.whole,
         p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY p.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2.0 AS middle
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN middle < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN middle < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM ordered
"""
