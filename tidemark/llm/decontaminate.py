"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A fixed mask is laid over every position of a token sequence; the tokens under its ones
are hashed, those under its zeros are ignored, so a hit survives substitutions there.
Seeds of the benchmark and of the documents are joined; each hit names a diagonal (place
in the document less place in the item), and along every such diagonal the tokens are
compared one by one: an item leaks where a window of it agrees in nearly all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash, table, with_checked_size

#: Ones come in pairs, so that the hash of two neighbours is made once for all masks.
MASKS = ("110110011", "1100011011")
#: Tokens compared together, and how many of them must agree. Shorter items: all but one in seven.
WINDOW, AGREE = 13, 11
#: Tokens along a diagonal that are compared at least. An item shorter than this must be in the document whole.
LEAST_TOKENS = 10
#: Items of fewer tokens are everyday phrases, which say nothing of a leak, and are not looked for.
LEAST_ITEM = 5
#: Seeds of a benchmark that is broadcast; a larger one is joined by shuffle.
BROADCAST_SEEDS = 200_000
#: Tokens of a piece of a document in which diagonals look up their tokens.
BLOCK = 64


def tokens(text: str) -> Column:
    """Lower-cased runs of letters and digits; null and empty texts have none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def pair_offsets(mask: str) -> list[int]:
    """Places of the mask's pairs of ones."""
    out, at = [], 0
    while at < len(mask):
        if mask[at] == "1":
            here = at if mask[at : at + 2] == "11" else at - 1  # the last one of an odd run: a pair with the one before
            if here < 0 or mask[here] != "1":
                raise ValueError(f"ones must come in pairs: {mask}")
            out.append(here)
            at += 1
        at += 1
    return out


def short_masks(items: DataFrame, masks: tuple[str, ...]) -> tuple[str, ...]:
    """Masks of ones alone for the lengths of items that no spaced mask fits in."""
    size = F.size("item_tokens")
    lengths = items.filter(size < min(map(len, masks))).select(size.alias("n")).distinct().collect()  # fewer than a mask has places
    return tuple("1" * n for n in sorted(r["n"] for r in lengths))


def with_seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Rows of df exploded to (pos, seed) for every mask and position; df has `tokens`."""
    hashed = df.withColumn("hashes", F.transform("tokens", lambda t: F.xxhash64(t))).drop("tokens")
    paired = hashed.withColumn("pairs", F.zip_with("hashes", F.slice("hashes", F.lit(2), F.greatest(F.size("hashes"), F.lit(1))), lambda a, b: F.xxhash64(a, b))).drop("hashes")

    def laid(k: int, mask: str) -> Column:
        last = F.size("pairs") - F.lit(len(mask))  # the pairs of n tokens are n, the last of them with null
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.lit(k), *[F.get("pairs", i + o) for o in pair_offsets(mask)]))

    seeded = paired.withColumn("by_mask", F.array(*[laid(k, m) for k, m in enumerate(masks)])).drop("pairs")
    others = [c for c in df.columns if c != "tokens"]
    # the outer forms: for the others Catalyst adds a filter on the array's size and pushes it down,
    # with all that makes the array, to where each place would read the whole text again
    each = seeded.select(*others, F.explode_outer("by_mask").alias("seeds"))
    return each.select(*others, F.posexplode_outer("seeds").alias("pos", "seed")).filter("seed is not null")


def token_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, block, block_tokens): the texts' tokens in pieces of BLOCK, once for rows of equal id and text."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens("text").alias("tokens")).filter(F.size("tokens") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / BLOCK).cast("int"))
    each = cut.select("doc_id", "text_hash", F.posexplode(F.transform(starts, lambda b: F.slice("tokens", b * BLOCK + 1, BLOCK))).alias("block", "block_tokens"))
    return each.groupBy("doc_id", "text_hash", "block").agg(F.first("block_tokens").alias("block_tokens"))


def compared_diagonals(docs: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """hits (doc_id, text_hash, item_id, item, diagonal) with `item_size` and `same`: 1 or 0 for each pair of tokens where item and document overlap.

    A diagonal meets only the pieces of the document that the item would cover, so its rows
    are bounded by the item, however long and repetitive the document is.
    """
    met = hits.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    texts = docs.join(met, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__hash")), "left_semi")
    sized = hits.join(items.select(F.col("item").alias("of"), F.size("item_tokens").alias("item_size")).distinct(), F.col("item") == F.col("of")).drop("of")
    first = F.floor(F.greatest(F.col("diagonal"), F.lit(0)) / BLOCK).cast("int")
    last = F.floor((F.col("diagonal") + F.col("item_size") - 1) / BLOCK).cast("int")
    wanted = sized.withColumn("at", F.explode(F.sequence(first, F.greatest(first, last))))
    pieces = token_blocks(texts).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "block", "block_tokens")
    found = wanted.join(pieces, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash")) & (F.col("at") == F.col("block")))
    found = found.join(items.select(F.col("item").alias("of"), "item_tokens").dropDuplicates(["of"]), F.col("item") == F.col("of"))
    start = F.col("block") * BLOCK
    begin = F.greatest(start, F.col("diagonal"))
    length = F.greatest(F.lit(0), F.least(start + F.size("block_tokens"), F.col("diagonal") + F.col("item_size")) - begin)
    same = F.zip_with(
        F.slice("item_tokens", begin - F.col("diagonal") + 1, length), F.slice("block_tokens", begin - start + 1, length), lambda x, y: (x == y).cast("int")
    )
    keys = ["doc_id", "text_hash", "item_id", "item", "diagonal", "item_size"]
    whole = found.select(*keys, "block", same.alias("same")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "same"))).alias("parts"))
    return whole.select(*keys, F.flatten(F.transform("parts", lambda p: p["same"])).alias("same"))


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: int = AGREE) -> DataFrame:
    """(doc_id, text_hash, item_id, n_agree, best_window) of each document and benchmark item that it leaks.

    docs has doc_id and text, benchmark item_id and text. A null doc_id or item_id is kept
    as such, repeated rows of a document give one row an item. Null, empty and very short
    texts leak nothing. Items of LEAST_ITEM to 9 tokens leak where all but one in seven of
    them are there in place. Texts of any length are looked through whole, in work that grows
    with their tokens times the item's. Empty tables give no rows.
    """
    items = stash(
        benchmark.select("item_id", tokens("text").alias("item_tokens")).filter(F.size("item_tokens") >= LEAST_ITEM).distinct(), "items"
    )
    masks = masks + short_masks(items, masks)
    seeds = with_seeds(items.withColumnRenamed("item_tokens", "tokens").withColumn("item", F.xxhash64("item_id", "tokens")), masks)
    seeds = stash(seeds.select("seed", F.col("pos").alias("item_pos"), "item_id", "item").distinct(), "seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens("text").alias("tokens"))
    hits = with_seeds(read, masks).join(seeds, "seed")
    hits = hits.select("doc_id", "text_hash", "item_id", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    keyed_items = items.withColumn("item", F.xxhash64("item_id", "item_tokens"))
    # stashed: a filter on it must not compute it again for each window
    compared = stash(compared_diagonals(docs, stash(hits, "hits"), keyed_items), "compared")
    span = F.least(F.lit(window), F.size("same"))
    windows = F.transform(F.sequence(F.lit(1), F.size("same") - span + 1), lambda i: F.aggregate(F.slice("same", i, span), F.lit(0), lambda a, x: a + x))
    need = F.when(span >= window, F.lit(agree)).otherwise(F.ceil(span * 6 / 7))
    compared = compared.filter(F.size("same") >= F.least(F.lit(LEAST_TOKENS), F.col("item_size"))).withColumn("best", F.array_max(windows)).filter(F.col("best") >= need)
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    return compared.groupBy("doc_id", "text_hash", "item_id").agg(F.max(total).cast("long").alias("n_agree"), F.max("best").cast("long").alias("best_window"))


def op8_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it leaks: doc_id, item_id, n_agree, best_window."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_agree").alias("n_agree"), F.max("best_window").alias("best_window"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak a benchmark item, all columns kept."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("__leak_doc"), F.col("text_hash").alias("__leak_hash")).distinct()
    found = with_checked_size(stash(found, "leaking"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__leak_doc")) & (F.xxhash64("text") == F.col("__leak_hash")), "left_anti")
