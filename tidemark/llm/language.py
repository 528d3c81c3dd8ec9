"""Language identification by Bayesian evidence fusion.

Text: byte-trigram likelihoods of each language, and of a flat model for what is no
language at all; a text is never judged by a table that it is counted in. To these come the declared markup language (how often each language's
texts declare what), the address suffix and the host, as priors smoothed hierarchically:
host towards its suffix, suffix towards the whole corpus. All counts are grouped
aggregates over the whole table, those of the trigram tables as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stash, table, texts, with_checked_size
from tidemark.llm.html_extract import extract

BUCKETS = 1 << 15
#: A text is judged by tables of the labelled texts in other folds than its own.
FOLDS = 4
#: Labels whose tables are on the workers together (512 KB each); more of them take more passes.
SHARD = 64
#: Trigrams of one text count as so many independent ones at most: their errors go together.
EFFECTIVE = 120.0
#: Pseudo-counts of the priors and of the declared-language table.
PULL, DECLARED_PULL = 20.0, 5.0
#: Prior of text in no language, and the least posterior of a kept text.
UNKNOWN, NONE_PRIOR, LEAST = "und", 0.001, 0.5

# lower-case ASCII letters, bytes of multi-byte letters; anything else is a gap
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def trigrams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams with a letter in the middle, and each text's number of them."""
    joined = np.frombuffer(b"  ".join([b"", *raw, b""]), dtype=np.uint8)
    folded = _FOLD[joined]
    doc = np.repeat(np.arange(len(raw)), [len(x) + 2 for x in raw])
    doc = np.concatenate(([0, 0], doc))[: len(folded)] if raw else np.zeros(len(folded), int)
    keep = np.flatnonzero(folded[1:-1] != 32)
    mixed = (folded[keep] * np.uint32(0x9E3779B1)) ^ (folded[keep + 1] * np.uint32(0x85EBCA77)) ^ (folded[keep + 2] * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(17)).astype(np.int64), np.bincount(doc[keep + 1], minlength=len(raw))


def fold(text_hash: Column) -> Column:
    """The part of the table that a text is in; equal texts are in the same."""
    return F.pmod(text_hash, F.lit(FOLDS)).cast("int")


def declared_labels(docs: DataFrame) -> dict[str, int]:
    """How many texts each label of the table declares; one number a label."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}


def fit(docs: DataFrame, names: list[str]) -> np.ndarray:
    """Log-likelihoods by fold, bucket and language, each from the labelled texts of all other folds.

    Every row of these languages is counted. What a language has not seen weighs as much as
    it has kinds of trigrams (Witten and Bell), spread over all buckets: less than half the
    flat model's share for each bucket however small the language, so that junk is never
    nearer to a rare label than to none. The result has FOLDS x SHARD x BUCKETS numbers at most.
    """
    if not names:
        return np.zeros((FOLDS, BUCKETS, 0), dtype=np.float32)
    place = {x: i for i, x in enumerate(names)}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                of: dict[tuple[int, str], list[bytes]] = {}
                for part, lang, raw in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts(piece, "text"), strict=True):
                    of.setdefault((part, lang), []).append(raw)
                for (part, lang), raw in of.items():
                    n = np.bincount(trigrams(raw)[0], minlength=BUCKETS)
                    bucket = np.flatnonzero(n)
                    keys = [pa.array(np.full(len(bucket), x, np.int32)) for x in (part, place[lang])]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], ["fold", "lang", "bucket", "n"])

    labelled = docs.filter(F.col("lang").isin(names) & F.col("text").isNotNull()).select(fold(F.xxhash64("text")).alias("fold"), "lang", "text")
    found = labelled.mapInArrow(tally, "fold int, lang int, bucket int, n long").groupBy("fold", "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((FOLDS, BUCKETS, len(names)))
    sums[found["fold"].to_numpy(), found["bucket"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    others = sums.sum(axis=0) - sums
    kinds = (others > 0).sum(axis=1, keepdims=True)
    total = others.sum(axis=1, keepdims=True) + kinds
    shares = np.where(total > 0, (others + kinds / BUCKETS) / np.maximum(total, 1), 0.5 / BUCKETS)
    return np.log(shares).astype(np.float32)


def text_evidence(docs: DataFrame, tables: np.ndarray, name: str) -> DataFrame:
    """docs (with text_hash and text) with the column `name`, a number for each language of the tables, and `n_trigrams`."""
    width = tables.shape[2]
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(tables.reshape(FOLDS * BUCKETS, width)))  # see fit for its bound
    others = [f for f in docs.schema if f.name != "n_trigrams"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loglik = shared.value
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                raw = texts(piece, "text")
                bucket, n = trigrams(raw)
                part = np.mod(piece.column(piece.schema.get_field_index("text_hash")).to_numpy(zero_copy_only=False), FOLDS)
                sums = np.zeros((len(raw), width))
                full = np.flatnonzero(n)
                if len(full) and width:
                    starts = np.concatenate(([0], np.cumsum(n)[:-1]))[full]
                    sums[full] = np.add.reduceat(loglik[bucket + np.repeat(part * BUCKETS, n)], starts, axis=0, dtype=np.float64)
                sums *= (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]
                evidence = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * width, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*[piece.column(piece.schema.get_field_index(f.name)) for f in others], evidence, pa.array(n)], [*[f.name for f in others], name, "n_trigrams"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + f", {name} array<double>, n_trigrams long"
    return docs.mapInArrow(score, schema)


def argmax(values: Column) -> Column:
    """Place of the greatest value; of equal ones the last place (no language), else the first."""
    top = F.array_max(values)
    return F.when(F.element_at(values, -1) == top, F.size(values) - 1).otherwise(F.array_position(values, top) - 1).cast("int")


def but_own(counts: Column, best: Column) -> Column:
    """Counts of texts by language without the row's own text, which is evidence already."""
    return F.transform(counts, lambda n, i: n - (i == best).cast("double"))


def log_shares(counts: Column, prior: Column, pull: float) -> Column:
    """Log of counts smoothed towards a distribution."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda n, p: F.ln((n + p * pull) / (total + pull)))


def identify(docs: DataFrame, suffix: Column | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, text_hash, declared, text_lang, language, posterior and kept of every row.

    docs has doc_id, text, lang (the declared language) and source (the host); `suffix` is
    the address suffix where there are addresses. A null declaration, host or suffix is
    no evidence by itself (nulls share one prior). A text without letters is in no
    language, so null and empty texts are not kept. Texts are judged by tables of other
    folds' texts, any number of labels of any size has its table. Host and declaration are counted over
    all other rows: a row's own text is not evidence twice. Ties go to no language, then to
    the first by name. Texts of any length count whole. Repeated rows give a row each, an empty table none; other columns are not read.
    """
    labels = declared_labels(docs)
    names = sorted(labels)
    size = len(names) + 1
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("lang").alias("declared"), F.col("source").alias("host"),
        (F.lit(None).cast("string") if suffix is None else suffix).alias("suffix"), "text",
    )
    shards = [names[i : i + SHARD] for i in range(0, len(names), SHARD)] or [[]]
    for i, some in enumerate(shards):
        read = text_evidence(read, fit(docs, some), f"evidence{i}")
    none_evidence = F.least(F.col("n_trigrams").cast("double"), F.lit(EFFECTIVE)) * -float(np.log(BUCKETS))
    evidence = F.concat(*[F.col(f"evidence{i}") for i in range(len(shards))], F.array(none_evidence))
    # before any host is known: labels weigh by their texts, what is in no language by NONE_PRIOR
    total = sum(labels.values()) + len(names)
    weights = [(1 - NONE_PRIOR) * (labels[x] + 1) / total for x in names] + [NONE_PRIOR]
    flat = F.array(*[F.lit(float(x)) for x in weights])
    read = read.withColumn("evidence", evidence).drop("text", *[f"evidence{i}" for i in range(len(shards))])
    likely = F.zip_with("evidence", flat, lambda e, w: e + F.ln(w))
    scored = stash(read.withColumn("text_best", F.when(F.col("n_trigrams") > 0, argmax(likely)).otherwise(F.lit(size - 1))), "evidence")

    tally = F.array(*[F.sum((F.col("text_best") == i).cast("double")) for i in range(size)])
    by_host = stash(scored.groupBy("host", "suffix").agg(tally.alias("n_host")), "hosts")
    sums = lambda column: F.array(*[F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0.0)) for i in range(size)])
    whole = by_host.agg(sums("n_host").alias("n")).select(F.transform(log_shares(F.col("n"), flat, PULL), F.exp)).first()[0]
    corpus = F.array(*[F.lit(float(x)) for x in whole])
    by_suffix = by_host.groupBy(F.col("suffix").alias("s")).agg(sums("n_host").alias("n_suffix"))
    by_suffix = by_suffix.select("s", F.transform(log_shares(F.col("n_suffix"), corpus, PULL), F.exp).alias("suffix_prior"))
    hosts = by_host.join(by_suffix, F.col("suffix").eqNullSafe(F.col("s"))).select(
        F.col("host").alias("h"), F.col("suffix").alias("hs"), "n_host", "suffix_prior"
    )
    hosts = stash(hosts, "priors")
    # P(declared | language): smoothed towards the declaration's share of the corpus
    declared = scored.filter("declared is not null").groupBy("declared").agg(tally.alias("n_declared"))
    totals = declared.agg(sums("n_declared").alias("n")).first()[0]
    per_language = F.array(*[F.lit(float(x)) for x in totals])
    everything = float(sum(totals)) or 1.0
    shared = F.aggregate("n_declared", F.lit(0.0), lambda a, x: a + x) / everything
    declared = stash(declared.select(F.col("declared").alias("d"), "n_declared", shared.alias("shared")), "declared")

    fused = scored.join(hosts, F.col("host").eqNullSafe(F.col("h")) & F.col("suffix").eqNullSafe(F.col("hs"))).join(declared, F.col("declared") == F.col("d"), "left")
    own = lambda counts: but_own(F.col(counts) if isinstance(counts, str) else counts, F.col("text_best"))
    fused = fused.withColumn("log_prior", log_shares(own("n_host"), F.col("suffix_prior"), PULL))
    fused = fused.withColumn("log_declared", F.zip_with(own("n_declared"), own(per_language), lambda n, t: F.ln((n + F.col("shared") * DECLARED_PULL) / (t + DECLARED_PULL))))
    none = F.array(*[F.lit(0.0)] * size)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = fused.withColumn("fused", add(add("evidence", "log_prior"), F.coalesce("log_declared", none))).withColumn("top", F.array_max("fused"))
    weight = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    name = lambda i: F.get(F.array(*[F.lit(x) for x in [*names, UNKNOWN]]), i)
    best = F.when(F.col("n_trigrams") > 0, argmax(F.col("fused"))).otherwise(F.lit(size - 1))
    out = fused.select("doc_id", "text_hash", "declared", name(F.col("text_best")).alias("text_lang"), name(best).alias("language"), F.round(1 / weight, 6).alias("posterior"))
    return out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("posterior") >= least))


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Language, posterior and verdict of every row of `documents`: doc_id, declared, text_lang, language, posterior, kept."""
    return identify(table(spark, sf_dir, "documents")).drop("text_hash")


def page_languages(spark, sf_dir: str) -> DataFrame:
    """The same for `pages`, with the address suffix as evidence: page_id, declared, text_lang, language, posterior, kept."""
    return identify_pages(table(spark, sf_dir, "pages")).withColumnRenamed("doc_id", "page_id").drop("text_hash")


def identified_documents(docs: DataFrame) -> DataFrame:
    """docs without the texts that are in no language or too uncertain, all columns kept."""
    found = identify(docs).filter("not kept").select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("declared").alias("__declared")).distinct()
    found = with_checked_size(stash(found, "rejected"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__hash")) & F.col("lang").eqNullSafe(F.col("__declared"))
    return docs.join(found, same, "left_anti")


def identify_pages(pages: DataFrame) -> DataFrame:
    """page_id (as doc_id), text_hash, declared, text_lang, language, posterior and kept of every row of pages.

    The text is the page's main text, the declaration its html element's lang without
    region, host and suffix are the address's; a null url or html has none of them.
    """
    host = F.nullif(F.lower(F.regexp_extract("url", r"//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*\slang\s*=\s*["']?([a-z]+)""", 1)), F.lit(""))
    read = pages.select(F.col("page_id").alias("doc_id"), "url", "html", F.struct(declared.alias("declared"), host.alias("host")).alias("m"))
    rows = extract(read.select(F.to_json(F.struct("doc_id", "m")).alias("key"), "url", "html"), key="key")
    of = F.from_json("key", "doc_id long, m struct<declared:string,host:string>")
    docs = stash(rows.select(of["doc_id"].alias("doc_id"), "text", of["m"]["declared"].alias("lang"), of["m"]["host"].alias("source")), "page_texts")
    return identify(docs, suffix=F.element_at(F.split("source", r"\."), -1))
