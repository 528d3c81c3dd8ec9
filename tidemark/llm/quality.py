"""Quality rules by repetition coverage.

Words of a slice of documents become 64-bit hashes in one array; n-grams of several
lengths are rolling hashes over that array, keyed by document so that only repeats inside
one text count. The characters under n-grams that occur twice or more, and those of lines
that repeat an earlier line, are set against the text's characters in words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mixed, repeated, rolled, slices, table, texts

#: Longest share of characters in duplicated n-grams, by n.
NGRAM_LIMITS = {5: 0.30, 7: 0.25, 10: 0.20}
#: Longest share of characters in lines that repeat an earlier one.
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"
_CONTINUES = np.array([0x80 <= b < 0xC0 for b in range(256)])
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_share double, " + ", ".join(f"dup{n}_share double" for n in NGRAM_LIMITS)


def covered(grams: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the words that some masked n-gram covers."""
    edges = np.zeros(size + 1, dtype=np.int64)
    at = np.flatnonzero(grams)
    np.add.at(edges, at, 1)
    np.subtract.at(edges, at + n, 1)
    return np.cumsum(edges[:-1]) > 0


def repeat_profile(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Per-document measures of one slice of texts."""
    raw = texts(batch, "text")
    split = [x.split() for x in raw]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    doc = np.repeat(np.arange(len(raw)), counts)
    total, docs = int(counts.sum()), len(raw)
    words = mixed(np.fromiter((hash(w) for x in split for w in x), dtype=np.int64, count=total).view(np.uint64))
    length = np.fromiter((len(w) for x in split for w in x), dtype=np.int64, count=total)
    for i, text in enumerate(raw):  # code points, where they are not bytes
        if not text.isascii():
            a = int(counts[:i].sum())
            length[a : a + counts[i]] = [len(w) - int(_CONTINUES[np.frombuffer(w, np.uint8)].sum()) if not w.isascii() else len(w) for w in split[i]]
    chars = np.bincount(doc, weights=length, minlength=docs).astype(np.int64)
    seen = {"n_words": counts, "word_chars": chars, "n_symbols": np.array([int(_SYMBOL[np.frombuffer(x, np.uint8)].sum()) for x in raw], dtype=np.int64)}
    salt = mixed(doc.astype(np.uint64) + np.uint64(1))

    def coverage(n: int) -> np.ndarray:
        grams = rolled(words, n)
        whole = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
        mask = np.zeros(len(grams), dtype=bool)
        mask[whole] = repeated(grams[whole] ^ salt[: len(grams)][whole])
        return covered(mask, n, total)

    seen["n_repeat_words"] = np.bincount(doc[coverage(3)], minlength=docs).astype(np.int64)
    share = np.maximum(chars, 1).astype(float)
    for n in NGRAM_LIMITS:
        under = coverage(n)
        seen[f"dup{n}_share"] = np.bincount(doc[under], weights=length[under], minlength=docs) / share
    again, again_chars = np.zeros(docs, dtype=np.int64), np.zeros(docs)
    for i, text in enumerate(raw):
        lines = [x for x in text.split(b"\n") if x.strip()]
        if len(lines) != len(set(lines)):
            known: set[bytes] = set()
            for line in lines:
                if line in known:
                    again[i] += 1
                    again_chars[i] += sum(len(w.decode()) for w in line.split())
                known.add(line)
    return seen | {"n_dup_lines": again, "line_share": again_chars / share}


def repetition_coverage(docs: DataFrame) -> DataFrame:
    """doc_id with the repetition measures of each text (null text: no words).

    Every row gives a row, repeated rows too; an empty text has all measures 0. Columns
    other than doc_id and text are not read. Memory follows a slice of 4 MB or the
    longest text.
    """
    fields = [x.split() for x in SCHEMA.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                seen = repeat_profile(piece)
                columns = [piece.column(0), *[pa.array(seen[name], pa.int64() if kind == "long" else pa.float64()) for name, kind in fields[1:]]]
                yield pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, SCHEMA)


def op5_repetition(spark, sf_dir: str) -> DataFrame:
    """Repetition rules over `documents`; a kept text passes the base rules and all coverage limits.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged
    each by itself; an empty table gives no rows.
    """
    seen = repetition_coverage(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passes = F.col("line_share") <= LINE_LIMIT
    for n, most in NGRAM_LIMITS.items():
        passes &= F.col(f"dup{n}_share") <= most
    return seen.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes)
