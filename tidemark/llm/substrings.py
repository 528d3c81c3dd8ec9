"""Substring dedup: words in windows of `window` words that start more than once are removed.

Every window has an anchor, the least-hashed gram inside it, so all occurrences of a
window's words agree on it. A run of windows with one anchor is a segment. Segments that
occur twice as a whole are repeated throughout. What remains are edges: unique segments
whose anchor occurs elsewhere. They are routed by anchor to reference shards; a shard is
the distinct segments of one anchor, and a suffix automaton of them with occurrence
counts gives, for each position, the longest suffix that occurs twice (the matching
statistic); where it reaches the window length, the window is repeated.

Automata are routed, not broadcast: the reference is the corpus itself, and sending all of
it to all documents would grow with its square. An anchor with more than HOT distinct
segments gets no automaton; its windows are counted by hash with partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, mixed, rolled, slices, stash, table, texts

WINDOW, GRAM = 35, 8
#: Distinct segments of an anchor that one automaton holds, about 100,000 words.
HOT = 2000
#: Bytes of segments' words that become Python objects together. Spark's batches have up to 64 MB, whose windows took gigabytes.
PIECE = 2 << 20

_INVERSE = pow(int(BASE), -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(BASE), _INVERSE)):
            steps = np.full(2 * n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)


def segments(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first window, last window) of each run of windows with one anchor."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams = rolled(words, gram)
    bits = np.uint64(max(24, int(len(grams)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least, width, span = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1, window - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :])
    at = (least & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    power, inverse = powers(len(words) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * power[: len(words)])))
    content = (sums[last + window] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)
    return grams[at[first]], mixed(content), first, last


class SuffixAutomaton:
    """Suffix automaton of several sequences, with weighted counts of occurrences."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], weight: int) -> None:
        step, link, length, count = self.step, self.link, self.length, self.count
        last = 0
        for x in sequence:
            known = step[last].get(x)
            if known is not None and length[known] == length[last] + 1:
                last = known
            else:
                if known is None:
                    new = len(step)
                    step.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    count.append(0)
                    p = last
                    while p >= 0 and x not in step[p]:
                        step[p][x] = new
                        p = link[p]
                    if p >= 0:
                        q = step[p][x]
                        link[new] = q if length[q] == length[p] + 1 else self._split(p, q, x)
                    last = new
                else:
                    last = self._split(last, known, x)
            count[last] += weight

    def _split(self, p: int, q: int, x: int) -> int:
        step, link, length = self.step, self.link, self.length
        clone = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = clone
        while p >= 0 and step[p].get(x) == q:
            step[p][x] = clone
            p = link[p]
        return clone

    def finish(self) -> None:
        """Carry counts up the links and note each state's longest suffix that occurs twice."""
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for v in reversed(order):
            self.count[self.link[v]] += self.count[v]
        self.twice = [0] * len(self.step)
        for v in order:
            self.twice[v] = self.length[v] if self.count[v] >= 2 else self.twice[self.link[v]]

    def statistics(self, sequence: list[int]) -> list[int]:
        """At each position of a sequence that was added: the longest suffix that occurs twice."""
        v, out = 0, []
        for x in sequence:
            v = self.step[v][x]
            out.append(self.twice[v])
        return out


_FOUND = "doc_id long, text_hash long, n_words long, kept_sha256 string, segments array<struct<a:long,s:long,first:int,last:int>>"
_PART = "a:long,s:long,first:int,n:long,kinds:long,words:binary"
_CUT = f"doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string, kept string, text string, spans array<struct<first:int,last:int>>, parts array<struct<{_PART}>>"
_PART_ARROW = pa.struct([("a", pa.int64()), ("s", pa.int64()), ("first", pa.int32()), ("n", pa.int64()), ("kinds", pa.int64()), ("words", pa.binary())])
_SPAN_ARROW = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def find_segments(docs: DataFrame, window: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                counts, digests, columns, sizes = [], [], [[], [], [], []], [0]
                for raw in texts(piece, "text"):
                    words = raw.split()
                    counts.append(len(words))
                    digests.append(sha(words))
                    found = segments(word_hashes(words), window) if len(words) >= window else None
                    if found:
                        for column, values in zip(columns, found, strict=True):
                            column.append(values)
                    sizes.append(sizes[-1] + (len(found[0]) if found else 0))
                flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
                structs = pa.StructArray.from_arrays(
                    [pa.array(flat[0].view(np.int64)), pa.array(flat[1].view(np.int64)), pa.array(flat[2].astype(np.int32)), pa.array(flat[3].astype(np.int32))], ["a", "s", "first", "last"]
                )
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(counts, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)],
                    ["doc_id", "text_hash", "n_words", "kept_sha256", "segments"],
                )

    return docs.mapInArrow(measure, _FOUND)


def covering(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Mask of the words under inclusive spans."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for a, b in spans:
        edges[a] += 1
        edges[b + 1] -= 1
    return np.cumsum(edges[:-1]) > 0


def cut_repeats(docs: DataFrame, window: int) -> DataFrame:
    """docs with `flagged` segments: the final result where no edges are open, else the edges' words."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                out = []
                for doc_id, text_hash, raw, flagged in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts(piece, "text"), piece.column(3).to_pylist(), strict=True):
                    words = raw.split()
                    spans = [(x["first"], x["last"] + window - 1) for x in flagged if x["n"] > 1]
                    send = [x for x in flagged if x["send"]]
                    open_edges = any(x["n"] == 1 for x in flagged)
                    hashes = word_hashes(words) if send else None
                    parts = [{"a": x["a"], "s": x["s"], "first": x["first"], "n": x["n"], "kinds": x["kinds"], "words": hashes[x["first"] : x["last"] + window].tobytes()} for x in send]
                    gone = covering(len(words), spans)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if not open_edges else None
                    out.append((doc_id, text_hash, len(words), int(gone.sum()), sha(kept) if kept is not None else None, b" ".join(kept) if kept is not None else None, raw if open_edges else None, [{"first": a, "last": b} for a, b in spans] if open_edges else [], parts))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(_SPAN_ARROW), pa.list_(_PART_ARROW)]
                columns = [pa.array(c, pa.binary()).cast(k) if k == pa.string() and i != 4 else pa.array(c, k) for i, (c, k) in enumerate(zip(zip(*out, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _CUT.split(", ")])

    return docs.mapInArrow(measure, _CUT)


def shard_windows(parts: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, start) of the repeated windows of edges, by one automaton an anchor."""
    schema = "doc_id long, text_hash long, start int"
    routed = parts.repartition("a").sortWithinPartitions("a", "s")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchor = [], None
        for batch in batches:
            for piece in slices(batch, "words", PIECE):
                names = piece.schema.names
                for row in zip(*[piece.column(names.index(c)).to_pylist() for c in ("a", "n", "first", "doc_id", "text_hash", "words")], strict=True):
                    if row[0] != anchor:
                        yield from pairs(matched(held, window))
                        held, anchor = [], row[0]
                    held.append(row)
        yield from pairs(matched(held, window))

    def pairs(found: list[tuple[int | None, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """An anchor's windows: as many as its shard has words at most."""
        if found:
            sizes = [len(starts) for _, _, starts in found]
            ids = pa.array([x for x, _, _ in found], pa.int64()).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
            hashes = np.repeat(np.array([h for _, h, _ in found], dtype=np.int64), sizes)
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes), pa.array(np.concatenate([x for _, _, x in found]).astype(np.int32))], ["doc_id", "text_hash", "start"])

    return routed.mapInArrow(match, schema)


def matched(rows: list[tuple], window: int) -> list[tuple[int | None, int, np.ndarray]]:
    """doc_id, text_hash and the repeated windows of each edge of an anchor that has some."""
    if len(rows) < 2:
        return []
    automaton = SuffixAutomaton()
    sequences = [np.frombuffer(r[5], dtype=np.uint64).tolist() for r in rows]
    for row, sequence in zip(rows, sequences, strict=True):
        automaton.add(sequence, row[1])
    automaton.finish()
    out = []
    for (_, n, first, doc_id, text_hash, _), sequence in zip(rows, sequences, strict=True):
        if n == 1:
            at = np.flatnonzero(np.array(automaton.statistics(sequence)) >= window)
            if len(at):
                out.append((doc_id, text_hash, first + at - window + 1))
    return out


def hot_windows(parts: DataFrame, window: int) -> DataFrame:
    """The same for anchors with many segments: windows counted by hash."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, "words", PIECE)):
            names = batch.schema.names
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for a, n, first, doc_id, text_hash, words in zip(*[batch.column(names.index(c)).to_pylist() for c in ("a", "n", "first", "doc_id", "text_hash", "words")], strict=True):
                grams = rolled(np.frombuffer(words, dtype=np.uint64), window)
                k = len(grams)
                for column, values in zip(columns, (grams.view(np.int64), np.full(k, a), np.full(k, n), np.arange(first, first + k), np.full(k, doc_id if doc_id is not None else 0), np.full(k, text_hash)), strict=True):
                    column.append(values)
                columns[4][-1] = pa.array(columns[4][-1], pa.int64()) if doc_id is not None else pa.nulls(k, pa.int64())
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for i, c in enumerate(columns) if i != 4]
            ids = pa.concat_arrays(columns[4]) if columns[4] else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1]), pa.array(flat[2]), pa.array(flat[3].astype(np.int32)), ids, pa.array(flat[4])], ["g", "a", "n", "start", "doc_id", "text_hash"])

    windows = stash(parts.mapInArrow(spread, "g long, a long, n long, start int, doc_id long, text_hash long"), "hot_windows")
    twice = windows.groupBy(F.col("g").alias("g2"), F.col("a").alias("a2")).agg(F.sum("n").alias("total")).filter("total > 1")
    return windows.filter("n = 1").join(twice, (F.col("g") == F.col("g2")) & (F.col("a") == F.col("a2"))).select("doc_id", "text_hash", "start")


def finish_edges(docs: DataFrame, window: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                out = []
                for doc_id, text_hash, raw, spans, starts in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts(piece, "text"), piece.column(3).to_pylist(), piece.column(4).to_pylist(), strict=True):
                    words = raw.split()
                    gone = covering(len(words), [(x["first"], x["last"]) for x in spans] + [(x, x + window - 1) for x in starts or []])
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    out.append((doc_id, text_hash, len(words), int(gone.sum()), sha(kept), b" ".join(kept).decode()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "text_hash", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.mapInArrow(measure, "doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, kept_sha256 and kept (the words that stay) of every row.

    `kept` is null where nothing is removed: the text stays as it is. Null and empty texts
    have no words. Repeated rows repeat each other's windows, so all lose them; a null
    doc_id is a value like any other. An empty table gives no rows; columns other than
    doc_id and text are not read.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = stash(find_segments(read, window), "segments")
    rows = found.select("doc_id", "text_hash", F.inline("segments"))
    same = rows.groupBy("a", "s").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "first")).alias("least"))
    anchors = same.groupBy(F.col("a").alias("a2")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1")
    known = same.join(anchors, F.col("a") == F.col("a2")).select(F.col("a").alias("ka"), F.col("s").alias("ks"), "n", "least", "kinds")
    known = stash(known, "known")
    flagged = rows.join(known, (F.col("a") == F.col("ka")) & (F.col("s") == F.col("ks")))
    # edges are sent, and of repeated segments one occurrence, where their anchor has others
    send = (F.col("kinds") > 1) & ((F.col("n") == 1) | F.struct("doc_id", "text_hash", "first").eqNullSafe(F.col("least")))
    flagged = flagged.select("doc_id", "text_hash", F.struct("a", "s", "first", "last", "n", "kinds", send.alias("send")).alias("x"))
    flagged = flagged.groupBy("doc_id", "text_hash").agg(F.collect_set("x").alias("flagged"))  # a set: repeated rows of a document give the same segments
    flagged = flagged.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "flagged")
    flagged = stash(flagged, "flagged")
    mine = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    cut = stash(cut_repeats(read.join(flagged, mine).select("doc_id", "text_hash", "text", "flagged"), window), "cut")

    parts = cut.select("doc_id", "text_hash", F.inline("parts"))
    starts = shard_windows(parts.filter(F.col("kinds") <= hot), window).unionByName(hot_windows(parts.filter(F.col("kinds") > hot), window))
    starts = starts.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set("start").alias("starts"))
    edged = cut.filter("text is not null").select("doc_id", "text_hash", "text", "spans").join(starts, mine, "left")
    finished = finish_edges(edged.select("doc_id", "text_hash", "text", "spans", "starts"), window)

    columns = ["doc_id", "text_hash", "n_words", "n_removed", "kept_sha256", "kept"]
    whole = found.join(flagged.select("d", "h"), mine, "left_anti").select("doc_id", "text_hash", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return whole.unionByName(cut.filter("text is null").select(columns)).unionByName(finished)


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    """Words that repeated windows of 35 words cover in every text of `documents`: doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def documents_without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from their texts, n_chars renewed where there is one; texts left empty go.

    A text that loses nothing keeps its white space, any other has its words joined by spaces.
    """
    done = dedup_substrings(docs).filter("n_removed > 0")
    done = done.select(*[F.col(c).alias(f"__cut_{c}") for c in done.columns]).dropDuplicates(["__cut_doc_id", "__cut_text_hash"])
    done = stash(done, "trimmed")
    met = docs.join(done, F.col("doc_id").eqNullSafe(F.col("__cut_doc_id")) & (F.xxhash64("text") == F.col("__cut_text_hash")), "left")
    met = met.filter("__cut_n_removed is null or __cut_n_removed < __cut_n_words")
    fresh = {"text": F.coalesce("__cut_kept", "text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("__cut_kept").isNull(), F.col("n_chars")).otherwise(F.length("__cut_kept")).cast("long")
    return met.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
