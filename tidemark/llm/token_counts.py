"""Token counts of whole texts by a public tokenizer, by overlap resynchronisation.

A text longer than a chunk is encoded in chunks that overlap. Two neighbouring encodings
are spliced in their overlap at a boundary that both have: a token that ends just before
white space in either, after other white space in the overlap. No pre-token of the
vocabulary's pattern crosses white space, so from such a boundary on both encodings are
the encoding of the rest, whatever precedes. Where an overlap holds no such boundary it is
widened, at last to the text's end. Chunks of many texts are encoded together; of each
text only the last chunk's token ends are held.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of a chunk, and of the overlap that it first has with the next.
CHUNK, OVERLAP = 1 << 11, 1 << 7
#: Chunks that are encoded together.
TOGETHER = 256
SCHEMA = "doc_id long, n_bytes long, n_tokens long"
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Splice:
    """State of a text whose chunks come in order."""

    __slots__ = ("text", "ends", "stop", "after", "tokens", "lost")

    def __init__(self, text: str) -> None:
        self.text, self.ends, self.stop, self.after, self.tokens, self.lost = text, None, 0, -1, 0, False


class Counter:
    """Counts tokens as the library gives them, without added special tokens, truncation or padding."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.spliced, self.widened = 0, 0  # characters of spliced texts, and how often an overlap was widened

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        states = [Splice(x) for x in texts]
        held: list[tuple[Splice, int]] = []
        for state in states:
            for start in range(0, max(len(state.text) - self.overlap, 1), self.chunk - self.overlap):
                held.append((state, start))
                if len(held) == TOGETHER:
                    self.encode(held)
                    held = []
        self.encode(held)
        return [self.resynchronised(x.text) if x.lost else x.tokens + len(x.ends) - int(np.searchsorted(x.ends, x.after, "right")) for x in states]

    def encode(self, held: list[tuple[Splice, int]]) -> None:
        """Encode chunks and splice each to the one before."""
        found = self.tokenizer.encode_batch([state.text[a : a + self.chunk] for state, a in held], add_special_tokens=False)
        for (state, start), got in zip(held, found, strict=True):
            if len(state.text) <= self.chunk:
                state.ends = np.arange(len(got))
                continue
            ends = np.fromiter((b for _, b in got.offsets), dtype=np.int64, count=len(got)) + start
            if start and not state.lost:
                at = self.boundary(state.text, state.ends, ends, max(start, state.after), state.stop)
                if at is None:
                    state.lost = True
                else:
                    state.tokens += int(np.searchsorted(state.ends, at, "right") - np.searchsorted(state.ends, state.after, "right"))
                    state.after = at
            if not start:
                self.spliced += len(state.text)
            state.ends, state.stop = ends, min(start + self.chunk, len(state.text))

    def boundary(self, text: str, left: np.ndarray, right: np.ndarray, begin: int, stop: int) -> int | None:
        """The last place in the overlap where a token ends before white space in both encodings."""
        first = _SPACE.search(text, begin, stop)
        if first is None:
            return None
        mine = left[np.searchsorted(left, first.start(), "right") : np.searchsorted(left, stop, "left")]
        theirs = right[np.searchsorted(right, first.start(), "right") : np.searchsorted(right, stop, "left")]
        shared = set(mine.tolist()) & set(theirs.tolist())
        for at in sorted(shared, reverse=True):
            if _SPACE.match(text, at):
                return at
        return None

    def ends_of(self, text: str, start: int, stop: int) -> np.ndarray:
        """Ends, in the whole text, of the tokens of a chunk."""
        return np.array([start + b for _, b in self.tokenizer.encode(text[start:stop], add_special_tokens=False).offsets], dtype=np.int64)

    def resynchronised(self, text: str) -> int:
        """Tokens of a text of which some overlap held no boundary: chunk by chunk, widening where none agrees."""
        size, tokens, after = len(text), 0, -1
        stop = min(self.chunk, size)
        left = self.ends_of(text, 0, stop)
        while stop < size:
            overlap = min(self.overlap, self.chunk // 2)
            while True:
                begin = max(stop - overlap, after, 0)
                end = min(begin + max(self.chunk, 2 * overlap), size)
                right = self.ends_of(text, begin, end)
                at = self.boundary(text, left, right, begin, stop)
                if at is not None or begin <= max(after, 0):
                    break
                self.widened += 1
                overlap *= 2
            if at is None:  # nothing stable in all of this chunk: the chunk itself gets longer
                self.widened += 1
                stop = min(2 * end - max(after, 0), size)
                left = self.ends_of(text, max(after, 0), stop)
                continue
            tokens += int(np.searchsorted(left, at, "right") - np.searchsorted(left, after, "right"))
            left, after, stop = right, at, end
        return tokens + len(left) - int(np.searchsorted(left, after, "right"))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each whole text; null is empty.

    Repeated rows give a row each, an empty table none. Columns other than doc_id and
    text are not read. Memory follows a slice of 4 MB or the longest text, not its tokens.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for piece in slices(batch, "text"):
                raw = pc.fill_null(piece.column(1).cast(pa.string()), "")
                size = pc.cast(pc.binary_length(raw), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), size, pa.array(counter.count(raw.to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, SCHEMA)


def op10_tokens(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token counts of every whole text of `documents` and whether they are above the limit."""
    counted = token_counts(table(spark, sf_dir, "documents"), path or public_path(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
