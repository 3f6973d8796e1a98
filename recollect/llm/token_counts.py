"""Token counts by offset-mapped attribution.

A whole document is encoded once; the tokens' byte lengths give their character
spans, and an interval join of spans and sections counts each section's tokens.
Sections are lines, each with the line feed that ends it.

The rule for a token that crosses a boundary: it belongs to the section that
holds most of its characters, to the first of them if several hold as many. A
character whose bytes are split over tokens belongs to the span of each.

Edge cases: null and empty texts have one section without characters or tokens;
repeated rows are counted each; an empty table gives no rows; other columns
don't matter; very long texts are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, tidied


class Encoder:
    """A rank file of the tiktoken library, opened when it is first used on a machine."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.encoding = path, pattern, None

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "encoding": None}

    def opened(self) -> Encoder:
        if self.encoding is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            for piece, i in ranks.items():
                self.size[i] = len(piece)
        return self

    def count(self, text: str) -> int:
        """The number of ids of text."""
        return len(self.opened().encoding.encode_ordinary(text))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of text and the bytes that each stands for."""
        ids = np.array(self.opened().encoding.encode_ordinary(text), np.int64)
        return ids, self.size[ids]


def spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, from the tokens' bytes."""
    end = np.cumsum(sizes)
    begin = end - sizes
    if len(text) == (end[-1] if len(end) else 0):
        return begin, end
    starts = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(starts)])
    return upto[begin + 1] - 1, upto[end]


def sections(text: str) -> np.ndarray:
    """Where lines end, the last at the end of the text."""
    at = np.flatnonzero(np.array([c == "\n" for c in text])) + 1 if len(text) < 64 else np.array([i + 1 for i in lines(text)], np.int64)
    return at if len(at) and at[-1] == len(text) else np.append(at, len(text)).astype(np.int64)


def lines(text: str) -> Iterator[int]:
    at = text.find("\n")
    while at >= 0:
        yield at
        at = text.find("\n", at + 1)


def attribute(begin: np.ndarray, end: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens of each section; ends: where sections end."""
    first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end - 1, "right")
    for t in np.flatnonzero(first != last):
        edge = np.concatenate([[begin[t]], ends[first[t] : last[t]], [end[t]]])
        first[t] += int(np.argmax(np.diff(edge)))
    return np.bincount(np.minimum(first, len(ends) - 1), minlength=len(ends))


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens): a row for each section of each document."""
    import public_tokenizers

    small_batches(documents.sparkSession)
    encoder = Encoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            null = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                text = text or ""
                ends = sections(text)
                n = len(ends)
                counts = attribute(*spans(text, encoder(text)[1]), ends)
                null.append(np.full(n, doc is None))
                for c, x in zip(out, (np.full(n, doc or 0, np.int64), np.arange(n), np.concatenate([[0], ends[:-1]]), ends, counts), strict=True):
                    c.append(x)
            if null:
                cols = [np.concatenate(c).astype(np.int64) for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], mask=np.concatenate(null)), *map(pa.array, cols[1:])], names=["doc_id", "section", "char_start", "char_end", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, section long, char_start long, char_end long, n_tokens long")


def op2_token_counts(documents: DataFrame) -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens for every line of every document."""
    return token_counts(documents)
