"""Cutting sessions into overlapping chunks of text."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

CHUNK, OVERLAP, SLACK = 4_800, 800, 1_200
#: Chunks' worth of characters that are held before chunks leave.
HELD = 64
ROLES = ("user", "assistant", "tool_result", "actions")
#: Fixed format: what stands before a chunk's text.
HEADER = lambda r: (("Title", r.title), ("Source", r.source_name), ("Source ref", r.source_ref), ("CWD", r.cwd), ("Updated", r.updated_at))
SCHEMA = "source_ref string, chunk_index int, event_start int, event_end int, char_start long, char_end long, text string, metadata string"


def flat(text: str, limit: int) -> str:
    text = " ".join(text.split())
    return text if len(text) <= limit else text[: limit - 3].rstrip() + "..."


def pack(blocks: list[tuple[int, str]], size: int, overlap: int, strict: bool = False) -> list[tuple[list[tuple[int, str]], int, int]]:
    """Blocks (event, text) to chunks (blocks, char_start, char_end), each as many blocks as size characters hold.

    A chunk begins with the blocks that end the one before, as many as overlap
    holds, one at least; strict leaves that out where the next block would not fit
    beside it. A block over size is cut by itself, its pieces overlapping, and
    nothing is carried across it. Chunks of white space alone are left out.

    Both ends of a chunk are found in the running sum of the blocks' lengths.
    """
    ends = list(accumulate(len(text) for _, text in blocks))
    return [chunk for s in spans(ends, size, overlap, strict) for chunk in written(blocks, ends, s, size, overlap)]


def spans(ends: list[int], size: int, overlap: int, strict: bool, carried: int = 0) -> Iterator[tuple[int, int, int]]:
    """(first, new, end) of each chunk: its blocks are first to end, those before new are carried; a block over size is a span of its own. The first chunk begins with carried ones."""
    starts = [0, *ends[:-1]]
    wide = [i for i in range(len(ends)) if ends[i] - starts[i] > size]
    for low, high in zip([0, *(i + 1 for i in wide)], [*wide, len(ends)], strict=True):
        first, new = low, low + (carried if low == 0 else 0)
        while new < high:
            end = max(new + 1, bisect_right(ends, starts[first] + size, new, high))
            yield first, new, end
            first = min(bisect_left(starts, ends[end - 1] - overlap, first, end), end - 1) if overlap > 0 else end
            new = end
            if strict and new < high and ends[new] - starts[first] > size:
                first = new
        if high < len(ends):
            yield high, high, high + 1


def written(blocks: list[tuple[int, str]], ends: list[int], span: tuple[int, int, int], size: int, overlap: int) -> Iterator[tuple[list[tuple[int, str]], int, int]]:
    """The chunk of a span, or the pieces of a block over size; none of white space alone."""
    first, _, end = span
    start = ends[first - 1] if first else 0
    event, text = blocks[first]
    if end - first > 1 or len(text) <= size:
        found = [(blocks[first:end], start, ends[end - 1])]
    else:
        step = max(size - overlap, 1)
        cuts = range(0, -(-(len(text) - size) // step) * step + 1, step)
        found = [([(event, text[c : c + size])], start + c, start + min(c + size, len(text))) for c in cuts]
    yield from (chunk for chunk in found if any(t.strip() for _, t in chunk[0]))


class Packer:
    """pack() for blocks that come one by one: chunks leave once what follows can't change them, so only a few chunks' blocks are held."""

    def __init__(self, size: int, overlap: int, strict: bool):
        self.how, self.size, self.overlap = (size, overlap, strict), size, overlap
        self.blocks: list[tuple[int, str]] = []
        self.held = self.at = self.carried = 0

    def add(self, event: int, text: str) -> Iterator[tuple[list[tuple[int, str]], int, int]]:
        self.blocks.append((event, text))
        self.held += len(text)
        if self.held > HELD * self.size:
            yield from self.done(False)

    def done(self, last: bool = True) -> Iterator[tuple[list[tuple[int, str]], int, int]]:
        """The chunks of what is held, without the one that may go on unless it is the last."""
        ends = list(accumulate(len(text) for _, text in self.blocks))
        found = list(spans(ends, *self.how, self.carried))
        keep, self.carried = len(self.blocks), 0
        if found and not last and (found[-1][2] - found[-1][0] > 1 or len(self.blocks[-1][1]) <= self.size):
            keep, new, _ = found.pop()
            self.carried = new - keep
        for s in found:
            yield from ((own, a + self.at, z + self.at) for own, a, z in written(self.blocks, ends, s, self.size, self.overlap))
        self.at += ends[keep - 1] if keep else 0
        self.blocks = self.blocks[keep:]
        self.held = sum(len(text) for _, text in self.blocks)


def chunk_sessions(sessions: DataFrame, events: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, strict: bool = False) -> DataFrame:
    """The chunks of every session: sessions (source_ref, source_name, title, cwd, updated_at), events (source_ref, event_index, role, ts, text).

    A session is packed in order, so one task reads it, but its events stream by;
    sessions spread over the cluster.
    """
    size, overlap = max(size, SLACK), min(max(overlap, 0), max(size, SLACK) // 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, packer, no = None, Packer(size, overlap, strict), 0

        def rows(chunks: Iterator) -> list[tuple]:
            nonlocal no
            out = []
            for own, a, z in chunks:
                text = "".join(f"{name}: {value}\n" for name, value in HEADER(head)) + "\n".join(b for _, b in own).strip()
                meta = {"event_start": own[0][0], "event_end": own[-1][0], "chunk_index": no}
                out.append((head.source_ref, no, own[0][0], own[-1][0], a, z, flat(text, size + SLACK), json.dumps(meta)))
                no += 1
            return out

        for pdf in batches:
            out = []
            for e in pdf.itertuples():
                if head is None or e.source_ref != head.source_ref:
                    out += rows(packer.done()) if head is not None else []
                    head, packer, no = e, Packer(size, overlap, strict), 0
                if e.role.lower() in ROLES:
                    out += rows(packer.add(int(e.event_index), f"{e.role.upper()}{f' [{e.ts}]' if e.ts else ''}\n{e.text}\n"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        if head is not None:
            yield pd.DataFrame(rows(packer.done()), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = events.select("source_ref", "event_index", "role", "ts", "text").join(sessions.select("source_ref", "source_name", "title", "cwd", "updated_at"), "source_ref")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.fillna("", ["role", "ts", "text", "title", "cwd", "updated_at"]).repartition(n, "source_ref").sortWithinPartitions("source_ref", "event_index")
    return ordered.mapInPandas(run, SCHEMA)
