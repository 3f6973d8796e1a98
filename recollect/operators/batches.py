"""Arrow batches of bounded size for Python steps over texts.

What a Python worker holds must not grow with a partition: Spark hands over batches of
few rows and bytes, a step works through pieces of them, and gives memory back when
its task ends, as workers are kept for later tasks.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows and bytes of a batch, bytes of text that are worked through at once.
ROWS, BYTES, PIECE = 1024, 4 << 20, 512 << 10
CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BYTES)}


@contextmanager
def small(spark: SparkSession) -> Iterator[None]:
    """For the jobs that run inside, small Arrow batches; the session's settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have size bytes together at most; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, that gives its memory back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
