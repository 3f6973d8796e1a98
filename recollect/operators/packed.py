"""Vectors in a byte a number: a first pass over the codes, an exact one over what the codes can't rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PACKED = "id long, size int, codes binary, scale double, error double"


def packed(rows: DataFrame) -> DataFrame:
    """(id, size, codes, scale, error) of rows (id, embedding): each number as one of 255 steps of scale, and the length of what that leaves out.

    Null and empty vectors, and those with null or non-finite numbers, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, x in zip(b.column("id").to_pylist(), b.column("embedding"), strict=True):
                if not x.is_valid or not len(x.values) or x.values.null_count:
                    continue
                v = x.values.to_numpy().astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                scale = float(np.abs(v).max()) / 127 or 1.0
                codes = np.rint(v / scale).astype(np.int8)
                rest = v - codes * scale
                for column, value in zip(out, (i, len(v), codes.tobytes(), scale, float(np.sqrt((rest * rest).sum()))), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64()), strict=True)], names=["id", "size", "codes", "scale", "error"])

    return rows.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(run, PACKED)


def bounds(codes: DataFrame, vector: list[float], k: int) -> DataFrame:
    """(id, low, high) between which the dot product of each packed row with vector lies; a task leaves out what can't be among its own k best."""
    q = np.array(vector, np.float64)
    length = float(np.sqrt(q @ q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.array([])
        for b in batches:
            if not b.num_rows:
                continue
            m = np.frombuffer(b"".join(x.as_buffer() for x in b.column("codes")), np.int8).reshape(b.num_rows, len(q))
            dot = (m @ q) * b.column("scale").to_numpy()
            slack = length * b.column("error").to_numpy() * (1 + 1e-9) + 1e-12 * (1 + np.abs(dot))  # the codes' error, and that of adding up
            low, high = dot - slack, dot + slack
            best = np.sort(np.concatenate([best, low]))[-k:]
            keep = high >= best[0] if len(best) == k else np.ones(len(low), bool)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(keep)), pa.array(low[keep]), pa.array(high[keep])], names=["id", "low", "high"])

    return codes.where(F.col("size") == len(q)).select("id", "codes", "scale", "error").mapInArrow(run, "id long, low double, high double")


def topk(codes: DataFrame, rows: DataFrame, vector: list[float], k: int = 10) -> DataFrame:
    """(id, score): the k rows of the largest dot product with vector, as if every row had been computed exactly; rows (id, embedding) are read for those alone that the codes leave."""
    near = bounds(codes, vector, k)
    floor = near.orderBy(F.desc("low")).limit(k).agg(F.when(F.count("*") == k, F.min("low")).alias("floor"))
    left = near.crossJoin(F.broadcast(floor)).where("floor is null or high >= floor")  # one row
    exact = T.dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector)))
    return rows.join(left.select("id"), "id", "left_semi").select("id", exact.alias("score")).orderBy(F.desc("score"), "id").limit(k)
