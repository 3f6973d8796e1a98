"""Vector search: exact cosine over stored unit vectors, and a deterministic hashing embedder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def vector_scores(rows: DataFrame, vector: DataFrame) -> DataFrame:
    """rows with score = 100 * cosine against vector, one row with a column q; positives only."""
    rows = rows.crossJoin(F.broadcast(vector.select("q").limit(1)))
    return rows.withColumn("score", 100 * T.dot(F.col("embedding"), F.col("q"))).drop("q").where("score > 0")


def vector_topk(rows: DataFrame, vector: DataFrame, limit: int = 10, candidates: DataFrame | None = None) -> DataFrame:
    """(id, score): the nearest rows, of candidates alone if given."""
    if candidates is not None:
        rows = rows.join(candidates.select("id"), "id", "left_semi")
    best = vector_scores(rows, vector).select("id", F.round("score", 4).alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(limit)


def embed(dims: int = 64):
    """A pandas UDF: unit vectors from hashed words and word pairs of the first 4,000 characters."""

    def vector(text: str | None) -> list[float]:
        words = (text or "")[:4000].lower().split()
        v = np.zeros(dims)
        for gram in (*words, *map(" ".join, zip(words, words[1:], strict=False))):
            h = zlib.crc32(gram.encode())
            v[h % dims] += 1 if h >> 31 else -1
        return (v / (np.linalg.norm(v) or 1)).astype(np.float32).tolist()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(vector)

    return run
