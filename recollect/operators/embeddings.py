"""Embeddings learnt from the archive itself, and their backfill.

Words that stand near each other often get vectors that are near: co-occurrence counts
within WINDOW words become positive pointwise mutual information, and its leading
eigenvectors, found by a randomised range finder with power iterations, become word
vectors. The counts stay in Spark, spread by word; what comes to the driver is one row
of DIMS + EXTRA numbers for each word of the vocabulary, whose size is a bound. A text's
vector is the average of its words' vectors, rare words weighing more, at length 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .batches import pieces, small, tidied
from .buckets import Buckets

#: Words of the vocabulary at most, and the texts that a word needs.
VOCABULARY, LEAST_TEXTS = 20_000, 3
WINDOW, DIMS, EXTRA, POWERS = 5, 64, 16, 2
#: Bytes of text whose pairs are counted at once, in some fifty times as many bytes.
PAIRED = 2 << 20
#: Frequency at which a word weighs half in a text's average.
RARE = 1e-3


class Model(NamedTuple):
    """Words, their vectors, and what each weighs in a text."""

    words: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray


def paired(texts: list[str | None], known: dict[str, int]) -> pa.RecordBatch:
    """(a, b, n) of some texts."""
    size, codes = max(1, len(known)), [np.zeros(0, np.int64)]
    for text in texts:
        at = np.array([known[w] for w in T.words_of(text or "") if w in known], np.int64)
        for d in range(1, WINDOW + 1):
            codes += [at[:-d] * size + at[d:], at[d:] * size + at[:-d]] if len(at) > d else []
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array((code // size).astype(np.int32)), pa.array((code % size).astype(np.int32)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])


def counted(rows: DataFrame, words: dict[str, int]) -> DataFrame:
    """(a, b, n): how often words a and b stand within WINDOW words of each other, both ways; only words of the vocabulary count, in distance too."""
    held = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, "text", PAIRED):
                yield paired(piece.column("text").to_pylist(), held.value)

    # what a piece has counted meets by pairs of words
    return rows.select("text").mapInArrow(tidied(run), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def product(matrix: DataFrame, right: np.ndarray) -> np.ndarray:
    """matrix (a, b, w), whose rows of one a lie together, times right: a row a word comes back."""
    held = matrix.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, w = (batch.column(c).to_numpy() for c in ("a", "b", "w"))
            order = np.argsort(a, kind="stable")
            first = np.flatnonzero(np.diff(a[order], prepend=-1))
            part = np.add.reduceat(w[order][:, None] * held.value[b[order]], first, 0) if len(a) else []
            for k, v in zip(a[order][first].tolist(), part, strict=True):
                out[k] = out[k] + v if k in out else v
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary())], names=["a", "v"])

    result = np.zeros((len(right), right.shape[1]))
    for r in matrix.mapInArrow(run, "a int, v binary").collect():  # a row a word; all partitions at once
        result[r.a] += np.frombuffer(bytes(r.v))
    return result


def fit(rows: DataFrame, dims: int = DIMS, vocabulary: int = VOCABULARY, seed: int = 3) -> Model:
    """The model of rows (text); with fewer words than dims, vectors are shorter."""
    each = rows.select(F.explode(T.words(F.col("text"))).alias("word"), F.monotonically_increasing_id().alias("no"))
    common = each.groupBy("word").agg(F.count("*").alias("n"), F.approx_count_distinct("no").alias("texts")).where(F.col("texts") >= LEAST_TEXTS)
    found = common.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    words = {r.word: i for i, r in enumerate(found)}
    total = max(1, sum(r.n for r in found))
    weights = np.array([RARE / (RARE + r.n / total) for r in found])
    if not words:
        return Model({}, np.zeros((0, dims)), weights)
    spark = rows.sparkSession
    pairs = counted(rows, words)
    with small(spark):
        sums = {r.a: r.n for r in pairs.groupBy("a").agg(F.sum("n").alias("n")).collect()}  # a row a word
    margin = np.array([float(sums.get(i, 1)) for i in range(len(words))])
    smooth = margin**0.75 / (margin**0.75).sum()
    margins = spark.createDataFrame([(i, float(m), float(s)) for i, (m, s) in enumerate(zip(margin, smooth, strict=True))], "i int, m double, s double")
    left, right = (F.broadcast(margins.select(F.col("i").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("m", "s")))) for c in ("a", "b"))  # a row a word
    # symmetric: each word is smoothed where it stands as context
    pmi = F.log(F.col("n") / F.sqrt(F.col("m_a") * F.col("m_b") * F.col("s_a") * F.col("s_b")))
    matrix = pairs.join(left, "a").join(right, "b").select("a", "b", pmi.alias("w")).where("w > 0").repartition("a")
    with small(spark):  # what persist() plans counts in small batches
        matrix = matrix.persist()
    try:
        g = np.random.default_rng(seed)
        q = np.linalg.qr(product(matrix, g.normal(size=(len(words), min(len(words), dims + EXTRA)))))[0]
        for _ in range(POWERS):
            q = np.linalg.qr(product(matrix, q))[0]
        values, turn = np.linalg.eigh(q.T @ product(matrix, q))
    finally:
        matrix.unpersist()
    best = np.argsort(-values)[:dims]
    return Model(words, (q @ turn[:, best]) * np.sqrt(np.maximum(values[best], 0)), weights)


def embedded(rows: DataFrame, model: Model, text: str = "text", to: str = "embedding") -> DataFrame:
    """rows with the vector of their texts; texts without a word of the model have a vector of zeros, null texts too."""
    held = rows.sparkSession.sparkContext.broadcast(tuple(model))  # plain values, as a broadcast's class would have to be installed

    @F.pandas_udf("array<float>")
    def vectors(texts):
        words, table, weights = held.value

        def one(t: str | None) -> list[float]:
            at = [words[w] for w in T.words_of(t or "") if w in words]
            v = weights[at] @ table[at] if at else np.zeros(table.shape[1])
            return (v / (np.linalg.norm(v) or 1)).astype(np.float32).tolist()

        return texts.map(one)

    return rows.withColumn(to, vectors(F.col(text)))


VECTORS = "id long, content long, updated_at string, embedding array<float>"


def backfill(store: Buckets, rows: DataFrame, model: Model, most: int = 512) -> tuple[Buckets, int]:
    """The store of VECTORS (key: id) with those of the newest rows (id, updated_at, text) that have none yet or another text, most of them at a time; and how many rows are left.

    A run that is stopped has written all its rows or none, so the next one goes on
    where the last whole one ended.
    """
    now = rows.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("content"), F.col("updated_at").cast("string").alias("updated_at"), "text")
    todo = now.join(store.read().select("id", "content"), ["id", "content"], "left_anti")
    left = todo.count()
    if not left:
        return store, 0
    lot = todo.orderBy(F.desc("updated_at"), "id").limit(most)
    return store.merge(embedded(lot, model).select("id", "content", "updated_at", "embedding")), max(0, left - most)
