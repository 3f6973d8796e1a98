"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky 2012).

Vectors are cut in two halves, each quantised by its own codebook; a pair of
centroids is a cell. A query walks the cells in the order of their summed
nearness with a heap (the multi-sequence walk) until they hold as many entries as
the table calls for; every entry met is ranked by its exact inner product in
double precision.

The codebooks are fitted on SAMPLE vectors at most, in hash order, and have a
number of centroids that grows with the root of the entries, MOST_CENTROIDS at
most; every vector is indexed. How much of the table a query visits is measured,
not set: ASKED vectors of the sample search the rest of it by brute force, and the
share of entries that the walk must pass to meet a neighbour is taken at the
quantile MET, so at the same recall clustered vectors need a small share and
vectors without any clusters some half. There is no other switch by size.

Cells of one first centroid are searched in one place; a centroid with more than
BLOCK entries, such as that of many equal vectors, is dealt over several places by
vec_id, and queries visit them all. Walks are dealt over tasks by query.

Edge cases: rows without vec_id and vectors that are null, empty, zero or hold
null or non-finite components take no part; of rows with equal vec_id the least
vector counts; vectors of other lengths have no inner product, so each length is
an index of its own and its queries find vectors of their length; equal scores go
by vec_id; fewer candidates than asked for are all returned, and a vector that is
alone finds none; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, n_partitions, small_batches, tidied

SAMPLE, BLOCK = 16_384, 4_096
#: Entries of a cell if all were equally full, and centroids of a half at least and at most.
PER_CELL, LEAST_CENTROIDS, MOST_CENTROIDS = 16, 8, 512
#: Queries that measure the walk, and the share of their neighbours that it must meet.
ASKED, MET = 256, 0.96
FAR = float("inf")


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(FAR)))).where(F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def codebook(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's algorithm, from k distinct vectors."""
    c = np.unique(v, axis=0)
    c = c[np.random.default_rng(5).permutation(len(c))[:k]]
    for _ in range(rounds):
        own = nearest(v, c)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, v[:, d], len(c)) for d in range(v.shape[1])], 1) if v.shape[1] else np.zeros((len(c), 0))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(v @ c.T - (c * c).sum(1) / 2, 1)


def walk(first: np.ndarray, second: np.ndarray, count: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells (i, j) by falling first[i] + second[j], until they hold enough entries."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    up, vp, n = (-first[a]).tolist(), (-second[b]).tolist(), count[np.ix_(a, b)].tolist()
    heap, out, held = [(up[0] + vp[0], 0, 0)], [], 0
    while heap and held < enough:
        _, x, y = heapq.heappop(heap)
        if n[x][y]:
            out.append((int(a[x]), int(b[y])))
            held += n[x][y]
        # a cell enters after its left neighbour, those of the first column after the one above, so each enters once
        if y + 1 < len(vp):
            heapq.heappush(heap, (up[x] + vp[y + 1], x, y + 1))
        if y == 0 and x + 1 < len(up):
            heapq.heappush(heap, (up[x + 1] + vp[0], x + 1, 0))
    return out


def measured(fit: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> float:
    """The share of entries that a walk passes before it meets a neighbour, at the quantile MET of the sample's own queries."""
    half = left.shape[1]
    ask = fit[:ASKED]
    near = ask @ fit.T
    near[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    k = min(k, len(fit) - 1)
    if k < 1:
        return 1.0
    best = np.argpartition(-near, k - 1, 1)[:, :k]
    i, j = nearest(fit[:, :half], left), nearest(fit[:, half:], right)
    # an entry stands behind all entries whose cell has a larger sum
    s = np.sort((ask[:, :half] @ left.T)[:, i] + (ask[:, half:] @ right.T)[:, j], 1)
    own = (ask[:, :half] @ left.T)[np.arange(len(ask))[:, None], i[best]] + (ask[:, half:] @ right.T)[np.arange(len(ask))[:, None], j[best]]
    behind = np.stack([len(fit) - np.searchsorted(a, x - 1e-12 * np.abs(x), "left") for a, x in zip(s, own, strict=True)])
    return float(np.quantile(behind / len(fit), MET))


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


ROWS = "block string, kind int, id long, cells binary, v binary"
FOUND = "query_id long, rank int, vec_id long, score double"


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest entries that each query meets; both tables have vec_id and embedding."""
    spark = embeddings.sparkSession
    sizes = [r[0] for r in embeddings.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()]
    found = [search_length(*(x.where(F.size("embedding") == n) for x in (embeddings, queries)), n, k) for n in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)


def search_length(embeddings: DataFrame, queries: DataFrame, size: int, k: int) -> DataFrame:
    """search() among vectors of one length."""
    spark = embeddings.sparkSession
    small_batches(spark, 2048)
    total = embeddings.count()
    sample = embeddings.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    fit = np.array(list(sample["embedding"]), np.float64).reshape(len(sample), size)
    half = max(1, size // 2)
    centroids = int(np.clip(round((total / PER_CELL) ** 0.5), LEAST_CENTROIDS, MOST_CENTROIDS))
    left, right = codebook(fit[:, :half], centroids), codebook(fit[:, half:], centroids if size > 1 else 1)
    share = measured(fit, left, right, k)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("embedding"))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(nearest(v[:, :half], left), pa.int32()), pa.array(nearest(v[:, half:], right), pa.int32()), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "i", "j", "v"])

    indexed = embeddings.select("vec_id", "embedding").mapInArrow(tidied(cells), "vec_id long, i int, j int, v binary")
    count = np.zeros((len(left), len(right)), np.int64)
    for r in indexed.groupBy("i", "j").count().collect():  # MOST_CENTROIDS squared rows at most
        count[r.i, r.j] = r["count"]
    places = np.maximum(1, -(-count.sum(1) // BLOCK))
    enough = max(k + 1, int(np.ceil(share * total)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("id", pa.int64()), ("cells", pa.binary()), ("v", pa.binary())])
        for b in batches:
            out = []
            for q, v in zip(b.column("vec_id").to_pylist(), matrix(b.column("embedding")) if b.num_rows else (), strict=True):
                met: dict[int, np.ndarray] = {}
                for i, j in walk(left @ v[:half], right @ v[half:], count, enough):
                    met.setdefault(i, np.zeros(len(right), np.bool_))[j] = True
                for i, js in met.items():
                    body = np.packbits(js).tobytes()
                    out += [(f"{i}-{s}", 1, q, body, v.tobytes()) for s in range(int(places[i]))]
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, js, vs, entries = None, [], [], [], None
        for b in batches:
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            for name, kind, i, cell, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != block:
                    block, ids, js, vs, entries = name, [], [], [], None
                if kind == 0:
                    ids.append(i)
                    js.append(cell)
                    vs.append(v)
                    continue
                if not ids:
                    continue
                if entries is None:
                    entries = np.array(ids), np.frombuffer(b"".join(js), np.uint16), np.frombuffer(b"".join(vs)).reshape(len(ids), size)
                own, at, e = entries
                sel = np.flatnonzero((np.unpackbits(np.frombuffer(cell, np.uint8))[at] > 0) & (own != i))
                q = np.frombuffer(v)
                score = e[sel] @ q
                if len(sel) > k:  # what may be among the best, whatever the order of summation
                    floor = np.partition(score, len(sel) - k)[len(sel) - k]
                    sel = sel[score >= floor - 1e-12 * np.abs(q).sum() * np.abs(e).max()]
                score = (e[sel] * q).sum(1)  # summed alike for every entry, so that equal vectors tie
                best = np.lexsort((own[sel], -score))[:k]
                out["query_id"] += [i] * len(best)
                out["vec_id"] += own[sel][best].tolist()
                out["score"] += score[best].tolist()
            yield pa.RecordBatch.from_pydict(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    n = n_partitions(spark)
    salt = F.pmod(F.col("vec_id"), F.element_at(F.array(*map(F.lit, places.tolist())), F.col("i") + 1))
    low = F.unhex(F.lpad(F.hex(F.col("j") % 256), 2, "0"))
    entries = indexed.select(F.concat_ws("-", "i", salt).alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.concat(low, F.unhex(F.lpad(F.hex(F.floor(F.col("j") / 256)), 2, "0"))).alias("cells"), "v")
    walks = queries.select("vec_id", "embedding").repartition(n, "vec_id").mapInArrow(tidied(asked), ROWS)
    rows = entries.unionByName(walks)
    rows = rows.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(tidied(ranked), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found for every vec_id divisible by 20."""
    rows = checkpointed(usable(embeddings))
    return search(rows, rows.where("vec_id % 20 = 0"))
