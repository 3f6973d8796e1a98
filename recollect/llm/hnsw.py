"""Near duplicates among embeddings by hierarchical navigable small-world graphs (Malkov and Yashunin 2016).

Vectors of one label (and of one length) are compared, those of different labels never
are. Equal vectors of a label become one node with a count. The nodes of a label are
dealt over shards of some SHARD_BYTES, at most SHARD nodes on average, and each shard
gets a graph of its own. Every two shards of a label meet in one task, as does every
shard with itself: each one's nodes are searched in the other's graph, and what either
side finds is a link of both. What leaves the task is a row a node: how many vectors it
is linked with there, and the least node that its links lead to; so a group of many
near copies makes no rows for its pairs. The components of those rows are the result.

Beams widen until an audit passes. An audit asks for AUDIT points that lie just within
the least cosine of nodes of the shard, the hardest to find, and compares what the beam
finds with all nodes of the shard; under RECALL the beam doubles. A query whose beam
has filled up with links for a half is asked again with one four times as wide. A beam
wider than 1/WHOLE of the shard costs more than comparing with all of its nodes, and is
replaced by that. All
links are verified in double precision; nodes that no path reaches are compared always.

Graphs are built in batches: a batch searches the graph of those before it and is
compared with itself, then takes its place with links both ways.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components,
and vectors without label, are linked with nothing; vectors of different lengths have
no cosine and are not linked; of rows with equal vec_id the least usable one counts;
rows without vec_id are each returned, linked with nothing, component null, kept; ties
and equal vectors are linked like others; an empty table gives no rows; other columns
are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .components import components

#: Links of a node above ground and on it, and the beam of building.
M, GROUND, BUILD = 12, 24, 48
#: Nodes and bytes of vectors in a shard; nodes that join a graph at once; the first beam.
SHARD, SHARD_BYTES, JOINING, BEAM = 8_192, 32 << 20, 256, 32
#: Beams of more than a shard's nodes by this are replaced by all of them.
WHOLE = 32
#: Points of an audit, and the share of their links that a beam must find.
AUDIT, RECALL = 256, 0.99
#: Queries that walk together.
TOGETHER = 512
FAR = float("inf")


def chosen(ids: np.ndarray, near: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows of at most most of the candidates ids (-1: none), nearest first: those nearer to the point than to any one taken before, then the nearest of the rest."""
    order = np.argsort(-near, 1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    v = vectors[ids]
    between = np.einsum("qid,qjd->qij", v, v)
    taken = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        close = (taken[:, :j] & (between[:, :j, j] > near[:, j, None])).any(1)
        taken[:, j] = (ids[:, j] >= 0) & ~close & (taken[:, :j].sum(1) < most)
    order = np.argsort(np.where(taken, 0, np.where(ids >= 0, 1, 2)), 1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """A small-world graph over unit vectors (float32): links[0] is the ground, entry the node that walks begin with."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.links, self.entry = vectors, links, entry

    def down(self, asked: np.ndarray, floor: int = 0) -> np.ndarray:
        """The nodes that greedy walks from the top reach above the layer floor."""
        at = np.full(len(asked), self.entry)
        near = asked @ self.vectors[self.entry]
        for layer in range(len(self.links) - 1, floor, -1):
            moving = np.arange(len(asked))
            while len(moving):
                ids = self.links[layer][at[moving]]
                s = np.where(ids >= 0, np.einsum("qmd,qd->qm", self.vectors[ids], asked[moving]), -FAR)
                best = s.argmax(1)
                s = s[np.arange(len(moving)), best]
                on = s > near[moving]
                at[moving[on]], near[moving[on]] = ids[on, best[on]], s[on]
                moving = moving[on]
        return at

    def search(self, asked: np.ndarray, beam: int, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the beam of each query, nearest first, -1 where it isn't full; known: only so many nodes are in the graph yet."""
        q, n = len(asked), len(self.vectors) if known is None else known
        seen = np.zeros((q, n + 1), bool)  # the last column takes the links that aren't there
        ids, near, done = np.full((q, beam), -1), np.full((q, beam), -FAR, np.float32), np.ones((q, beam), bool)
        start = self.down(asked)
        ids[:, 0], near[:, 0], done[:, 0] = start, np.einsum("qd,qd->q", self.vectors[start], asked), False
        seen[np.arange(q), start] = True
        live = np.arange(q)
        while len(live):
            open_ = np.where(done[live], -FAR, near[live])
            at = open_.argmax(1)
            on = open_[np.arange(len(live)), at] > -FAR
            live, at = live[on], at[on]
            if not len(live):
                break
            done[live, at] = True
            to = self.links[0][ids[live, at]]
            fresh = (to >= 0) & ~seen[live[:, None], to]
            seen[live[:, None], to] = True
            s = np.where(fresh, np.einsum("qmd,qd->qm", self.vectors[to], asked[live]), -FAR)
            some = s.max(1) > near[live, -1]
            if some.any():
                row, to, s, fresh = live[some], to[some], s[some], fresh[some]
                all_ids, all_near = np.concatenate([ids[row], np.where(fresh, to, -1)], 1), np.concatenate([near[row], s], 1)
                all_done = np.concatenate([done[row], ~fresh], 1)
                order = np.argsort(-all_near, 1, kind="stable")[:, :beam]
                ids[row], near[row], done[row] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_near, all_done))
        return ids, near

    @staticmethod
    def built(vectors: np.ndarray) -> Graph:
        """The graph of vectors, which join in their order."""
        n = len(vectors)
        g = np.random.default_rng(11)
        level = np.minimum((-np.log(1 - g.random(n)) / np.log(M)).astype(int), 8)
        level[0] = level.max(initial=0)
        graph = Graph(vectors, [np.full((n, GROUND if k == 0 else M), -1) for k in range(int(level.max(initial=0)) + 1)], 0)
        begin = 0
        while begin < n:
            end = min(n, begin + max(16, min(JOINING, begin)))
            own = np.arange(begin, end)
            among = vectors[own] @ vectors[own].T
            np.fill_diagonal(among, -FAR)
            for layer, links in enumerate(graph.links):
                who = np.flatnonzero(level[own] >= layer)
                if not len(who):
                    break
                mates = np.where((level[own] >= layer)[None, :], among[who], -FAR)
                if layer == 0 and begin:
                    ids, near = graph.search(vectors[own[who]], BUILD, begin)
                else:  # layers above ground hold few nodes
                    there = np.flatnonzero(level[:begin] >= layer)
                    s = vectors[own[who]] @ vectors[there].T
                    top = np.argsort(-s, 1, kind="stable")[:, :BUILD]
                    ids, near = there[top].reshape(len(who), -1), np.take_along_axis(s, top, 1)
                top = np.argsort(-mates, 1, kind="stable")[:, :GROUND]
                s = np.take_along_axis(mates, top, 1)
                ids, near = np.concatenate([ids, np.where(s > -FAR, own[top], -1)], 1), np.concatenate([near, s], 1)
                links[own[who]] = chosen(ids, near, vectors, links.shape[1])
                graph.back(links, own[who])
            begin = end
        return graph

    def back(self, links: np.ndarray, own: np.ndarray) -> None:
        """Links from the nodes that own have chosen back to own."""
        to, source = links[own].ravel(), np.repeat(own, links.shape[1])
        keep = to >= 0
        to, source = to[keep], source[keep]
        keep = ~(links[to] == source[:, None]).any(1)
        order = np.argsort(to[keep], kind="stable")
        to, source = to[keep][order], source[keep][order]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        for some in np.array_split(np.arange(len(node)), max(1, len(node) // TOGETHER)):
            if len(some):
                wide = int(count[some].max())
                at = first[some][:, None] + np.arange(wide)
                new = np.where(np.arange(wide) < count[some][:, None], source[np.minimum(at, len(source) - 1)], -1)
                ids = np.concatenate([links[node[some]], new], 1)
                near = np.where(ids >= 0, np.einsum("qid,qd->qi", self.vectors[ids], self.vectors[node[some]]), -FAR)
                if ids.shape[1] > 4 * links.shape[1]:  # a node that very many have chosen: of its nearest
                    top = np.argsort(-near, 1, kind="stable")[:, : 4 * links.shape[1]]
                    ids, near = np.take_along_axis(ids, top, 1), np.take_along_axis(near, top, 1)
                links[node[some]] = chosen(ids, near, self.vectors, links.shape[1])

    def unreached(self) -> np.ndarray:
        """Nodes that no path on the ground leads to from the nodes above it."""
        seen = np.zeros(len(self.vectors) + 1, bool)
        front = np.array([self.entry])
        for links in self.links[1:]:
            front = np.union1d(front, np.flatnonzero((links >= 0).any(1)))
        while len(front):
            seen[front] = True
            front = np.unique(self.links[0][front])
            front = front[(front >= 0) & ~seen[front]]
        return np.flatnonzero(~seen[:-1])


def audit(graph: Graph, least: float) -> int:
    """The beam that passes: the number of nodes if none up to 1/WHOLE of them does."""
    v, n = graph.vectors, len(graph.vectors)
    g = np.random.default_rng(7)
    own = v[g.permutation(n)[:AUDIT]]
    aside = g.standard_normal(own.shape).astype(np.float32)
    aside -= np.einsum("qd,qd->q", aside, own)[:, None] * own
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    inside = min(1.0, least + 1e-3)
    points = np.where(size > 1e-6, inside * own + (1 - inside**2) ** 0.5 * aside / np.maximum(size, 1e-6), own).astype(np.float32)
    truth = points @ v.T >= least
    loose = graph.unreached()
    beam = BEAM
    while beam <= n // WHOLE:
        ids, near = graph.search(points, beam)
        hit = np.zeros_like(truth)
        row, at = np.nonzero((ids >= 0) & (near >= least))
        hit[row, ids[row, at]] = True
        hit[:, loose] = truth[:, loose]
        filled = (near >= least).sum(1) * 2 > beam  # asked again with wider beams
        if (hit & truth)[~filled].sum() >= RECALL * truth[~filled].sum():
            return beam
        beam *= 2
    return n


def links(graph: Graph, beam: int, exact: np.ndarray, asked: np.ndarray, least: float) -> np.ndarray:
    """A matrix (queries, nodes) of the links that are found: exact and asked are unit vectors in double precision."""
    n = len(exact)
    out = np.zeros((len(asked), n), bool)
    loose = graph.unreached()
    rows, wide = np.arange(len(asked)), beam
    while len(rows):
        again = []
        for some in np.array_split(rows, -(-len(rows) // TOGETHER)):
            if wide > n // WHOLE:
                out[some] = asked[some] @ exact.T >= least
                continue
            ids, near = graph.search(asked[some].astype(np.float32), wide)
            row, at = np.nonzero((ids >= 0) & (near >= least - 1e-4))
            out[some[row], ids[row, at]] = np.einsum("id,id->i", asked[some[row]], exact[ids[row, at]]) >= least
            if len(loose):
                out[np.ix_(some, loose)] = asked[some] @ exact[loose].T >= least
            again.append(some[2 * (near >= least - 1e-4).sum(1) > wide])
        rows, wide = np.concatenate(again) if again else rows[:0], 4 * wide
    return out


def least_of(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number that links lead to, of each row and each column of a matrix of links: rows are numbered first, columns after them."""
    a, b = np.nonzero(link)
    b = b + len(link)
    name = np.arange(sum(link.shape))
    while True:
        new = name.copy()
        np.minimum.at(new, a, name[b])
        np.minimum.at(new, b, name[a])
        new = np.minimum(new, new[new])
        if (new == name).all():
            return name[: len(link)], name[len(link) :]
        name = new


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long byte strings of doubles as rows."""
    column = column.combine_chunks()
    return np.frombuffer(b"".join(x.as_buffer() for x in column)).reshape(len(column), -1)


NODES = "grp string, size int, shards int, shard int, node long, copies long, v binary, layers binary"
FOUND = "node long, root long, linked long"


def built(rows: pa.Table) -> pa.Table:
    """The rows of one shard with each node's links, layer by layer, and the audited beam in the first place."""
    order = np.argsort(rows["deal"].to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    v = stacked(rows["v"])
    graph = Graph.built(v.astype(np.float32))
    beam = audit(graph, float(rows["least"][0].as_py()))
    packed = np.concatenate([np.full((len(v), 1), beam), np.full((len(v), 1), len(graph.links)), *graph.links], 1).astype(np.int32)
    out = rows.select(["grp", "size", "shards", "shard", "node", "copies", "v"])
    return out.append_column("layers", pa.array([x.tobytes() for x in packed], pa.binary())).cast(pa.schema([("grp", pa.string()), ("size", pa.int32()), ("shards", pa.int32()), ("shard", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("v", pa.binary()), ("layers", pa.binary())]))


def loaded(rows: pa.Table) -> tuple[Graph, int, np.ndarray]:
    """The graph of a shard's rows, in the order in which they were built, its beam and its vectors."""
    v = stacked(rows["v"])
    packed = np.frombuffer(b"".join(x.as_buffer() for x in rows["layers"].combine_chunks()), np.int32).reshape(len(v), -1)
    widths = [GROUND] + [M] * (int(packed[0, 1]) - 1)
    at = np.concatenate([[2], 2 + np.cumsum(widths)])
    return Graph(v.astype(np.float32), [packed[:, a:b] for a, b in zip(at, at[1:], strict=False)], 0), int(packed[0, 0]), v


def met(least: float):
    """For each two shards: (node, root, linked) of their nodes that are linked there."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.lexsort((rows["place"].to_numpy(), rows["shard"].to_numpy()))))
        shard = rows["shard"].to_numpy()
        first = rows.filter(pa.array(shard == shard[0]))
        node, copies = first["node"].to_numpy(), first["copies"].to_numpy()
        graph, beam, v = loaded(first)
        if shard[0] == rows["b"][0].as_py():
            link = links(graph, beam, v, v, least)
            link |= link.T
            np.fill_diagonal(link, False)
            other, others = node, copies
        else:
            second = rows.filter(pa.array(shard != shard[0]))
            if not second.num_rows:
                return pa.table({"node": [], "root": [], "linked": []}, SCHEMA)
            other, others = second["node"].to_numpy(), second["copies"].to_numpy()
            graph2, beam2, v2 = loaded(second)
            link = links(graph2, beam2, v2, v, least)
            link |= links(graph, beam, v, v2, least).T
        left, right = least_of(link)
        both = np.concatenate([node, other])
        # the least node of a group, by its number among the nodes
        name = np.concatenate([left, right])
        least_node = np.full(len(both), np.iinfo(np.int64).max)
        np.minimum.at(least_node, name, both)
        root, linked = least_node[name], np.concatenate([link @ others, link.T @ copies if other is not node else np.zeros(len(other), np.int64)])
        keep = np.concatenate([link.any(1), link.any(0)])
        return pa.table({"node": both[keep], "root": root[keep], "linked": linked[keep].astype(np.int64)}, SCHEMA)

    return run


SCHEMA = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("linked", pa.int64())])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """embedding as unit vectors of doubles in bytes."""
    for b in batches:
        out = []
        for x in b.column("embedding"):
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            v = v / np.abs(v).max()  # so that squares stay finite
            out.append((v / np.sqrt((v * v).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "size", "node", "copies", "deal")), pa.array(out, pa.binary())], names=["grp", "size", "node", "copies", "deal", "v"])


def near_duplicates(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of embeddings (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    small_batches(spark, 2048)
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("grp"), F.col("embedding").cast("array<double>").alias("embedding"))
    numbers = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(FAR))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("size", F.when(F.coalesce(numbers, F.lit(False)) & F.col("grp").isNotNull(), F.size("embedding")))
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    best = F.min(F.struct(F.col("size").isNull().alias("useless"), "size", "grp", "embedding")).alias("r")
    rows = checkpointed(rows.where("vec_id is not null").groupBy("vec_id").agg(best).select("vec_id", "r.size", "r.grp", "r.embedding"))

    usable = rows.where("size is not null")
    nodes = checkpointed(usable.groupBy("grp", "size", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    room = F.greatest(F.lit(64), F.least(F.lit(SHARD), F.lit(SHARD_BYTES) / (8 * F.col("size"))))
    counts = nodes.groupBy("grp", "size").agg(F.ceil(F.count("*") / F.first(room)).cast("int").alias("shards"))
    dealt = nodes.withColumn("deal", F.xxhash64("node")).mapInArrow(packed, "grp string, size int, node long, copies long, deal long, v binary")
    dealt = dealt.join(counts, ["grp", "size"]).withColumn("shard", F.pmod("deal", "shards").cast("int")).withColumn("least", F.lit(least))
    graphs = checkpointed(dealt.groupBy("grp", "size", "shard").applyInArrow(built, NODES))

    # every two shards of a label meet once, a shard with itself too
    mate = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    pairs = graphs.withColumn("deal", F.xxhash64("node")).select("*", mate.alias("mate")).withColumn("a", F.least("shard", "mate")).withColumn("b", F.greatest("shard", "mate"))
    found = checkpointed(pairs.select("grp", "size", "a", "b", "shard", "node", "copies", "v", "layers", F.col("deal").alias("place")).groupBy("grp", "size", "a", "b").applyInArrow(met(least), FOUND))
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    own = nodes.join(linked, "node", "left").join(groups, "node", "left")
    own = own.select("grp", "size", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = usable.join(own, ["grp", "size", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("size is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(nameless)


def op12_embedding_dedup(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: near duplicates of equal labels at a cosine of 0.93."""
    return near_duplicates(embeddings)
