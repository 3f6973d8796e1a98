"""N-gram Jaccard self-join with adaptive multi-match prefixes (after Wang, Li and Feng 2012).

A document is the set of its distinct five-word shingles. Two documents link
when 100 * intersection >= 80 * union. Links and their components are exact:

1. classes: documents with equal sets are one class, its least doc_id stands for
   it, and copies are never paired.
2. order: shingles are ordered by hash, those that many documents share last, by
   their estimated number of documents. Any order gives exact results; a good
   one keeps passages that many documents share out of the prefixes.
3. prefixes: two linked sets of n and m share t = ceil(80 / 180 * (n + m))
   shingles or more, so the first n - ceil(0.8 n) + l of one and as many of the
   other share l at least. l is 1 for a document whose prefix is cheap, and
   grows with the logarithm of the estimated candidates of its prefix. A pair is
   a candidate when its prefixes share the smaller l.
4. dense groups: where many documents share a prefix shingle, each is first
   verified against the one whose shared shingles begin first; what this links
   needs no further pairs among itself, as only components are asked for.
5. candidates: all pairs of different components so far that share a prefix
   shingle, if sizes, the shingles left behind it and those before it that either
   shares with anyone leave room for t in common, and if bits of their prefixes'
   shared shingles leave room for l and t; then counted, held against l and t
   once more, and verified on whole sets.

Posting lists are packed by hash bucket of the shingle and live in as many
buckets as the session has shuffle partitions; a bucket works through one
shingle's list in stretches and emits counted pairs as it goes, so no list of
pairs is held. Sets are sent to where they are verified; a document with many
partners meets them in several places.

A shingle is known by 64 bits, its words' 64-bit hashes combined by place,
so two sets of 20,000 meet a false common shingle about once in 10**10 pairs. The
shared shingles are those that recur within some million shingles of one task; one
that m documents share is met so once m passes a few times the root of the number
of such stretches, so what the order misses are lists that short. A list of over
BIG postings is cut into pieces by component and size, and each two pieces are
counted wherever there is room.

Edge cases: null and empty texts and texts without words have no shingles and
are linked with nothing (a component of their own); with fewer than five words
the whole sequence is the one shingle; rows with a null doc_id have no
component; of rows with equal doc_id the one with the least set key is linked
and all get its component; an empty table gives no rows; other columns are
dropped.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, n_partitions, small_batches, tidied
from .components import components

K = 5
#: Shingles that stand last are those of so many documents at least, and so many of them at most.
SHARED, MOST_SHARED = 16, 1 << 16
#: Documents with a shingle from which on its group counts as dense.
DENSE = 8
#: l is this at most.
LONGEST = 9
#: Partners of a document that are verified in one place.
PARTNERS = 64
#: Bits of the filter that tells which sets are needed: so many a document, between these bounds; beyond, it lets more through, which the join drops.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28

#: Postings of one shingle from which on its list is cut, and postings of a piece.
BIG, PIECE = 8_192, 4_096
#: Odd multipliers, one for each place in a shingle.
_PLACES = np.random.default_rng(2024).integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles: its words' hashes, each times its place's multiplier, summed and mixed."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(K, len(words))
    n = len(words) - k + 1
    total = w[:n] * _PLACES[0]
    for i in range(1, k):
        total += w[i : i + n] * _PLACES[i]
    return np.unique(mixed(total + np.uint64(k)))


def blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(struct.pack("<q", x.nbytes) + x.tobytes() for x in arrays))


def arrays(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    for kind in kinds:
        (n,) = struct.unpack_from("<q", raw, at)
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# 1 and 2: classes and order

DOC = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("body", pa.binary())])


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; rows without key hold shingles that recur among some million, with their counts."""
    held, size, met = [], 0, set()

    def recurring() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        return batch(DOC, [[None], [None], [None], [blob(token[count > 1], count[count > 1])]])

    for b in batches:
        out = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            s = shingles(text)
            key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            out.append((doc, len(s), key, None))
            if key not in met:
                met.add(key)
                held.append(s)
                size += len(s)
        if out:
            yield batch(DOC, list(zip(*out, strict=True)))
        if size > 4_000_000:
            yield recurring()
            held, size, met = [], 0, set()
    if held:
        yield recurring()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
    for b in batches:
        for body in b.column("body").to_pylist():
            token, n = arrays(body, "u8", "i8")
            yield batch(schema, [token.view(np.int64), n])


class Order:
    """The order of shingles: by hash, those of many documents last, by their estimated documents."""

    def __init__(self, token: np.ndarray, count: np.ndarray):
        by = np.argsort(token)
        self.token, self.count = token[by], count[by]

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """s in order, with the estimated documents of each (1 if few)."""
        cost = np.ones(len(s), np.int64)
        if len(self.token):
            at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
            cost = np.where(self.token[at] == s, self.count[at], 1)
        by = np.lexsort((s, cost))
        return s[by], cost[by]


def prefix(s: np.ndarray, order: Order) -> tuple[np.ndarray, int]:
    """The first shingles of a set in order, and l, the number that a candidate must share."""
    n = len(s)
    tokens, cost = order(s)
    short = n - (80 * n + 99) // 100 + 1
    candidates = int((cost[:short] - 1).sum())
    l = min(1 + candidates.bit_length() // 2, LONGEST, n - short + 1)
    return tokens[: short + l - 1], l


# 3: posting lists

POSTING = pa.schema([("bucket", pa.int32()), ("body", pa.binary())])
KINDS = ("u8", "i8", "i8", "i4", "i4", "i4", "i4", "i4", "u8", "u8", "u8", "u8")
# shingle, document, set size, position, prefix length, l, shared shingles before it and in the prefix, and which these are, as bits


def prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("l", pa.int32()), ("tokens", pa.binary())])
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(text)
                if len(s) and doc is not None:
                    tokens, l = prefix(s, shared.value)
                    out.append((doc, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), l, tokens.tobytes()))
            if out:
                yield batch(schema, list(zip(*out, strict=True)))

    return run


def home_of(token: np.ndarray, buckets: int) -> np.ndarray:
    return ((token >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def blank(n: int) -> list[np.ndarray]:
    """The columns that ranked() fills."""
    return [np.zeros(n, k) for k in KINDS[6:]]


def dealt(home: np.ndarray, cols: tuple | list, buckets: int) -> pa.RecordBatch:
    """Postings packed by the bucket that is their home."""
    by = np.argsort(home, kind="stable")
    edge = np.searchsorted(home[by], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edge))
    return batch(POSTING, [some, [blob(*(c[by[edge[k] : edge[k + 1]]] for c in cols)) for k in some]])


def posted(buckets: int):
    """Prefixes to posting lists packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            length = np.array([len(t) for *_, t in held])
            token = np.concatenate([t for *_, t in held])
            doc, n, l = (np.repeat(np.array([h[k] for h in held], np.int64), length) for k in range(3))
            pos = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            cols = token, doc, n, pos.astype("i4"), np.repeat(length, length).astype("i4"), l.astype("i4"), *blank(len(token))
            return dealt(home_of(token, buckets), cols, buckets)

        for b in batches:
            for doc, n, l, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "l", "tokens")), strict=True):
                held.append((doc, n, l, np.frombuffer(raw, np.uint64)))
                size += len(held[-1][3])
            if size > 2_000_000:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return run


def by_bucket(batches: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows sorted by bucket to each bucket's joined arrays."""
    at, parts = None, []
    for b in batches:
        for bucket, body in zip(b.column("bucket").to_pylist(), b.column("body").to_pylist(), strict=True):
            if bucket != at and parts:
                yield at, [np.concatenate(c) for c in zip(*parts, strict=True)]
                parts = []
            at = bucket
            parts.append(arrays(body, *kinds))
    if parts:
        yield at, [np.concatenate(c) for c in zip(*parts, strict=True)]


def shared_only(buckets: int):
    """Postings of one bucket but for those of shingles that one document alone has, dealt anew by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in by_bucket(batches, *KINDS):
            by = np.argsort(cols[0], kind="stable")
            token = cols[0][by]
            again = np.zeros(len(token), bool)
            same = token[1:] == token[:-1]
            again[1:] |= same
            again[:-1] |= same
            if again.any():
                cols = [c[by][again] for c in cols]
                yield dealt((cols[1] * 0x9E3779B1 >> 16) % buckets, cols, buckets)

    return run


def ranked(buckets: int):
    """Postings dealt by document to postings dealt by shingle, with the number of shared shingles that stand before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in by_bucket(batches, *KINDS):
            by = np.lexsort((cols[3], cols[1]))
            cols = [c[by] for c in cols]
            begin = np.flatnonzero(np.concatenate([[True], cols[1][1:] != cols[1][:-1]]))
            size = np.diff(np.append(begin, len(by)))
            cols[6] = (np.arange(len(by)) - np.repeat(begin, size)).astype("i4")
            cols[7] = np.repeat(size, size).astype("i4")
            bit = cols[0] >> np.uint64(40)
            for k in range(4):
                own = np.where((bit >> np.uint64(6)) % np.uint64(4) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
                cols[8 + k] = np.repeat(np.bitwise_or.reduceat(own, begin), size)
            # what stands before and behind must leave room for the least overlap of any link
            cols = [c[100 * (cols[6] + cols[2] - cols[3]) >= 80 * cols[2]] for c in cols]
            if len(cols[0]):
                yield dealt(home_of(cols[0], buckets), cols, buckets)

    return run


def may_link(i: np.ndarray, j: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
    """Whether the documents of postings i and j can share enough.

    Before the shingle they share at most as many as either shares with anyone,
    behind it as many as either has left.
    """
    n, m = cols[2][i], cols[2][j]
    before = np.minimum(cols[6][i], cols[6][j])
    behind = np.minimum(n - cols[3][i], m - cols[3][j])
    return (100 * np.minimum(n, m) >= 80 * np.maximum(n, m)) & (180 * (before + behind) >= 80 * (n + m))


def may_count(i: np.ndarray, j: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
    """Whether the prefixes of postings i and j can share l shingles, and enough beside what lies behind them.

    A shingle whose bit the other document lacks is not in the other's prefix.
    """
    n, m, p, q = cols[2][i], cols[2][j], cols[3][i], cols[3][j]
    lacks_i = sum(np.bitwise_count(c[i] & ~c[j]).astype(np.int64) for c in cols[8:])
    lacks_j = sum(np.bitwise_count(c[j] & ~c[i]).astype(np.int64) for c in cols[8:])
    shared = np.minimum(cols[7][i] - lacks_i, cols[7][j] - lacks_j)
    rest = np.maximum(np.minimum(n - cols[4][i], m - q - 1), np.minimum(m - cols[4][j], n - p - 1))
    return (shared >= np.minimum(cols[5][i], cols[5][j])) & (180 * (shared + rest) >= 80 * (n + m))


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def sorted_lists(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Postings by shingle, then by set size."""
    by = np.lexsort((cols[1], cols[2], cols[0]))
    return [c[by] for c in cols]


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4: pairs of a dense group's first document with each other one."""
    for _, cols in by_bucket(batches, *KINDS):
        cols = sorted_lists(cols)
        token, doc, n, pos, _, _, before = cols[:7]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(begin, len(token)))
        dense = np.repeat(size >= DENSE, size)
        # the fewest shingles of its own, then the smallest set, then the least document
        by = np.lexsort((doc, n, (pos - before) / n, token))
        head = np.repeat(by[begin], size)
        ok = dense & (doc[head] != doc) & may_link(head, np.arange(len(doc)), cols)
        if ok.any():
            pairs = np.unique(np.stack([doc[head][ok], doc[ok]], 1), axis=0)
            yield batch(PAIR, [pairs[:, 0], pairs[:, 1]])


HIT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hits", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("l", pa.int32()), ("p", pa.int32()), ("q", pa.int32()), ("np", pa.int32()), ("mq", pa.int32())])


def hits_of(i: np.ndarray, j: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs of postings i and j, counted by pair of documents."""
    _, doc, n, pos, length, l = cols[:6]
    swap = doc[i] > doc[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    by = np.lexsort((doc[j], doc[i]))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.concatenate([[True], (doc[i][1:] != doc[i][:-1]) | (doc[j][1:] != doc[j][:-1])]))
    count = np.diff(np.append(first, len(i)))
    p, q = np.maximum.reduceat(pos[i], first), np.maximum.reduceat(pos[j], first)
    i, j = i[first], j[first]
    return batch(HIT, [doc[i], doc[j], count, n[i], n[j], np.minimum(l[i], l[j]), p, q, length[i], length[j]])


#: A counted pair, or a piece of a long list beside another one.
CROSSED = pa.schema([*HIT, ("piece", pa.string()), ("body", pa.binary())])


def whole(hits: pa.RecordBatch) -> pa.RecordBatch:
    """Counted pairs in the form of CROSSED."""
    return pa.RecordBatch.from_arrays([*hits.columns, pa.nulls(hits.num_rows, pa.string()), pa.nulls(hits.num_rows, pa.binary())], schema=CROSSED)


def met(stretches: Iterator[tuple[np.ndarray, np.ndarray]], own: np.ndarray, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counted pairs of the postings i and j of each stretch that are of different components and may link."""
    held_i, held_j, held = [], [], 0
    for i, j in stretches:
        for test in (lambda: own[i] != own[j], lambda: may_link(i, j, cols), lambda: may_count(i, j, cols)):
            ok = test()
            i, j = i[ok], j[ok]
        held_i.append(i)
        held_j.append(j)
        held += len(i)
        if held > 1_000_000:
            yield hits_of(np.concatenate(held_i), np.concatenate(held_j), cols)
            held_i, held_j, held = [], [], 0
    if held:
        yield hits_of(np.concatenate(held_i), np.concatenate(held_j), cols)


def along(token: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of sorted lists that sizes allow, in stretches of about a million."""
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    end = np.append(begin[1:], len(token))
    stop = np.repeat(end, end - begin)
    # a posting's partners come after it in its list, up to the largest set that can link with it: one search over (list number, n)
    number = np.repeat(np.arange(len(begin)), end - begin)
    wide = np.int64(int(n.max()) * 2 + 2)
    reach = np.minimum(np.searchsorted(number * wide + n, number * wide + n * 100 // 80, "right"), stop)
    left = np.maximum(reach - np.arange(len(token)) - 1, 0)
    at = 0
    while at < len(token):
        upto = int(np.searchsorted(np.cumsum(left[at : at + 65_536]), 1_000_000)) + at + 1
        upto = min(upto, len(token), at + 65_536)
        k = left[at:upto]
        i = np.repeat(np.arange(at, upto), k)
        yield i, i + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        at = upto


def pieces(cols: list[np.ndarray], own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each two pieces of a long list, sorted by component and size, that hold different components of like sizes: a row that any task can count."""
    by = np.lexsort((cols[2], own))
    cuts = [by[k : k + PIECE] for k in range(0, len(by), PIECE)]
    for r, p in enumerate(cuts):
        for c, q in enumerate(cuts[r:], r):
            one = own[p[0]] == own[q[-1]]  # sorted, so all between are the same
            n, m = cols[2][p], cols[2][q]
            if not one and 100 * n.max() >= 80 * m.min() and 100 * m.max() >= 80 * n.min():
                both = p if r == c else np.concatenate([p, q])
                body = blob(np.array([len(p)]), own[both], *(x[both] for x in cols))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in HIT), pa.array([f"{cols[0][0]}-{r}-{c}"]), pa.array([body], pa.binary())], schema=CROSSED)


def pieced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """5, long lists: counted pairs between two pieces, or within one."""
    for b in batches:
        for body in b.column("body").to_pylist():
            (n,), own, *cols = arrays(body, "i8", "i8", *KINDS)
            total = len(own)

            def stretches(n: int = n, total: int = total) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for a in range(0, n, 128):
                    i = np.arange(a, min(a + 128, n))
                    j = np.arange(n, total) if total > n else np.arange(n)
                    i, j = np.repeat(i, len(j)), np.tile(j, len(i))
                    yield (i, j) if total > n else (i[i < j], j[i < j])

            for hits in met(stretches(), own, cols):
                yield hits


def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """5: counted pairs of different components; a bucket's rows with labels (token 0, document, label) come with its lists. Long lists leave in pieces."""
    for _, cols in by_bucket(batches, *KINDS):
        known = cols[5] < 0  # rows with labels, marked by a negative l
        label_doc, label = cols[1][known], cols[2][known]
        cols = [c[~known] for c in cols]
        if not len(cols[0]):
            continue
        cols = sorted_lists(cols)
        token, doc = cols[:2]
        own = doc.copy()
        if len(label_doc):
            by = np.argsort(label_doc)
            at = np.minimum(np.searchsorted(label_doc[by], doc), len(by) - 1)
            own = np.where(label_doc[by][at] == doc, label[by][at], doc)
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(begin, len(token)))
        for a, n in zip(begin[size > BIG], size[size > BIG], strict=True):
            yield from pieces([c[a : a + n] for c in cols], own[a : a + n])
        short = np.repeat(size <= BIG, size)
        if short.any():
            cols, own = [c[short] for c in cols], own[short]
            for hits in met(along(cols[0], cols[2]), own, cols):
                yield whole(hits)


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, bucket): in which buckets the documents of dense groups are."""
    schema = pa.schema([("doc", pa.int64()), ("bucket", pa.int32())])
    for bucket, cols in by_bucket(batches, *KINDS):
        token, doc = sorted_lists(cols)[:2]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(begin, len(token)))
        some = np.unique(doc[np.repeat(size >= DENSE, size)])
        if len(some):
            yield batch(schema, [some, np.full(len(some), bucket)])


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, bucket, component) as bodies in the form of posting lists, with l = -1."""
    for b in batches:
        bucket = b.column("bucket").to_numpy()
        doc, label = b.column("doc").to_numpy(), b.column("component").to_numpy()
        for k in np.unique(bucket):
            on = bucket == k
            m = int(on.sum())
            zero = np.zeros(m, "i4")
            yield batch(POSTING, [[k], [blob(np.zeros(m, "u8"), doc[on].astype("i8"), label[on].astype("i8"), zero, zero, zero - 1, *blank(m))]])


# verification

SET = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("body", pa.binary())])


def needed_sets(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, key, body): the sets of the pairs' documents, and of the few others that a filter lets through."""
    spark = documents.sparkSession
    docs = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
    n_bits = min(max(1 << (BITS_EACH * docs.agg(F.approx_count_distinct("doc")).first()[0]).bit_length(), LEAST_BITS), MOST_BITS)
    bit = docs.select(F.pmod(F.xxhash64("doc"), F.lit(n_bits)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toPandas()
    filled = np.zeros(n_bits // 64, np.int64)
    filled[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(filled)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = b.column("bit").to_numpy()
            on = (shared.value[bits >> 6] >> (bits & 63)) & 1
            out = []
            for doc, text, ok in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), on, strict=True):
                if ok and len(s := shingles(text)):
                    out.append((doc, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes()))
            if out:
                yield batch(SET, list(zip(*out, strict=True)))

    rows = documents.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(n_bits)).alias("bit"))
    return rows.mapInArrow(tidied(sets), "doc_id long, key binary, body binary")


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place, a set before its partners: the pairs that link."""
    place, a, own = None, None, None
    for b in batches:
        out = []
        for at, other, body in zip(*(b.column(c).to_pylist() for c in ("place", "other", "body")), strict=True):
            s = np.frombuffer(body, np.uint64)
            if other is None:
                place, a, own = at, int(at.split("-")[0]) if at[0] != "-" else -int(at.split("-")[1]), s
            elif at == place:
                both = np.intersect1d(own, s, assume_unique=True).size
                if 100 * both >= 80 * (len(own) + len(s) - both):
                    out.append((a, other))
        if out:
            yield batch(PAIR, list(zip(*out, strict=True)))


def linked(documents: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link.

    What places a set is needed in is found from the pairs alone, so a set moves to
    meet its places and from there to each of them.
    """
    n = n_partitions(documents.sparkSession)
    # a document's partners are dealt over places of some PARTNERS each
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("places"))
    spot = pairs.join(degree, "a").select("a", "b", F.concat_ws("-", "a", F.pmod(F.xxhash64("b"), F.col("places"))).alias("place"))
    theirs = spot.select(F.col("b").alias("doc_id"), "place", F.col("b").alias("other"))
    own = spot.select(F.col("a").alias("doc_id"), "place").distinct().withColumn("other", F.lit(None).cast("long"))
    need = own.unionByName(theirs).join(classes, "doc_id")
    rows = needed_sets(documents, pairs).join(need, ["doc_id", "key"]).select("place", "other", "body")
    rows = rows.repartition(n, "place").sortWithinPartitions("place", F.asc_nulls_first("other"))
    return rows.mapInArrow(tidied(verified), "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each row of documents."""
    spark = documents.sparkSession
    small_batches(spark)
    n = n_partitions(spark)
    documents = documents.select("doc_id", "text")
    seen = checkpointed(documents.mapInArrow(tidied(keyed), "doc_id long, n long, key binary, body binary"))
    rows = seen.where("key is not null").select("doc_id", "n", "key")
    node = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    classes = checkpointed(node.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")))

    tally = seen.where("key is null").mapInArrow(tidied(counted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(f"n >= {SHARED}")
    tally = tally.orderBy(F.desc("n"), "token").limit(MOST_SHARED).toPandas()
    order = spark.sparkContext.broadcast(Order(tally["token"].to_numpy(np.int64).view(np.uint64), tally["n"].to_numpy(np.int64)))

    first = documents.mapInArrow(tidied(prefixes(order)), "doc_id long, key binary, n long, l int, tokens binary").join(classes, ["doc_id", "key"])
    lists = first.mapInArrow(tidied(posted(n)), "bucket int, body binary")
    for step in (shared_only(n), ranked(n)):
        lists = lists.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(step), "bucket int, body binary")
    lists = checkpointed(lists.repartition(n, "bucket").sortWithinPartitions("bucket"))

    pairs = checkpointed(lists.mapInArrow(tidied(spread), "a long, b long").distinct())
    sure = checkpointed(linked(documents, classes, pairs))
    labels = components(sure)

    marks = lists.mapInArrow(tidied(placed), "doc long, bucket int").join(labels.withColumnRenamed("node", "doc"), "doc").mapInArrow(tidied(labelled), "bucket int, body binary")
    both = lists.unionByName(marks).repartition(n, "bucket").sortWithinPartitions("bucket")
    counts = "a long, b long, hits long, n long, m long, l int, p int, q int, np int, mq int"
    hits = checkpointed(both.mapInArrow(tidied(crossed), counts + ", piece string, body binary"))
    long_lists = hits.where("piece is not null").repartition(n, "piece").select("body").mapInArrow(tidied(pieced), counts)
    hits = hits.where("piece is null").drop("piece", "body").unionByName(long_lists)
    hits = hits.groupBy("a", "b").agg(F.sum("hits").alias("hits"), *(F.max(c).alias(c) for c in ("n", "m", "l", "p", "q", "np", "mq")))
    # shingles not counted lie behind the last hit in both sets, and behind the prefix in one of them
    rest = F.greatest(F.least(F.col("n") - F.col("np"), F.col("m") - F.col("q") - 1), F.least(F.col("m") - F.col("mq"), F.col("n") - F.col("p") - 1))
    hits = hits.where((F.col("hits") >= F.col("l")) & (180 * (F.col("hits") + rest) >= 80 * (F.col("n") + F.col("m"))))
    more = linked(documents, classes, checkpointed(hits.select("a", "b")))

    found = components(sure.unionByName(checkpointed(more)))
    member = node.join(classes.withColumnRenamed("doc_id", "own"), "key", "left").select("doc_id", F.coalesce("own", "doc_id").alias("own"))
    member = member.join(found.withColumnRenamed("node", "own"), "own", "left").select("doc_id", F.coalesce("component", "own").alias("component_id"))
    return rows.join(member, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op5_ngram_jaccard_join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return near_duplicates(documents)


#: All pairs that share a shingle, then everything reachable by links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), size AS (SELECT doc_id, len(s) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM size UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT size.doc_id, n AS n_shingles, min(reach.b) AS component_id FROM size JOIN reach ON reach.a = size.doc_id GROUP BY size.doc_id, n
"""
