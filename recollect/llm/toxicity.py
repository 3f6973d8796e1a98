"""Toxicity classifier: subword bags averaged into a linear softmax (after Joulin et al. 2017).

A word is the bag of its own bucket and of the buckets of its character n-grams,
each bucket with a vector. Vectors and softmax start from small random numbers
and are trained jointly in numpy, so an unseen misspelling shares the n-gram
vectors of the words that it resembles.

A document is the average of its words' vectors, read at several scales: windows
of WINDOW words in a row are ranked by what the softmax reads in them, and the
document's vector is a weighted sum of the averages over its worst window and
over the worst shares of SCALES; the weights are trained as well. So a few toxic
words in a long text, which would vanish in one average, count, and so does weak
evidence that recurs. Every word of a text is read in scoring, and in training too
but for texts of over TRAIN_CHARS code points, of which SPREAD stretches are read,
spread over the whole text; a labelled text is never left out for its length.

Words are runs of letters and digits in lower case; other signs stand between
them. A run of more than LONG characters (Chinese or Japanese, joined words)
counts as overlapping pieces of PIECE characters, STEP apart.

Once trained, the softmax is linear in the average, so each bucket is worth one
number, and the distinct words of a block of texts are valued at once.

Edge cases: null and empty texts, or texts without letters and digits, score
what the bias alone gives; very long texts are read whole; repeated rows are
scored alike; rows with a null doc_id are scored and count as not held out; an
empty table gives no rows; without labelled rows of both kinds every score is the
share of label 1 (or 0); extra columns, whatever their names, are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BLOCK_BYTES, held_out, labelled_sample, small_batches, tidied

#: Labelled rows that are learnt from at most, by label; the bytes of all of them.
TRAIN_ROWS = {0: 1200, 1: 600}
ALL_BYTES = 16 << 20
#: A longer text (code points) is learnt from by SPREAD stretches of equal length over the whole of it.
TRAIN_CHARS, SPREAD = 60_000, 12
#: One row in so many, of each label, is kept from training and places the cut.
APART = 5
BUCKETS, DIM = 1 << 20, 4
NGRAMS = (3, 4, 5, 6, 7)
#: Documents that a bucket needs to get a vector.
MIN_DOCS = 4
WINDOW = 2
#: Shares of a document's windows, the worst, whose averages are read beside the worst window.
SCALES = (0.004, 0.02, 0.15)
#: A run of more than LONG characters is read in pieces.
LONG, PIECE, STEP = 40, 16, 8
GAIN = 20.0
#: ASCII letters and digits, and what is neither ASCII nor space nor one of the common signs beyond it.
WORD = re.compile("[^\\s\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7 -⁯₠-⃏←-⯿　-〄〈-〠＀-／：-＠﻿]+")


def words_of(text: str | None) -> list[str]:
    """The text's words, long runs in pieces."""
    words = WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= LONG:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w) - PIECE + STEP, STEP)])]


def numbered(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of the word at every place, and the words of each text."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = words_of(t)
        counts[i] = len(own)
        words += own
    coded = pa.array(words, pa.string()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counts


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def buckets_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): the buckets of every word, its own one and those of its n-grams between < and >."""
    n = len(words)
    marked = pc.binary_join_element_wise("<", words, ">", "").cast(pa.binary()).cast(pa.large_binary())
    own = np.fromiter((zlib.crc32(w) for w in marked.to_pylist()), np.uint32, n)
    _, offsets, data = marked.buffers()
    edge = np.frombuffer(offsets, np.int64, n + 1, marked.offset * 8)
    raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]].astype(np.uint32) + np.uint32(1)
    edge = edge - edge[0]
    size = np.diff(edge)
    word = np.repeat(np.arange(n, dtype=np.int32), size)
    left = (np.repeat(edge[1:], size) - np.arange(len(raw))).astype(np.int32)  # bytes from here to the word's end
    flat, owner, h = [mixed(own)], [np.arange(n, dtype=np.int32)], raw
    for k in range(2, max(NGRAMS) + 1):
        h = h[: len(raw) - k + 1] * np.uint32(0x01000193) + raw[k - 1 :]
        if k in NGRAMS:
            whole = left[: len(h)] >= k
            flat.append(mixed(h[whole] + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)))
            owner.append(word[: len(h)][whole])
    return (np.concatenate(flat) & np.uint32(BUCKETS - 1)).astype(np.int32), np.concatenate(owner)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, text) of each window: every place of a text but the last ones begins one; texts without words have none."""
    n = np.where(counts > 0, np.maximum(counts - WINDOW + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    text = np.repeat(np.arange(len(counts)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[text]
    return first, np.minimum(first + WINDOW, (begin + counts)[text]), text


def pools_of(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's windows begin, how many it has, and how many each scale takes (worst first), one row a text."""
    n = np.bincount(text, minlength=n_texts)
    take = np.stack([np.minimum(n, 1), *(np.minimum(n, np.ceil(f * n).astype(np.int64)) for f in SCALES)], 1)
    return np.cumsum(n) - n, n, take


def pooled(z: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """The average of z over the windows that each scale takes, a row for each text."""
    begin, _, take = pools_of(text, n_texts)
    total = np.concatenate([[0.0], np.cumsum(z[np.lexsort((-z, text))])])
    return (total[begin[:, None] + take] - total[begin][:, None]) / np.maximum(take, 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def bags(words: pa.Array, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(used, flat, owner, size): the buckets that MIN_DOCS documents have, those of every word by number, whose they are, and how many each word has in all."""
    flat, owner = buckets_of(words)
    size = np.bincount(owner, minlength=len(words))
    by = np.argsort(owner, kind="stable").astype(np.int32)
    flat, owner = flat[by], owner[by]
    del by
    edge = np.concatenate([[0], np.cumsum(size)])
    seen, end = np.zeros(BUCKETS, np.int32), np.cumsum(counts)
    for a, z in zip(end - counts, end, strict=True):
        own = np.unique(at[a:z])
        seen[np.unique(np.concatenate([flat[:0], *(flat[edge[w] : edge[w + 1]] for w in own)]))] += 1
    # buckets that few documents have get no vector: they could only be learnt by heart
    common = seen >= min(MIN_DOCS, len(counts))
    kept = common[flat]
    number = (np.cumsum(common) - 1).astype(np.int32)
    return np.flatnonzero(common), number[flat[kept]], owner[kept], size


def train(texts: list[str], label: np.ndarray, steps: int = 40, rate: float = 0.02, decay: float = 0.02, seed: int = 11) -> dict:
    """Bucket vectors E, softmax C and b, and scale weights a, by Adam over all documents; with 0 steps they are random."""
    words, at, counts = numbered(texts)
    used, flat, owner, size = bags(words, at, counts)
    at = at.astype(np.int32)
    first, stop, text = (x.astype(np.int32) for x in windows_of(counts))
    begin, n_windows, take = pools_of(text, len(texts))
    both = stop - first == 2
    width = (stop - first).astype(np.float32)
    head, tail = at[first], at[stop - 1]  # a window's first word, and its last
    y = label.astype(int)
    even = len(y) / 2 / np.maximum(np.bincount(y, minlength=2), 1)
    g = np.random.default_rng(seed)
    p = {"E": g.normal(0, 0.01, (DIM, len(used))), "C": g.normal(0, 0.1, (DIM, 2)), "b": np.zeros(2), "a": np.zeros(take.shape[1])}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    place = (np.arange(len(text)) - begin[text]).astype(np.int32)  # the rank that a window gets once they are sorted
    per = np.maximum(take, 1)
    for step in range(1, steps + 1):
        word = np.stack([np.bincount(owner, e[flat], len(words)) / size for e in p["E"]]).astype(np.float32)
        x = np.stack([(w[head] + np.where(both, w[tail], 0)) / width for w in word])
        rank = np.lexsort((-(p["C"][:, 1] - p["C"][:, 0]) @ x, text))
        x = x[:, rank]
        alpha = softmax(p["a"])
        means = np.stack([np.stack([np.bincount(text, np.where(place < take[text, s], e, 0), len(y)) / per[:, s] for e in x]) for s in range(take.shape[1])])
        doc = np.tensordot(alpha, means, 1)
        dz = (softmax(GAIN * doc.T @ p["C"] + p["b"]) - np.eye(2)[y]) * (even[y] / len(y))[:, None]
        dx = GAIN * dz @ p["C"].T
        d_alpha = np.einsum("sdn,nd->s", means, dx)
        share = np.zeros(len(text), np.float32)
        share[rank] = sum(np.where(place < take[text, s], alpha[s] / per[text, s], 0) for s in range(take.shape[1])) / width[rank]
        grad = {"b": dz.sum(0), "C": GAIN * doc @ dz, "a": alpha * (d_alpha - alpha @ d_alpha), "E": np.empty_like(p["E"])}
        for k in range(DIM):
            each = share * dx[text, k].astype(np.float32)
            d_word = (np.bincount(head, each, len(words)) + np.bincount(tail, np.where(both, each, 0), len(words))) / size
            grad["E"][k] = np.bincount(flat, d_word[owner], len(used))
        for k in p:
            # one pace for all buckets: those that tell most move most
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * v[k] + 0.001 * ((grad[k] ** 2).mean() if k == "E" else grad[k] ** 2)
            p[k] -= rate * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * p[k] * (k == "E"))
    worth = np.zeros(BUCKETS, np.float32)
    worth[used] = GAIN * (p["C"][:, 1] - p["C"][:, 0]) @ p["E"]
    return {"worth": worth, "alpha": softmax(p["a"]), "bias": float(p["b"][1] - p["b"][0])}


def logits(model: dict, texts: list[str | None]) -> np.ndarray:
    """What the softmax reads in each text."""
    words, at, counts = numbered(texts)
    flat, owner = buckets_of(words)
    value = np.bincount(owner, model["worth"][flat], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)
    first, stop, text = windows_of(counts)
    total = np.concatenate([[0.0], np.cumsum(value[at])])
    return pooled((total[stop] - total[first]) / np.maximum(stop - first, 1), text, len(texts)) @ model["alpha"] + model["bias"]


def spread(text: Column) -> Column:
    """The text, or SPREAD stretches of it from its beginning to its end, TRAIN_CHARS in all."""
    piece = TRAIN_CHARS // SPREAD
    pieces = [F.substring(text, (F.lit(1) + (F.length(text) - piece) * k / (SPREAD - 1)).cast("int"), F.lit(piece)) for k in range(SPREAD)]
    return F.when(F.length(text) > TRAIN_CHARS, F.concat_ws(" ", *pieces)).otherwise(text)


def fit(documents: DataFrame, labels: DataFrame, bound: dict = TRAIN_ROWS) -> dict | float:
    """The model learnt from at most bound labelled documents of each kind, or the share of label 1 if there is but one kind."""
    small_batches(documents.sparkSession)
    sample = labelled_sample(labels, "toxic", bound)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    rows = rows.select("label", "doc_id", spread(F.col("text")).alias("text"))
    # rows beyond ALL_BYTES fall out by the order of hashes, whatever their length, before they come to the driver
    order = W.orderBy(F.xxhash64("doc_id", F.lit("order")), "text")
    few = rows.orderBy(F.xxhash64("doc_id", F.lit("order")), "text").limit(2 * sum(bound.values()))
    got = few.withColumn("bytes", F.sum(F.octet_length("text")).over(order)).where(F.col("bytes") <= ALL_BYTES).orderBy("bytes").select("label", "text").toPandas()
    label = got["label"].to_numpy(np.float32)
    if len(label) == 0 or label.min() == label.max():
        return float(label[0]) if len(label) else 0.0
    nth = np.where(label == 1, np.cumsum(label == 1), np.cumsum(label == 0))
    apart = nth % APART == 0
    model = train(list(got["text"][~apart]), label[~apart])
    # how many clean documents there are for a toxic one, of those that may be learnt from
    seen = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    return calibrated(model, list(got["text"][apart]), label[apart], seen.clean / max(1, seen.toxic))


def calibrated(model: dict, texts: list[str], label: np.ndarray, clean: float = 1.0) -> dict:
    """The model with its cut where errors are fewest among texts that it has not seen, in the middle of the best stretch; there are so many clean documents for a toxic one."""
    if min((label == 0).sum(), (label == 1).sum()) < 5:
        return model
    z = logits(model, texts)
    at = np.unique(z)
    cuts = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    good, bad = np.sort(z[label == 0]), np.sort(z[label == 1])
    cost = np.searchsorted(bad, cuts) / len(bad) + clean * (1 - np.searchsorted(good, cuts) / len(good))
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    low, high = np.concatenate([[at[0] - 1], at])[best[0]], np.concatenate([at, [at[-1] + 1]])[best[-1]]
    return model | {"bias": model["bias"] - float(low + high) / 2}


def scores(model: dict | float, texts: list[str | None]) -> np.ndarray:
    """The score of each text, from 0 to 1; texts are read in blocks."""
    if isinstance(model, float):
        return np.full(len(texts), model)
    out, i = np.empty(len(texts)), 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and held < BLOCK_BYTES:
            held += len(texts[j] or "") + 1
            j += 1
        out[i:j] = np.round(1 / (1 + np.exp(-np.clip(logits(model, texts[i:j]), -30, 30))), 9)
        i = j
    return out


def score(documents: DataFrame, model: dict | float, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """documents' doc_id (or the columns keep) with score and predicted."""
    small_batches(documents.sparkSession, 4096)
    cols = keep or ["doc_id"]
    rows = documents.select(*cols, *[] if "text" in cols else ["text"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cols).schema.fields) + ", score double"
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = scores(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(y, pa.float64())], [*cols, "score"])

    return rows.mapInArrow(tidied(scored), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
