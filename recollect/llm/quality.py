"""Quality classifier: attention over the passages of a document, learnt from document labels.

A document is a bag of passages (gated attention-based multiple-instance
learning, Ilse et al. 2018). Each passage is encoded from its bytes; a small
network gives each passage a hidden vector h and a gate
w . (tanh(V h) * sigmoid(U h)); the softmax of the gates weighs the hidden
vectors, and a logistic layer scores the weighted sum.

Learning takes TRAIN_ROWS labelled rows at most, and of each TRAIN_PASSAGES
passages at most, spread evenly over the whole text; scoring reads every passage.

Edge cases: null and empty texts are one empty passage and get a score like any
other; very long texts are encoded in blocks of passages; repeated rows are scored
alike, and several texts of one labelled doc_id are each learnt from, within the
bound; rows with a null doc_id are scored and count as not held out; an empty table
gives no rows; without labelled rows of both kinds every score is the share of
label 1 (or 0.5). Extra columns of the input, whatever their names, are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, small_batches, tidied

#: Labelled rows that are learnt from at most, and passages of each.
TRAIN_ROWS, TRAIN_PASSAGES = 2500, 32
#: Bytes of a passage.
PASSAGE = 768
#: Buckets that pairs of neighbouring bytes are hashed to.
PAIRS = 256
STATS = 6
WIDTH = 256 + PAIRS + STATS
HIDDEN, GATE = 24, 12


def passages(text: str | None) -> list[bytes]:
    """The whole text cut into stretches of PASSAGE bytes."""
    raw = (text or "").encode("utf-8", "replace")
    return [raw[i : i + PASSAGE] for i in range(0, len(raw), PASSAGE)] or [b""]


def encode(parts: list[bytes]) -> np.ndarray:
    """A row of features for each passage: bytes, hashed byte pairs, repetition."""
    n = len(parts)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    own = np.repeat(np.arange(n), lengths)
    single = np.bincount(own * 256 + raw, minlength=n * 256).reshape(n, 256)
    pair = ((raw[:-1] * 31 + raw[1:] * 131) ^ (raw[1:] >> 3)) % PAIRS
    same = own[:-1] == own[1:]
    double = np.bincount((own[:-1] * PAIRS + pair)[same], minlength=n * PAIRS).reshape(n, PAIRS)
    size = np.maximum(lengths, 1)[:, None]
    stats = np.zeros((n, STATS), np.float32)
    for i, part in enumerate(parts):
        words = part.split()
        stats[i, 0] = len(zlib.compress(part, 1)) / (len(part) + 16)
        stats[i, 1] = len(set(words)) / max(1, len(words))
        stats[i, 2] = min(len(part) / max(1, len(words)), 40) / 10
        stats[i, 3] = len(re.findall(rb"(\S+) \1(?!\S)", part)) / max(1, len(words))
    stats[:, 4] = lengths / PASSAGE
    stats[:, 5] = 1
    return np.hstack([np.sqrt(single / size), np.sqrt(double / size), stats]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, x: np.ndarray, start: np.ndarray) -> dict:
    """All that is computed for bags of passages; start: where each bag begins in x."""
    h = np.tanh(x @ p["W"])
    t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    gate = (t * s) @ p["w"]
    bag = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
    e = np.exp(gate - np.maximum.reduceat(gate, start)[bag])
    a = e / np.add.reduceat(e, start)[bag]
    z = np.add.reduceat(a[:, None] * h, start)
    return {"h": h, "t": t, "s": s, "bag": bag, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["b"])}


def train(x: np.ndarray, start: np.ndarray, label: np.ndarray, steps: int = 160, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> dict:
    """The network's weights, by Adam over all bags; a column is scaled by its spread."""
    g = np.random.default_rng(seed)
    mean, spread = x.mean(0), x.std(0) + 1e-2
    x = (x - mean) / spread
    p = {"W": g.normal(0, 0.05, (x.shape[1], HIDDEN)), "V": g.normal(0, 0.2, (HIDDEN, GATE)), "U": g.normal(0, 0.2, (HIDDEN, GATE)), "w": g.normal(0, 0.2, GATE), "c": g.normal(0, 0.2, HIDDEN), "b": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = forward(p, x, start)
        dy = ((f["y"] - label) / len(label)).astype(np.float32)
        dz = dy[:, None] * p["c"]
        da = (f["h"] * dz[f["bag"]]).sum(1)
        dgate = f["a"] * (da - np.add.reduceat(f["a"] * da, start)[f["bag"]])
        dt, ds = (dgate[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), dgate[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"]))
        dh = f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + ds @ p["U"].T
        grad = {"c": f["z"].T @ dy, "b": dy.sum(keepdims=True), "w": (f["t"] * f["s"]).T @ dgate, "V": f["h"].T @ dt, "U": f["h"].T @ ds, "W": x.T @ (dh * (1 - f["h"] ** 2))}
        for k in p:
            d = grad[k] + decay * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p | {"mean": mean, "spread": spread}


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc, label, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True):
            parts = passages(text)
            if len(parts) > TRAIN_PASSAGES:
                parts = [parts[i * len(parts) // TRAIN_PASSAGES] for i in range(TRAIN_PASSAGES)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "label": pa.array([label], pa.int32()), "x": pa.array([encode(parts).astype(np.float16).tobytes()], pa.binary())})


def fit(documents: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> dict | float:
    """The model learnt from at most bound labelled rows, or the share of label 1 if there is but one kind."""
    small_batches(documents.sparkSession)
    sample = labelled_sample(labels, "quality", bound)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    rows = rows.mapInArrow(tidied(encoded), "doc_id long, label int, x binary")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x"), "x").limit(bound).toPandas().sort_values(["doc_id", "x"], kind="stable")
    label = got["label"].to_numpy(np.float32)
    if len(label) == 0 or label.min() == label.max():
        return float(label[0]) if len(label) else 0.5
    bags = [np.frombuffer(x, np.float16).reshape(-1, WIDTH).astype(np.float32) for x in got["x"]]
    return train(np.vstack(bags), np.cumsum([0, *map(len, bags[:-1])]), label)


def scores(model: dict | float, texts: list[str | None]) -> np.ndarray:
    """The score of each text, from 0 to 1; passages of a batch are encoded in blocks."""
    out = np.full(len(texts), model if isinstance(model, float) else 0.5)
    if isinstance(model, float):
        return out
    i = 0
    while i < len(texts):
        parts, start, j = [], [], i
        while j < len(texts) and len(parts) < 1024:
            start.append(len(parts))
            parts += passages(texts[j])
            j += 1
        x = np.vstack([(encode(parts[k : k + 1024]) - model["mean"]) / model["spread"] for k in range(0, len(parts), 1024)])
        out[i:j] = np.round(forward(model, x, np.array(start))["y"].astype(float), 5)  # single precision: equal texts score alike in any block
        i = j
    return out


def score(documents: DataFrame, model: dict | float, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """documents' doc_id (or the columns keep) with score and predicted."""
    small_batches(documents.sparkSession)
    cols = keep or ["doc_id"]
    rows = documents.select(*cols, *[] if "text" in cols else ["text"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cols).schema.fields) + ", score double"

    def scored(batches):
        for b in batches:
            y = scores(model, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(y, pa.float64())], [*cols, "score"])

    return rows.mapInArrow(tidied(scored), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality_classifier(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
