"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by source, language and topic; the cells' weights are raked,
one margin after the other, until the weighted margins meet their targets; then
each document is kept with a probability in proportion to its cell's weight,
drawn from a hash of its id, so the draw is the same wherever it runs.

Tokens are those of a byte-level BPE. Topics are learnt from all documents: a
document is the logarithms of its words' counts over DIMS hashed places, its
language's mean is taken off, so that topics cut across languages, however many
there are, and spherical k-means groups what is left into TOPICS; sums are whole
numbers, so the topics don't depend on the order of tasks. Only its start is drawn from START rows.

Targets default to the observed shares to the power of TEMPER, which lifts small
sources and holds back a hot one. Probabilities are scaled so that KEEP of all
tokens are expected; a cell whose probability would pass 1 is kept whole and
reported as capped, and the others are scaled up for it.

Every source and language is a margin of its own, however many there are. Up to
MAX_CELLS cells are raked on the driver; more stay where they are, in one row a
source, and the driver holds factors of languages and topics alone. Both meet
the same margins, up to rounding.

Targets go by the columns' own values (None for null): {"source": {"web": 0.5,
...}}; a value without a target in a margin that has some gets none.

Edge cases: null and empty texts have no tokens and topic 0; very long texts are
read whole; null sources and languages are margins of their own; repeated rows are
drawn alike; an empty table gives no rows; other columns, whatever their names,
stay as they are in draw() and don't matter elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, tidied
from .token_counts import Encoder

TEMPER, KEEP, SEED = 0.7, 0.8, 17
TOPICS = 8
#: Cells that the driver rakes by itself.
MAX_CELLS = 150_000
#: Places that words are hashed to, rounds of k-means, rows that it starts from.
DIMS, ROUNDS, START = 128, 6, 512
#: Languages whose means, a KB each, may be sent to every task; more are joined by a shuffle, with the same result.
LANGUAGES_SENT = 4096
#: Words of fewer letters say nothing of a topic.
TOPIC_LETTERS = 4
MARGINS = ("source", "lang", "topic")


def vectors(texts: list[str | None]) -> np.ndarray:
    """Each document's words as whole numbers from 0 to 127 over DIMS places, of length 127 about."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = (t or "").lower().split()
        counts[i] = len(own)
        words += own
    told = np.fromiter(map(len, words), np.int64, len(words)) >= TOPIC_LETTERS
    place = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % DIMS
    row = np.repeat(np.arange(len(texts)), counts)
    x = np.log1p(np.bincount((row * DIMS + place)[told], minlength=len(texts) * DIMS)[: len(texts) * DIMS].reshape(len(texts), DIMS))
    return np.round(127 * x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)).astype(np.int8)


def described(documents: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """columns with n_tokens and vec for every document."""
    import public_tokenizers

    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [encoder.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in vectors(texts)], pa.binary())], names=[*columns, "n_tokens", "vec"])

    rows = documents.select(*columns, *(["text"] if "text" not in columns else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*columns).schema.fields)
    return rows.mapInArrow(tidied(run), f"{schema}, n_tokens long, vec binary")


def rows_of(column: pa.Array, kind: type = np.int8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, DIMS).astype(float)


def language_means(slim: DataFrame) -> DataFrame:
    """(of, sums) of every language: its rows' vectors added up and, last, the number of those that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            of = [v for v in total for _ in range(DIMS + 1)]
            return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(np.tile(np.arange(DIMS + 1), len(total)), pa.int32()), pa.array(np.concatenate(list(total.values())).astype(np.int64))], names=["of", "d", "x"])

        for b in batches:
            x, langs = rows_of(b.column("vec")), b.column("lang").to_pylist()
            x = np.hstack([x, x.any(1, keepdims=True)])
            names = {v: i for i, v in enumerate(dict.fromkeys(langs))}
            own = np.array([names[v] for v in langs], np.int64)
            for v, i in names.items():
                total[v] = total.get(v, 0) + x[own == i].sum(0)
            if len(total) > LANGUAGES_SENT:
                yield told()
                total.clear()
        if total:
            yield told()

    sums = slim.select("lang", "vec").mapInArrow(tidied(run), "of string, d int, x long").groupBy("of", "d").agg(F.sum("x").alias("x"))
    return sums.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s.x).alias("sums"))


def with_sums(rows: DataFrame, lang: str, means: DataFrame) -> DataFrame:
    """rows with the sums of their language; means of few languages are sent to every task, those of more are joined as the optimizer sees fit."""
    means = F.broadcast(means) if means.count() <= LANGUAGES_SENT else means
    rows = rows.join(means, F.col(lang).eqNullSafe(F.col("of")), "left").drop("of")
    return rows.withColumn("sums", F.coalesce("sums", F.array_repeat(F.lit(0).cast("long"), DIMS + 1)))


def residuals(x: np.ndarray, sums: pa.Array) -> np.ndarray:
    """Rows without their language's mean, in thousandths, of length 1000 about; empty ones stay 0."""
    s = sums.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS + 1).astype(float)
    x = np.where(x.any(1, keepdims=True), x - s[:, :DIMS] / np.maximum(s[:, DIMS:], 1), 0)
    return np.round(1000 * x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9))


def topics_of(rest: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(np.round(rest @ centres.T / 1000, 9), 1) if len(rest) else np.zeros(0, np.int64)


def without_means(slim: DataFrame, means: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """columns with rest, the residuals, of every row of a table with lang and vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = residuals(rows_of(b.column("vec")), b.column("sums")).astype(np.int16)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array([r.tobytes() for r in rest], pa.binary())], names=[*columns, "rest"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*columns).schema.fields)
    return with_sums(slim, "lang", means).mapInArrow(tidied(run), f"{schema}, rest binary")


def learnt(rows: DataFrame) -> np.ndarray:
    """The topics' centres, from rows with rest."""
    some = rows.select("rest").orderBy(F.xxhash64("rest"), "rest").limit(START).toArrow().column("rest")
    if not len(some):
        return np.zeros((TOPICS, DIMS))
    first = rows_of(some, np.int16) / 1000
    # rows that lie far apart, one after the other
    pick = [int(np.argmax((first * first).sum(1)))]
    for _ in range(1, TOPICS):
        pick.append(int(np.argmin(np.round((first @ first[pick].T).max(1), 9))))
    centres = first[pick]
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros((TOPICS, DIMS), np.int64)
            for b in batches:
                rest = rows_of(b.column("rest"), np.int16)
                own = topics_of(rest, centres)
                for k in np.unique(own):
                    total[k] += rest[own == k].sum(0).astype(np.int64)
            k, d = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(d, pa.int32()), pa.array(total[k, d])], names=["k", "d", "x"])

        sums = np.zeros((TOPICS, DIMS))
        for r in rows.select("rest").mapInArrow(tidied(run), "k int, d int, x long").groupBy("k", "d").agg(F.sum("x").alias("x")).collect():  # TOPICS times DIMS rows at most
            sums[r.k, r.d] = r.x
        moved = np.where(sums.any(1, keepdims=True), sums, centres)
        centres = moved / np.maximum(np.sqrt((moved * moved).sum(1, keepdims=True)), 1e-9)
    return centres


def rake(cells: list[tuple], tokens: np.ndarray, targets: dict[str, dict] | None = None, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """A weight for each cell, so that weighted tokens meet the margins' target shares (of MARGINS, in order)."""
    tokens = np.asarray(tokens, float)
    total = tokens.sum()
    if not cells or total <= 0:
        return np.ones(len(cells))
    margins = []
    for m, name in enumerate(MARGINS):
        values = sorted({c[m] for c in cells}, key=lambda v: (v is None, v))
        at = {v: i for i, v in enumerate(values)}
        own = np.array([at[c[m]] for c in cells])
        seen = np.bincount(own, tokens, len(values))
        share = np.array([targets[name].get(v, 0.0) for v in values]) if targets and name in targets else np.where(seen > 0, seen / max(total, 1), 0) ** TEMPER * (seen > 0)
        margins.append((own, share / max(share.sum(), 1e-300)))
    weight = np.ones(len(cells))
    for _ in range(rounds):
        worst = 0.0
        for own, share in margins:
            now = np.bincount(own, weight * tokens, len(share)) / max(total, 1e-300)
            factor = np.where(now > 0, share / np.where(now > 0, now, 1), 1.0)
            worst = max(worst, float(np.abs(now - share).max(initial=0)))
            weight = weight * factor[own]
        if worst < tolerance:
            break
    return weight


def probabilities(weight: np.ndarray, tokens: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """min(1, scale * weight), scaled so that keep of all tokens are expected."""
    low, high = 0.0, 1.0 / max(weight[weight > 0].min(initial=1.0), 1e-12)
    for _ in range(200):
        mid = (low + high) / 2
        if (np.minimum(1, mid * weight) * tokens).sum() < keep * tokens.sum():
            low = mid
        else:
            high = mid
    return np.minimum(1, high * weight)


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def shares(values: list, seen: np.ndarray, goal: dict | None) -> np.ndarray:
    """Target shares of a margin's values, as rake() has them."""
    share = np.array([goal.get(v, 0.0) for v in values]) if goal is not None else np.where(seen > 0, seen / max(seen.sum(), 1), 0) ** TEMPER * (seen > 0)
    return share / max(share.sum(), 1e-300)


def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one row a source: the row, place and tokens of each cell, and the rows' targets."""
    held = b.column("held")
    flat = held.flatten()
    owner = np.repeat(np.arange(b.num_rows), np.diff(held.offsets.to_numpy()))
    return owner, flat.field("at").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False).astype(float), b.column("goal").to_numpy(zero_copy_only=False)


def factors(owner: np.ndarray, at: np.ndarray, n: np.ndarray, goal: np.ndarray, f: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each source under the factors f of languages and topics, and the source's own factor that meets its target."""
    held = np.bincount(owner, n * f[at], len(goal))
    return held, np.where(held > 0, goal * total / np.where(held > 0, held, 1), 1.0)


def raked(cells: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, rounds: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """(source, lang, topic, weight, probability) of cells with n, as rake() and probabilities() give them, without all cells on the driver.

    A weight is the product of a factor of its source, one of its language and one
    of its topic, and a source's factor follows from the others and its own cells;
    so a round is one pass over sources that brings sums by language and topic.
    """
    spark, targets = cells.sparkSession, targets or {}
    langs, topics = ([(r[0], r.n) for r in cells.groupBy(c).agg(F.sum("n").alias("n")).orderBy(c).collect()] for c in ("lang", "topic"))
    total = float(sum(n for _, n in topics))
    if total <= 0:
        return cells.select("source", "lang", "topic", F.lit(1.0).alias("weight"), F.lit(0.0).alias("probability"))
    lang_share = shares([v for v, _ in langs], np.array([n for _, n in langs], float), targets.get("lang"))
    topic_share = np.zeros(TOPICS)
    topic_share[[v for v, _ in topics]] = shares([v for v, _ in topics], np.array([n for _, n in topics], float), targets.get("topic"))
    index = F.broadcast(spark.createDataFrame([(v, j) for j, (v, _) in enumerate(langs)], "of string, j int"))
    placed = cells.join(index, F.col("lang").eqNullSafe(F.col("of"))).select("source", (F.col("j") * TOPICS + F.col("topic")).alias("at"), "n")
    sources = checkpointed(placed.groupBy("source").agg(F.collect_list(F.struct("at", "n")).alias("held"), F.sum("n").alias("seen")))
    if "source" in targets:
        goal = F.broadcast(spark.createDataFrame([(v, float(x)) for v, x in targets["source"].items()], "named string, goal double"))
        sources = sources.join(goal, F.col("source").eqNullSafe(F.col("named")), "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
    else:
        sources = sources.withColumn("goal", F.when(F.col("seen") > 0, F.pow(F.col("seen") / total, F.lit(TEMPER))).otherwise(0.0))
    whole = max(sources.agg(F.sum("goal")).first()[0], 1e-300)
    sources = checkpointed(sources.select("source", "held", (F.col("goal") / whole).alias("goal")))

    def passed(f: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, worst = np.zeros(len(f)), 0.0
            for b in batches:
                if b.num_rows:
                    owner, at, n, goal = arrays(b)
                    held, a = factors(owner, at, n, goal, f, total)
                    old = 1.0 if before is None else factors(owner, at, n, goal, before, total)[1]
                    worst = max(worst, float(np.abs(old * held / total - goal).max()))
                    sums += np.bincount(at, a[owner] * n, len(f))
            k = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1), pa.int64()), pa.array(np.append(sums[k], worst), pa.float64())], names=["k", "x"])

        out, worst = np.zeros(len(f)), 0.0
        for r in sources.select("held", "goal").mapInArrow(tidied(run), "k long, x double").groupBy("k").agg(F.sum("x").alias("x"), F.max("x").alias("most")).collect():
            if r.k < 0:
                worst = r.most
            else:
                out[r.k] = r.x
        return out.reshape(-1, TOPICS), worst

    by_lang, by_topic = np.ones(len(langs)), np.ones(TOPICS)
    f, before = np.outer(by_lang, by_topic).ravel(), None
    for _ in range(rounds):
        sums, worst = passed(f, before)
        before = f
        for axis, (own, share) in enumerate(((by_lang, lang_share), (by_topic, topic_share))):
            now = own * (sums @ by_topic if axis == 0 else by_lang @ sums) / total
            worst = max(worst, float(np.abs(now - share).max(initial=0)))
            own *= np.where(now > 0, share / np.where(now > 0, now, 1), 1.0)
        f = np.outer(by_lang, by_topic).ravel()
        if worst < tolerance:
            break

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                owner, at, n, goal = arrays(b)
                w = factors(owner, at, n, goal, before, total)[1][owner] * f[at]
                yield pa.RecordBatch.from_arrays([b.column("source").take(pa.array(owner)), pa.array(at, pa.int32()), pa.array(n, pa.float64()), pa.array(w, pa.float64())], names=["source", "at", "n", "weight"])

    weights = checkpointed(sources.mapInArrow(tidied(weighed), "source string, at int, n double, weight double"))
    least = weights.where("weight > 0").agg(F.min("weight")).first()[0]
    low, high = 0.0, 1.0 / max(min(1.0, 1.0 if least is None else least), 1e-12)
    for _ in range(16):  # each pass tries 255 scales at once
        scales = low + (high - low) * np.arange(1, 256) / 256

        def kept(batches: Iterator[pa.RecordBatch], scales: np.ndarray = scales) -> Iterator[pa.RecordBatch]:
            x = np.zeros(len(scales))
            for b in batches:
                w, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("weight", "n"))
                x += np.minimum(1, scales[:, None] * w) @ n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)), pa.int64()), pa.array(x, pa.float64())], names=["k", "x"])

        got = sorted(tuple(r) for r in weights.select("weight", "n").mapInArrow(tidied(kept), "k long, x double").groupBy("k").agg(F.sum("x")).collect())
        i = next((k for k, x in got if x >= keep * total), len(scales))
        low, high = (low if i == 0 else float(scales[i - 1])), (high if i == len(scales) else float(scales[i]))
        if high - low <= 1e-15 * high:
            break
    named = weights.withColumn("j", F.floor(F.col("at") / TOPICS).cast("int")).join(index, "j")
    return named.select("source", F.col("of").alias("lang"), (F.col("at") % TOPICS).cast("int").alias("topic"), "weight", F.least(F.lit(1.0), high * F.col("weight")).alias("probability"))


def weighted(cells: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, weight, probability) of every cell (source, lang, topic, n)."""
    cells = checkpointed(cells)
    if cells.count() > MAX_CELLS:
        return raked(cells, targets, keep)
    found = sorted(cells.collect(), key=lambda r: [(v is None, v) for v in r[:3]])
    names, tokens = [tuple(r[:3]) for r in found], np.array([r.n for r in found], float)
    weight = rake(names, tokens, targets)
    p = probabilities(weight, tokens, keep) if len(names) else weight
    table = cells.sparkSession.createDataFrame([(*c, float(w), float(q)) for c, w, q in zip(names, weight, p, strict=True)], "source string, lang string, topic int, weight double, probability double")
    return F.broadcast(table)


def with_topic(rows: DataFrame, centres: np.ndarray, columns: tuple[str, ...]) -> DataFrame:
    """columns with the topic of every row of a table with rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topic = topics_of(rows_of(b.column("rest"), np.int16), centres)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(topic, pa.int32())], names=[*columns, "topic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields)
    return rows.select(*columns, "rest").mapInArrow(tidied(run), f"{schema}, topic int")


def cells_of(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    return with_topic(rows, centres, ("source", "lang", "n_tokens")).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n"))


def mixed(documents: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP) -> DataFrame:
    """doc_id, source, lang, n_tokens, topic, weight, probability, capped, sampled for every document."""
    small_batches(documents.sparkSession)
    slim = checkpointed(described(documents, ("doc_id", "source", "lang")))
    slim = checkpointed(without_means(slim, checkpointed(language_means(slim)), ("doc_id", "source", "lang", "n_tokens")))
    centres = learnt(slim)
    table = weighted(cells_of(slim, centres), targets, keep).select(*(F.col(c).alias(f"cell_{c}") for c in MARGINS), "weight", "probability")
    same = [F.col(c).eqNullSafe(F.col(f"cell_{c}")) for c in MARGINS]
    rows = with_topic(slim, centres, ("doc_id", "source", "lang", "n_tokens")).join(table, same[0] & same[1] & same[2])
    return rows.select("doc_id", "source", "lang", "n_tokens", "topic", "weight", "probability", (F.col("probability") >= 1).alias("capped"), (uniform(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def draw(documents: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP) -> DataFrame:
    """The documents drawn, with their own columns, whatever these are named."""
    small_batches(documents.sparkSession)
    columns = documents.columns
    slim = checkpointed(described(documents, ("source", "lang")))
    means = checkpointed(language_means(slim))
    slim = checkpointed(without_means(slim, means, ("source", "lang", "n_tokens")))
    centres = learnt(slim)
    table = weighted(cells_of(slim, centres), targets, keep).select(*MARGINS, "probability")
    own = {c: f"c{i}" for i, c in enumerate(columns)}  # names that can't clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors(b.column(own["text"]).to_pylist()).astype(float)
            topic = topics_of(residuals(x, b.column("sums")), centres)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own.values()), pa.array(topic, pa.int32())], names=[*own.values(), "own_topic"])

    rows = documents.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = with_sums(rows, own["lang"], means).mapInArrow(tidied(run), f"{schema}, own_topic int")
    same = F.col(own["source"]).eqNullSafe(F.col("source")) & F.col(own["lang"]).eqNullSafe(F.col("lang")) & (F.col("own_topic") == F.col("topic"))
    rows = rows.join(table, same).where(uniform(F.col(own["doc_id"])) < F.col("probability"))
    return rows.select(*(F.col(x).alias(c) for c, x in own.items()))


def op7_mixing(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, n_tokens, topic, weight, probability, capped, sampled for every document."""
    return mixed(documents)
