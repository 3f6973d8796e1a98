"""Full-text search over a table with id, title and text: BM25, prefixes, phrases, literals, proximity.

Index is an inverted index on disk, written once in one pass over the texts: a
query looks up its own terms, whose postings hold all that BM25, prefixes and
phrases need, and no text is read again. Without an index, as for the few chunks
of one session, a query counts its own terms in one scan.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .batches import pieces, small, tidied

K1, B = 1.2, 0.75
#: Files over which a term's postings are dealt.
SLOTS = 8


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def equals(t: str):
    return lambda x: x == t


def begins(t: str):
    return lambda x: x.startswith(t)


def back(n: int):
    return lambda x: x - n


def posted(b: pa.RecordBatch) -> pa.RecordBatch:
    """(term, id, tf, len, positions) of a batch (id, low)."""
    find = re.compile(T.TERM).findall
    terms, owner, tf, size, ends, pos = [], [], [], [], [0], []
    for i, low in enumerate(b.column("low").to_pylist()):
        own: dict[str, list[int]] = {}
        words = find(low or "")
        for at, w in enumerate(words):
            own.setdefault(w, []).append(at)
        for term, places in own.items():
            terms.append(term)
            tf.append(len(places))
            pos += places
            ends.append(len(pos))
        owner += [i] * len(own)
        size += [len(words)] * len(own)
    ids = b.column("id").take(pa.array(owner, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), ids, pa.array(tf, pa.int32()), pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32()))], names=["term", "id", "tf", "len", "positions"])


def postings(rows: DataFrame) -> DataFrame:
    """(term, id, tf, len, positions): the inverted index; a row's words are counted where the row is, so that nothing but postings moves, in pieces, so that a Python worker's memory doesn't grow with a partition."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, "low"):
                yield posted(piece)

    return rows.select("id", F.lower("text").alias("low")).mapInArrow(tidied(run), f"term string, id {kind}, tf int, len int, positions array<int>")


class Index:
    """Postings of a table, sorted by term and id in files, so that a look-up reads the row groups of its terms alone; a common term lies in several files."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings = spark.read.parquet(f"{path}/postings")
        self.stats = spark.read.parquet(f"{path}/stats")

    @staticmethod
    def write(rows: DataFrame, path: str) -> Index:
        """The index of rows (id, text) at path."""
        # dealt by hash, as ranges would count all words once more to find their bounds; a common term lies in SLOTS files
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        with small(rows.sparkSession):
            postings(rows).repartition(n, "term", F.pmod(F.xxhash64("id"), F.lit(SLOTS))).sortWithinPartitions("term", "id").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
        lengths = rows.select(F.size(T.terms(F.col("text"))).alias("len"))
        lengths.agg(F.count("*").alias("docs"), F.avg("len").alias("mean_len")).write.mode("overwrite").parquet(f"{path}/stats")
        return Index(rows.sparkSession, path)

    def counted(self, terms: list[str], prefix: bool = False) -> DataFrame:
        """(id, len, tf0, tf1, ...) of the rows that hold any of terms."""
        test = [F.col("term").startswith(t) if prefix else F.col("term") == t for t in terms]
        hits = self.postings.where(reduce(lambda a, b: a | b, test, F.lit(False)))
        return hits.groupBy("id").agg(F.max("len").alias("len"), *(F.coalesce(F.sum(F.when(c, F.col("tf"))), F.lit(0)).cast("int").alias(f"tf{i}") for i, c in enumerate(test)))

    def scored(self, terms: list[str], prefix: bool = False) -> DataFrame:
        """counted() with bm25 (larger is better)."""
        rows = self.counted(terms, prefix)
        df = rows.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
        return weighed(rows.crossJoin(F.broadcast(self.stats)).crossJoin(F.broadcast(df)), len(terms))  # one row each

    def phrase(self, words: list[str]) -> DataFrame:
        """(id, hits): the rows that hold the words one after the other, and how often (not overlapping)."""
        hits = self.postings.where(F.col("term").isin(list(set(words))))
        held = hits.groupBy("id").agg(*(F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(words)))
        begin = F.col("p0")
        for i in range(1, len(words)):
            begin = F.array_intersect(begin, F.transform(f"p{i}", back(i)))
        apart = F.aggregate(F.array_sort(begin), F.struct(F.lit(0).alias("n"), F.lit(-len(words)).alias("last")), lambda s, p: F.when(p >= s["last"] + len(words), F.struct((s["n"] + 1).alias("n"), p.alias("last"))).otherwise(s))["n"]
        return held.select("id", apart.alias("hits")).where("hits > 0")


_WRITTEN: dict[tuple[str, str], tuple[tuple, str]] = {}


def state(rows: DataFrame) -> tuple:
    """What rows are made of: the plan, and the time and length of each file that it reads."""
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    files = []
    for f in sorted(rows.inputFiles()):
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(f))
        status = place.getFileSystem(conf).getFileStatus(place)
        files.append((f, status.getModificationTime(), status.getLen()))
    return (rows.semanticHash(), *files)


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine in a local session without it, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/") or tempfile.mkdtemp(prefix="index")


def indexed(rows: DataFrame, name: str) -> Index:
    """The index of rows, written when this application first asks for name or rows have changed since; the one before is removed."""
    spark = rows.sparkSession
    key, now = (spark.sparkContext.applicationId, name), state(rows)
    held, path = _WRITTEN.get(key, (None, ""))
    if held != now:
        if path:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        path = f"{shared(spark)}/index-{uuid.uuid4().hex}"
        Index.write(rows.select("id", "text"), path)
        _WRITTEN[key] = now, path
    return Index(spark, path)


def counted(rows: DataFrame, terms: list[str], prefix: bool = False, column: str = "text") -> DataFrame:
    """rows with len, the number of terms, and tf0, tf1, ... the occurrences of each of terms."""
    w = T.terms(F.col(column))
    rows = rows.withColumn("words", w).withColumn("len", F.size("words"))
    for i, t in enumerate(terms):
        rows = rows.withColumn(f"tf{i}", F.size(F.filter("words", begins(t) if prefix else equals(t))))
    return rows.drop("words")


def weighed(rows: DataFrame, n: int) -> DataFrame:
    """rows with len, tf0.. and the corpus' docs, mean_len, df0.. to rows with bm25."""

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))

    return rows.withColumn("bm25", total([part(i) for i in range(n)]))


def scored(rows: DataFrame | Index, terms: list[str], prefix: bool = False) -> DataFrame:
    """counted rows that hold a term, with bm25 (larger is better)."""
    if isinstance(rows, Index):
        return rows.scored(terms, prefix)
    rows = counted(rows, terms, prefix)
    n = len(terms)
    stats = rows.agg(F.count("*").alias("docs"), F.avg("len").alias("mean_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n)))
    return weighed(rows.where(total([F.col(f"tf{i}") for i in range(n)]) > 0).crossJoin(F.broadcast(stats)), n)  # stats is one row


def bm25(rows: DataFrame | Index, terms: list[str], limit: int = 10, prefix: bool = False) -> DataFrame:
    """(id, score): the best rows for any of the terms."""
    best = scored(rows, terms, prefix).select("id", F.round("bm25", 4).alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(limit)


def phrase(rows: DataFrame | Index, words: list[str]) -> DataFrame:
    """Rows that hold the words one after the other, with the number of times."""
    if isinstance(rows, Index):
        return rows.phrase(words)
    joined = F.concat(F.lit(" "), F.array_join(T.terms(F.col("text")), "  "), F.lit(" "))
    needle = " " + "  ".join(words) + " "
    return rows.withColumn("hits", T.occurrences(joined, needle)).where("hits > 0")


def literal(rows: DataFrame, needle: str, newest: int | None = 5000, order: str = "id") -> DataFrame:
    """Rows that hold the literal in any case, of the newest ones that do (None: all), with score 100 + 10 * min(count, 5)."""
    low = F.lower("text")
    hits = rows.where(F.contains(low, F.lit(needle.lower())))
    hits = hits if newest is None else hits.orderBy(F.desc(order)).limit(newest)
    return hits.withColumn("score", 100 + 10 * F.least(T.occurrences(low, needle.lower()), F.lit(5)))


def proximity(rows: DataFrame, terms: list[str], width: int = 40) -> DataFrame:
    """(id, best, score): the most distinct terms within width positions; 5 * best**2, 0 under three positions or terms."""
    hits = rows.select("id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term")).where(F.col("term").isin(terms))
    near = W.partitionBy("id").orderBy("pos").rangeBetween(-width, 0)
    hits = hits.withColumn("near", F.size(F.collect_set("term").over(near)))
    best = hits.groupBy("id").agg(F.max("near").alias("best"), F.count("*").alias("n"))
    return best.select("id", "best", F.when((F.col("n") >= 3) & (F.col("best") >= 3), 5 * F.col("best") ** 2).otherwise(0).cast("int").alias("score"))


def strong_enough(matched: Column, terms: list[str], anchors_hit: Column | None) -> Column:
    """Two distinct terms of up to three, three of more, and an anchor if the query has one."""
    least = 1 if len(terms) < 2 else 2 if len(terms) <= 3 else 3
    gate = matched >= least
    return gate & anchors_hit if anchors_hit is not None else gate


def exact_scores(rows: DataFrame, query: str, limit: int = 300, index: Index | None = None) -> DataFrame:
    """(id, score): the best of phrase, literal and gated term scores of each row; with an index only literals and the best rows' proximity read texts."""
    terms = T.match_terms(query)
    held = index or rows
    legs = []
    for words in T.phrase_queries(query):
        if index is None:
            ranked = scored(phrase(rows, words).drop("hits"), words)
        else:  # the rank of a phrase is that of its words among the rows that hold it
            found = index.phrase(words).select("id")
            own = index.counted(words).join(found, "id")
            n = own.agg(F.count("*").alias("docs"), F.avg("len").alias("mean_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
            ranked = weighed(own.crossJoin(F.broadcast(n)), len(words))
        legs.append(ranked.select("id", (180 + 80 / (1 + F.abs("bm25"))).alias("score")))
    if T.needs_literal(query):
        legs.append(literal(rows, T.focus_query(query)).select("id", F.col("score").cast("double").alias("score")))
    ranked = scored(held, terms)
    matched = total([(F.col(f"tf{i}") > 0).cast("int") for i in range(len(terms))])
    anchors = [i for i, t in enumerate(terms) if t in T.anchor_tokens(terms)]
    hit = total([(F.col(f"tf{i}") > 0).cast("int") for i in anchors]) > 0 if anchors else None
    top = ranked.where(strong_enough(matched, terms, hit)).withColumn("matched", matched).orderBy(F.desc("bm25"), "id").limit(limit)
    top = top.select("id", "bm25", "matched")
    close = proximity(rows.join(F.broadcast(top.select("id")), "id", "left_semi"), terms).select("id", F.col("score").alias("prox"))  # limit rows
    legs.append(top.join(close, "id", "left").select("id", (50 / (1 + F.abs("bm25")) + 3 * F.col("matched") ** 2 + F.coalesce("prox", F.lit(0))).alias("score")))
    union = reduce(DataFrame.unionByName, legs)
    best = union.groupBy("id").agg(F.round(F.max("score"), 4).alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(limit)


def instant_hits(rows: DataFrame, query: str, limit: int = 8, session: str = "source_ref", index: Index | None = None) -> DataFrame:
    """Search while typing: the best row of each session by 2 * title prefixes + text prefixes, then bm25; the best sessions."""
    terms = T.index_terms(query, 8)
    ranked = scored(index or rows, terms, prefix=True).select("id", "bm25", *(f"tf{i}" for i in range(len(terms))))
    words = T.terms(F.col("title"))
    title = total([F.exists(words, begins(t)).cast("int") for t in terms])
    text = total([(F.col(f"tf{i}") > 0).cast("int") for i in range(len(terms))])
    found = rows.select("id", session, "title").join(ranked, "id").select("id", session, (2 * title + text).alias("hits"), F.round("bm25", 4).alias("score"))
    # the best of a session is one aggregate, so a session with very many hits is summed up before it moves
    order = F.struct((-F.col("hits")).alias("hits"), (-F.col("score")).alias("score"), "id")
    best = found.groupBy(session).agg(F.min(order).alias("best"))
    out = best.select(F.col("best.id").alias("id"), session, (-F.col("best.hits")).alias("hits"), (-F.col("best.score")).alias("score"))
    return out.orderBy(F.desc("hits"), F.desc("score"), "id").limit(limit)


def document_frequency(rows: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = 1 + ln((N + 1) / (df + 1))."""
    n = rows.agg(F.count("*").alias("n"))
    df = rows.select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(1 + F.log((F.col("n") + 1) / (F.col("df") + 1)), 4).alias("idf"))


def lexical_sessions(rows: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, score): phrase, weighted terms, distinct terms and proximity over one text a session."""
    terms = T.query_tokens(query)
    low = F.lower("text")
    rows = rows.withColumn("words", T.tokens(F.col("text")))
    for i, t in enumerate(terms):
        rows = rows.withColumn(f"c{i}", F.size(F.filter("words", equals(t))))
    stats = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"c{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    d = total([(F.col(f"c{i}") > 0).cast("int") for i in range(len(terms))])
    rows = rows.where(d > 0).crossJoin(F.broadcast(stats))
    weighted = total([F.when(F.col(f"c{i}") > 0, (1 + 0.25 * F.least(f"c{i}", F.lit(2))) * (1 + F.log((F.col("n") + 1) / (F.col(f"df{i}") + 1)))).otherwise(0) for i in range(len(terms))])
    said = query.strip().lower()
    whole = F.when(F.contains(low, F.lit(said)), 50).otherwise(0) if len(said) >= 6 else F.lit(0)
    close = proximity(rows.select("id", "text"), terms).select("id", F.col("score").alias("prox"))
    out = rows.select("id", (whole + weighted + 2 * d * d).alias("base")).join(close, "id", "left")
    return out.select("id", F.round(F.col("base") + F.coalesce("prox", F.lit(0)), 4).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
