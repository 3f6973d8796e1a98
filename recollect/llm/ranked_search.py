"""Ranked lexical search: the documents that score highest for each item.

Postings are a DataFrame whose rows lie in buckets by term; a term's rows are dealt
over SLOTS buckets by document, so that no bucket holds a very frequent term whole.
They are written once to the shared folder. Items' terms are joined with them, each
match gets an integer score, item and document are summed up, and a window numbers
the best.

Postings move twice: to their buckets, and from there to the tasks of their
documents, where all matches of a document meet, so that the sums of item and
document, far more rows than there are postings, never move. SEEDS terms of an item
that score highest give it a floor, which k documents reach by these terms alone; only
sums that reach it go on to the window. That leaves out no document and no tie.

Edge cases: null and empty texts have no terms and are no documents for the counts;
equal rows count once, different texts of one doc_id are documents of their own (of
equal scores the lesser text hash comes first); rows without doc_id or item_id take
no part; the terms of all rows of one item_id are that item's; very long texts are
read whole; terms that every document holds weigh 0 or little and may leave an item
with few documents or none; empty tables give no rows; other columns are dropped.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, n_partitions, shared_folder, small_batches, tidied

#: A term: the longest run of ASCII digits and letters and of everything outside of ASCII, in UTF-8 bytes.
TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BUCKETS, SLOTS = 4096, 16
#: Distinct terms of items that go to the tasks, rows of (item, term) that are broadcast at most; beyond them joins shuffle.
WANTED, BROADCAST = 200_000, 400_000
#: Terms of an item whose documents give the score to reach; matches that a task sums up.
SEEDS, MATCHES = 8, 4_000_000
#: Postings that a task gathers before it hands them on.
ROWS = 50_000
COUNTED = "term binary, doc_id long, text_key long, tf long, n long"


def counted(docs: DataFrame, wanted: list[bytes] | None = None) -> DataFrame:
    """(term, doc_id, text_key, tf, n) of every text of docs (doc_id, text), and a row with an empty term for each text that has terms; wanted: of these terms alone."""
    held = docs.sparkSession.sparkContext.broadcast(frozenset(wanted)) if wanted is not None else None

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["term", "doc_id", "text_key", "tf", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, rows = re.compile(TERM).findall, [[], [], [], [], []]
        only = held.value if held else None
        for b in batches:
            for doc, key, text in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                words = find(text.as_buffer().to_pybytes().translate(LOWER)) if text.is_valid else ()
                if not words:
                    continue
                own = Counter(words)
                terms = [b"", *own] if only is None else [b"", *(t for t in own if t in only)]
                rows[0] += terms
                rows[1] += [doc] * len(terms)
                rows[2] += [key] * len(terms)
                rows[3] += map(own.__getitem__, terms)  # a Counter has 0 of the empty term
                rows[4] += [len(words)] * len(terms)
                if len(rows[0]) >= ROWS:
                    yield batch(rows)
                    rows = [[], [], [], [], []]
        yield batch(rows)

    small_batches(docs.sparkSession)
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidied(run), COUNTED)


def postings(docs: DataFrame, wanted: list[bytes] | None = None) -> DataFrame:
    """counted() with each row once, in buckets by term and slot, in the shared folder."""
    rows = counted(docs, wanted).withColumn("bucket", F.pmod(F.xxhash64("term", F.pmod("text_key", F.lit(SLOTS))), F.lit(BUCKETS)).cast("int"))
    rows = rows.repartition("bucket").groupBy("bucket", "term", "doc_id", "text_key").agg(F.max("tf").alias("tf"), F.max("n").alias("n"))
    path = f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    rows.sortWithinPartitions("bucket", "term").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of the highest scores above 0 for each item (item_id, text), ties to the smaller doc_id."""
    spark = docs.sparkSession
    own = counted(items.select(F.col("item_id").alias("doc_id"), "text")).where("term != X''").select(F.col("doc_id").alias("item_id"), "term").distinct()
    own = checkpointed(own)
    terms = own.select("term").distinct()
    few = terms.count() <= WANTED
    held = postings(docs, [bytes(r.term) for r in terms.collect()] if few else None)
    docs_n, words_n = held.where("term = X''").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    m = f"(10 + (90 * n * {docs_n}L) div {words_n}L)"
    matches = held.where("term != X''").select("term", "doc_id", "text_key", F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * {m})").alias("part"))
    if not few:
        matches = matches.join(terms, "term", "left_semi")

    weight = F.floor(1000 * F.log(F.lit(2.0 * docs_n + 2) / (2 * F.col("df") + 1))).cast("long")
    known = matches.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most")).select("term", "df", weight.alias("w"), "most").where("w > 0")
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc(F.col("w") * F.col("most")), "term"))
    asked = checkpointed(own.join(known, "term").select("item_id", "term", "df", "w", place.alias("place")))
    n, made = asked.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    # asked goes to every task if its size is within the bound, by a shuffle on the term else
    sent = (lambda rows: F.broadcast(rows)) if n <= BROADCAST else (lambda rows: rows)
    key = ["item_id", "doc_id", "text_key"]
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "text_key")

    seeds = matches.join(sent(asked.where(F.col("place") <= SEEDS).select("item_id", "term", "w")), "term").groupBy(*key).agg(F.sum(F.col("w") * F.col("part")).alias("score"))
    seeds = seeds.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    floor = seeds.select("item_id", F.col("score").alias("floor"))
    asked = checkpointed(asked.join(floor, "item_id", "left").select("item_id", "term", "w", F.coalesce("floor", F.lit(1)).alias("floor")))

    tasks = max(n_partitions(spark), made // MATCHES)
    total = matches.repartition(tasks, "doc_id").join(sent(asked), "term").groupBy(*key).agg(F.sum(F.col("w") * F.col("part")).alias("score"), F.max("floor").alias("floor"))
    out = total.where("score >= floor").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best documents for each item."""
    return ranked(docs, items, 10)


def term_sql(table: str, key: str) -> str:
    """SELECT of (key, text, term) of every term of a table, with repeats."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return rf"SELECT {key}, text, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT {key}, text FROM {table} WHERE {key} IS NOT NULL)"


ORACLE = f"""WITH words AS ({term_sql('documents', 'doc_id')}), size AS (SELECT doc_id, text, count(*) AS n FROM words GROUP BY ALL),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM size), post AS (SELECT doc_id, text, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), asked AS (SELECT DISTINCT item_id, term FROM ({term_sql('benchmark', 'item_id')})),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM asked JOIN df USING (term), whole),
scored AS (SELECT item_id, doc_id, text, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l)))) AS BIGINT) AS score
  FROM w JOIN post USING (term) JOIN size USING (doc_id, text), whole GROUP BY ALL),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 10"""
