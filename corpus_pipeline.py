"""A corpus pipeline: quality, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents, and other columns, whatever their names, are dropped.

Edge cases, for all stages: an empty table gives no rows; null and empty texts are
documents like others; very long texts are read whole; rows with a null doc_id are
documents of their own; each stage says what becomes of repeated rows and ties.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import bpe, mixing, ngram_join, quality, toxicity
from recollect.llm.common import checkpointed, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Doc_ids with several texts that are broadcast at most.
ODD_IDS = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for quality 1; null and empty texts are scored like any other, equal texts have equal scores, so repeated rows stay or go together."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), model, keep=COLUMNS).where("predicted = 1").select(COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic; null and empty texts stay unless nearly all labels say toxic, repeated rows stay or go together."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model, keep=COLUMNS).where("predicted = 0").select(COLUMNS)


def with_nodes(docs: DataFrame) -> DataFrame:
    """docs with node: the doc_id, but a hash of id and text, above 2^62, where the id is null or another text has it too (the text of least hash keeps it)."""
    rows = docs.select(COLUMNS).withColumn("text_hash", F.xxhash64("text", F.col("text").isNull()))
    odd = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("odd_id")).agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least != most")
    odd = checkpointed(odd.select("odd_id", "least"))
    odd = F.broadcast(odd) if odd.count() <= ODD_IDS else odd
    own = F.xxhash64("doc_id", "text", F.lit("node")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    plain = F.col("doc_id").isNotNull() & (F.col("odd_id").isNull() | (F.col("text_hash") == F.col("least")))
    return rows.join(odd, F.col("doc_id") == F.col("odd_id"), "left").select(*COLUMNS, F.when(plain, F.col("doc_id")).otherwise(own).alias("node"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least node, so of least doc_id where ids are unique.

    Different texts of one doc_id, and texts without an id, are documents of their
    own; only a row whose text equals a kept one's or is linked to it is dropped, so
    of repeated rows one stays. Null and empty texts are linked with nothing and stay,
    once for each doc_id and kind.
    """
    rows = with_nodes(docs)
    groups = ngram_join.near_duplicates(rows.select(F.col("node").alias("doc_id"), "text"))
    firsts = groups.where("doc_id = component_id").select(F.col("doc_id").alias("node")).distinct()
    return rows.join(firsts, "node").dropDuplicates(["node"]).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities; the draw goes by doc_id, so repeated rows are drawn together, null ids as one; documents without tokens are drawn as their cell is."""
    return mixing.draw(docs.select(COLUMNS)).select(COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text: n_tokens, ids, decoded_sha256; null texts count as empty, repeated rows are encoded each."""
    out = bpe.encode(docs, bpe.vocabulary_path(), decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: The stages learn weights and draw components, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:  # the next one has read what this stage was given
            remove(spark, f"{home}/{k - 1}")
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
