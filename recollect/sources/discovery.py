"""Which transcripts of a dialect are sessions: files by their first lines, policy, one copy of each session, the newest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy
from . import logs, tailing, transcripts
from .transcripts import as_text, field, session_of

#: Bytes at the beginning of a file that tell what it is.
HEAD = 262_144


def heads(spark: SparkSession, dialect: str, root: str) -> DataFrame:
    """(path, mtime, size, session_id, cwd, entrypoints, subagent, executed) of every transcript, from its first lines alone."""
    tailing.register(spark)
    rows = spark.read.format(dialect).option("headBytes", HEAD).load(root)
    files = rows.groupBy("path").agg(F.max("mtime").alias("mtime"), F.max("file_size").alias("size"))
    rows = transcripts.tailed(rows)
    cwd = F.coalesce(field("$.cwd"), field("$.payload.cwd"))
    entry = F.nullif(F.trim(as_text("$.entrypoint")), F.lit(""))
    meta = F.when(as_text("$.type") == "session_meta", F.struct(
        field("$.payload.id").alias("id"), F.coalesce(field("$.payload.thread_source"), F.when(field("$.payload.source.subagent", "variant").isNotNull(), "subagent"), F.lit("")).alias("thread"),
        F.coalesce(field("$.payload.originator"), F.lit("")).alias("originator"), F.coalesce(field("$.payload.source"), F.lit("")).alias("source")))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    told = rows.groupBy("path").agg(
        first(cwd).alias("cwd"), F.array_sort(F.collect_set(entry)).alias("entrypoints"), first(meta).alias("m"),
        F.coalesce(F.bool_or(field("$.isSidechain", "boolean") | field("$.agentId").isNotNull()), F.lit(False)).alias("sidechain"))
    out = files.join(told, "path", "left")
    subagent = F.contains("path", F.lit("/subagents/")) | F.coalesce("sidechain", F.lit(False)) | F.coalesce(F.contains(F.lower("m.thread"), F.lit("subagent")), F.lit(False))
    executed = F.coalesce(policy.exec_origin(F.coalesce("m.source", F.lit("")), F.coalesce("m.originator", F.lit("")), F.coalesce("cwd", F.lit(""))) == "automated", F.lit(False)) if dialect == "codex" else F.lit(False)
    session = F.coalesce(F.nullif("m.id", F.lit("")), session_of(F.col("path")))
    return out.select("path", "mtime", "size", session.alias("session_id"), F.coalesce("cwd", F.lit("")).alias("cwd"), F.coalesce("entrypoints", F.array().cast("array<string>")).alias("entrypoints"), subagent.alias("subagent"), executed.alias("executed"))


def discovered(spark: SparkSession, dialect: str, root: str, allowed: Callable[[Column, Column], Column] | None = None, executed: bool = True, max_files: int = 0) -> DataFrame:
    """heads() of the transcripts to be read: no subagents', none that the policy (of cwd and entrypoints) leaves out, and nothing that a program ran unless executed.

    Of copies of a session the newest counts, of a conversation's transcripts the
    full one, then the largest. The cap of max_files is on what is left, so that
    excluded files take no places in it.
    """
    rows = heads(spark, dialect, root).where("not subagent")
    if not executed:
        rows = rows.where("not executed")
    if allowed is not None:
        rows = rows.where(F.coalesce(allowed(F.col("cwd"), F.col("entrypoints")), F.lit(False)))
    if dialect == "antigravity":
        files = rows.select(F.col("session_id").alias("conversation"), F.col("path").endswith("/transcript_full.jsonl").alias("is_full"), "size", "path")
        rows = rows.join(logs.best_transcripts(files).select("path"), "path", "left_semi")
    else:
        rows = logs.newest_copies(rows.withColumn("updated_at", F.col("mtime")).withColumn("file_path", F.col("path"))).drop("updated_at", "file_path")
    return rows.orderBy(F.desc("mtime"), "path").limit(max_files) if max_files > 0 else rows


def sessions(spark: SparkSession, dialect: str, root: str, allowed: Callable[[Column, Column], Column] | None = None, executed: bool = True, max_files: int = 0) -> DataFrame:
    """The sessions of what is discovered below root."""
    found = discovered(spark, dialect, root, allowed, executed, max_files)
    rows = spark.read.format(dialect).load(root).join(found.select("path"), "path", "left_semi")
    return transcripts.sessions_in(dialect, transcripts.tailed(rows), executed)
