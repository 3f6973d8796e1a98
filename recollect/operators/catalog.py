"""Catalogue aggregates over the chunk index: projects, statistics, status, clusters, footprint, threads, people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def project_breakdown(chunks: DataFrame, human: Column, limit: int = 20) -> DataFrame:
    """Sessions, sessions of people, chunks and the last update by source and folder."""
    rows = chunks.withColumn("human", F.when(human, F.col("session_id")))
    out = rows.groupBy("source_name", "cwd").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("human").alias("human_sessions"), F.count("*").alias("chunks"), F.max("updated_at").alias("updated_at"))
    return out.orderBy(F.desc("sessions"), F.desc("chunks"), "source_name", "cwd").limit(limit)


def collapsed_projects(chunks: DataFrame, roots: list[str], limit: int = 20) -> DataFrame:
    """As project_breakdown, with folders below a root counted as the root; the longest root that fits counts."""
    folder = F.col("cwd")
    for r in sorted((r.rstrip("/") for r in roots), key=len):
        folder = F.when(F.col("cwd").startswith(r + "/"), F.lit(r)).otherwise(folder)
    out = chunks.withColumn("folder", folder).groupBy("folder").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("chunks"))
    return out.orderBy(F.desc("sessions"), "folder").limit(limit)


def index_stats(chunks: DataFrame, embedded: Column) -> DataFrame:
    """Sessions, chunks, embedded and missing, in all and by source (null source: all)."""
    rows = chunks.select("source_name", "session_id", embedded.cast("int").alias("e"))
    out = rows.groupingSets([["source_name"], []], "source_name").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("chunks"), F.sum("e").cast("long").alias("embedded"))
    return out.withColumn("missing", F.col("chunks") - F.col("embedded"))


def sync_status(rows: DataFrame) -> DataFrame:
    """By source: rows, the last import, and the hash of the newest row."""
    return rows.groupBy("source_name").agg(F.count("*").alias("records"), F.max("imported_at").alias("imported_at"), F.max_by("content_hash", F.struct("imported_at", "id")).alias("newest_hash"))


def latest_by_ref(rows: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(source_name, source_ref, content_hash, updated_at, record_kind, records, imported_at): the newest import of each session, by which a sync knows what to send; records and imported_at are the source's."""
    rows = rows if sources is None else rows.where(F.lower("source_name").isin([x.lower() for x in sources]))
    order = F.struct("imported_at", "updated_at", "content_hash")
    newest = rows.groupBy("source_name", "source_ref").agg(F.count("*").alias("n"), F.max("imported_at").alias("last"), F.max_by(F.struct("content_hash", "updated_at", "record_kind"), order).alias("b"))
    # a source's totals from its sessions' counts, not from its rows once more
    total = newest.groupBy("source_name").agg(F.sum("n").alias("records"), F.max("last").alias("imported_at"))
    return newest.select("source_name", "source_ref", "b.*").join(total, "source_name")


def project_sessions(chunks: DataFrame, source: str, cwd: str, rooted: bool = False) -> DataFrame:
    """(source_ref, session_id, title, updated_at, chunks, origin) of a folder's sessions, the newest first; rooted: of the folders below it too."""
    here = F.col("cwd") == cwd
    rows = chunks.where((F.col("source_name") == source) & (here | F.col("cwd").startswith(cwd + "/") if rooted else here))
    origin = F.get_json_object("metadata_json", "$.origin") if "metadata_json" in chunks.columns else F.lit(None).cast("string")
    out = rows.groupBy("source_ref").agg(F.max("session_id").alias("session_id"), F.max("title").alias("title"), F.max("updated_at").alias("updated_at"), F.count("*").alias("chunks"), F.max(origin).alias("origin"))
    return out.orderBy(F.desc("updated_at"), "source_ref")


def clusters(rows: DataFrame, metadata: str, path: str) -> DataFrame:
    """Distinct sessions by a value inside the JSON metadata."""
    return rows.groupBy(F.get_json_object(metadata, path).alias("cluster")).agg(F.countDistinct("session_id").alias("sessions"))


def footprint(rows: DataFrame, newest: int = 300) -> DataFrame:
    """Rows, and their bytes as the mean length of the newest rows says."""
    mean = rows.orderBy(F.desc("id")).limit(newest).agg(F.avg(F.length("text")).alias("mean"))
    return rows.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(mean)).select("rows", F.round("mean", 4).alias("mean_chars"), F.round(F.col("rows") * F.col("mean"), 2).alias("chars"))


def monthly(rows: DataFrame, pattern: str) -> DataFrame:
    """Distinct sessions a month whose text matches."""
    from ..functions.text import regexp

    return rows.where(regexp(F.col("text"), pattern)).groupBy(F.substring("updated_at", 1, 7).alias("month")).agg(F.countDistinct("session_id").alias("sessions"))


def session_rollup(chunks: DataFrame) -> DataFrame:
    """Chunks, last update and newest title of each session, in one pass."""
    return chunks.groupBy("source_ref").agg(F.count("*").alias("chunks"), F.max("updated_at").alias("updated_at"), F.max_by("title", F.struct("updated_at", "id")).alias("title"))


def grown_sessions(chunks: DataFrame, seen: DataFrame, by: int = 25) -> DataFrame:
    """Sessions with by chunks more than when they were last seen."""
    now = chunks.groupBy("source_ref").agg(F.count("*").alias("chunks"))
    return now.join(seen, "source_ref").where(F.col("chunks") >= F.col("seen") + by)


def threads(messages: DataFrame) -> DataFrame:
    """First user text, last text, number and last turn of each conversation; epochs (#e2) belong together."""
    rows = messages.withColumn("thread", F.regexp_replace(F.col("conv_id").cast("string"), r"#e\d+$", ""))
    return rows.groupBy("thread").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"),
        F.max_by("text", "turn").alias("last_text"), F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


def person_registry(events: DataFrame, topics: int = 10) -> DataFrame:
    """First and last seen, counters and the last topics of each person."""
    recent = events.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    return recent.groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(F.col("event_type") == "click").alias("chats"),
        F.count_if(F.col("event_type") != "click").alias("observed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= topics, F.struct("r", "event_type")))), lambda x: x.event_type), ",").alias("topics"))


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def tool_counts(sessions: DataFrame, tools: DataFrame) -> DataFrame:
    """Sessions of every tool of the list, 0 where there is none."""
    return tools.join(sessions.groupBy("source_name").agg(F.count("*").alias("n")), "source_name", "left").select("source_name", F.coalesce("n", F.lit(0)).alias("sessions"))


def repeats_dropped(rows: DataFrame, text: str, most: int = 2, prefix: int = 200) -> DataFrame:
    """Rows whose first characters no more than most rows share.

    Prefixes are counted before they are shuffled and only those that go come back,
    so a prefix that very many rows share is no place that they all meet.
    """
    often = rows.groupBy(F.substring(text, 1, prefix).alias("_start")).agg(F.count("*").alias("_same")).where(F.col("_same") > most)
    return rows.join(often.select("_start"), F.substring(text, 1, prefix).eqNullSafe(F.col("_start")), "left_anti")


def budget_totals(log: DataFrame, tool: str, seconds: str, extension: Column) -> DataFrame:
    return log.groupBy(tool).agg(F.count_if(~extension).alias("calls"), F.round(F.sum(F.when(~extension, F.col(seconds))), 4).alias("seconds"), F.count_if(extension).alias("extensions"))


def freshness(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """By source: the newest file, the newest index entry, and whether files are newer."""
    f = files.groupBy("source_name").agg(F.max("mtime").alias("newest_file"))
    c = chunks.groupBy("source_name").agg(F.max("indexed_at").alias("indexed_at"))
    return f.join(c, "source_name", "left").withColumn("stale", F.coalesce(F.col("newest_file") > F.col("indexed_at"), F.lit(True)))


def memory_stats(items: DataFrame) -> DataFrame:
    """(dimension, value, n): memory items in all and by scope, source and kind, in one pass."""
    names = ["scope", "source_name", "record_kind"]
    rows = items.groupingSets([[], *([c] for c in names)], *names).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "scope").when(F.col("g") == 5, "source_name").otherwise("record_kind")
    return rows.select(dimension.alias("dimension"), F.when(F.col("g") == 7, "").otherwise(F.coalesce(*names)).alias("value"), "n")


def prompt_stats(prompts: DataFrame) -> DataFrame:
    """(source_name, prompts, first_ts, last_ts), in all (null source) and by source."""
    rows = prompts.groupingSets([["source_name"], []], "source_name").agg(F.count("*").alias("prompts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.grouping("source_name").alias("g"))
    return rows.select(F.when(F.col("g") == 0, F.coalesce("source_name", F.lit(""))).alias("source_name"), "prompts", "first_ts", "last_ts")


def prompts_between(prompts: DataFrame, after: str = "", before: str = "", source: str = "") -> DataFrame:
    """Prompts of a stretch of time; a date-only upper bound ends with its last second."""
    rows = prompts if not after else prompts.where(F.col("ts") >= after)
    rows = rows if not before else rows.where(F.col("ts") <= before + ("T23:59:59" if len(before) == 10 else ""))
    return rows if not source else rows.where(F.col("source_name") == source)


def health(chunks: DataFrame, embedded: Column) -> DataFrame:
    """One row: chunks, those embedded, automated sessions, the last time of indexing."""
    automated = F.get_json_object("metadata_json", "$.origin") == "automated"
    return chunks.agg(F.count("*").alias("total"), F.count_if(embedded).alias("embedded"), F.countDistinct(F.when(automated, F.col("source_ref"))).alias("automated"), F.coalesce(F.max("indexed_at"), F.lit("")).alias("indexed_at"))


def signature(chunks: DataFrame, embedded: Column) -> DataFrame:
    """One row that changes when the embedded chunks do: their number, largest id and last time of indexing."""
    return chunks.where(embedded).agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("max_id"), F.coalesce(F.max("indexed_at"), F.lit("")).alias("indexed_at"))


def entrypoint_frequency(sessions: DataFrame) -> DataFrame:
    """(entrypoint, n) of sessions with an array of entry points."""
    return frequencies(sessions.select(F.explode("entrypoints").alias("entrypoint")), "entrypoint")


def dashboard(chunks: DataFrame, embedded: Column, stale: bool = False) -> DataFrame:
    """One row: chunks, embedded, missing, coverage, whether semantic search is on (half or more are embedded), and warnings."""
    rows = chunks.agg(F.count("*").alias("total"), F.count_if(embedded).alias("embedded"))
    coverage = F.when(F.col("total") > 0, F.col("embedded") / F.col("total")).otherwise(F.lit(0.0))
    warn = F.array_compact(F.array(F.lit("index" if stale else None).cast("string"), F.when((F.col("total") > 0) & (F.col("embedded") == 0), "semantic search: none").when((F.col("total") > 0) & (coverage < 0.5), "semantic search: partial")))
    return rows.select("total", "embedded", (F.col("total") - F.col("embedded")).alias("missing"), F.round(coverage, 4).alias("coverage"), ((F.col("total") > 0) & (coverage >= 0.5)).alias("semantic"), warn.alias("warnings"))


def exported(sessions: DataFrame, turns: DataFrame, recent: int = 20, parts: int = 4) -> DataFrame:
    """(source_ref, kind, parent, title, updated_at, text, content_hash): a record for each session, and chunks of equal numbers of turns for the newest.

    sessions: source_ref, source_name, title, updated_at, text; turns: source_ref, turn, role, text.
    """
    from ..functions import text as T
    from .windows import equal_split

    own = sessions.select("source_ref", F.lit("session").alias("kind"), F.lit(None).cast("string").alias("parent"), "title", "updated_at", "text", T.stable_hash(F.col("source_ref"), F.lit("session"), F.col("updated_at"), F.col("text")).alias("content_hash"))
    newest = sessions.orderBy(F.desc("updated_at"), "source_ref").limit(recent).select("source_ref", "source_name", "title", "updated_at")
    rows = equal_split(turns.join(F.broadcast(newest), "source_ref"), "source_ref", "turn", parts)  # recent rows
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("turn", F.concat(F.upper("role"), F.lit(": "), "text").alias("line"))))), lambda x: x["line"]), "\n")
    chunks = rows.groupBy("source_ref", "source_name", "title", "updated_at", "part").agg(said.alias("raw"))
    head = F.concat(F.lit("Source: "), "source_name", F.lit("\nSession title: "), "title", F.lit("\nSession ref: "), "source_ref", F.lit("\nChunk "), (F.col("part") + 1).cast("string"), F.lit("\n"), "raw")
    part = F.col("part").cast("string")
    chunks = chunks.select(F.concat("source_ref", F.lit(":chunk:"), part).alias("source_ref"), F.lit("chunk").alias("kind"), F.col("source_ref").alias("parent"), F.concat("title", F.lit(" [chunk "), (F.col("part") + 1).cast("string"), F.lit("]")).alias("title"), "updated_at", T.normalize_text(head, 4000).alias("text"), T.stable_hash(F.col("source_ref"), F.lit("chunk"), part, F.col("updated_at"), F.col("raw")).alias("content_hash"))
    return own.unionByName(chunks)
