"""Smaller sources: side tables, best transcripts, viewer events, chat, budget and retrieval logs, folder slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .tailing import GLOBS
from .transcripts import as_text, blocks, field, lines, of, session_of

#: Characters of a viewer event.
VIEWER_CHARS = 8_000


def paths(dialect: str, root: str) -> list[str]:
    if dialect not in GLOBS:
        raise ValueError(f"unknown source: {dialect}")
    return [f"{root.rstrip('/')}/{g}" for g in GLOBS[dialect]]


def recent_files(spark: SparkSession, patterns: list[str], limit: int = 0) -> DataFrame:
    """(path, mtime, size), newest first; limit 0 is no limit. Contents are not read."""
    files = spark.read.format("binaryFile").load(patterns).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).distinct().orderBy(F.desc("mtime"), "path")
    return files.limit(limit) if limit > 0 else files


def best_transcripts(files: DataFrame) -> DataFrame:
    """The path of each conversation's fullest transcript: (conversation, is_full, size, path)."""
    return files.groupBy("conversation").agg(F.max_by("path", F.struct("is_full", "size", "path")).alias("path"))


def newest_copies(sessions: DataFrame) -> DataFrame:
    """The newest copy of each session."""
    r = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("updated_at"), F.desc("file_path")))
    return sessions.withColumn("r", r).where("r = 1").drop("r")


def with_titles(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles from a side table (session_id, thread_name) where it has one that people would write."""
    side = titles.where(T.is_human_title(F.col("thread_name"))).groupBy("session_id").agg(F.max("thread_name").alias("thread_name"))
    return sessions.join(side, "session_id", "left").withColumn("title", F.coalesce("thread_name", "title")).drop("thread_name")


def thread_origins(threads: DataFrame) -> DataFrame:
    """(session_id, originator, source) of another application's table of threads, read by JDBC or from an export."""
    return threads.select(F.col("id").alias("session_id"), F.coalesce("originator", F.lit("")).alias("originator"), F.coalesce("source", F.lit("")).alias("source"))


def cut(text: Column) -> Column:
    """A viewer's text, with the number of characters that are left out."""
    more = F.length(text) - VIEWER_CHARS
    return F.when(more > 0, F.concat(F.substring(text, 1, VIEWER_CHARS), F.lit("\n\u2026 (+"), F.format_number(more, 0), F.lit(" more chars)"))).otherwise(text)


def shown(kind: Column | str, text: Column, tool: Column | str = "") -> Column:
    plain = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(plain(kind).alias("kind"), plain(tool).alias("tool"), F.coalesce(text, F.lit("")).alias("text"))


def any_text(v: Column, *paths: str) -> Column:
    """The first of some members: text as it is, other values as JSON."""
    return F.coalesce(*(x for p in paths for x in (F.try_variant_get(v, p, "string"), F.to_json(F.try_variant_get(v, p, "variant")))), F.lit(""))


def message_view() -> Column:
    """Viewer events of a line of the message dialect; a reminder that was put in is not shown."""
    kind, content = as_text("$.type"), blocks("$.message.content")
    said = F.trim(as_text("$.message.content"))
    reminder = said.startswith("<system-reminder>") & said.endswith("</system-reminder>")
    own = F.transform(content, lambda b: F.when(of(b, "$.type") == "text", shown(kind, of(b, "$.text"))).when(
        (kind == "assistant") & (of(b, "$.type") == "thinking"), shown("thinking", F.coalesce(F.nullif(of(b, "$.thinking"), F.lit("")), of(b, "$.text")))).when(
        (kind == "assistant") & (of(b, "$.type") == "tool_use"), shown("tool_use", any_text(b, "$.input"), F.coalesce(F.nullif(of(b, "$.name"), F.lit("")), F.lit("tool")))).when(
        (kind == "user") & (of(b, "$.type") == "tool_result"), shown("tool_result", any_text(b, "$.content"), "result")))
    plain = F.when((kind == "user") & ~reminder, F.array(shown("user", said))).otherwise(F.array().cast(VIEW))
    return F.when(kind.isin("user", "assistant"), F.when(F.size(content) > 0, F.array_compact(own).cast(VIEW)).otherwise(plain))


def response_view() -> Column:
    """Viewer events of a line of the response dialect; metadata lines are not shown."""
    kind, what, role, v = as_text("$.type"), as_text("$.payload.type"), as_text("$.payload.role"), F.col("v")
    item, content = kind == "response_item", blocks("$.payload.content")
    thought = F.when(F.size(blocks("$.payload.summary")) > 0, blocks("$.payload.summary")).otherwise(content)
    call, output = what.isin("function_call", "custom_tool_call", "local_shell_call"), what.isin("function_call_output", "custom_tool_call_output")
    joined = lambda items, name, sep: F.array_join(F.transform(F.filter(items, lambda b: of(b, "$.type") == name) if name else items, lambda b: of(b, "$.text")), sep)
    one = (
        F.when((kind == "event_msg") & (what == "user_message"), shown("user", as_text("$.payload.message")))
        .when(item & (what == "message") & (role == "assistant"), shown("assistant", joined(content, "output_text", "\n")))
        .when(item & (what == "message") & (role == "user"), shown("user", joined(content, "input_text", "")))
        .when(item & (what == "reasoning"), shown("thinking", joined(thought, "", "")))
        .when(item & call, shown("tool_use", any_text(v, "$.payload.arguments", "$.payload.action", "$.payload.input"), F.coalesce(F.nullif(as_text("$.payload.name"), F.lit("")), F.replace(what, F.lit("_"), F.lit(" ")))))
        .when(item & output, shown("tool_result", any_text(v, "$.payload.output.output", "$.payload.output"), "output")))
    return F.when(one.isNotNull(), F.array(one).cast(VIEW))


def step_view() -> Column:
    """Viewer events of a line of the step dialect."""
    kind, content = as_text("$.type"), as_text("$.content")
    asked = F.coalesce(F.nullif(F.regexp_extract(content, r"(?s)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", 1), F.lit("")), content)
    calls = F.transform(blocks("$.tool_calls"), lambda b: shown("tool_use", any_text(b, "$.args"), F.coalesce(F.nullif(of(b, "$.name"), F.lit("")), F.lit("tool"))))
    planned = F.concat(F.array(shown("thinking", as_text("$.thinking")), shown("assistant", content)).cast(VIEW), calls.cast(VIEW))
    return F.when(kind == "USER_INPUT", F.array(shown("user", asked)).cast(VIEW)).when(kind == "PLANNER_RESPONSE", planned).otherwise(F.array(shown("tool_result", content, "output")).cast(VIEW))


VIEW = "array<struct<kind:string,tool:string,text:string>>"
VIEWS = {"claude": message_view, "codex": response_view, "antigravity": step_view}


def viewer_events(spark: SparkSession, files: str | list[str], cap: int = 0, dialect: str = "claude") -> DataFrame:
    """(path, no, kind, tool, text, ts): what a viewer shows of transcripts, thinking and tool calls included, cap events of each at most; over-long lines are told."""
    rows = lines(spark, files, max_bytes=48 << 20)
    told = F.array(shown("oversized", F.lit("line left out"))).cast(VIEW)
    found = F.when(F.col("value").isNull(), told).when(F.col("v").isNotNull(), VIEWS[dialect]())
    ts = F.coalesce(field("$.timestamp"), field("$.created_at"), F.lit(""))
    rows = rows.select("path", "line_no", ts.alias("ts"), F.posexplode(found).alias("part", "e"))
    rows = rows.withColumn("text", F.regexp_replace("e.text", r"^\s+|\s+$", "")).where((F.col("text") != "") | F.col("e.kind").isin("tool_use", "tool_result"))
    no = F.row_number().over(W.partitionBy("path").orderBy("line_no", "part"))
    rows = rows.select("path", (no - 1).alias("no"), "e.kind", "e.tool", cut(F.col("text")).alias("text"), "ts")
    return rows.where(F.col("no") < cap) if cap else rows


# What an editor's conversation leaves behind instead of a transcript, the oldest first.
ARTIFACTS = ["implementation_plan.md", "task.md", "walkthrough.md"]


def artifact_events(spark: SparkSession, root: str) -> DataFrame:
    """(source_ref, event_index, role, text, ts) of conversations without a transcript: their plan and walkthrough as turns of the agent.

    root holds a folder for each conversation. An artifact is a file that people read, so it is one text.
    """
    files = spark.read.text(f"{root.rstrip('/')}/*/*.md", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("ts"), "value")
    name, own = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    rows = files.select(own.alias("id"), F.array_position(F.array(*map(F.lit, ARTIFACTS)), name).alias("place"), name.alias("name"), "ts", F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text")).where("place > 0 and text <> ''")
    no = F.row_number().over(W.partitionBy("id").orderBy("place")) - 1
    return rows.select(F.concat(F.lit("antigravity:"), "id").alias("source_ref"), no.alias("event_index"), F.lit("assistant").alias("role"), F.concat(F.lit("["), "name", F.lit("]\n"), "text").alias("text"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))


def artifact_sessions(events: DataFrame, transcripts: DataFrame) -> DataFrame:
    """A row for each conversation that has artifacts and no transcript: title, last time, and the folder that holds the files it speaks of."""
    own = events.join(transcripts.select("source_ref"), "source_ref", "left_anti")
    paths = F.regexp_extract_all("text", F.lit(r"(?:file://)?(/(?:Users|home)/[^\s)`'\"]+)"), F.lit(1))
    out = own.withColumn("paths", paths).groupBy("source_ref").agg(F.flatten(F.collect_list("paths")).alias("paths"), F.max("ts").alias("updated_at"), F.min_by("text", "event_index").alias("opening"))
    return out.select("source_ref", F.lit("antigravity").alias("source_name"), T.normalize_text(F.col("opening"), 90).alias("title"), inferred_folder(F.array().cast("array<string>"), F.col("paths"), "/").alias("cwd"), "updated_at", F.lit("interactive").alias("origin"))


def recorded(history: DataFrame, metadata: DataFrame) -> DataFrame:
    """(session_id, workspace, title, typed) of what an application records beside its transcripts.

    history: session_id, workspace, type, ts; metadata: session_id, title, workspaces (URIs), internal.
    A prompt or a record that is not internal says that a person typed; the prompts' workspace counts first.
    """
    told = history.where("coalesce(type, '') <> 'slash_command' and coalesce(session_id, '') <> ''").groupBy("session_id").agg(F.max_by(F.nullif("workspace", F.lit("")), F.when(F.coalesce("workspace", F.lit("")) != "", F.col("ts"))).alias("told"))
    place = F.regexp_replace(F.try_url_decode(F.replace(F.get("workspaces", 0), F.lit("+"), F.lit("%2B"))), "^[a-z]+://[^/]*", "")
    known = metadata.where("not coalesce(internal, false)").groupBy("session_id").agg(F.max(F.nullif("title", F.lit(""))).alias("title"), F.max(place).alias("place"))
    return told.join(known, "session_id", "full_outer").select("session_id", F.coalesce("told", "place", F.lit("")).alias("workspace"), F.coalesce("title", F.lit("")).alias("title"), F.lit(True).alias("typed"))


def chat_messages(spark: SparkSession, files: str | list[str], last: int = 0) -> DataFrame:
    """(path, line_no, role, text, ts) of chat logs, the last messages of each if asked for."""
    rows = lines(spark, files).where(as_text("$.type") == "message").select("path", "line_no", as_text("$.role").alias("role"), as_text("$.text").alias("text"), as_text("$.ts").alias("ts"))
    if not last:
        return rows
    return rows.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("line_no")))).where(F.col("r") <= last).drop("r")


def budget_log(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """(tool, seconds, tokens, results, extension) of retrieval budget logs."""
    rows = lines(spark, files).where("v is not null")
    return rows.select(as_text("$.tool").alias("tool"), field("$.seconds", "double").alias("seconds"), field("$.tokens", "long").alias("tokens"), field("$.result_count", "int").alias("results"), (as_text("$.kind") == "extension").alias("extension"))


def retrievals(messages: DataFrame) -> DataFrame:
    """Assistant rows with the user text that they answer."""
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return messages.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(w)).where("role = 'assistant'")


def folder_of(slug: Column) -> Column:
    """The path that a folder's slug (-home-a-b) stands for."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(slug, "-"), lambda x: x != ""), "/"))


def most_common(items: Column) -> Column:
    """The item that an array holds most often, the first of those on a tie."""
    counted = F.transform(F.array_distinct(items), lambda x, i: F.struct(F.size(F.filter(items, lambda y: y == x)).alias("n"), (-i).alias("back"), x.alias("x")))
    return F.array_max(counted)["x"]


def inferred_folder(commands: Column, paths: Column, home: str) -> Column:
    """Where a conversation worked: the folder that most commands ran in, else the deepest that holds all its files, else (if that says nothing) the one of most files."""
    absolute = lambda a: F.filter(a, lambda x: F.startswith(x, F.lit("/")))
    ran = F.transform(absolute(commands), lambda x: F.regexp_replace(x, "/+$", ""))
    held = F.transform(F.filter(absolute(paths), lambda x: ~F.contains(x, F.lit("/.gemini/"))), lambda x: F.regexp_replace(x, "/[^/]*$", ""))
    shared = F.coalesce(F.nullif(common_folder(held), F.lit("")), F.lit("/"))
    return F.when(F.size(ran) > 0, most_common(ran)).when(F.size(held) == 0, "").when(shared.isin("/", home), most_common(held)).otherwise(shared)


def common_folder(folders: Column) -> Column:
    """The deepest folder that holds all of an array of folders."""
    parts = F.transform(folders, lambda f: F.split(f, "/"))
    shortest = F.array_min(F.transform(parts, F.size))
    same = F.filter(F.sequence(F.lit(1), shortest), lambda n: F.size(F.array_distinct(F.transform(parts, lambda p: F.array_join(F.slice(p, F.lit(1), n), "/")))) == 1)
    n = F.coalesce(F.array_max(same), F.lit(0))
    return F.array_join(F.slice(F.get(parts, 0), F.lit(1), n), "/")


def source_ref(dialect: str, path: Column) -> Column:
    return F.concat(F.lit(dialect + ":"), session_of(path))
