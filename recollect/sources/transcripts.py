"""Transcripts of three agent dialects, JSON Lines, to sessions and events.

Lines are read as text, since a field may be a string in one line and an array
in the next, and taken apart as VARIANT. A large file is read in splits by several
tasks; a line's number comes from its split's place in the file and its place
there, so no file is ever one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators import asof, policy

#: Longer lines (bytes) are skipped, as they hold embedded files.
LINE_BYTES = 524_288
EVENT = "source_ref string, event_index int, role string, text string, ts string"


def lines(spark: SparkSession, paths: str | list[str], newest: int = 0, max_bytes: int = 0) -> DataFrame:
    """(path, mtime, line_no, value, v): the lines of files, newest files first if capped; over-long lines have no value."""
    meta = {"path": "file_path", "mtime": "file_modification_time", "start": "file_block_start"}
    size = F.octet_length("value")
    rows = spark.read.text(paths).select(*(F.col(f"_metadata.{x}").alias(c) for c, x in meta.items()), F.monotonically_increasing_id().alias("at"), size.alias("size"), F.when(size < LINE_BYTES, F.col("value")).alias("value"))
    if newest > 0:
        files = rows.groupBy("path").agg(F.max("mtime").alias("of")).orderBy(F.desc("of"), "path").limit(newest)
        rows = rows.join(F.broadcast(files.select("path")), "path", "left_semi")  # newest rows
    order = W.partitionBy("path").orderBy("start", "at")
    rows = rows.withColumn("line_no", F.row_number().over(order) - 1)
    if max_bytes:
        rows = rows.withColumn("used", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).where(F.col("used") <= max_bytes).drop("used")
    rows = rows.where("size > 0").select("path", "mtime", "line_no", "value")
    return rows.withColumn("v", F.try_parse_json("value"))


def field(path: str, kind: str = "string", column: str = "v") -> Column:
    return F.try_variant_get(F.col(column), path, kind)


def as_text(path: str) -> Column:
    return F.coalesce(field(path), F.lit(""))


def blocks(path: str) -> Column:
    """An array field as variants; a string field as none."""
    return F.coalesce(field(path, "array<variant>"), F.array().cast("array<variant>"))


def of(block: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(block, path, "string"), F.lit(""))


def texts(items: Column, kind: str) -> Column:
    return F.array_join(F.transform(F.filter(items, lambda b: of(b, "$.type") == kind), lambda b: of(b, "$.text")), "\n")


def session_of(path: Column) -> Column:
    """A transcript's session: its file's name, or the folder below brain/ that it lies in."""
    own = F.regexp_extract(path, r"/brain/([^/]+)/\.system_generated/", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", ""))


def one_copy(rows: DataFrame) -> DataFrame:
    """The lines of one file of each session: the full transcript rather than a short one, then the newest, then the last by path."""
    best = F.struct(F.col("path").endswith("/transcript_full.jsonl").alias("full"), "mtime", "path")
    kept = rows.groupBy(session_of(F.col("path")).alias("session")).agg(F.max(best).alias("best")).select(F.col("best.path").alias("path"))
    return rows.join(kept, "path", "left_semi")


def tailed(rows: DataFrame) -> DataFrame:
    """Rows of the data source as lines(): a line's place is the byte where it begins."""
    return rows.where("size > 0").select("path", "mtime", F.col("at").alias("line_no"), "value", F.try_parse_json("value").alias("v"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Event rows without empty texts or repeats of the one before, numbered within their file."""
    rows = rows.withColumn("text", F.trim("text")).where("text <> ''").withColumn("ts", F.substring("ts", 1, 19))
    w = W.partitionBy("path").orderBy("line_no", "part")
    rows = rows.withColumn("same", F.col("role").eqNullSafe(F.lag("role").over(w)) & F.col("text").eqNullSafe(F.lag("text").over(w))).where("not same")
    return rows.select(F.concat(F.lit(name + ":"), session_of(F.col("path"))).alias("source_ref"), (F.row_number().over(w) - 1).alias("event_index"), "role", "text", "ts")


def parts(rows: DataFrame, *events: Column) -> DataFrame:
    """Each line's events, in order."""
    return rows.select("path", "line_no", F.posexplode(F.array(*events)).alias("part", "e")).select("path", "line_no", "part", "e.*")


def event(role: str, text: Column, when: Column, ts: str = "$.timestamp") -> Column:
    return F.struct(F.lit(role).alias("role"), F.when(when, text).otherwise("").alias("text"), as_text(ts).alias("ts"))


def tool_line(name: Column, args: Column) -> Column:
    """[Bash] command, [Read] path, or the name and the arguments as JSON."""
    pick = lambda k: F.get_json_object(args, f"$.{k}")
    what = F.coalesce(pick("command"), pick("cmd"), pick("file_path"), pick("path"), pick("pattern"), args, F.lit(""))
    return F.concat(F.lit("["), name, F.lit("] "), T.normalize_text(what, 500))


def claude_events(rows: DataFrame) -> DataFrame:
    """Events of the dialect whose lines are user and assistant messages with content blocks."""
    kind, content = as_text("$.type"), blocks("$.message.content")
    calls = F.filter(content, lambda b: of(b, "$.type") == "tool_use")
    results = F.filter(content, lambda b: of(b, "$.type") == "tool_result")
    said = F.coalesce(field("$.message.content"), F.lit(""))
    own = F.filter(content, lambda b: of(b, "$.type") == "text")
    first = F.when(F.size(own) > 0, of(F.get(own, 0), "$.text")).otherwise(F.when(F.size(content) == 0, said).otherwise(""))
    return numbered(parts(
        rows,
        event("assistant", texts(content, "text"), kind == "assistant"),
        event("actions", F.array_join(F.transform(calls, lambda b: tool_line(of(b, "$.name"), F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("")))), "\n"), kind == "assistant"),
        event("user", first, kind == "user"),
        event("tool_result", F.array_join(F.transform(results, lambda b: T.normalize_text(of(b, "$.content"), 1200)), "\n"), kind == "user"),
    ), "claude")


def codex_events(rows: DataFrame) -> DataFrame:
    """Events of the dialect whose lines are event_msg and response_item with a payload."""
    kind, what, role = as_text("$.type"), as_text("$.payload.type"), as_text("$.payload.role")
    item, content = kind == "response_item", blocks("$.payload.content")
    name = F.coalesce(field("$.payload.name"), field("$.payload.tool_name"), F.lit("tool"))
    args = F.coalesce(field("$.payload.arguments"), field("$.payload.input"), F.lit(""))
    output = F.coalesce(field("$.payload.output"), field("$.payload.content"), F.lit(""))
    return numbered(parts(
        rows,
        event("user", as_text("$.payload.message"), (kind == "event_msg") & (what == "user_message")),
        event("assistant", texts(content, "output_text"), item & (what == "message") & (role == "assistant")),
        event("user", texts(content, "input_text"), item & (what == "message") & (role == "user")),
        event("actions", tool_line(name, args), item & what.isin("function_call", "custom_tool_call", "mcp_tool_call", "local_shell_call")),
        event("tool_result", T.normalize_text(output, 1600), item & what.isin("function_call_output", "custom_tool_call_output", "mcp_tool_call_output")),
    ), "codex")


def antigravity_events(rows: DataFrame) -> DataFrame:
    """Events of the dialect whose lines are steps with source, type, content and tool calls."""
    source, content, calls = as_text("$.source"), as_text("$.content"), blocks("$.tool_calls")
    asked = F.coalesce(F.nullif(F.regexp_extract(content, r"(?s)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", 1), F.lit("")), content)
    actions = F.array_join(F.transform(calls, lambda b: tool_line(of(b, "$.name"), F.coalesce(F.to_json(F.try_variant_get(b, "$.args", "variant")), F.lit("")))), "\n")
    tool = (source != "USER_EXPLICIT") & (source != "SYSTEM") & ~as_text("$.type").isin("PLANNER_RESPONSE", "NOTIFY_USER", "MODEL_RESPONSE") & (F.size(calls) == 0)
    return numbered(parts(
        rows,
        event("user", asked, source == "USER_EXPLICIT", "$.created_at"),
        event("tool_result", T.normalize_text(content, 1600), tool, "$.created_at"),
        event("assistant", content, (source == "MODEL") & ~tool, "$.created_at"),
        event("actions", actions, F.size(calls) > 0, "$.created_at"),
    ), "antigravity")


DIALECTS = {"claude": claude_events, "codex": codex_events, "antigravity": antigravity_events}


def events(spark: SparkSession, dialect: str, paths: str | list[str], newest: int = 0, max_bytes: int = 0) -> DataFrame:
    """(source_ref, event_index, role, text, ts) of the transcripts under paths, of one copy of each session; max_bytes: of so much of each file."""
    return adapter(dialect)(one_copy(lines(spark, paths, newest, max_bytes)))


def adapter(dialect: str, enabled: list[str] | None = None):
    """The event reader of a dialect; an error for an unknown one, or one that is not enabled."""
    if dialect not in DIALECTS or (enabled is not None and dialect not in enabled):
        raise ValueError(f"unknown source: {dialect}")
    return DIALECTS[dialect]


def sessions(spark: SparkSession, dialect: str, paths: str | list[str], newest: int = 0, executed: bool = True, max_bytes: int = 0) -> DataFrame:
    """A row for each session with a user turn: title, folder, times, entry points, human turns, turns; of copies of a session the newest.

    executed=False leaves out what programs ran instead of people.
    """
    return sessions_in(dialect, lines(spark, paths, newest, max_bytes), executed)


def sessions_in(dialect: str, rows: DataFrame, executed: bool = True) -> DataFrame:
    """sessions() of lines that are read already."""
    rows = one_copy(rows)
    own = adapter(dialect)(rows)
    ref = F.concat(F.lit(dialect + ":"), session_of(F.col("path")))
    cwd = F.coalesce(field("$.cwd"), field("$.payload.cwd"))
    # subagent transcripts are no sessions of their own, by their folder or by what their first lines say
    rows = rows.where(~F.contains("path", F.lit("/subagents/")))
    if dialect == "codex":
        about = F.struct(F.coalesce(field("$.payload.thread_source"), F.when(field("$.payload.source.subagent", "variant").isNotNull(), "subagent"), F.lit("")).alias("thread"), F.coalesce(field("$.payload.originator"), F.lit("")).alias("originator"), F.coalesce(field("$.payload.source"), F.lit("")).alias("source"), F.coalesce(field("$.payload.cwd"), F.lit("")).alias("cwd"))
        meta = rows.where(as_text("$.type") == "session_meta").groupBy("path").agg(F.min_by(about, "line_no").alias("m"))
        told = F.contains(F.lower("m.thread"), F.lit("subagent"))
        gone = told if executed else told | (policy.exec_origin(F.col("m.source"), F.col("m.originator"), F.col("m.cwd")) == "automated")
        rows = rows.join(meta.where(gone).select("path"), "path", "left_anti")
    head = rows.groupBy(ref.alias("source_ref")).agg(
        F.max_by(cwd, F.when(cwd.isNotNull(), F.col("line_no"))).alias("cwd"),
        F.collect_set(F.nullif(F.trim(as_text("$.entrypoint")), F.lit(""))).alias("entrypoints"),
        F.coalesce(F.bool_or(field("$.isSidechain", "boolean") | field("$.agentId").isNotNull()), F.lit(False)).alias("sidechain"),
        F.max(F.coalesce(field("$.timestamp"), field("$.created_at"))).alias("updated_at"), F.first("path").alias("file_path"))
    typed = (F.col("role") == "user") & T.is_user_text(F.col("text"))
    turns = own.groupBy("source_ref").agg(
        F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(typed).alias("human_turns"),
        F.min_by(F.when(typed, F.col("text")), F.when(typed, F.col("event_index"))).alias("opening"),
        F.array_sort(F.collect_list(F.struct("event_index", "role", F.substring("text", 1, 800).alias("text"), "ts"))).alias("turns"))
    out = head.join(turns, "source_ref").where("user_turns > 0")
    out = out.withColumn("source_name", F.lit(dialect)).withColumn("title", T.normalize_text(F.coalesce("opening", F.col("source_ref")), 90)).drop("opening")
    return summarised(out)


def summarised(rows: DataFrame) -> DataFrame:
    """rows (title, turns) with short_summary, of the first user turn and the last of the agent's, and detailed_summary, of the last three and two."""
    said = lambda role: F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"])
    last = lambda a, n: F.array_join(F.transform(F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a), lambda t: T.normalize_text(t, 160)), "; ")
    user, agent = said("user"), said("assistant")
    lead = F.when(F.size(user) > 0, T.normalize_text(F.get(user, 0), 140)).otherwise(F.col("title"))
    short = F.when(F.size(agent) > 0, F.concat(lead, F.lit(" Last assistant note: "), T.normalize_text(F.element_at(agent, -1), 120))).otherwise(lead)
    parts = F.array(F.concat(F.lit("Title: "), "title", F.lit(".")), F.when(F.size(user) > 0, F.concat(F.lit("Recent user turns: "), last(user, 3), F.lit("."))), F.when(F.size(agent) > 0, F.concat(F.lit("Recent assistant notes: "), last(agent, 2), F.lit("."))))
    return rows.withColumn("short_summary", short).withColumn("detailed_summary", F.array_join(F.array_compact(parts), " "))


def prompts(spark: SparkSession, dialect: str, paths: str | list[str]) -> DataFrame:
    """(source_name, session_id, ts, cwd, text, text_hash): typed prompts without slash commands, once each."""
    rows = lines(spark, paths)
    pick = lambda *names: F.coalesce(*(field(f"$.{n}") for n in names), F.lit(""))
    text = F.trim(pick("display", "text"))
    rows = rows.select(
        F.lit(dialect).alias("source_name"), pick("sessionId", "session_id", "conversationId").alias("session_id"),
        F.date_format(T.iso_time(pick("timestamp", "ts", "created_at")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"),
        pick("project", "cwd", "workspace").alias("cwd"), text.alias("text"), (pick("type") == "slash_command").alias("command"))
    rows = rows.where("not command and text <> '' and ts is not null").where(~(F.col("text").startswith("/") & ~F.contains("text", F.lit(" "))))
    return rows.drop("command").withColumn("text_hash", T.text_hash(F.col("text"))).dropDuplicates(["source_name", "session_id", "ts", "text_hash"])


def first_prompts_matched(prompts: DataFrame, conversations: DataFrame, seconds: int = 120) -> DataFrame:
    """Prompts without a session take that of the conversation with the same first text, nearest in time."""
    left = prompts.select("text_hash", F.col("ts").alias("ts"), T.squeezed(F.col("text")).alias("key"))
    right = conversations.select(T.squeezed(F.col("text")).alias("key"), F.col("session_id").alias("id"), "ts")
    found = asof.nearest(left, right, "key", seconds)
    return found.groupBy("text_hash", "ts").agg(F.min_by("match_id", F.struct("gap", "match_id")).alias("session_id"))
