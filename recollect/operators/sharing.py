"""Access policies as tables: exclusions, private folders, visibility by account, purges, decisions and review queues.

An account's policy is one row: source_name, account, mode (blacklist or whitelist)
and arrays of rules: included, excluded (folders), included_classes,
excluded_classes, private, private_classes, excluded_sessions,
excluded_entrypoints, excluded_details (origin details), and exclude_automated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import policy, store

POLICY = (
    "source_name string, account string, mode string, included array<string>, excluded array<string>, included_classes array<string>, excluded_classes array<string>, "
    "private array<string>, private_classes array<string>, excluded_sessions array<string>, excluded_entrypoints array<string>, excluded_details array<string>, exclude_automated boolean"
)
# Folders of a home that are no project of their own; where temporary and agents' own folders begin.
CATCH_ALL = ["code", "documents", "desktop", "downloads", "projects", "src", "work", "tmp"]
TEMPORARY = ["/private/tmp", "/private/var/", "/tmp"]
AGENT_FOLDERS = [".claude", ".codex", ".gemini"]
#: Which rules of a policy each kind of scope change edits.
KINDS = {"workdir": "excluded", "session": "excluded_sessions", "workdir_class": "excluded_classes", "entrypoint": "excluded_entrypoints"}
LEVELS = ("team", "owner", "exclude")


def lowered(rules: Column) -> Column:
    return F.transform(F.filter(F.coalesce(rules, F.array().cast("array<string>")), lambda r: F.trim(r) != ""), lambda r: F.lower(F.trim(r)))


def entrypoint_blocked(entrypoints: Column, excluded: Column) -> Column:
    """Whether any entry point of a session is excluded, in any case."""
    return F.coalesce(F.arrays_overlap(F.transform(entrypoints, F.lower), lowered(excluded)), F.lit(False))


def session_blocked(ids: list[Column], excluded: Column) -> Column:
    """Whether any of a session's ids is excluded, in any case; an id may have its source in front."""
    hit = F.lit(False)
    for c in ids:
        one = F.lower(F.trim(F.coalesce(c, F.lit(""))))
        bare = F.regexp_replace(one, "^[^:]*:", "")
        hit = hit | ((one != "") & (F.array_contains(lowered(excluded), one) | F.array_contains(lowered(excluded), bare)))
    return F.coalesce(hit, F.lit(False))


def origin_excluded(origin: Column, detail: Column, excluded: Column, automated: Column) -> Column:
    """Automated sessions, all of them or those of a listed detail."""
    name = F.lower(F.trim(F.coalesce(detail, F.lit(""))))
    return F.coalesce((origin == "automated") & (automated | ((name != "") & F.array_contains(lowered(excluded), name))), F.lit(False))


def trimmed(path: Column) -> Column:
    return F.regexp_replace(F.trim(path), "/+$", "")


def workdir_private(cwd: Column, classes: Column, private: Column, private_classes: Column) -> Column:
    """A folder on the list itself, or of a class on the list; nothing is private without a folder."""
    own = F.array_contains(F.transform(F.filter(F.coalesce(private, F.array().cast("array<string>")), lambda r: F.trim(r) != ""), trimmed), trimmed(cwd))
    return F.coalesce((F.trim(cwd) != "") & (own | F.arrays_overlap(classes, lowered(private_classes))), F.lit(False))


def included(cwd: Column, classes: Column, p: str = "p") -> Column:
    """Whether a policy (a struct column named p) lets a folder in, by its rules and its classes."""
    rule = lambda name: F.col(f"{p}.{name}")
    fits = lambda rules, own: (policy.matches(F.coalesce(cwd, F.lit("")), lowered(rule(rules))) & (F.coalesce(F.trim(cwd), F.lit("")) != "")) | F.coalesce(F.arrays_overlap(classes, lowered(rule(own))), F.lit(False))
    blocked = fits("excluded", "excluded_classes")
    return F.when(F.lower(rule("mode")) == "whitelist", fits("included", "included_classes") & ~blocked).otherwise(~blocked)


def visible_to_accounts(rows: DataFrame, policies: DataFrame, classes: Column) -> DataFrame:
    """Rows that some account of their source allows: that of their own account, or any if there is none of its name; a source without policies shows nothing.

    rows: source_type, source_name, account, cwd, session_id, source_ref; what is no session always passes. policies: POLICY, some dozens of rows.
    """
    own = policies.groupBy(F.lower("source_name").alias("of_source")).agg(F.collect_list(F.struct(*policies.columns)).alias("accounts"))
    rows = rows.withColumn("_classes", classes).join(F.broadcast(own), F.lower("source_name") == F.col("of_source"), "left")
    named = F.filter("accounts", lambda a: a["account"] == F.coalesce(F.col("account"), F.lit("default")))
    rows = rows.withColumn("_candidates", F.coalesce(F.when(F.size(named) > 0, named).otherwise(F.col("accounts")), F.array().cast(rows.schema["accounts"].dataType)))
    bare = F.regexp_replace("source_ref", "^[^:]*:", "")

    def allows(a: Column) -> Column:
        blank = F.coalesce(F.trim("cwd"), F.lit("")) == ""
        fits = lambda rules, own: (policy.matches(F.coalesce("cwd", F.lit("")), lowered(a[rules])) & ~blank) | F.coalesce(F.arrays_overlap("_classes", lowered(a[own])), F.lit(False))
        blocked = fits("excluded", "excluded_classes")
        inside = F.when(F.lower(a["mode"]) == "whitelist", fits("included", "included_classes") & ~blocked).otherwise(~blocked)
        return inside & ~session_blocked([F.col("session_id"), bare], a["excluded_sessions"])

    other = F.coalesce("source_type", F.lit("trajectory")) != "trajectory"
    return rows.where(other | F.exists("_candidates", allows)).drop("_classes", "of_source", "accounts", "_candidates")


def catch_all(cwd: Column, home: str) -> Column:
    """Folders that sessions of any kind are begun in: the home and its common folders, temporary ones, agents' own."""
    at = F.coalesce(F.nullif(trimmed(F.regexp_replace(F.coalesce(cwd, F.lit("")), "^~", home)), F.lit("")), F.lit("/"))
    below = F.when(F.startswith(at, F.lit(home + "/")), F.substring(at, len(home) + 2, 1 << 20))
    out = at.isin("/", home) | F.lower(below).isin(CATCH_ALL)
    for t in TEMPORARY:
        out = out | at.startswith(t)
    for a in AGENT_FOLDERS:
        out = out | F.coalesce(below.startswith(a), F.lit(False))
    return F.coalesce(out, F.lit(False))


def gui_chats(sessions: DataFrame, origins: DataFrame, home: str, chats: str) -> DataFrame:
    """sessions (source_name, session_id, cwd) with gui: chats of the desktop application without a project folder.

    chats is the folder of its own chats; origins: session_id, originator, source. An unknown origin counts as one.
    """
    known = origins.select(F.lower(F.trim("session_id")).alias("of_id"), F.lower("originator").alias("originator"), "source").dropDuplicates(["of_id"])
    own = F.lower(F.trim(F.substring_index(F.substring_index("session_id", "#", 1), ":", -1)))
    rows = sessions.join(known, own == F.col("of_id"), "left")
    place = F.coalesce("cwd", F.lit("")).startswith(chats)
    terminal = (F.col("originator") == "codex-tui") | (F.col("source") == "cli")
    unsure = F.col("of_id").isNull() | F.contains("originator", F.lit("desktop")) | ~terminal
    gui = (F.lower(F.trim("source_name")) == "codex") & (catch_all(F.col("cwd"), home) | place) & (place | F.coalesce(unsure, F.lit(True)))
    return rows.withColumn("gui", F.coalesce(gui, F.lit(False))).drop("of_id", "originator", "source")


def purged_by(chunks: DataFrame, path: str, value: str, sources: list[str] | None = None) -> DataFrame:
    """The index without the sessions that have a chunk with value at a path of its metadata, of some sources only if named."""
    hit = chunks.where(F.get_json_object("metadata_json", path) == value)
    hit = hit if not sources else hit.where(F.col("source_name").isin(sources))
    return store.deleted(chunks, hit.select("source_ref"), "source_ref")


def purged_by_origin(chunks: DataFrame, origin: str, sources: list[str] | None = None) -> DataFrame:
    return purged_by(chunks, "$.origin", origin, sources)


def purged_by_detail(chunks: DataFrame, detail: str, sources: list[str] | None = None) -> DataFrame:
    return purged_by(chunks, "$.origin_detail", detail, sources)


def scope_changed(policies: DataFrame, action: str, source: str, kind: str = "", value: str = "", account: str = "default") -> DataFrame:
    """The policies after exclude, unexclude or set_visibility.

    A folder is out, or back, for all accounts of its source; other rules change for
    the account alone, or the source's first one if none has that name.
    """
    value = value.strip()
    if action not in ("exclude", "unexclude", "set_visibility"):
        raise ValueError(f"unknown action: {action}")
    if action != "set_visibility" and (kind not in KINDS or not value):
        raise ValueError(f"unknown kind: {kind}" if kind not in KINDS else "a value is needed")
    here = F.lower("source_name") == source.strip().lower()
    named = F.max(F.when(F.col("account") == account, 1).otherwise(0)).over(W.partitionBy("source_name"))
    first = F.min("account").over(W.partitionBy("source_name"))
    mine = here & ((F.col("account") == account) | ((named == 0) & (F.col("account") == first)))
    rows = policies.withColumn("_mine", mine)
    if action == "set_visibility":
        mode = "whitelist" if value.lower() == "whitelist" else "blacklist"
        return rows.withColumn("mode", F.when(F.col("_mine"), mode).otherwise(F.col("mode"))).drop("_mine")
    column = KINDS[kind]
    plain = value if kind in ("workdir", "session") else value.lower()
    plain = plain.split(":", 1)[1] if kind == "session" and ":" in plain else plain
    old = F.coalesce(F.col(column), F.array().cast("array<string>"))
    if action == "exclude":
        new = F.when(F.array_contains(old, plain), old).otherwise(F.array_append(old, F.lit(plain)))
    else:
        new = F.filter(old, lambda r: F.lower(r) != plain.lower())
    return rows.withColumn(column, F.when(here if kind == "workdir" else F.col("_mine"), new).otherwise(F.col(column))).drop("_mine")


def purged_to_policy(chunks: DataFrame, policies: DataFrame, classes: Column) -> DataFrame:
    """The index without sessions that no account of their source allows any more; a session is judged as a whole."""
    own = chunks.groupBy("source_ref").agg(F.max("source_name").alias("source_name"), F.max("session_id").alias("session_id"), F.max("cwd").alias("cwd"))
    own = own.withColumn("source_type", F.lit("trajectory")).withColumn("account", F.lit(None).cast("string"))
    return chunks.join(visible_to_accounts(own, policies, classes).select("source_ref"), "source_ref", "left_semi")


def decided(decisions: DataFrame, made: DataFrame) -> DataFrame:
    """Sharing decisions (key, level, by, decided_at) with new ones put in; a level that isn't known is left out."""
    return store.merged(decisions, made.where(F.col("level").isin(*LEVELS)).withColumnRenamed("decided_at", "imported_at"), "key") if "imported_at" in decisions.columns else store.merged(decisions, made.where(F.col("level").isin(*LEVELS)), "key")


def needs_decision(s: DataFrame) -> Column:
    """Whether the reviewer asks: level ask, or a question on the row."""
    return (F.col("level") == "ask") | (F.coalesce("question", F.lit("")) != "")


def to_decide(suggestions: DataFrame, private: DataFrame, answered: DataFrame) -> DataFrame:
    """The sessions that wait for the owner, in order: those asked for, then those of a host, then by chunks. Answers by the reviewer don't count."""
    rows = suggestions.where(needs_decision(suggestions)).join(private.select("source_ref"), "source_ref", "left_anti")
    rows = rows.join(answered.where("by <> 'reviewer'").select("source_ref"), "source_ref", "left_anti")
    return rows.orderBy(F.col("level") != "ask", ~F.col("hop"), F.desc("chunks"), "source_ref")


def recommended(suggestions: DataFrame, private: DataFrame, answered: DataFrame) -> DataFrame:
    """The sessions that the reviewer would share and nobody has answered: by confidence, host, chunks."""
    rank = F.expr("CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END")
    rows = suggestions.where((F.col("level") == "team") & ~needs_decision(suggestions))
    rows = rows.join(private.select("source_ref"), "source_ref", "left_anti").join(answered.select("source_ref"), "source_ref", "left_anti")
    return rows.orderBy(rank, ~F.col("hop"), F.desc("chunks"), "source_ref")


def to_review(sessions: DataFrame, seen: DataFrame) -> DataFrame:
    """Sessions to look at again: never seen, twice the chunks of last time (25 at least), or to be shared without a name; hosted ones first, then by chunks.

    sessions: source_ref, chunks, hosted, last; seen: source_ref, chunks, level, name.
    """
    old = seen.select("source_ref", F.col("chunks").alias("old"), "level", "name")
    rows = sessions.join(old, "source_ref", "left")
    grown = F.col("old").isNull() | (F.col("chunks") >= 2 * F.greatest("old", F.lit(25)))
    unnamed = (F.col("level") == "team") & (F.coalesce("name", F.lit("")) == "")
    return rows.where(grown | F.coalesce(unnamed, F.lit(False))).drop("old", "level", "name").orderBy(~F.col("hosted"), F.desc("chunks"), F.coalesce("last", F.lit("")), "source_ref")


def preference_examples(suggestions: DataFrame, decisions: DataFrame, limit: int = 30) -> DataFrame:
    """(no, source_ref, said, chose): what the owner chose, for the reviewer to learn from: questions first, then overruled calls, newest first."""
    own = decisions.where("by = 'owner'").select("source_ref", F.col("level").alias("chosen"), "decided_at")
    rows = own.join(suggestions, "source_ref", "left")
    asked = F.coalesce(needs_decision(rows), F.lit(False))
    overruled = F.coalesce(F.col("level").isin("team", "owner") & (F.col("level") != F.col("chosen")), F.lit(False))
    chose = F.when(F.col("chosen") == "team", "to share").when(F.col("chosen") == "exclude", "to exclude it from the index").otherwise("to keep private")
    said = F.coalesce(F.nullif("question", F.lit("")), F.nullif("reason", F.lit("")), F.lit(""))
    order = [~asked, ~overruled, F.desc("decided_at"), F.col("source_ref")]
    top = rows.withColumn("said", said).withColumn("chose", chose).orderBy(*order).limit(limit)
    return top.withColumn("no", F.row_number().over(W.orderBy(*order))).select("no", "source_ref", "said", "chose")


def overview(projects: DataFrame, decisions: DataFrame, suggestions: DataFrame, flagged: DataFrame, private: DataFrame, sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every project with its owner's level and the reviewer's suggestion, a row for each session that the suggestion flags (one with null ref where it flags none).

    projects: project, sessions, last; decisions: project, level; suggestions: project,
    suggested, reason; flagged: project, ref; private: ref; sessions: session_id,
    level; chunks: source_ref, title. A flagged session has its title, whether it is
    private, and the level decided for it, else owner if it is private. Titles are
    looked up for flagged sessions alone. Flags of projects without a suggestion
    don't count; of several decisions the largest counts.
    """
    levels = decisions.groupBy("project").agg(F.max("level").alias("level"))
    told = suggestions.groupBy("project").agg(F.max(F.struct("suggested", "reason")).alias("_told")).select("project", "_told.*")
    flags = flagged.select("project", "ref").distinct().join(told.select("project"), "project", "left_semi")
    titles = chunks.join(flags.select(F.col("ref").alias("source_ref")).distinct(), "source_ref", "left_semi").groupBy(F.col("source_ref").alias("ref")).agg(F.max("title").alias("title"))
    own = sessions.groupBy(F.lower("session_id").alias("_sid")).agg(F.max("level").alias("_own"))
    flags = flags.withColumn("_sid", F.lower(F.substring_index(F.substring_index("ref", "#", 1), ":", -1))).join(own, "_sid", "left").join(titles, "ref", "left")
    flags = flags.join(private.select("ref", F.lit(True).alias("private")).distinct(), "ref", "left")
    flags = flags.select("project", "ref", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("private", F.lit(False)).alias("private"), F.coalesce("_own", F.when(F.col("private"), "owner")).alias("session_level"))
    rows = projects.join(levels, "project", "left").join(told, "project", "left").join(flags, "project", "left")
    return rows.select("project", "sessions", "last", "level", "suggested", "reason", "ref", "title", "private", "session_level")


def members(feed: DataFrame, own: str) -> DataFrame:
    """Who has written in a channel: oneself, then bots, then the latest."""
    rows = feed.where("author_id <> ''").groupBy("author_id").agg(F.max_by("author_name", "seq").alias("name"), F.max("is_bot").alias("is_bot"), F.max("ts").alias("last"))
    return rows.orderBy(F.col("author_id") != own, ~F.col("is_bot"), F.desc("last"), "author_id")
