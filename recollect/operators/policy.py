"""Who may see what: folder rules, visibility, sharing, origins, privacy masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entry points of automated sessions.
AUTOMATED = ["sdk-cli", "sdk-py", "sdk-ts", "sdk", "headless", "print"]


def matches(cwd: Column, rules: Column) -> Column:
    """Whether a folder fits a rule: a path (itself or below), a path component, or part of the path."""
    at = F.rtrim(F.lower(cwd))

    def one(rule: Column) -> Column:
        r = F.lower(rule)
        path = (at == r) | F.startswith(at, F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/")))
        return F.when(F.startswith(r, F.lit("/")), path).otherwise(F.contains(at, r))

    return F.exists(rules, one)


def allowed(cwd: Column, mode: Column, included: Column, excluded: Column) -> Column:
    """Blacklist: not excluded; whitelist: included and not excluded."""
    blocked = matches(cwd, excluded)
    return F.when(mode == "whitelist", matches(cwd, included) & ~blocked).otherwise(~blocked)


def workdir_classes(cwd: Column, home: str) -> Column:
    """Labels of a folder."""
    at = F.regexp_replace(F.coalesce(cwd, F.lit("")), "/+$", "")
    label = lambda c, name: F.when(c, F.lit(name))
    base = F.array(
        label(at == "", "empty"), label(at == home, "home_default"), label(at.rlike(r"/Documents/[^/]*(?i:chat)s?(/|$)"), "documents_chat"),
        label(at.rlike(r"/workspaces?(/|$)"), "workspace"), label((at == "") | (at == home) | at.isin("/", "/tmp"), "no_project"))
    found = F.array_compact(base)
    return F.when(F.size(found) == 0, F.array(F.lit("project"))).otherwise(found)


def origin(marker: Column, sidechain: Column, cwd: Column, entrypoints: Column, human_turns: Column) -> Column:
    """(origin, detail): marker, then side chain, worktree, SDK entry point, no human turn; else interactive."""
    auto = lambda d: F.struct(F.lit("automated").alias("origin"), d.alias("detail"))
    return (
        F.when(marker.isNotNull(), auto(F.coalesce(F.nullif(F.regexp_extract(marker, r"(?i)origin\s*=\s*([^\s>]+)", 1), F.lit("")), F.lit("orchestrated"))))
        .when(sidechain, auto(F.lit("subagent")))
        .when(cwd.rlike(r"(?i)/\.[^/]*worktrees?/"), auto(F.lit("orchestrated")))
        .when(F.exists(entrypoints, lambda e: F.lower(F.trim(e)).isin(AUTOMATED)), auto(F.lit("sdk")))
        .when(human_turns == 0, auto(F.lit("no-user-turns")))
        .otherwise(F.struct(F.lit("interactive").alias("origin"), F.lit("").alias("detail")))
    )


def exec_origin(source: Column, originator: Column, cwd: Column) -> Column:
    machine = (F.lower(F.trim(source)) == "exec") | F.contains(F.lower(originator), F.lit("exec")) | F.coalesce(cwd.rlike(r"(?i)/\.[^/]*worktrees?/"), F.lit(False))
    return F.when(machine, "automated").otherwise("interactive")


def hidden_from_team(rows: DataFrame, private: DataFrame, sessions: DataFrame, projects: DataFrame, open_mode: bool = False) -> DataFrame:
    """rows with hidden: private session, open mode, the session's decision, a catch-all folder, the project's level; hidden when in doubt."""
    # private and decided sessions grow with the archive: the optimizer sees their size and chooses the join
    rows = rows.join(private.select("source_ref", F.lit(True).alias("is_private")).distinct(), "source_ref", "left")
    rows = rows.join(sessions.select("source_ref", F.col("level").alias("session_level")), "source_ref", "left")
    rows = rows.join(projects.select("project", F.col("level").alias("project_level")), "project", "left")
    hidden = (
        F.when(F.col("is_private"), True).when(F.lit(open_mode), False)
        .when(F.col("session_level").isNotNull(), F.col("session_level") != "share")
        .when(F.col("catch_all"), True)
        .otherwise(F.coalesce(F.col("project_level") != "share", F.lit(True)))
    )
    return rows.withColumn("hidden", hidden).drop("is_private", "session_level", "project_level")


def visible(rows: DataFrame, owner: bool) -> DataFrame:
    """The owner sees all; others see what isn't hidden, without titles: blank, and masked in the header that begins a chunk's text."""
    if owner:
        return rows
    rows = rows.where("not hidden").withColumn("title", F.lit(""))
    for c in ("text", "text_preview", "summary_short"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.regexp_replace(c, r"Title: .*?(?= Source: |\n|$)", "Title: (owner-only)"))
    return rows


def private_rows(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows with private: a session that the owner shared is not; else a stamp on the row, the live policy on its folder, or team sharing says so.

    rows: source_ref, stamped (visibility is private), folder_private (by the live policy), hidden (by team sharing), agent (an agent's session).
    """
    own = F.substring_index("source_ref", "#", 1)
    rows = rows.join(shared.select(F.col("source_ref").alias("_shared")).distinct(), own == F.col("_shared"), "left")
    said = F.coalesce("stamped", F.lit(False)) | F.coalesce("folder_private", F.lit(False)) | (F.coalesce("agent", F.lit(True)) & F.coalesce("hidden", F.lit(True)))
    return rows.withColumn("private", ~(F.col("_shared").isNotNull() & F.coalesce("agent", F.lit(True))) & said).drop("_shared")


def scoped(rows: DataFrame, scope: str, actor: str, target: str = "") -> DataFrame:
    if scope == "private":
        return rows.where((F.col("scope") == "private") & (F.col("owner_id") == actor))
    if scope == "shared":
        return rows.where(F.col("scope") == "shared")
    if scope == "target_user":
        return rows.where((F.col("scope") == "private") & (F.col("owner_id") == target))
    raise ValueError(f"unknown scope: {scope}")


def review_candidates(sessions: DataFrame, typed: DataFrame, decided: DataFrame, private: DataFrame) -> DataFrame:
    """Sessions that a person typed in, not decided and not private."""
    return sessions.join(typed, "source_ref", "left_semi").join(decided, "source_ref", "left_anti").join(private, "source_ref", "left_anti")


def toggled(rules: Column, value: Column, on: bool) -> Column:
    return F.array_union(rules, F.array(value)) if on else F.array_except(rules, F.array(value))
