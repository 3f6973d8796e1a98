"""What a search shows: payload rows, compact rows, snippets, evidence within a budget, answer sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import lexical
from .search import rendered, score_text

# Metadata that a compact row keeps.
COMPACT = ["session_id", "raw_session_id", "chunk_id", "chunk_index", "event_start", "event_end", "origin", "origin_detail"]
# Signs of a snippet's worth, with what each adds.
WORTH = [
    (30, [r"(^|\n)user \["]),
    (8, [r"(^|\n)assistant \["]),
    (-40, [r"\[exec_command\]", "curl -fss", "trajectory_investigation"]),
    (-6, ["tool_result", r"\[truncated\]"]),
    (-60, ["source ref: (claude|codex|antigravity):", '"source_ref"', '"match_kind"']),
    (-25, ["this session is being continued"]),
]


def payload(hits: DataFrame, match_kind: str) -> DataFrame:
    """Result rows of chunks with a score: fixed fields, rounded scores, previews, and metadata with the chunk's own fields."""
    own = ("chunk_index", "event_start", "event_end", "char_start", "char_end", "file_path")
    extra = F.create_map(F.lit("chunk_id"), F.col("id").cast("string"), *(x for c in own if c in hits.columns for x in (F.lit(c), F.col(c).cast("string"))))
    kept = F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(kept, lambda k, _: ~F.map_contains_key(extra, k)), extra)
    score = F.round("score", 4)
    return hits.select(
        F.lit("trajectory").alias("source_type"), "source_name", "source_ref", F.lit("trajectory_chunk").alias("record_kind"), "title", "updated_at", "cwd",
        score.alias("score"), score.alias("match_score"), F.lit(match_kind).alias("match_kind"), T.normalize_text(F.col("text"), 500).alias("text_preview"),
        T.normalize_text(F.col("text"), 240).alias("summary_short"), merged.alias("metadata"))


def compact(rows: DataFrame) -> DataFrame:
    """Payload rows cut down: kept metadata, three snippets of 700 characters, and null for what is empty."""
    kept = F.map_filter("metadata", lambda k, v: k.isin(COMPACT) & (F.coalesce(v, F.lit("")) != ""))
    snippets = F.transform(F.slice(F.coalesce("snippets", F.array().cast("array<string>")), 1, 3), lambda s: T.normalize_text(s, 700)) if "snippets" in rows.columns else F.array().cast("array<string>")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        "source_ref", text("source_name").alias("source_name"), text("title").alias("title"), text("updated_at").alias("updated_at"), text("cwd").alias("cwd"),
        F.col("match_score").alias("score"), text("match_kind").alias("match_kind"), F.coalesce(text("text_preview"), text("summary_short")).alias("text_preview"),
        F.when(F.size(kept) > 0, kept).alias("metadata"), F.when(F.size(snippets) > 0, snippets).alias("snippets"))


def occurrences_at(text: Column, needle: str, most: int) -> Column:
    """Where a literal begins (from 1), in any case, each occurrence after the one before, most of them."""
    low, size = F.lower(text), max(1, len(needle))
    # the parts between occurrences give their places
    parts = F.split(low, "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in needle.lower()), -1)
    lengths = F.transform(F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(most))), F.length)
    summed = F.aggregate(lengths, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")), lambda s, n: F.struct((s["at"] + n + size).cast("int").alias("at"), F.concat(s["found"], F.array((s["at"] + n).cast("int"))).alias("found")))
    return summed["found"]


def snippet_candidates(text: Column, needle: str, width: int = 900, most: int = 8) -> Column:
    """Stretches of text around the first occurrences of a literal, with ellipses where text is left out."""

    def cut(at: Column) -> Column:
        begin = F.greatest(F.lit(1), at - width // 2)
        end = F.least(F.length(text), at + len(needle) - 1 + width // 2)
        body = F.regexp_replace(F.substring(text, begin, end - begin + 1), r"^\s+|\s+$", "")
        return F.concat(F.when(begin > 1, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))

    return F.transform(occurrences_at(text, needle, most), cut)


def snippet_quality(snippet: Column) -> Column:
    """What a snippet's look is worth: people's turns count for it, commands and quoted results against it."""
    low = F.lower(snippet)
    return lexical.total([F.when(low.rlike("|".join(signs)), F.lit(worth)).otherwise(F.lit(0)) for worth, signs in WORTH])


def snippets(text: Column, query: str, limit: int = 3, width: int = 900) -> Column:
    """The best snippets for a query: 40 for each of its tokens inside, and the snippet's quality; the first found wins a tie."""
    phrase = " ".join(T.focus_query(query).split())[:160]
    terms = T.query_tokens(query)
    found = [snippet_candidates(text, phrase, width)] if len(phrase) >= 6 else []
    found += [snippet_candidates(text, t, width, 3) for t in terms]
    if not found:
        return F.array().cast("array<string>")
    # the phrase and then token after token, until there are enough
    held = F.aggregate(F.array(*found), F.array().cast("array<string>"), lambda a, c: F.when(F.size(a) >= limit * 8, a).otherwise(F.array_distinct(F.concat(a, c))))
    covered = lambda s: lexical.total([F.contains(F.lower(s), F.lit(t)).cast("int") for t in terms])
    ranked = F.transform(held, lambda s, i: F.struct((-(40 * covered(s) + snippet_quality(s))).alias("worth"), i.alias("no"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(ranked), 1, limit), lambda x: x["s"])


def excerpt(text: Column, terms: list[str], size: int = 14, whole: bool = False) -> Column:
    """size terms of a text from a little before the first that the query has, with ellipses where terms are left out; whole: words of any script, as they are written."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{Mn}]+"), F.lit(0)) if whole else T.terms(text)
    hit = F.array_position(F.transform(words, lambda w: (T.plain(w) if whole else w).isin(terms)), True)
    begin = F.greatest(F.lit(1), F.least(F.greatest(hit - size // 4, F.lit(1)), F.size(words) - size + 1)).cast("int")
    return F.concat(F.when(begin > 1, "...").otherwise(""), F.array_join(F.slice(words, begin, F.lit(size)), " "), F.when(begin + size <= F.size(words), "...").otherwise(""))


def event_snippets(events: DataFrame, query: str, limit: int = 4, chars: int = 1800) -> DataFrame:
    """(source_ref, no, event_index, snippet): a session's events for a query, with places kept for kinds of them.

    People's and the agent's turns fill the places by their weight; one place is kept
    for the strongest tool output if that scores 60 or more, and one for the agent's
    last turn if the query asks for history. A user's turn takes the one after it along.
    """
    blank = F.lit("")
    title, cwd = (F.col(c) if c in events.columns else blank for c in ("title", "cwd"))
    base = score_text(F.col("text"), title, cwd, query)
    w = W.partitionBy("source_ref").orderBy("event_index")
    following = F.lead(F.struct("block", "role")).over(w)
    rows = events.withColumn("block", rendered()).withColumn("following", following).withColumn("base", base)
    first = F.row_number().over(W.partitionBy("source_ref", "role").orderBy("event_index")) == 1
    plain = F.col("role").isin("user", "assistant")
    weight = F.when(F.col("role") == "user", 1.0).otherwise(0.7) * F.col("base")
    rows = rows.withColumn("weight", F.when(plain, F.when(first & (F.col("role") == "user"), 1.25 * weight + 40).otherwise(weight)).otherwise(F.col("base")))
    rows = rows.withColumn("kind", F.when(plain, "primary").otherwise("secondary")).where("base > 0 or role = 'assistant'")
    history = bool(re.search(T.HISTORY, query))
    last = (F.col("role") == "assistant") & (F.col("event_index") == F.max(F.when(F.col("role") == "assistant", F.col("event_index"))).over(W.partitionBy("source_ref"))) if history else F.lit(False)
    by = W.partitionBy("source_ref", "kind").orderBy(F.desc(F.when(F.col("base") > 0, F.col("weight"))), F.desc("event_index"))
    whole = W.partitionBy("source_ref")
    rows = rows.withColumn("last", last).withColumn("rank", F.when(F.col("base") > 0, F.row_number().over(by)))
    strong = F.coalesce(F.max(F.when(F.col("kind") == "secondary", F.col("base"))).over(whole) >= 60, F.lit(False)).cast("int")
    ends = F.max(F.col("last").cast("int")).over(whole)
    rows = rows.withColumn("places", F.greatest(F.lit(1), limit - strong - ends))
    # the order in which places are taken: turns, the last turn, tool output
    group = F.when((F.col("kind") == "primary") & (F.col("rank") <= F.col("places")), 0).when(F.col("last"), 1).when((F.col("kind") == "secondary") & F.col("rank").isNotNull(), 2)
    rows = rows.withColumn("group", group).where("group is not null")
    rows = rows.withColumn("no", F.row_number().over(W.partitionBy("source_ref").orderBy("group", "rank", "event_index"))).where(F.col("no") <= limit)
    shown = F.when((F.col("role") == "user") & F.col("following").isNotNull(), F.concat("block", "following.block")).otherwise(F.col("block"))
    return rows.select("source_ref", "no", "event_index", F.substring(shown, 1, chars).alias("snippet"))


def evidence(results: DataFrame, max_chars: int = 18_000, intro: str = "") -> DataFrame:
    """(no, block): result sections in order, with their headers, until max_chars are used; the one that passes them is cut and says so."""
    w = W.orderBy("no").rowsBetween(W.unboundedPreceding, -1)  # results of one request
    place = F.when(F.coalesce("cwd", F.lit("")) != "", F.concat(F.lit("\nWorking directory: "), "cwd")).otherwise("")
    head = F.concat(F.lit("### Candidate "), F.col("no").cast("string"), F.lit("\nSource ref: "), "source_ref", F.lit("\nTool: "), "source_name", F.lit("\nUpdated: "), "updated_at", F.lit("\nTitle: "), "title", place)
    rows = results.withColumn("block", F.concat(head, F.lit("\n\nParsed trajectory evidence:\n"), F.coalesce("transcript", F.lit(""))))
    used = len(intro) + F.coalesce(F.sum(F.length("block") + 2).over(w), F.lit(0))
    rows = rows.withColumn("left", max_chars - used - 2).where("left > 0")
    cut = F.concat(F.rtrim(F.substring("block", F.lit(1), F.greatest(F.lit(0), F.col("left") - 30).cast("int"))), F.lit("\n\n[truncated]"))
    return rows.select("no", F.when(F.length("block") > F.col("left"), cut).otherwise(F.col("block")).alias("block"))


def answer_sources(log: DataFrame, most: int = 6) -> DataFrame:
    """(source_ref, kind, title, score): what an answer drew on, from a log (no, source_ref, kind, title, score): reads beat matches, the later row counts; matches only fill up to most."""
    rows = log.where(F.coalesce("source_ref", F.lit("")) != "").withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("match")))
    best = rows.groupBy("source_ref").agg(F.max(F.struct((F.col("kind") == "read").alias("read"), "no", "kind", T.normalize_text(F.coalesce("title", F.lit("")), 160).alias("title"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("b"))
    rows = best.select("source_ref", "b.kind", "b.title", "b.score", F.col("b.read").alias("is_read"))
    reads = rows.agg(F.count_if("is_read").alias("reads"))
    place = F.row_number().over(W.partitionBy("is_read").orderBy(F.desc("score"), "source_ref"))
    rows = rows.crossJoin(F.broadcast(reads)).withColumn("place", place).where(F.col("is_read") | (F.col("place") <= most - F.col("reads")))
    return rows.orderBy(F.desc("is_read"), F.desc("score"), "source_ref").select("source_ref", "kind", "title", "score")
