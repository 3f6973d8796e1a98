"""Ranking: hybrid search, semantic memory, merged channels, prompts, overview, reading windows, the search loop."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import lexical, vectors

#: Markers of text that quotes retrieval output; a caller adds its own.
ECHOES = ['"match_kind"', '"source_ref"', "source ref: "]
# Words of a message that puts an earlier one right.
CORRECTIONS = ["better word", "correction", "corrected", "rename", "renamed", "agreed"]


def in_window(rows: DataFrame, after: str = "", before: str = "", source: str = "") -> DataFrame:
    """Rows of a source and of a stretch of time; a date-only bound takes in its whole day."""
    if source:
        rows = rows.where(F.lower("source_name") == source.lower())
    if after:
        rows = rows.where(F.col("updated_at") >= after)
    if before:
        rows = rows.where(F.col("updated_at") <= (before + "~" if len(before) <= 10 else before))
    return rows


def adjusted(rows: DataFrame, query: str, now: str | None = None, echoes: list[str] = ECHOES) -> Column:
    """score with title, position, echo and generated-session factors, then recency, in this order."""
    terms = T.query_tokens(query)
    title = F.size(F.array_intersect(F.array(*map(F.lit, terms)), T.tokens(F.col("title")))) if terms else F.lit(0)
    s = F.col("score") + 35 * title
    s = s + F.when(F.col("chunk_index") <= 1, 25).otherwise(0)
    s = F.when((F.col("chunk_index") > 120) & (title == 0), s * 0.8).otherwise(s)
    body = F.lower(F.regexp_replace("text", r"^Title: .*? Updated: \S* ?", ""))
    if not re.search(T.ABOUT_SEARCH, query):  # who asks about the search may want what quotes it
        echo = reduce(lambda a, b: a | b, [F.contains(body, F.lit(e)) for e in echoes], F.lit(False))
        s = F.when(echo, s * 0.35).otherwise(s)
    if "generated" in rows.columns:
        s = F.when(F.col("generated"), s * 0.2).otherwise(s)
    if now and "updated_at" in rows.columns:
        age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp"))) / 86400.0
        s = s + F.coalesce(T.recency(age, bool(re.search(T.RECENT, query))), F.lit(0.0))
    return F.round(s, 4)


def capped(rows: DataFrame, per_session: int, limit: int, session: str = "source_ref") -> DataFrame:
    """The best rows, at most per_session of a session."""
    order = [F.desc("score"), F.col("id")]
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy(session).orderBy(*order)))
    return ranked.where(F.col("r") <= per_session).drop("r").orderBy(*order).limit(limit)


def search(chunks: DataFrame, query: str, vector: DataFrame | None = None, mode: str = "hybrid", limit: int = 10, exact_limit: int = 300, vector_limit: int = 50, now: str | None = None, union: bool = False, per_session: int = 2, index: lexical.Index | None = None) -> DataFrame:
    """(id, source_ref, score): exact, vector or hybrid search over chunks, as one plan.

    In hybrid mode vectors rerank the exact hits if there are any; union=True lets
    both legs bring rows. Filters belong before: pass chunks through in_window().
    """
    if mode not in ("exact", "fts", "lexical", "vector", "semantic", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    exact, near = mode not in ("vector", "semantic"), vector is not None and mode in ("vector", "semantic", "hybrid")
    legs = [lexical.exact_scores(chunks.select("id", "text"), query, exact_limit, index)] if exact else []
    if near:
        rows = chunks.select("id", "embedding")
        if exact and not union:
            legs.append(vectors.vector_topk(rows, vector, vector_limit, F.broadcast(legs[0].select("id"))))  # exact_limit rows
            none = legs[0].agg((F.count("*") == 0).alias("none"))
            rows = rows.crossJoin(F.broadcast(none)).where("none").drop("none")
        legs.append(vectors.vector_topk(rows, vector, vector_limit))
    hits = reduce(DataFrame.unionByName, legs).groupBy("id").agg(F.sum("score").alias("score"))
    rows = chunks.join(F.broadcast(hits), "id")  # exact_limit + vector_limit rows at most
    rows = rows.withColumn("score", adjusted(rows, query, now))
    return capped(rows.select("id", "source_ref", "score"), per_session, limit)


def semantic_memory(rows: DataFrame, vector: DataFrame, query: str, limit: int = 10, min_score: float = 0.2) -> DataFrame:
    """(id, score, overlap): 0.8 * cosine + 0.4 * share of query tokens, one row a parent.

    If no row passes min_score or the overlap and there are up to 20, those of 0.05
    or more stand in, the first 2 * limit.
    """
    terms = T.query_tokens(query)
    near = vectors.vector_scores(rows, vector).withColumn("cosine", F.col("score") / 100)
    overlap = F.size(F.array_intersect(F.array(*map(F.lit, terms)), T.tokens(F.col("text")))) / max(1, len(terms))
    near = near.withColumn("overlap", overlap).withColumn("score", 0.8 * F.col("cosine") + 0.4 * F.col("overlap") + F.when(F.col("kind") == "chunk", 0.03).otherwise(0))
    near = near.withColumn("kept", (F.col("score") >= min_score) | (F.col("overlap") >= 0.25)).select("id", "parent", "score", "overlap", "kept")
    few = near.agg(F.coalesce(~F.bool_or("kept") & (F.count("*") <= 20), F.lit(False)).alias("few"))
    rank = F.row_number().over(W.partitionBy("few").orderBy(F.desc("score"), "id"))
    spare = near.crossJoin(F.broadcast(few)).where("few and score >= 0.05").withColumn("r", rank).where(F.col("r") <= 2 * limit).drop("r", "few")  # 20 rows at most
    kept = near.where("kept").unionByName(spare)
    best = kept.groupBy("parent").agg(F.max(F.struct("score", (-F.col("id")).alias("back"), "overlap")).alias("best"))
    out = best.select((-F.col("best.back")).alias("id"), F.round("best.score", 4).alias("score"), F.round("best.overlap", 4).alias("overlap"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def merge_channels(channels: list[DataFrame]) -> DataFrame:
    """(ref, channels, score, is_chunk): one row a session; chunks beat sessions, then the higher score.

    Channels with metadata (a map) and cwd bring those too: metadata is the union of
    all, the best row's values first, and cwd the best row's or else its metadata's.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels)
    rows = rows.withColumn("ref", F.substring_index("ref", ":chunk:", 1)).where("ref <> ''")
    more = [c for c in ("metadata", "cwd") if c in rows.columns]
    order = F.struct("is_chunk", "score", *(F.to_json(c).alias(f"{c}_text") if c == "metadata" else F.col(c) for c in more))
    out = rows.groupBy("ref").agg(
        F.array_sort(F.collect_set("channel")).alias("channels"), F.max(order).alias("best"),
        *([F.collect_set(F.struct("is_chunk", "score", F.to_json("metadata").alias("m"))).alias("all")] if "metadata" in more else []))
    cols = ["ref", F.array_join("channels", ",").alias("channels"), F.col("best.score").alias("score"), F.col("best.is_chunk").alias("is_chunk")]
    if "metadata" in more:
        maps = F.transform(F.array_sort("all"), lambda x: F.from_json(x["m"], "map<string,string>"))  # worse rows first, so that better ones overwrite
        merged = F.aggregate(F.filter(maps, lambda m: m.isNotNull()), F.create_map().cast("map<string,string>"), lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m))
        cols.append(merged.alias("metadata"))
        if "cwd" in more:
            cols.append(F.coalesce(F.nullif("best.cwd", F.lit("")), F.try_element_at(merged, F.lit("cwd")), F.lit("")).alias("cwd"))
    return out.select(*cols)


def candidates(channels: dict[str, DataFrame], limit: int, filtered: bool, seen: DataFrame | None = None) -> DataFrame:
    """The merged channels, each cut to what the request calls for, three times that if a filter is to thin them; seen are the refs that may be shown."""
    inner = max(2 * limit, 5, 8)
    each = max(2 * inner, 5, 8) * (3 if filtered else 1)
    legs = []
    for name, rows in channels.items():
        leg = rows.orderBy(F.desc("score"), "ref").limit(each).withColumn("channel", F.lit(name))
        legs.append(leg if seen is None else leg.join(seen.select("ref"), "ref", "left_semi"))
    return merge_channels(legs)


def candidate_boosts(memory: DataFrame) -> DataFrame:
    """(ref, boost): 60 less 4 for each place down the memory hits, the best of each session; never under 0."""
    place = F.row_number().over(W.orderBy("no")) - 1  # hits of one request, some dozens
    rows = memory.withColumn("boost", 60.0 - 4 * place).where("source_type = 'trajectory'")
    ref = F.substring_index(F.coalesce(F.nullif("parent_source_ref", F.lit("")), "source_ref"), ":chunk:", 1)
    return rows.groupBy(ref.alias("ref")).agg(F.greatest(F.lit(0.0), F.max("boost")).alias("boost")).where("ref <> ''")


def final_rank(score: Column, query: str, title: Column, cwd: Column, local: Column | None = None, chunk: Column | None = None) -> Column:
    """score + 28 for each query token in the title and 8 for each in the folder; for history questions 60 more for local look-ups and 15 for the index's hits."""
    terms = F.array(*map(F.lit, T.query_tokens(query)))
    s = score + 28 * F.size(F.array_intersect(terms, T.terms(title))) + 8 * F.size(F.array_intersect(terms, T.terms(cwd)))
    if re.search(T.HISTORY, query):
        for flag, more in ((local, 60), (chunk, 15)):
            s = s if flag is None else s + F.when(flag, more).otherwise(0)
    return s


def prompt_search(prompts: DataFrame, query: str, limit: int = 10, index: lexical.Index | None = None) -> DataFrame:
    """(id, hits): prompts with all terms, or with any if none has all; distinct by session and first 200 characters. With an index of the prompts no other prompts' texts are read."""
    terms = T.index_terms(query)
    rows = lexical.scored(prompts, terms) if index is None else prompts.join(lexical.scored(index, terms), "id")
    hits = lexical.total([(F.col(f"tf{i}") > 0).cast("int") for i in range(len(terms))])
    rows = rows.withColumn("hits", hits).withColumn("all", F.col("hits") == len(terms))
    some = rows.agg(F.coalesce(F.max("all"), F.lit(False)).alias("some"))
    rows = rows.crossJoin(F.broadcast(some)).where(F.col("all") | ~F.col("some"))
    order = [F.desc("hits"), F.desc(F.round("bm25", 4)), F.col("id")]
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("session_id", F.substring("text", 1, 200)).orderBy(*order))).where("r = 1")
    return rows.orderBy(*order).limit(limit).select("id", "hits")


def overview_search(sessions: DataFrame, query: str, recent: int = 20, limit: int = 10) -> DataFrame:
    """(id, score): 5 for each token in the title, its occurrences in the text, 0.75 for the newest sessions."""
    terms = T.query_tokens(query)
    low = F.lower("text")
    score = lexical.total([F.when(F.contains(F.lower("title"), F.lit(t)), 5).otherwise(0) + T.occurrences(low, t) for t in terms])
    flagged = sessions.orderBy(F.desc("updated_at"), "id").limit(recent).select("id", F.lit(0.75).alias("bonus"))
    rows = sessions.join(F.broadcast(flagged), "id", "left").withColumn("base", score).where("base > 0")
    return rows.select("id", F.round(F.col("base") + F.coalesce("bonus", F.lit(0.0)), 4).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


# The headings of a digest.
DIGEST = {
    0: "Trajectory memory is available from prior local agent sessions.",
    3: "Potentially relevant prior trajectories:",
    4: "Recent trajectories with more detail:",
    5: "Older trajectory catalog:",
    6: "Treat these summaries as hints, not ground truth. If exact provenance matters, inspect the source trajectory file.",
}


def prompt_digest(sessions: DataFrame, query: str = "", recent: int = 20, matches: int = 4, older: int = 8) -> DataFrame:
    """(section, place, line): what a prompt is told of earlier sessions, in this order: counts by tool, the sessions that match the query, the newest with more detail, those before them in short.

    sessions: id, tool, title, text, updated_at, short_summary, detailed_summary. A
    match has 5 points for each token in its title, one for each time it stands in the
    text, and 0.75 if it is one of the newest; a query without tokens prefers the
    newest. Sections without rows have no heading; null texts count as empty.
    """
    spark = sessions.sparkSession
    rows = sessions.select("id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("tool", "title", "text", "updated_at", "short_summary", "detailed_summary")))
    newest = [F.desc("updated_at"), F.col("id")]
    short = rows.select("id", "tool", "title", "updated_at", "short_summary", "detailed_summary").orderBy(*newest).limit(recent + older)
    short = short.withColumn("place", F.row_number().over(W.orderBy(*newest)))  # recent + older rows
    head = F.concat(F.lit("- ["), "tool", F.lit("]["), F.substring("updated_at", 1, 10), F.lit("] "))
    brief = F.concat(head, "title", F.lit(": "), "short_summary")

    def part(section: int, found: DataFrame, line: Column, first: int = 1) -> DataFrame:
        top = found.where(F.col("place") == first).select(F.lit(section).alias("section"), F.lit(0).alias("place"), F.lit(DIGEST[section]).alias("line"))
        return top.unionByName(found.select(F.lit(section).alias("section"), "place", line.alias("line")))

    tools = rows.groupBy("tool").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.struct("tool", "n"))).alias("tools"))
    each = F.array_join(F.transform("tools", lambda t: F.concat(F.initcap(t.tool), F.lit(" "), t.n.cast("string"))), ", ")
    counts = tools.select(F.lit(1).alias("section"), F.lit(0).alias("place"), F.concat(F.lit("Global overview: "), F.col("total").cast("string"), F.lit(" total sessions "), each, F.lit(".")).alias("line"))
    said = [(0, 0, DIGEST[0]), (6, 0, DIGEST[6])] + ([(2, 0, f"Current user query for memory matching: {query}")] if query else [])
    parts = [spark.createDataFrame(said, "section int, place int, line string"), counts]
    if query:
        terms = T.query_tokens(query)
        flagged = short.where(F.col("place") <= recent).select("id", F.lit(True).alias("new"))
        points = lexical.total([F.when(F.contains(F.lower("title"), F.lit(t)), 5.0).otherwise(0.0) + T.occurrences(F.lower("text"), t) for t in terms]) if terms else F.lit(0.2)
        scored = rows.join(F.broadcast(flagged), "id", "left").withColumn("score", points + F.when(F.col("new"), 0.75 if terms else 0.8).otherwise(0.0))
        best = [F.desc("score"), *newest]
        hits = scored.where("score > 0").drop("text").orderBy(*best).limit(matches).withColumn("place", F.row_number().over(W.orderBy(*best)))  # matches rows
        parts.append(part(3, hits, brief))
    parts += [part(4, short.where(F.col("place") <= recent), F.concat(head, "detailed_summary")), part(5, short.where(F.col("place") > recent), brief, recent + 1)]
    return reduce(DataFrame.unionByName, parts).orderBy("section", "place")


def read_window(events: DataFrame, ref: str, at: int, before: int = 3, after: int = 3, tail: int = 0, query: str = "", max_chars: int = 0) -> DataFrame:
    """Events around a hit, with the session's last ones if asked for.

    With max_chars the window has 64 percent of them, or 58 where the tail comes
    too, and the tail the rest; part is window or tail, and block the text, cut
    where its part's characters end. An event is shown once.
    """
    rows = events.where(F.col("source_ref") == ref)
    last = rows.agg(F.max("event_index").alias("last"))
    near = F.col("event_index").between(max(0, at - before), at + after)
    rows = rows.crossJoin(F.broadcast(last)).where(near | (F.col("event_index") > F.col("last") - tail)).withColumn("part", F.when(near, "window").otherwise("tail")).drop("last")
    if not max_chars:
        return rows.drop("part").orderBy("event_index")
    share = max_chars * (58 if tail else 64) // 100
    budget = F.when(F.col("part") == "window", share).otherwise(max_chars - share)
    rows = rows.withColumn("block", rendered())
    used = F.coalesce(F.sum(F.length("block")).over(W.partitionBy("source_ref", "part").orderBy("event_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("used", used).where(F.col("used") < budget)
    return rows.withColumn("block", F.substring("block", F.lit(1), (budget - F.col("used")).cast("int"))).drop("used").orderBy("event_index")


def read(events: DataFrame, ref: str, query: str, max_chars: int = 18_000) -> DataFrame:
    """The rendered session: all of it if it fits, else events that hold query tokens, else the last twelve."""
    rows = events.where(F.col("source_ref") == ref).withColumn("block", rendered())
    rows = rows.withColumn("hit", F.size(F.array_intersect(F.array(*map(F.lit, T.query_tokens(query) or [""])), T.tokens(F.col("text")))) > 0)
    whole = rows.agg((F.sum(F.length("block")) <= max_chars).alias("fits"), F.max("hit").alias("any"), F.max("event_index").alias("last"))
    rows = rows.crossJoin(F.broadcast(whole)).where(F.col("fits") | F.when(F.col("any"), F.col("hit")).otherwise(F.col("event_index") > F.col("last") - 12))
    used = F.sum(F.length("block")).over(W.partitionBy("source_ref").orderBy("event_index").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= max_chars).select("event_index", "block").orderBy("event_index")


def rendered() -> Column:
    """ROLE [time], the text, a line feed."""
    stamp = F.when(F.col("ts").isNull() | (F.col("ts") == ""), "").otherwise(F.concat(F.lit(" ["), F.col("ts"), F.lit("]")))
    return F.concat(F.upper("role"), stamp, F.lit("\n"), F.col("text"), F.lit("\n"))


def related_chunks(chunks: DataFrame, ref: str, query: str, limit: int = 2) -> DataFrame:
    """(id, score): other sections of one session: literal, term and anchor-recency scores, the best of each chunk."""
    rows = chunks.where(F.col("source_ref") == ref)
    terms = T.index_terms(query)
    legs = [lexical.literal(rows, query, 24, "chunk_index").select("id", F.col("score").cast("double").alias("score"))]
    ranked = lexical.scored(rows, terms)
    matched = lexical.total([(F.col(f"tf{i}") > 0).cast("int") for i in range(len(terms))])
    legs.append(ranked.select("id", (50 / (1 + F.abs("bm25")) + 3 * matched**2).alias("score")))
    fixes = reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(m)) for m in CORRECTIONS])
    for t in [t for t in T.anchor_tokens(terms) if len(t) >= 8][:8]:
        times = T.occurrences(F.lower("text"), t)
        place = F.row_number().over(W.partitionBy("source_ref").orderBy(F.desc("chunk_index"))) - 1
        newest = rows.where(F.contains(F.lower("text"), F.lit(t))).withColumn("place", place).where("place < 24")
        score = F.greatest(F.lit(0), 300 - 20 * F.col("place")) + min(len(t), 24) + 8 * F.least(times, F.lit(5)) + F.when(fixes, 360).otherwise(0)
        legs.append(newest.select("id", score.cast("double").alias("score")))
    best = reduce(DataFrame.unionByName, legs).groupBy("id").agg(F.round(F.max("score"), 4).alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(limit)


def close_together(words: Column, terms: list[str], width: int = 40) -> Column:
    """5 * best**2 for the most distinct terms within width positions of a text's tokens; 0 under three positions or terms."""
    known = F.array(*map(F.lit, terms or [""]))
    at = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.array_contains(known, F.get(words, i)))
    near = F.transform(at, lambda i: F.size(F.array_intersect(known, F.slice(words, F.greatest(i - width, F.lit(0)) + 1, F.least(i + 1, F.lit(width + 1))))))
    best = F.array_max(near)
    return F.when((F.size(at) >= 3) & (best >= 3), 5 * best * best).otherwise(0)


def score_text(text: Column, title: Column, cwd: Column, query: str) -> Column:
    """What a text is worth for a query: 80 for the focused query in it; if its terms are strong enough, their counts, places in title and folder, number and closeness."""
    terms = T.query_tokens(query)
    phrase = T.focus_query(query).lower()[:200]
    words = T.tokens(text)
    times = [F.size(F.filter(words, lexical.equals(t))) for t in terms]
    said = F.when(F.contains(F.lower(text), F.lit(phrase)), 80.0).otherwise(0.0) if len(phrase) >= 6 else F.lit(0.0)
    d = lexical.total([(n > 0).cast("int") for n in times])
    anchors = [n for t, n in zip(terms, times, strict=True) if t in T.anchor_tokens(terms)]
    strong = lexical.strong_enough(d, terms, lexical.total([(n > 0).cast("int") for n in anchors]) > 0 if anchors else None) | (said > 0)
    held = lambda c, t, more: F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t)), more).otherwise(0)
    each = [F.when(n > 0, 1 + 0.25 * F.least(n, F.lit(2)) + held(title, t, 8) + held(cwd, t, 4)).otherwise(0) for t, n in zip(terms, times, strict=True)]
    return F.when(strong & ((d > 0) | (said > 0)), said + lexical.total(each) + 1.5 * d * d + close_together(words, terms)).otherwise(0.0)


# What a role's events count for, beside 0.35 for others.
ROLE_WEIGHTS = {"user": 1.0, "assistant": 0.7, "tool_result": 0.18, "actions": 0.12}


def session_scores(sessions: DataFrame, events: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Two stages: session headers first, then the events of the best; 1.35 * header + the best event by role, a fifth of it for generated sessions."""
    title, cwd = F.col("title"), F.col("cwd")
    heads = sessions.withColumn("header", score_text(F.concat_ws(" ", title, cwd), title, cwd, query)).orderBy(F.desc("header"), "source_ref").limit(max(4 * limit, 12))
    weight = F.create_map(*[F.lit(x) for kv in ROLE_WEIGHTS.items() for x in kv])
    first = F.row_number().over(W.partitionBy("source_ref", "role").orderBy("event_index")) == 1
    body = events.join(F.broadcast(heads.select("source_ref", "title", "cwd")), "source_ref").withColumn("first", first & (F.col("role") == "user"))  # 12 rows, or 4 * limit
    s = score_text(F.col("text"), title, cwd, query) * F.coalesce(F.try_element_at(weight, F.col("role")), F.lit(0.35))
    best = body.withColumn("s", F.when(F.col("first"), 1.25 * s + 40).otherwise(s)).groupBy("source_ref").agg(F.max("s").alias("event"))
    total = 1.35 * F.col("header") + F.coalesce("event", F.lit(0.0))
    total = F.when(F.col("generated"), 0.2 * total).otherwise(total) if "generated" in sessions.columns else total
    out = heads.join(best, "source_ref", "left").select("source_ref", F.round(total, 4).alias("score"))
    return out.where("score > 0").orderBy(F.desc("score"), "source_ref").limit(limit)


def needs_iteration(top: list[float], status: bool = False, history: bool = False) -> bool:
    """Whether the best scores call for more queries."""
    if not top:
        return True
    margin = top[0] - (top[1] if len(top) > 1 else 0)
    return top[0] < 180 or status and top[0] < 500 or history and top[0] < 420 or margin < (80 if history else 45)


def query_variants(query: str, hits: list[dict] = (), most: int = 8, hints: dict[str, str] | None = None) -> list[str]:
    """Rewrites of a query, distinct in any case: focused, without its opening, its quotations, its tokens, with words of status, with the hints whose keyword it holds; then titles and folders of the best hits."""
    low, focused = query.lower(), T.focus_query(query)
    words = T.query_tokens(query)
    opened = [re.sub(p, "", low, count=1) for p in T.QUESTION_OPENINGS]
    told = [x for k, more in (hints or {}).items() if k.lower() in low for x in (f"{focused} {more}", more)]
    met = [x for h in list(hits)[:4] for x in (h.get("title") or "", (h.get("cwd") or "").rstrip("/").rsplit("/", 1)[-1])]
    found = [
        query, focused, *(q for q in opened if q != low), *re.findall(r'"([^"]{6,})"', query)[:3], " ".join(words[:10]) if len(words) > 2 else "",
        f"latest current status progress {focused}" if re.search(T.STATUS, query) else "", *told, *met,
    ]
    plain = [re.sub(r"\s+", " ", x)[:300].strip(" ?.'\"") for x in found]
    return list({x.lower(): x for x in reversed(plain) if x}.values())[::-1][:most]


def search_loop(run, query: str, rounds: int = 2, least_gain: float = 15, planner=None, seconds: float = 25, clock=time.monotonic) -> list[dict]:
    """Searches until the best scores suffice or seconds have passed: the query, its variants, then a planner's queries; run(query) gives rows with ref and score."""
    end = clock() + seconds
    best: dict[str, dict] = {}

    def ask(queries: list[str]) -> float:
        before = max((r["score"] for r in best.values()), default=0.0)
        for q in queries:
            for r in run(q) if clock() < end else ():
                if r["ref"] not in best or best[r["ref"]]["score"] < r["score"]:
                    best[r["ref"]] = r
        return max((r["score"] for r in best.values()), default=0.0) - before

    ranked = lambda: sorted(best.values(), key=lambda r: (-r["score"], r["ref"]))
    ask([query])
    if needs_iteration([r["score"] for r in ranked()]):
        ask(query_variants(query, ranked())[1:])
        for _ in range(rounds if planner else 0):
            if clock() >= end or not needs_iteration([r["score"] for r in ranked()]) or ask(planner(query, ranked())[:4]) < least_gain:
                break
    return ranked()
