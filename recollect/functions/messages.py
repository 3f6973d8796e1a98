"""Message text: relay envelopes, sections, session keys, owner's voice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import text as T

# Fixed formats: a relay envelope between these brackets, a word, ask or ans, and name=value pairs, percent-encoded.
FIELDS = "\u27e6\\w+ (ask|ans)([^\u27e7]*)\u27e7"
#: It ends a message as a line of its own, or begins it after mentions.
TRAILER = rf"\n[ \t]*(?:-#[ \t]*|_)?{FIELDS}_?[ \t]*$"
LEADING = rf"(?s)^(?:<@!?[A-Za-z0-9]+(?:\|[^>]*)?>\s*)*{FIELDS}\s?(.*)$"
#: On whose behalf a bot asks: **Name** (via bot): before the text.
BEHALF = r"^\*{1,2}([^*\n]{1,80})\*{1,2} \(via [^)\n]{1,80}\):\s*"
# Answers that say nothing of their own.
ACKNOWLEDGEMENTS = [
    "sure", "ok", "okay", "yes", "y", "proceed", "continue", "go ahead", "go", "thanks", "thank you", "do it", "yes please", "sounds good",
    "please proceed", "great", "lgtm",
]
# How prompts begin that tools put in the owner's place.
DRIVEN = [
    r"Read the ENTIRE file", r"You are driving a Nebula notebook", r"We were disconnected", r"Implement the following plan", r"<!--\s*agent-session",
    r"In notebook /", r"Continue from where", r"\[Pasted text", r"Caveat: The messages below", r"<command-name>", r"<local-command",
    r"This session is being continued", r"Summarize prior conversation", r"\[Agent-driver", r"Reply with exactly", r"Review expected",
    r"You are (an?|the) [a-z -]*agent\b", r".*\bcontinue authorized\b",
]


def relayed(c: Column) -> Column:
    """kind, id, actor_id, name, body and asker of a message with an envelope, null without one.

    body is the text without the envelope and without the prefix that names the asker.
    """
    raw = F.rtrim(F.regexp_replace(c, r"\s+$", ""))
    ends, leads = raw.rlike(TRAILER), F.trim(raw).rlike(LEADING)
    part = lambda k: F.when(ends, F.regexp_extract(raw, TRAILER, k)).otherwise(F.regexp_extract(F.trim(raw), LEADING, k))
    pairs = F.filter(F.split(F.trim(part(2)), r"\s+"), lambda x: F.contains(x, F.lit("=")))
    value = lambda name: F.coalesce(F.substring_index(F.get(F.filter(pairs, lambda x: F.startswith(x, F.lit(name + "="))), 0), "=", -1), F.lit(""))
    plain = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    body = F.trim(F.when(ends, F.regexp_replace(raw, TRAILER, "")).otherwise(F.regexp_extract(F.trim(raw), LEADING, 3)))
    asker = F.trim(F.regexp_extract(body, BEHALF, 1))
    said = F.struct(
        part(1).alias("kind"), value("id").alias("id"), plain(value("actor")).alias("actor_id"),
        F.coalesce(F.nullif(plain(value("name")), F.lit("")), asker).alias("name"), F.trim(F.regexp_replace(body, BEHALF, "")).alias("body"), asker.alias("asker"))
    return F.when(ends | leads, said)


def stripped(c: Column) -> Column:
    """The message without its envelope, the prefix that names the asker kept."""
    raw = F.regexp_replace(c, r"\s+$", "")
    leads = F.trim(raw).rlike(LEADING)
    return F.when(raw.rlike(TRAILER), F.regexp_replace(F.regexp_replace(raw, TRAILER, ""), r"\s+$", "")).when(leads, F.trim(F.regexp_extract(F.trim(raw), LEADING, 3))).otherwise(raw)


def owner_voice(c: Column) -> Column:
    """Whether the owner says something: 4 to 1,500 characters, no acknowledgement, no bare slash command, nothing that a tool put there."""
    t = F.trim(c)
    bare = F.regexp_replace(F.lower(t), r"^[ .!]+|[ .!]+$", "")
    command = t.startswith("/") & ~F.contains(t, F.lit(" "))
    return F.length(t).between(4, 1500) & ~bare.isin(ACKNOWLEDGEMENTS) & ~command & ~t.rlike("(?i)^(?:" + "|".join(DRIVEN) + ")")


def session_id(ref: Column) -> Column:
    """A session id without its source's prefix and its chunk or epoch suffix."""
    return F.regexp_replace(F.regexp_replace(ref, r"(:chunk:\d+|#e?\d+)$", ""), r"^[a-z_]+:", "")


def project_key(source: Column, cwd: Column) -> Column:
    return F.concat_ws(":", source, F.regexp_replace(F.coalesce(cwd, F.lit("")), "/+$", ""))


def looks_like_followup(text: Column, before: Column) -> Column:
    """A marker word anywhere, at most two query tokens, or one of five letters shared with the message before."""
    words, old = T.query_words(text), T.query_words(before)
    long = lambda a: F.filter(a, lambda x: F.length(x) >= 5)
    return text.rlike(T.FOLLOW_UP) | (F.size(words) <= 2) | F.coalesce(F.arrays_overlap(long(words), long(old)), F.lit(False))


def safe_session_key(key: Column) -> Column:
    """A session key that can name a file: letters, digits, dots and dashes, 120 at most; main if nothing is left."""
    t = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), r"[^a-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, 120)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("main"))


def handle(override: Column, aliases: Column, name: Column) -> Column:
    """A short name: the override as a slug, else the shortest alias that looks like a user name, else a slug of the name, 20 characters at most."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(override, F.lit("")))), "[^a-z0-9._-]+", "-"), "^[-._]+|[-._]+$", ""), 1, 20)
    fit = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.lower(F.trim(a))), lambda a: a.rlike("^[a-z0-9][a-z0-9._-]{1,19}$"))
    best = F.array_min(F.transform(fit, lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))))["a"]
    plain = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 20)
    return F.coalesce(F.nullif(slug, F.lit("")), best, F.nullif(plain, F.lit("")), F.lit("owner"))


HEADING = r"^\s{0,3}#{1,4}\s+(.*\S)\s*$"
RULE = r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$"
ITEM = r"^\s*[-*]\s+"


def sections(briefings: DataFrame) -> DataFrame:
    """(id, no, kind, title, body) of briefings (id, text), nothing reworded.

    A heading or a rule begins a block. A block whose heading speaks of what was
    overlooked gives one row for each item and a note of the rest; another heading
    an article; without a heading the first row of all is the intro, others notes.
    """
    lines = briefings.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    cut = F.col("line").rlike(HEADING) | F.col("line").rlike(RULE)
    w = W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("block", F.sum(cut.cast("int")).over(w)).withColumn("cut", cut)
    title = F.trim(F.regexp_replace(F.regexp_extract("line", HEADING, 1), r"^[* ]+|[* ]+$", ""))
    text = F.array_sort(F.collect_list(F.when(~F.col("cut"), F.struct("line_no", "line"))))
    blocks = lines.groupBy("id", "block").agg(F.coalesce(F.max(F.when(F.col("cut"), title)), F.lit("")).alias("title"), F.transform(text, lambda x: x.line).alias("lines"))
    body = F.regexp_replace(F.array_join("lines", "\n"), r"^\s+|\s+$", "")
    blocks = blocks.withColumn("body", body).where("title <> '' or body <> ''")
    # in an overlooked block, indented lines go on with the last item, other lines are notes
    kind = "array<string>"
    nothing = F.struct(F.array().cast(kind).alias("items"), F.array().cast(kind).alias("notes"))

    def told(acc: Column, line: Column) -> Column:
        items, notes, said = acc["items"], acc["notes"], F.trim(F.regexp_replace(line, r"\s+$", ""))
        more = F.concat(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(items, -1), said)))
        state = lambda i, n: F.struct(i.alias("items"), n.alias("notes"))
        return (
            F.when(line.rlike(ITEM), state(F.concat(items, F.array(F.regexp_replace(said, ITEM, ""))), notes))
            .when((F.size(items) > 0) & line.rlike(r"^(  |\t)") & (said != ""), state(more, notes))
            .when(said != "", state(items, F.concat(notes, F.array(said)))).otherwise(acc))

    found = F.aggregate("lines", nothing, told)
    row = lambda name, title, text: F.struct(F.lit(name).alias("kind"), title.alias("title"), text.alias("body"))
    blank, none = F.lit(""), F.array().cast("array<struct<kind:string,title:string,body:string>>")
    missed = F.concat(F.transform(found["items"], lambda x: row("overlooked", blank, x)), F.when(F.size(found["notes"]) > 0, F.array(row("note", blank, F.array_join(found["notes"], "\n")))).otherwise(none))
    plain = F.when(F.col("title") != "", F.array(row("article", F.col("title"), F.col("body")))).otherwise(F.array(row("open", blank, F.col("body"))))
    rows = blocks.select("id", "block", F.posexplode(F.when(F.contains(F.lower("title"), F.lit("overlook")), missed).otherwise(plain)).alias("at", "r"))
    rows = rows.withColumn("no", F.row_number().over(W.partitionBy("id").orderBy("block", "at")))
    intro = (F.col("no") == 1) & (F.col("r.kind") == "open")
    kinds = F.when(intro, "intro").when(F.col("r.kind") == "open", "note").otherwise(F.col("r.kind"))
    return rows.select("id", "no", kinds.alias("kind"), "r.title", F.when(intro, F.regexp_replace("r.body", r"^[*\s]+|[*\s]+$", "")).otherwise(F.col("r.body")).alias("body"))
