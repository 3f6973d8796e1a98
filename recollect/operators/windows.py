"""Session windows: caps, slices, duplicates, context, idle gaps, rolling rates, nearest matches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def equal_split(rows: DataFrame, session: str, order: str, parts: int = 4) -> DataFrame:
    """Each row's part, ceil(n / parts) rows to a part."""
    n = F.count("*").over(W.partitionBy(session))
    no = F.row_number().over(W.partitionBy(session).orderBy(order)) - 1
    return rows.withColumn("part", F.floor(no / F.ceil(n / parts)).cast("int"))


def recency_slices(rows: DataFrame, order: list[Column], recent: int = 8, older: int = 32) -> DataFrame:
    """The newest rows flagged recent or older; a top-k, so no single sorted partition of all rows."""
    top = rows.orderBy(*order).limit(recent + older)
    no = F.row_number().over(W.orderBy(*order))
    return top.withColumn("no", no).withColumn("slice", F.when(F.col("no") <= recent, "recent").otherwise("older"))


def adjacent_dropped(rows: DataFrame, session: str, order: str, *columns: str) -> DataFrame:
    """Rows that differ from the row before."""
    w = W.partitionBy(session).orderBy(order)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return rows.withColumn("keep", first | ~same).where("keep").drop("keep")


def with_last_user_turn(rows: DataFrame, session: str, order: str) -> DataFrame:
    """The last user text before each row."""
    w = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(w))


def event_window(rows: DataFrame, session: str, order: str, before: int, after: int, what: str) -> DataFrame:
    """Each row with its neighbours' texts."""
    return rows.withColumn("near", F.collect_list(what).over(W.partitionBy(session).orderBy(order).rowsBetween(-before, after)))


def in_budget(rows: DataFrame, session: str, order: str, text: str, chars: int) -> DataFrame:
    """The newest rows of each session within a number of characters, one at least."""
    w = W.partitionBy(session).orderBy(F.desc(order))
    used = F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).withColumn("r", F.row_number().over(w)).where((F.col("used") <= chars) | (F.col("r") == 1)).drop("used", "r")


def idle_sessions(rows: DataFrame, key: str, ts: str, gap: Column) -> DataFrame:
    """Session numbers: a row begins one when it comes later than its own gap (seconds) after the row before."""
    w = W.partitionBy(key).orderBy(ts, *[c for c in ("event_id",) if c in rows.columns])
    since = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
    begins = F.when(since.isNull() | (since > gap), 1).otherwise(0)
    return rows.withColumn("begins", begins).withColumn("session_no", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("begins")


def rolling_count(rows: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows of the key within the last seconds, this one included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.withColumn("n", F.count("*").over(W.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)))


def debounced(rows: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Messages of a key with less than gap between them, as one."""
    return rows.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("messages")).select(key, F.col("w.start").alias("began"), "messages")


def rate_limited(rows: DataFrame, key: str, ts: str, limit: int = 6, seconds: float = 60) -> DataFrame:
    """allowed: fewer than limit allowed rows in the last seconds; denied rows don't count.

    What came before a pause of that length doesn't matter any more, so a key's
    rows are cut at pauses and each stretch is a group: a busy key is many groups.
    A stretch streams by in order; only the times of the last allowed rows are held.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    order = W.partitionBy(key).orderBy(at, *(c for c in ("event_id",) if c in rows.columns))
    pause = F.coalesce(at - F.lag(at).over(order) >= int(seconds * 1_000_000), F.lit(True))
    rows_ = rows.withColumn("_at", at).withColumn("_stretch", F.sum(pause.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    columns = rows.columns
    tie = [c for c in ("event_id",) if c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, seen = None, deque()
        for pdf in batches:
            allowed = []
            for k, stretch, t in zip(pdf[key], pdf["_stretch"], pdf["_at"], strict=True):
                if (k, stretch) != group:
                    group, seen = (k, stretch), deque()
                while seen and t - seen[0] >= seconds * 1_000_000:
                    seen.popleft()
                allowed.append(len(seen) < limit)
                if allowed[-1]:
                    seen.append(t)
            yield pdf[columns].assign(allowed=allowed)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", allowed boolean"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows_.repartition(n, key, "_stretch").sortWithinPartitions(key, "_stretch", "_at", *tie).mapInPandas(run, schema)


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time, within seconds.

    Time is cut into buckets of that length, so the join is by key and bucket and
    no pair further apart than two buckets is ever made.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    wide = seconds * 1_000_000
    a = left.withColumn("bucket", F.explode(F.array(*(F.floor(at("ts") / wide) + d for d in (-1, 0, 1)))))
    b = right.select(F.col(key), F.col("id").alias("match_id"), F.col("ts").alias("match_ts")).withColumn("bucket", F.floor(at("match_ts") / wide))
    pairs = a.join(b, [key, "bucket"]).withColumn("gap", F.abs(at("ts") - at("match_ts"))).where(F.col("gap") <= wide)
    r = F.row_number().over(W.partitionBy("id").orderBy("gap", "match_id"))
    return pairs.withColumn("r", r).where("r = 1").drop("r", "bucket")


def mentions(chunks: DataFrame, session: str, order: str) -> DataFrame:
    """max(0, 300 - 20 * position) of each chunk, newest first."""
    place = F.row_number().over(W.partitionBy(session).orderBy(F.desc(order))) - 1
    return chunks.withColumn("bonus", F.greatest(F.lit(0), 300 - 20 * place))


def trailing(rows: DataFrame, key: str, ts: str, now: str, hours: float) -> DataFrame:
    """Rows of the last hours before now."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    return rows.where((F.col(ts).cast("timestamp") >= since) & (F.col(ts).cast("timestamp") <= F.lit(now).cast("timestamp")))


def to_compact(messages: DataFrame, session: str, order: str, text: str, most: int = 40, chars: int = 16_000, keep: int = 24) -> DataFrame:
    """(session, messages, chars, compactable): conversations over most messages or chars, and how many of the oldest to fold; the last keep stay."""
    out = messages.groupBy(session).agg(F.count("*").alias("messages"), F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars"))
    return out.withColumn("compactable", F.greatest(F.col("messages") - keep, F.lit(0))).where(((F.col("messages") > most) | (F.col("chars") > chars)) & (F.col("compactable") > 0))


def rotated(log: DataFrame, session: str, order: str, cap: int = 400) -> DataFrame:
    """segment: which file of the log each row is in, when a file that holds over cap rows is put away before the next row."""
    n = F.row_number().over(W.partitionBy(session).orderBy(order)) - 1
    return log.withColumn("segment", F.floor(n / (cap + 1)).cast("int"))


def unread(feed: DataFrame, read: DataFrame, channel: str) -> DataFrame:
    """(channel, unread): rows of others after the last one read; read has channel and read_seq, a channel without has read none."""
    rows = feed.join(read, channel, "left").where((F.col("seq") > F.coalesce("read_seq", F.lit(0))) & ~F.col("is_self") & ~F.col("local"))
    return read.select(channel).unionByName(feed.select(channel)).distinct().join(rows.groupBy(channel).agg(F.count("*").alias("unread")), channel, "left").fillna(0, ["unread"])


def waiting(requests: DataFrame, now: float, seconds: float = 300) -> DataFrame:
    """Requests that some bot still has to answer, made no longer than seconds ago."""
    return requests.where((F.lit(now) - F.col("created") <= seconds) & (F.size("bots") > 0))


def retained(outbox: DataFrame, now: float, seconds: float = 600) -> DataFrame:
    """Outbox rows that stay: unsent ones, and sent ones for some time."""
    return outbox.where(~F.col("sent") | (F.col("created") > now - seconds))


def paced(log: DataFrame, base: float = 90, most: float = 600) -> DataFrame:
    """One row: budget, extension granted, spent and remaining seconds of a retrieval log (seconds, extension_seconds)."""
    out = log.agg(F.coalesce(F.sum("extension_seconds"), F.lit(0.0)).alias("extension"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("spent"))
    budget = F.least(F.lit(float(most)), base + F.col("extension"))
    return out.select(F.round(budget, 1).alias("budget"), F.round("extension", 1).alias("extension"), F.round("spent", 1).alias("spent"), F.round(F.greatest(F.lit(0.0), budget - F.col("spent")), 1).alias("remaining"))


def briefing_since(runs: DataFrame, now: str, today: str, hours: float = 36, days: int = 4) -> DataFrame:
    """One row: since and backdrop of a briefing, from the runs (started_at, day) of earlier days: the last run, hours back at least and days at most."""
    at = F.lit(now).cast("timestamp")
    least, most = at - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"), at - F.expr(f"INTERVAL {days} DAYS")
    last = runs.where(F.col("day") < today).agg(F.max("started_at").alias("last"))
    return last.select(F.greatest(F.least(F.coalesce("last", least), least), most).alias("since"), (at - F.expr("INTERVAL 14 DAYS")).alias("backdrop"))


def briefing(prompts: DataFrame, info: DataFrame, window: DataFrame, voice: Column, repeats: int = 3) -> DataFrame:
    """Prompts of the owner since the backdrop, with the session's title and folder: not automated, not repeated; slice is recent or backdrop.

    prompts: source_ref, ts, cwd, text; info: source_ref, title, cwd, origin.
    """
    from .catalog import repeats_dropped

    rows = prompts.crossJoin(F.broadcast(window)).where(F.col("ts") >= F.col("backdrop"))
    rows = repeats_dropped(rows.withColumn("text", F.trim("text")), "text", repeats - 1).where(voice)
    known = info.groupBy("source_ref").agg(F.max("title").alias("title"), F.max("cwd").alias("own_cwd"), F.max("origin").alias("origin"))
    rows = rows.join(known, "source_ref", "left").where(F.coalesce("origin", F.lit("")) != "automated")
    place = F.coalesce(F.nullif("cwd", F.lit("")), "own_cwd", F.lit(""))
    return rows.select("source_ref", "ts", place.alias("cwd"), F.coalesce("title", F.lit("")).alias("title"), F.substring("text", 1, 700).alias("text"), F.when(F.col("ts") >= F.col("since"), "recent").otherwise("backdrop").alias("slice"))


def skipped(listing: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Files of the listing (path, size, mtime, policy) with the verdict of an earlier look, null where the file or the policy has changed since."""
    same = ["path", "size", "mtime", "policy"]
    return listing.join(verdicts.select(*same, "verdict"), same, "left")
