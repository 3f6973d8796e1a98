"""Streams: incremental refresh of an index, sessions by idle gap, rate limits, deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Runs of a level of a refreshed table that become one of the next level.
COMPACT = 20
#: Rows of a key that a stateful operator hands on at once.
PIECE = 10_000


def refresh(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df, files: int = 100, compact: int = COMPACT):
    """Merges new files under source into the table at target, each once; ends when there are none.

    The checkpoint is the ledger of files. A batch writes its own rows alone, as
    the run of its number on level 0, and run again after a failure it writes the
    same run over the old one. Every compact runs of a level become one of the next,
    so a row is written once a level, and levels grow with the logarithm of the
    batches; the newest version of a key wins, whatever level it lies on. Runs go once
    a later run of their level was merged away too, so a batch that is run again finds
    all it needs.
    """

    def merge(batch: DataFrame, number: int) -> None:
        newest_first(transform(batch), key).write.mode("overwrite").parquet(f"{target}/run0/{number}")
        level, width = 0, max(2, compact)
        while (number + 1) % width == 0:
            parts = [n for n in versions(spark, f"{target}/run{level}") if number - width < n <= number]
            newest_of(spark, [(f"{target}/run{level}/{n}", n) for n in parts], key).write.mode("overwrite").parquet(f"{target}/run{level + 1}/{number}")
            for n in versions(spark, f"{target}/run{level}"):
                if n <= number - width:
                    remove(spark, f"{target}/run{level}/{n}")
            level, width = level + 1, width * max(2, compact)

    if not folder(spark, f"{target}/key/_SUCCESS")[0].exists(folder(spark, f"{target}/key/_SUCCESS")[1]):
        spark.createDataFrame(list(enumerate(key)), "no int, name string").coalesce(1).write.mode("overwrite").parquet(f"{target}/key")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def newest_first(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key: of the latest imported_at if there is one, else and on a tie the largest by all columns."""
    order = [F.desc(c) for c in ("imported_at",) if c in rows.columns] + [F.desc(F.to_json(F.struct(*rows.columns)))]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the tables below path that were written to their end."""
    fs, place = folder(spark, path)
    if not fs.exists(place):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(place)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(folder(spark, f"{path}/{n}/_SUCCESS")[1]))


def remove(spark: SparkSession, path: str) -> None:
    fs, place = folder(spark, path)
    fs.delete(place, True)


def newest_of(spark: SparkSession, parts: list[tuple[str, int]], key: list[str]) -> DataFrame:
    """The row of the highest number of each key, over tables (path, number) that hold a key once each."""
    if len(parts) == 1:
        return spark.read.parquet(parts[0][0])
    rows = None
    for path, n in parts:
        part = spark.read.parquet(path).withColumn("_version", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_version")))).where("_r = 1").drop("_r", "_version")


def live(spark: SparkSession, target: str) -> list[tuple[str, int]]:
    """The runs (path, number) that the table consists of: the highest level's, and of each level below what is newer."""
    found, upto = [], -1
    levels = 0
    while folder(spark, f"{target}/run{levels}")[0].exists(folder(spark, f"{target}/run{levels}")[1]):
        levels += 1
    for level in reversed(range(levels)):
        new = [n for n in versions(spark, f"{target}/run{level}") if n > upto]
        found += [(f"{target}/run{level}/{n}", n) for n in new]
        upto = max([upto, *new])
    return found


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The refreshed table as it is now, none before its first batch."""
    parts = live(spark, target)
    return newest_of(spark, parts, [r["name"] for r in spark.read.parquet(f"{target}/key").orderBy("no").collect()]) if parts else None


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with a watermark a second ahead of ts, so that rows of the first second of all are not late."""
    return stream.withColumn("_at", F.col(ts) + F.expr("INTERVAL 1 SECOND")).withWatermark("_at", late)


def in_order(batches: Iterator[pd.DataFrame], ts: str) -> Iterator[pd.Series]:
    """The times of a key's rows of one trigger in order, over all its Arrow batches, a piece at a time: only the times are held, eight bytes each."""
    times = pd.concat([pdf[ts] for pdf in batches], ignore_index=True).sort_values(ignore_index=True)
    for at in range(0, len(times), PIECE):
        yield times[at : at + PIECE]


def idle_sessions(stream: DataFrame, key: str, ts: str, gap_seconds: float, late: str = "1 day", forget: float | None = None) -> DataFrame:
    """(key, ts, session_no) of a stream: the number rises when a row comes later than the gap after the last one.

    A key without rows for forget seconds of event time (ten gaps by default), once
    the watermark has passed them, loses its state, so state follows the keys in use;
    should it come back, its numbers begin again. Rows that come later than late are
    left out.
    """
    forget = 10 * gap_seconds if forget is None else forget

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, number = state.get if state.exists else (None, 0)
        for times in in_order(batches, ts):
            numbers = []
            for t in times.astype("datetime64[us]").astype("int64") / 1e6:
                number += last is None or t - last > gap_seconds
                last = t if last is None else max(last, t)
                numbers.append(number)
            yield pd.DataFrame({key: k[0], ts: times, "session_no": numbers})
        state.update((last, number))
        state.setTimeoutTimestamp(max(int((last + forget) * 1000), state.getCurrentWatermarkMs() + 1))

    kind = dict(stream.dtypes)[key]
    return timed(stream, ts, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, session_no int", "last double, number int", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(stream: DataFrame, key: str, ts: str, limit: int = 6, seconds: float = 60, late: str = "1 day") -> DataFrame:
    """(key, ts, allowed): the sliding limit with denied rows left out of the count; a key's state ends when the watermark has passed its last window, rows later than late are left out."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        for times in in_order(batches, ts):
            allowed = []
            for t in times.astype("datetime64[us]").astype("int64") / 1e6:
                seen = [s for s in seen if t - s < seconds]
                allowed.append(len(seen) < limit)
                seen += [t] if allowed[-1] else []
            yield pd.DataFrame({key: k[0], ts: times, "allowed": allowed})
        state.update((seen,))
        state.setTimeoutTimestamp(max(int((max(seen, default=0.0) + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    kind = dict(stream.dtypes)[key]
    return timed(stream, ts, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, allowed boolean", "seen array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def once(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Messages by id, each once while its time is within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def debounced(stream: DataFrame, key: str, ts: str, gap: str = "1250 milliseconds", late: str = "10 seconds") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("messages"))
