"""Keyed state with timers: requests that are answered or expire, by transformWithState.

The session needs RocksDB's state store (spark.sql.streaming.stateStore.providerClass);
with_timers() sets it for the queries that it is given to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    """A session beside spark, of the same application and tables, whose streams may keep such state."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


class Requests(StatefulProcessor):
    """Of each request the first time it was asked and the first time it was answered, until the timer at the end of its time decides."""

    def __init__(self, key: str, seconds: float):
        self.key, self.seconds = key, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "ms long")
        self.answered = handle.getValueState("answered", "ms long")

    def due(self, ms: int) -> int:
        return ms + int(self.seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = {"ask": self.asked.get()[0] if self.asked.exists() else None, "ans": self.answered.get()[0] if self.answered.exists() else None}
        was = first["ask"]
        for pdf in rows:  # the least of all batches, so their order doesn't matter
            for kind in first:
                ms = pdf.loc[pdf["kind"] == kind, "ms"]
                if len(ms):
                    first[kind] = int(ms.min()) if first[kind] is None else min(first[kind], int(ms.min()))
        if first["ans"] is not None:
            self.answered.update((first["ans"],))
        if first["ask"] is not None and first["ask"] != was:
            self.asked.update((first["ask"],))
            if was is not None:
                self.handle.deleteTimer(self.due(was))
            self.handle.registerTimer(self.due(first["ask"]))
        elif was is None and first["ask"] is None:  # an answer to nothing is forgotten in time as well
            self.handle.registerTimer(self.due(first["ans"]))
        yield pd.DataFrame({self.key: pd.Series(dtype="object"), "asked_ms": pd.Series(dtype="int64"), "outcome": pd.Series(dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked = self.asked.get()[0] if self.asked.exists() else None
        answered = self.answered.get()[0] if self.answered.exists() else None
        if asked is None or expiredTimerInfo.getExpiryTimeInMs() == self.due(asked):
            self.asked.clear()
            self.answered.clear()
        if asked is not None and expiredTimerInfo.getExpiryTimeInMs() == self.due(asked):
            within = answered is not None and answered <= self.due(asked)
            yield pd.DataFrame({self.key: [key[0]], "asked_ms": [asked], "outcome": ["answered" if within else "expired"]})
        else:
            yield pd.DataFrame({self.key: pd.Series(dtype="object"), "asked_ms": pd.Series(dtype="int64"), "outcome": pd.Series(dtype="object")})

    def close(self) -> None:
        pass


def requests(stream: DataFrame, key: str, ts: str, seconds: float, late: str = "1 minute") -> DataFrame:
    """(key, asked_ms, outcome) of a stream of asks and answers (key, ts, kind: ask or ans), once each: answered within seconds of the ask, or expired.

    A row comes out when the watermark has passed the request's end, so rows up to
    late count whatever their order is, within a trigger and over triggers. State
    ends with the timer. Rows of other kinds and without key or time are left out.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col("kind").isin("ask", "ans"))
    rows = rows.select(F.col(key).cast("string").alias(key), F.col(ts).alias("at"), F.unix_millis(ts).alias("ms"), "kind").withWatermark("at", late)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Requests(key, seconds), outputStructType=f"{key} string, asked_ms long, outcome string", outputMode="Append", timeMode="EventTime")


def outcomes(rows: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """requests() of a whole table."""
    rows = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    first = rows.groupBy(F.col(key).cast("string").alias(key)).agg(*(F.min(F.when(F.col("kind") == k, F.unix_millis(ts))).alias(k) for k in ("ask", "ans")))
    within = F.coalesce(F.col("ans") <= F.col("ask") + int(seconds * 1000), F.lit(False))
    return first.where("ask is not null").select(key, F.col("ask").alias("asked_ms"), F.when(within, "answered").otherwise("expired").alias("outcome"))
