"""Nearest in time, without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def nearest(left: DataFrame, right: DataFrame, key: str, seconds: float, ts: str = "ts", outer: bool = False) -> DataFrame:
    """left rows with match_id, match_ts and gap (microseconds): the row of right (key, id, ts) of equal key that is nearest in time, within seconds; of equal gaps the earlier one, of equal times the least id.

    Both sides stand in one order of time, and each row of left takes the last row of
    right before it and the next one after it, whichever is nearer: the cost is that
    of a sort, however many rows share a key. Time is cut at multiples of seconds, so
    that a key with very many rows is many groups; what lies over a cut is carried
    there, the last row of a stretch into the next one and the first into the one
    before, which is as far as a match can lie. Rows of left without key or time have
    no match; outer keeps all rows of left.
    """
    wide = int(seconds * 1_000_000)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = left.select(F.col(key).alias("k"), at(ts).alias("t"), F.struct("*").alias("row"))
    held = right.select(F.col(key).alias("k"), at(ts).alias("t"), "id").where("k is not null and t is not null").groupBy("k", "t").agg(F.min("id").alias("id"))
    stretch = F.floor(F.col("t") / F.lit(wide))
    marked = held.select("k", stretch.alias("stretch"), F.struct("t", "id").alias("m"))
    edges = marked.groupBy("k", "stretch").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    none = lambda df: F.lit(None).cast(df.schema["row"].dataType)
    theirs = marked.unionByName(edges.select("k", (F.col("stretch") + 1).alias("stretch"), F.col("last").alias("m"))).unionByName(edges.select("k", (F.col("stretch") - 1).alias("stretch"), F.col("first").alias("m")))
    theirs = theirs.select("k", "stretch", F.col("m.t").alias("t"), "m", none(own).alias("row"))
    all_ = own.where("k is not null and t is not null").select("k", stretch.alias("stretch"), "t", F.lit(None).cast(theirs.schema["m"].dataType).alias("m"), "row").unionByName(theirs)
    in_time = W.partitionBy("k", "stretch").orderBy("t", F.col("row").isNotNull())
    before = F.last("m", ignorenulls=True).over(in_time.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("m", ignorenulls=True).over(in_time.rowsBetween(0, W.unboundedFollowing))
    rows = all_.withColumn("before", before).withColumn("after", after).where("row is not null")

    def gap(m: str) -> Column:
        return F.abs(F.col(f"{m}.t") - F.col("t"))

    best = F.when(F.col("before").isNull() | (gap("after") < gap("before")), F.col("after")).otherwise(F.col("before"))
    rows = rows.withColumn("best", best).withColumn("gap", F.abs(F.col("best.t") - F.col("t")))
    found = F.col("gap") <= wide
    time = F.timestamp_micros("best.t")
    if dict(right.dtypes)[ts] == "timestamp_ntz":
        time = time.cast("timestamp_ntz")
    rows = rows.select("row.*", F.when(found, F.col("best.id")).alias("match_id"), F.when(found, time).alias("match_ts"), F.when(found, F.col("gap")).alias("gap"))
    if not outer:
        return rows.where("gap is not null")
    alone = left.where(F.col(key).isNull() | F.col(ts).isNull())
    return rows.unionByName(alone, allowMissingColumns=True)
