"""A table in buckets by key that takes upserts: a merge writes only the buckets that it touches.

Every version of the table names the folder of each bucket in a manifest (as the
full-text index does), so a reader keeps to one version while a merge goes on, a merge
that fails leaves nothing behind but folders that no version names, and of two merges
that begin with one version the second is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import versions


class Buckets:
    """One version of the table at path."""

    def __init__(self, spark: SparkSession, path: str, version: int, live: dict):
        self.spark, self.path, self.version, self.live = spark, path, version, live

    @staticmethod
    def open(spark: SparkSession, path: str) -> Buckets:
        version, live = versions.newest(spark, path)
        if live is None:
            raise FileNotFoundError(f"no table at {path}")
        return Buckets(spark, path, version, live)

    @staticmethod
    def create(spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64) -> Buckets:
        """An empty table; a bucket should hold some hundred MB in the end."""
        names = spark.createDataFrame([], schema)
        live = {"schema": names.schema.simpleString().removeprefix("struct<").removesuffix(">"), "key": key, "n": buckets, "folders": {}, "batches": []}
        return Buckets(spark, path, versions.put(spark, path, 0, live), live)

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of this version, of some buckets or all."""
        wanted = self.live["folders"] if only is None else {b: self.live["folders"][b] for b in map(str, only) if b in self.live["folders"]}
        empty = self.spark.createDataFrame([], self.live["schema"].replace(":", " "))
        return self.spark.read.schema(empty.schema).parquet(*(f"{self.path}/data/{f}" for f in wanted.values())) if wanted else empty

    def numbered(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.live["key"]), F.lit(self.live["n"])).cast("int"))

    def merge(self, changes: DataFrame, batch: str | None = None, gone: str | None = None) -> Buckets:
        """The version with changes put in: a row takes the place of the one of its key; of several the newest by imported_at, then the largest by all columns. Rows for which the condition gone holds take theirs away. A batch that was merged before changes nothing."""
        if batch is not None and batch in self.live["batches"]:
            return self
        key, columns = self.live["key"], self.read([]).columns
        order = [F.desc(c) for c in ("imported_at",) if c in columns] + [F.desc(F.to_json(F.struct(*columns)))]
        newest = changes.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
        newest = self.numbered(newest)
        touched = [r[0] for r in newest.select("_bucket").distinct().collect()]  # n at most
        # null keys are equal to each other here
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
        kept = self.numbered(self.read(touched)).alias("o").join(newest.select("_bucket", *key).alias("c"), [F.col("o._bucket") == F.col("c._bucket"), *same], "left_anti")
        put = newest if gone is None else newest.where(f"NOT coalesce({gone}, false)")
        name = uuid.uuid4().hex
        kept.select(*columns, "_bucket").unionByName(put.select(*columns, "_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        filled = set(versions.listed(self.spark, f"{self.path}/data/{name}"))
        folders = {b: f for b, f in self.live["folders"].items() if int(b) not in touched} | {str(b): f"{name}/_bucket={b}" for b in touched if f"_bucket={b}" in filled}
        live = self.live | {"folders": folders, "batches": [*self.live["batches"], *([batch] if batch else [])][-1000:]}
        return Buckets(self.spark, self.path, versions.put(self.spark, self.path, self.version, live), live)

    def vacuum(self) -> None:
        """Removes the folders that this version doesn't name; readers of older versions lose theirs."""
        used = set(self.live["folders"].values())
        for name in versions.listed(self.spark, f"{self.path}/data"):
            for part in versions.listed(self.spark, f"{self.path}/data/{name}"):
                if part.startswith("_bucket=") and f"{name}/{part}" not in used:
                    versions.remove(self.spark, f"{self.path}/data/{name}/{part}")
            if not any(f.startswith(f"{name}/") for f in used):
                versions.remove(self.spark, f"{self.path}/data/{name}")
        versions.forget(self.spark, self.path, self.version)
