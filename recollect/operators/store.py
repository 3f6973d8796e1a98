"""Tables that change: diffs, merges, deletes, purges, feeds, batches, on plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .buckets import Buckets


def diff(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, state): new, removed, changed or same, by a full outer join."""
    a = old.select(key, F.struct(*columns).alias("was"))
    b = new.select(key, F.struct(*columns).alias("is"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("is")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def stale(state: DataFrame, listing: DataFrame, key: str, most: int) -> DataFrame:
    """The newest changed or new rows to refresh, most at a time, each with the number that is left for later (remaining)."""
    todo = state.where(F.col("state").isin("new", "changed")).join(listing, key)
    left = todo.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("remaining"))
    return todo.orderBy(F.desc("updated_at"), key).limit(most).crossJoin(F.broadcast(left))


def merged(store: DataFrame, changes: DataFrame, *key: str) -> DataFrame:
    """store with changes put in: rows of an equal key are replaced; the newest change counts, on a tie the largest by all columns."""
    order = [F.desc(c) for c in ("imported_at",) if c in changes.columns] + [F.desc(F.to_json(F.struct(*changes.columns)))]
    newest = changes.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    return store.join(newest.select(*key), list(key), "left_anti").unionByName(newest, allowMissingColumns=True)


def merge_counts(store: DataFrame, changes: DataFrame, key: str, content: str) -> DataFrame:
    """Rows inserted, updated, unchanged and kept."""
    state = diff(store, changes, key, content)
    name = F.expr("CASE state WHEN 'new' THEN 'inserted' WHEN 'changed' THEN 'updated' WHEN 'same' THEN 'unchanged' ELSE 'kept' END")
    return state.groupBy(name.alias("outcome")).agg(F.count("*").alias("n"))


def deleted(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return store.join(gone.select(key).distinct(), key, "left_anti")


def new_projects(known: DataFrame, current: DataFrame) -> DataFrame:
    """(project, state): pending if met for the first time, known, or dropped if it is gone."""
    a, b = known.select("project", F.lit(1).alias("k")), current.select("project", F.lit(1).alias("c"))
    return a.join(b, "project", "full_outer").select("project", F.when(F.col("k").isNull(), "pending").when(F.col("c").isNull(), "dropped").otherwise("known").alias("state"))


def reviewed_projects(known: DataFrame, current: DataFrame, now: str, first_run: bool = False) -> DataFrame:
    """The projects (key, first_seen, sessions, reviewed) after a look at the index (key, sessions, worthy).

    The first run takes all as reviewed. Later a new project enters, to be reviewed,
    if it is worth it; one that still waits leaves when it is not, or is gone; what
    was reviewed stays.
    """
    seen = current.select("key", F.col("sessions").alias("now_sessions"), "worthy")
    rows = known.join(seen, "key", "full_outer")
    new, worthy = F.col("reviewed").isNull(), F.coalesce("worthy", F.lit(False))
    rows = rows.where(F.when(new, worthy | F.lit(first_run)).otherwise(F.col("reviewed") | worthy))
    return rows.select("key", F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.coalesce("now_sessions", "sessions").alias("sessions"), F.coalesce("reviewed", F.lit(first_run)).alias("reviewed"))


def prefix_lookup(rows: DataFrame, key: str, prefix: str, newest: str) -> DataFrame:
    """The newest row whose key begins with prefix; the range reaches the scan."""
    return rows.where(F.col(key).startswith(prefix)).orderBy(F.desc(newest), key).limit(1)


def trimmed_feed(feed: DataFrame, rows: DataFrame, most: int = 600, keep: int = 400) -> DataFrame:
    """feed with rows appended; once over most rows, the last keep."""
    all_rows = feed.unionByName(rows)
    n = all_rows.agg(F.count("*").alias("total"))
    top = all_rows.orderBy(F.desc("seq")).limit(most + 1).withColumn("r", F.row_number().over(W.orderBy(F.desc("seq"))))
    return top.crossJoin(F.broadcast(n)).where((F.col("total") <= most) | (F.col("r") <= keep)).drop("r", "total")


def batched(rows: DataFrame, by: str, order: str, size: int = 50) -> DataFrame:
    """The batch number of each row within its source."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size).cast("int"))


def corrected(rows: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """rows with the corrections' values where there are any."""
    fixes = corrections.select(key, F.col(column).alias("fixed"))
    return rows.join(fixes, key, "left").withColumn(column, F.coalesce("fixed", column)).drop("fixed").select(*rows.columns)


def with_hash(rows: DataFrame, *parts: str) -> DataFrame:
    return rows.withColumn("content_hash", T.stable_hash(*map(F.col, parts)))


def valid_records(rows: DataFrame, required: list[str], kinds: list[str]) -> Column:
    """Whether an imported record has all it needs and a known kind."""
    ok = F.coalesce(F.col("kind").isin(kinds), F.lit(False))
    for c in required:
        ok = ok & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return ok


def imported(rows: DataFrame, required: list[str], kinds: list[str], widths: dict[str, int]) -> DataFrame:
    """The valid records, fields cut to their widths, each with the number of records refused (rejected)."""
    ok = valid_records(rows, required, kinds)
    refused = rows.agg(F.count_if(~ok).alias("rejected"))
    cut = [F.substring(c, 1, widths[c]).alias(c) if c in widths else F.col(c) for c in rows.columns]
    return rows.where(ok).select(*cut).crossJoin(F.broadcast(refused))


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The chunk index as Parquet by source; files are ranges of time within a source, so bounds skip files and no source is one task."""
    hashed = with_hash(chunks, "title", "cwd", "text").repartitionByRange("source_name", "updated_at", "source_ref")
    hashed.sortWithinPartitions("source_name", "updated_at").write.mode(mode).partitionBy("source_name").parquet(path)


def rebuilt(chunks: DataFrame, path: str) -> DataFrame:
    """Replaces the chunk index and gives its rows by source, counted from what was written."""
    write_chunks(chunks, path)
    return chunks.sparkSession.read.parquet(path).groupBy("source_name").agg(F.countDistinct("source_ref").alias("sessions"), F.count("*").alias("chunks"))


def compacted(spark, source: str, target: str, mb: int = 256) -> None:
    """A table written anew in files of some mb; vectors that are JSON text become arrays of floats, '[]' and blanks become null."""
    rows = spark.read.parquet(source)
    if dict(rows.dtypes).get("embedding") == "string":
        rows = rows.withColumn("embedding", F.nullif(F.from_json("embedding", "array<float>"), F.array().cast("array<float>")))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    size = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(fs_path).getLength()
    rows.repartition(max(1, -(-size // (mb << 20)))).write.mode("overwrite").parquet(target)


def with_json(column: Column, path: str, value: Column) -> Column:
    """A JSON object with the member of a path like $.a set to a text; other members stay as they are, in the order of their names; text that is no object becomes one."""
    name, kind = path.removeprefix("$."), "map<string,variant>"
    parsed = F.try_parse_json(column)
    old = F.coalesce(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed.cast(kind)), F.create_map().cast(kind))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != name), F.create_map(F.lit(name), value.cast("string").cast("variant"))))


def with_origins(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """The rows whose metadata_json doesn't yet say what origins (source_ref, origin, origin_detail) says of their session, with origin and detail set.

    An origin other than interactive or automated is none: such sessions keep what
    they have. Of several rows of a session the largest counts.
    """
    said = origins.where(F.col("origin").isin("interactive", "automated")).groupBy("source_ref").agg(F.max(F.struct("origin", F.coalesce("origin_detail", F.lit("")).alias("detail"))).alias("_said"))
    rows = rows.join(said, "source_ref").select(*(F.col(c) for c in rows.columns), "_said")
    same = F.get_json_object("metadata_json", "$.origin").eqNullSafe(F.col("_said.origin")) & F.get_json_object("metadata_json", "$.origin_detail").eqNullSafe(F.col("_said.detail"))
    new = with_json(with_json(F.col("metadata_json"), "$.origin", F.col("_said.origin")), "$.origin_detail", F.col("_said.detail"))
    return rows.where(~same).withColumn("metadata_json", new).drop("_said")


def origins_written(held: Buckets, origins: DataFrame) -> Buckets:
    """A bucketed table of chunks with its sessions' origins written back: only buckets with rows that change are written, and a second time none."""
    return held.merge(with_origins(held.read(), origins))


def origin_counts(rows: DataFrame) -> DataFrame:
    """(origin, detail, sessions) as the rows' metadata_json have them, unknown where there is none."""
    said = rows.groupBy("source_ref").agg(F.max("metadata_json").alias("j"))
    origin, detail = F.get_json_object("j", "$.origin"), F.get_json_object("j", "$.origin_detail")
    known = F.coalesce(origin.isin("interactive", "automated"), F.lit(False))
    return said.groupBy(F.when(known, origin).otherwise("unknown").alias("origin"), F.when(known, F.coalesce(detail, F.lit(""))).otherwise("").alias("detail")).agg(F.count("*").alias("sessions"))


def appended(rows: DataFrame, path: str) -> None:
    """Rows as JSON Lines behind what path holds."""
    rows.write.mode("append").json(path)


def archived(spark, path: str, archive: str, stamp: str) -> str:
    """Moves a log away, to archive/stamp, and says where it is now; a log that isn't there stays away."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{archive}/{stamp}")
    fs = old.getFileSystem(conf)
    if not fs.exists(old):
        return ""
    fs.mkdirs(new.getParent())
    if fs.exists(new) or not fs.rename(old, new):
        raise FileExistsError(f"{archive}/{stamp}")
    return f"{archive}/{stamp}"


def write_overview(overview: DataFrame, path: str) -> None:
    """The overview, some dozens of sessions and counts, as one JSON file."""
    overview.coalesce(1).write.mode("overwrite").json(path)


def read_overview(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def backfill(chunks: DataFrame, embedded: Column, limit: int = 256) -> DataFrame:
    """The chunks to embed next, newest first: (id, text), with the number left after them (remaining)."""
    limit = max(1, min(limit, 4096))
    todo = chunks.where(~embedded)
    left = todo.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))
    return todo.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit).select("id", "text").crossJoin(F.broadcast(left))
