"""Streams against the same rows in one batch."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.streaming import refresh as R


def test_refresh_equals_rebuild(spark, tmp_path):
    rows = [(i, f"v{i}") for i in range(20)]
    src, target = str(tmp_path / "src"), str(tmp_path / "t")
    spark.createDataFrame(rows[:10], "id int, v string").write.parquet(src)
    R.refresh(spark, src, "id int, v string", target, str(tmp_path / "c"), ["id"])
    spark.createDataFrame([*rows[10:], (3, "new")], "id int, v string").write.mode("append").parquet(src)
    for _ in range(2):  # the second finds no new file
        R.refresh(spark, src, "id int, v string", target, str(tmp_path / "c"), ["id"])
    got = {r.id: r.v for r in R.current(spark, target).collect()}
    assert got == dict(rows) | {3: "new"}


@pytest.mark.parametrize("kind", ["idle", "rate", "once"])
def test_stateful(spark, tmp_path, kind):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", float(t)) for t in (0, 1, 2, 61, 900)], "k string, s double").selectExpr("k", "timestamp_seconds(s) AS ts", "cast(s as string) AS id").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp, id string").parquet(src)
    out = {"idle": lambda: R.idle_sessions(stream, "k", "ts", 100), "rate": lambda: R.rate_limited(stream, "k", "ts", 2, 60), "once": lambda: R.once(stream, "k", "ts")}[kind]()
    q = out.writeStream.format("memory").queryName(f"out_{kind}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table(f"out_{kind}").orderBy(F.col("ts")).collect()
    if kind == "idle":
        assert [r.session_no for r in rows] == [1, 1, 1, 1, 2]
    elif kind == "rate":
        assert [r.allowed for r in rows] == [True, True, False, True, True]
    else:
        assert len(rows) == 1


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    """The commit of the last batch is lost, as if the driver had died between the table and the commit."""
    src, target, c = str(tmp_path / "src"), str(tmp_path / "t"), str(tmp_path / "c")
    want = {}
    for n in range(7):
        rows = [(i, f"v{n}-{i}") for i in range(n, n + 5)]
        want |= dict(rows)
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(src)
        R.refresh(spark, src, "id int, v string", target, c, ["id"], compact=3)
        if n in (2, 3, 5, 6):
            last = max(int(p.name) for p in (tmp_path / "c/commits").iterdir() if p.name.isdigit())
            for p in (tmp_path / "c/commits").glob(f"*{last}*"):
                p.unlink()
            R.refresh(spark, src, "id int, v string", target, c, ["id"], compact=3)
        assert {r.id: r.v for r in R.current(spark, target).collect()} == want
    assert len(R.versions(spark, f"{target}/run1")) <= 2 and len(R.versions(spark, f"{target}/run0")) <= 6
    assert R.current(spark, str(tmp_path / "none")) is None


def test_a_row_is_written_once_a_level(spark, tmp_path):
    """Nine batches in twos: one run of level 3 and the last batch; no level's run is written more than once."""
    src, target, c = str(tmp_path / "src"), str(tmp_path / "t"), str(tmp_path / "c")
    want = {}
    for n in range(9):
        rows = [(i, f"v{n}") for i in (n, n + 1, 100)]
        want |= dict(rows)
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(src)
        R.refresh(spark, src, "id int, v string", target, c, ["id"], compact=2)
        assert {r.id: r.v for r in R.current(spark, target).collect()} == want
    assert [path.removeprefix(target) for path, _ in R.live(spark, target)] == ["/run3/7", "/run0/8"]
    assert [len(R.versions(spark, f"{target}/run{k}")) for k in range(4)] == [3, 2, 2, 1]


def test_state_ends(spark, tmp_path):
    (tmp_path / "src").mkdir()
    src = str(tmp_path / "src")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(src)
    out = R.rate_limited(stream, "k", "ts", 2, 60, late="1 minute")

    def go():
        q = out.writeStream.foreachBatch(lambda rows, _: rows.count()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None

    for i, k in enumerate("abcdef"):
        spark.createDataFrame([(k, 1000.0 * i)], "k string, s double").selectExpr("k", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(src)
        held = go()
    assert held <= 2  # keys that are silent are forgotten


@pytest.mark.parametrize("size", [64, 7])
def test_order_over_all_arrow_batches(spark, tmp_path, size):
    """600 shuffled rows of one key in one trigger, in Arrow batches far smaller than that."""
    g = random.Random(3)
    times = [0.0]
    for _ in range(599):
        times.append(times[-1] + g.choice([1, 5, 20, 130]))
    src, mixed = str(tmp_path / "src"), g.sample(times, len(times))
    spark.createDataFrame([("a", t) for t in mixed], "k string, s double").selectExpr("k", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(src)
    sessions, allowed, seen = [], [], []
    for i, t in enumerate(times):
        sessions.append(1 if not i else sessions[-1] + (t - times[i - 1] > 100))
        seen = [s for s in seen if t - s < 60]
        allowed.append(len(seen) < 2)
        seen += [t] if allowed[-1] else []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        for name, want in (("session_no", sessions), ("allowed", allowed)):
            stream = spark.readStream.schema("k string, ts timestamp").parquet(src)
            out = R.idle_sessions(stream, "k", "ts", 100) if name == "session_no" else R.rate_limited(stream, "k", "ts", 2, 60)
            out.writeStream.format("memory").queryName(f"{name}_{size}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
            assert [r[name] for r in spark.table(f"{name}_{size}").orderBy("ts").collect()] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
