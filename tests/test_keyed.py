"""Keyed state with timers against the whole table."""

import random

import pytest

from recollect.streaming import keyed

SCHEMA = "id string, ts timestamp, kind string"


@pytest.mark.parametrize("size", [10_000, 3])
def test_requests_expire_by_timers(spark, tmp_path, size):
    g = random.Random(size)
    own = keyed.with_timers(spark)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    rows = []
    for i in range(60):
        at = g.uniform(0, 500)
        rows += [(f"r{i}", at + g.choice([0, 0, 3]), "ask") for _ in range(g.choice([1, 1, 2]))]
        rows += [(f"r{i}", at + g.choice([1, 20, 31, 90]), "ans") for _ in range(g.choice([0, 1, 1, 3]))]
    rows += [("orphan", 50.0, "ans"), (None, 3.0, "ask"), ("other", 4.0, "note")]
    g.shuffle(rows)
    src = str(tmp_path / "src")
    make = lambda part: spark.createDataFrame(part, "id string, s double, kind string").selectExpr("id", "timestamp_millis(cast(s * 1000 as bigint)) AS ts", "kind")
    whole = make(rows)
    got = []

    def go():
        out = keyed.requests(own.readStream.schema(SCHEMA).parquet(src), "id", "ts", 30, late="10 minutes")
        q = out.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    for part in (rows[:100], rows[100:], [("last", 5000.0, "ask")]):  # the last row's time lets all before it end
        make(part).coalesce(1).write.mode("append").parquet(src)
        go()
    want = sorted(tuple(r) for r in keyed.outcomes(whole, "id", "ts", 30).collect())
    assert sorted(got) == want and {o for *_, o in want} == {"answered", "expired"}
