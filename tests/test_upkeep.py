"""The as-of join, packed vectors and the bucketed table against brute force."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from recollect.operators import asof, buckets, packed, versions


def test_nearest_by_hand(spark):
    g = random.Random(2)
    at = lambda: None if g.random() < 0.05 else round(g.random() * 400, g.choice([0, 1, 6]))
    left = [(i, g.choice("abc") if i % 9 else None, at()) for i in range(300)]
    right = [(i, g.choice("abc"), at()) for i in range(200)]
    stamp = lambda rows: spark.createDataFrame(rows, "id int, k string, s double").selectExpr("id", "k", "timestamp_micros(cast(s * 1000000 as bigint)) AS ts", "'x' AS t", "1 AS stretch")
    micros = lambda s: int(s * 1_000_000)
    for seconds in (0.5, 7, 5000):
        want = {}
        for i, k, s in left:
            near = [(abs(micros(s) - micros(x)), micros(x), j) for j, o, x in right if s is not None and x is not None and o == k and abs(micros(s) - micros(x)) <= seconds * 1e6]
            want[i] = min(near)[::2] if near else (None, None)
        rows = asof.nearest(stamp(left), stamp(right).select("id", "k", "ts"), "k", seconds, outer=True).collect()
        assert {r.id: (r.gap, r.match_id) for r in rows} == want and len(rows) == 300 and set(rows[0].asDict()) == {"id", "k", "ts", "t", "stretch", "match_id", "match_ts", "gap"}
        assert asof.nearest(stamp(left), stamp(right).select("id", "k", "ts"), "k", seconds).count() == sum(g is not None for g, _ in want.values())


def test_nearest_of_a_hot_key_is_linear(spark):
    """One key with 100,000 rows on both sides: 10^10 pairs, were there any."""
    rows = spark.range(100_000).selectExpr("id", "'hi' AS k", "timestamp_seconds(id * 2) AS ts")
    other = spark.range(100_000).selectExpr("id", "'hi' AS k", "timestamp_seconds(id * 2 + 1) AS ts")
    began = time.time()
    got = asof.nearest(rows, other, "k", 120).agg(F.count("*").alias("n"), F.count_if(F.col("match_id") == F.greatest(F.col("id") - 1, F.lit(0))).alias("right")).first()
    assert (got.n, got.right) == (100_000, 100_000) and time.time() - began < 60


def test_packed_equals_exact(spark):
    g = random.Random(5)
    vector = lambda n: [g.gauss(0, 1) * g.choice([1, 1, 50]) for _ in range(n)]
    rows = [(i, vector(8)) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(2000, None), (2001, []), (2002, [math.nan] * 8), (2003, vector(7)), (2004, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    codes = packed.packed(df).cache()
    kept = {r.id: list(r.embedding) for r in df.collect() if r.embedding and len(r.embedding) == 8 and not math.isnan(r.embedding[0])}
    for q in (vector(8), rows[3][1], [0.0] * 8):
        dots = {i: sum(a * b for a, b in zip(v, q, strict=True)) for i, v in kept.items()}
        for k in (1, 10, 1000):
            got = [(r.id, r.score) for r in packed.topk(codes, df, q, k).collect()]
            want = sorted(dots.items(), key=lambda x: (-x[1], x[0]))[:k]
            assert [x for x, _ in got] == [x for x, _ in want] or [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
            assert len(got) == len(want)
    q = vector(8)
    bounds = {r.id: r for r in packed.bounds(codes, q, 1000).collect()}
    assert all(r.low <= sum(a * b for a, b in zip(kept[i], q, strict=True)) <= r.high for i, r in bounds.items())
    assert packed.bounds(codes, q, 5).count() < 5 * 60  # most rows are ruled out by their codes


def test_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        buckets.Buckets.open(spark, path)
    make = lambda rows: spark.createDataFrame(rows, "k long, v string, imported_at int, gone boolean")
    table = buckets.Buckets.create(spark, path, "k long, v string, imported_at int", ["k"], 8)
    table = table.merge(make([(i, "a", 1, False) for i in range(100)] + [(None, "null", 1, False), (5, "older", 0, False)]), gone="gone")
    want = {i: "a" for i in range(100)} | {None: "null"}
    state = lambda t: {r.k: r.v for r in t.read().collect()}
    assert state(table) == want
    before, old = table, dict(table.live["folders"])
    table = table.merge(make([(7, "b", 2, False), (200, "c", 2, False), (None, "n", 3, False), (9, "", 2, True)]), batch="1", gone="gone")
    want = want | {7: "b", 200: "c", None: "n"}
    del want[9]
    assert state(table) == want and state(buckets.Buckets.open(spark, path)) == want
    assert state(before)[7] == "a"  # a reader keeps to its version
    changed = {b for b, f in table.live["folders"].items() if old.get(b) != f}
    assert 1 <= len(changed) <= 4 < len(old)  # only what was touched is written
    assert table.merge(make([(7, "again", 9, False)]), batch="1").version == table.version
    with pytest.raises(versions.Conflict):
        before.merge(make([(1, "x", 1, False)]))
    table.vacuum()
    assert state(buckets.Buckets.open(spark, path)) == want
    empty = table.merge(make([(k, "", 9, True) for k in want]), gone="gone")
    assert state(empty) == {}


def test_learnt_embeddings_and_backfill(spark, tmp_path):
    """Texts of one theme without a common word are nearer to each other than to another theme's."""
    from recollect.operators import embeddings

    g = random.Random(7)
    themes = [[f"t{k}w{i}" for i in range(24)] for k in range(4)]
    said = lambda k, words: " ".join(g.choices(words or themes[k], k=12) + g.choices(["the", "of", "it"], k=4))
    rows = [(i, f"2024-01-{i % 28 + 1:02}", said(i % 4, None)) for i in range(600)] + [(9000, "2025", None), (9001, "2025", "unknown")]
    df = spark.createDataFrame(rows, "id long, updated_at string, text string")
    model = embeddings.fit(df, dims=16)
    new = spark.createDataFrame([(2 * k + h, said(k, themes[k][12 * h : 12 * h + 12])) for k in range(4) for h in (0, 1)], "id long, text string")
    v = {r.id: r.embedding for r in embeddings.embedded(new, model).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    own = [dot(2 * k, 2 * k + 1) for k in range(4)]
    other = [dot(2 * k, 2 * j + 1) for k in range(4) for j in range(4) if j != k]
    assert min(own) > max(other) + 0.2
    assert embeddings.fit(df.limit(0)).words == {}
    store = buckets.Buckets.create(spark, str(tmp_path / "v"), embeddings.VECTORS, ["id"], 4)
    order, left = [i for _, i in sorted(((t, -i) for i, t, _ in rows), reverse=True)], len(rows)
    for run in range(1, 4):
        store, left = embeddings.backfill(store, df, model, 250)
        assert {r.id for r in store.read().collect()} == {-i for i in order[: 250 * run]} and left == max(0, len(rows) - 250 * run)
    again, left = embeddings.backfill(store, df, model)
    assert again.version == store.version and left == 0
    changed = df.withColumn("text", F.when(F.col("id") == 5, "t1w1 t1w2").otherwise(F.col("text")))
    store, left = embeddings.backfill(store, changed, model)
    assert left == 0 and store.read().count() == len(rows)
    assert sum(map(abs, store.read().where("id = 9000").first().embedding)) == 0
