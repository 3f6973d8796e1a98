"""Co-bucketed tables, embedding near-dedup and ranked search against brute force; chat formatting and training on very long input."""

import hashlib
import math
import re
import time
import zlib
from datetime import datetime

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recollect.llm import bucketed, chat_format, hnsw, ranked_search, toxicity

# 11

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def key(row):
    """A row's place: the first column descending, the others ascending, nulls first, NaN last, -0.0 as 0.0."""
    out = [(0, 0) if row[0] is None else (1, -row[0])]
    for x in row[1:]:
        out.append((0, 0) if x is None else (1, x.encode()) if isinstance(x, str) else ((1, (1, 0)) if math.isnan(x) else (1, (0, x))) if isinstance(x, float) else (1, x))
    return out


def expected(sales, lines):
    """{(table, bucket): (rows in order, {start: rows}, rewritten)}."""
    ids = {r[0] for r in sales} - {None}
    crc = lambda t: zlib.crc32(t.encode()) % 150
    own = lambda i: 151 if i is None else crc(f"pair{i}")
    rules = {
        "sales": (sales, lambda r: own(r[0]) - (own(r[0]) % 5 == 1), lambda r: own(r[0])),
        "sale_lines": (lines, lambda r: 0 if r[2] is None else crc(str(r[2])), lambda r: 150 if r[0] is not None and r[0] not in ids else own(r[0])),
    }
    out = {}
    for name, (rows, start, bucket) in rules.items():
        starts, buckets = {}, {}
        for r in rows:
            starts.setdefault(start(r), []).append(r)
            buckets.setdefault(bucket(r), []).append(r)
        for b, held in buckets.items():
            lineage = {}
            for r in held:
                lineage[start(r)] = lineage.get(start(r), 0) + 1
            stays = len(lineage) == 1 and len(starts[next(iter(lineage))]) == len(held)
            out[name, b] = (sorted(held, key=key), lineage, not stays)
    return out


def test_cobucketed_pair(spark):
    g = np.random.default_rng(4)
    t = [None, datetime(2024, 1, 1), datetime(2024, 5, 1, 2, 3, 4, 567)]
    text = [None, "", "a", "a\0b", "a\0", "é", "😀 z", "x" * 5000]
    number = [None, 0.0, -0.0, math.nan, math.inf, -math.inf, 1.5, -2.25]
    pick = lambda a: a[int(g.integers(len(a)))]
    sales = [(pick([None, 1, 2, 3, *range(-5, 60)]), pick([None, 1, -1, 1 << 62]), pick(text), pick(number), pick(t), pick(t), pick([None, -3, 2])) for _ in range(300)]
    lines = [(pick([None, 1, 1, 1, 1, *range(-5, 90)]), pick([None, 1, 2]), pick([None, 7, 8, 9]), pick([None, 5]), pick([None, 1]), pick(number), pick(number), pick(text), pick(t)) for _ in range(900)]
    sales += sales[:20]
    # a starting file that holds one bucket whole stays, whatever its number
    alone = next(i for i in range(100, 9999) if (b := zlib.crc32(f"pair{i}".encode()) % 150) % 5 == 1 and not {b, b - 1} & {zlib.crc32(f"pair{r[0]}".encode()) % 150 for r in sales})
    sales.append((alone, None, "moved by number alone", 1.0, t[1], t[1], 1))
    got = bucketed.op11_cobucketed_pair(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)).collect()
    want = expected(sales, lines)
    assert {(r.table_name, r.bucket) for r in got} == set(want)
    assert not next(r for r in got if r.table_name == "sales" and r.bucket == zlib.crc32(f"pair{alone}".encode()) % 150).rewritten
    times = {i: sum(r[0] == i for r in sales) for i in {r[0] for r in sales} - {None}}
    for r in got:
        rows, lineage, rewritten = want[r.table_name, r.bucket]
        table = pq.read_table(r.path.removeprefix("file:"))
        assert ",".join(table.column_names) == r.columns
        same = lambda a, b: [[repr(x) if x != 0 or not isinstance(x, float) else 0.0 for x in row] for row in a] == [[repr(x) if x != 0 or not isinstance(x, float) else 0.0 for x in row] for row in b]
        assert same([tuple(x.values()) for x in table.to_pylist()], rows)
        assert (r.rewritten, r.n_rows) == (rewritten, len(rows))
        assert r.ids_sha256 == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in rows).encode()).hexdigest()
        assert r.lineage_sha256 == hashlib.sha256(",".join(f"{s}:{n}" for s, n in sorted(lineage.items())).encode()).hexdigest()
        both = ("sales", r.bucket) in want and ("sale_lines", r.bucket) in want
        assert r.n_joined == (sum(times.get(x[0], 0) for x in want["sale_lines", r.bucket][0]) if both else 0)
    # -0.0 is kept, and nothing but the final files is there
    assert sum(str(x) == "-0.0" for r in got if r.table_name == "sales" for x in pq.read_table(r.path.removeprefix("file:"))["total"].to_pylist()) == sum(str(r[3]) == "-0.0" for r in sales)
    from pathlib import Path

    folder = Path(got[0].path.removeprefix("file:")).parents[1]
    assert {str(p) for p in folder.rglob("*") if p.is_file()} == {re.sub("^file:/+", "/", r.path) for r in got}
    assert bucketed.op11_cobucketed_pair(spark.createDataFrame([], SALES), spark.createDataFrame([], LINES)).count() == 0


def test_bucketed_columns_of_any_name(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, f"{i}", i % 2 == 0, float(-i)) for i in range(50)], "number int, row long, bucket string, keys boolean, file float")
    files = bucketed.write(bucketed.rows_of(df), F.col("row.number"), 3, str(tmp_path), "part", "row")
    assert [(n, k) for n, _, k in files] == [(0, 17), (1, 17), (2, 16)]
    assert [tuple(x.values()) for x in pq.read_table(files[0][1]).to_pylist()] == [(0, i, f"{i}", i % 2 == 0, float(-i)) for i in range(48, -1, -3)]
    with pytest.raises(TypeError, match="no order"):
        bucketed.write(bucketed.rows_of(df.select(F.array("row").alias("a"))), F.lit(0), 1, str(tmp_path / "b"), "part")


# 12


def brute(rows, least=0.93):
    """{vec_id: (n_links, component_id)} of rows (vec_id, vector, label) with different ids."""
    use = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    link = {r[0]: set() for r in rows}
    for a in use:
        for b in use:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    link[a[0]].add(b[0])
                    link[b[0]].add(a[0])
    out = {}
    for i in sorted(link):
        if i not in out:
            todo, seen = [i], {i}
            while todo:
                new = link[todo.pop()] - seen
                seen |= new
                todo += new
            out |= {j: (len(link[j]), i) for j in seen}
    return out


@pytest.mark.parametrize("shard", [8192, 70])
def test_embedding_dedup(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    g = np.random.default_rng(1)
    rows = []
    for i in range(420):
        base = rows[int(g.integers(len(rows)))] if i > 30 and i % 3 else None
        v = g.normal(size=12) if base is None or len(base[1] or []) != 12 else np.array(base[1]) + g.normal(size=12) * g.choice([0, 0.05, 0.25])
        rows.append((i, [float(x) for x in v], int(g.integers(2)) if base is None else base[2]))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 12, 1), (1003, [math.nan] + [1.0] * 11, 1), (1004, [None] + [1.0] * 11, 1), (1005, rows[0][1], None), (1006, [1.0, 0.0], 1), (1007, [2.0, 0.0], 1), (1008, [1e-200] * 12, 0), (1009, [1e200] * 12, 0)]
    df = spark.createDataFrame([(i, None if v is None else v, k, "x", 1) for i, v, k in rows], "vec_id long, embedding array<double>, label int, node string, size int")
    got = {r.vec_id: r for r in hnsw.op12_embedding_dedup(df.union(df.where("vec_id % 7 = 0"))).collect()}
    want = brute([r for r in rows if r[0] < 1008]) | {1008: (1, 1008), 1009: (1, 1008)}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    none = hnsw.op12_embedding_dedup(df.limit(2).withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in none] == [(None, 0, None, True)] * 2
    assert hnsw.op12_embedding_dedup(df.limit(0)).count() == 0


def test_graph_recall_and_dense_groups():
    g = np.random.default_rng(3)
    v = g.normal(size=(3000, 32))
    v[1000:1400] = v[0] + 0.05 * g.normal(size=(400, 32))  # a group of near copies, denser than any beam
    v[1400:1500] = v[1:101] + 0.2 * g.normal(size=(100, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v[g.permutation(3000)]
    graph = hnsw.Graph.built(v.astype(np.float32))
    assert all((x[x >= 0] < 3000).all() for x in graph.links)
    beam = hnsw.audit(graph, 0.93)
    found, true = hnsw.links(graph, beam, v, v, 0.93), v @ v.T >= 0.93
    assert not (found & ~true).any() and (found & true).sum() >= 0.995 * true.sum()
    ids, near = graph.search(v[:50].astype(np.float32), 64)
    assert (np.diff(near, axis=1) <= 0).all()
    top = np.argsort(-(v[:50] @ v.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(top, ids[:, :10], strict=True)]) > 0.8


# 13


def test_ranked_search(spark, monkeypatch):
    g = np.random.default_rng(8)
    words = ["alpha", "Beta", "γάμμα", "δ", "x1", "naïve", "日本", "É", "é", "the", "THE", "a-b", "c_d"]
    text = lambda n: "".join(str(w) + str(s) for w, s in zip(g.choice(words, n), g.choice([" ", ", ", "\n", "--", "\t"], n), strict=True))
    docs = [(i, "the " + text(int(g.integers(0, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, "-- !"), (903, "the " * 4000), (904, "γάμμα " * 3), (905, "γάμμα " * 3), (5, "another text of an id: γάμμα")]
    items = [(i, text(int(g.integers(1, 9)))) for i in range(12)] + [(50, None), (51, "the the"), (52, "nowhere"), (53, "γάμμα"), (53, "x1")]
    d = spark.createDataFrame([(*r, "x", 1) for r in [*docs, *docs[:9], (None, "γάμμα")]], "doc_id long, text string, term string, n int")
    b = spark.createDataFrame([*items, (None, "alpha")], "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", d.select("doc_id", "text")), ("benchmark", b)):
        con.register(f"{name}_rows", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_rows")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ranked_search.ORACLE})").fetchall())
    assert {r[0] for r in want} >= {53} and not {r[0] for r in want} & {50, 52}
    for wanted, seeds in ((200_000, 8), (3, 1)):  # terms in the tasks, and joined
        monkeypatch.setattr(ranked_search, "WANTED", wanted)
        monkeypatch.setattr(ranked_search, "BROADCAST", wanted)
        monkeypatch.setattr(ranked_search, "SEEDS", seeds)
        assert sorted(map(tuple, ranked_search.op13_ranked_search(d, b).collect())) == want
    # every document holds it: weights of 0 find nothing
    assert ranked_search.op13_ranked_search(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() in (0, 2)
    assert ranked_search.op13_ranked_search(d.limit(0), b).count() == ranked_search.op13_ranked_search(d, b.limit(0)).count() == 0


def test_ranked_search_by_hand(spark):
    docs = {1: "red red fish", 2: "red", 3: "blue fish and more words", 4: "green"}
    d, b = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(7, "Red FISH red")], "item_id long, text string")
    own = {i: t.split() for i, t in docs.items()}
    size = sum(map(len, own.values()))
    score = {}
    for i, w in own.items():
        m = 10 + 90 * len(w) * 4 // size
        score[i] = sum(math.floor(1000 * math.log(10 / (2 * sum(t in x for x in own.values()) + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in ("red", "fish"))
    want = sorted(((-s, i) for i, s in score.items() if s), key=lambda x: x)
    assert [(r.rank, r.doc_id, r.score) for r in ranked_search.ranked(d, b).orderBy("rank").collect()] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


# 4 and 8 on very long input


def test_conversations_of_many_bytes(spark):
    """Eight times the turns, of 1 KB each in one conversation, take about eight times as long, not sixty-four."""
    took = {}
    for n in (500, 500, 4000):
        rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} <|im_end|> " + "word " * 200) for i in range(n)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2).cache()
        df.count()
        at = time.time()
        got = {r.conv_id: r for r in chat_format.op4_chat_format(df).collect()}[1]
        took[n] = time.time() - at
        loss = "".join(r[3] for r in rows if r[2] == "assistant")
        assert (got.n_turns, got.loss_chars, got.n_examples) == (n, len(loss), n // 2)
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        df.unpersist()
    assert took[4000] < 16 * max(took[500], 0.5)
    pieces = chat_format.expanded(chat_format.formatted(spark.createDataFrame(rows[:6], "conv_id long, turn long, role string, text string"))).orderBy("example").collect()
    assert [chat_format.END + "\n" + r.text[r.loss_start : r.loss_end] + chat_format.END + "\n" == chat_format.END + "\n" + rows[2 * k + 1][3].replace("<|", "<\\|") + chat_format.END + "\n" for k, r in enumerate(pieces)] == [True] * 3


def test_training_on_long_texts(spark):
    """200 labelled texts of some 100 KB: toxic words stand all over the toxic ones."""
    g = np.random.default_rng(2)
    good, bad = [f"fine{i}" for i in range(300)], ["grubble", "snarkle", "vextor"]
    rows = []
    for i in range(200):
        words = g.choice(good, 14_000).tolist()
        if i % 2:
            for at in g.integers(0, 14_000, 300):
                words[at] = bad[int(g.integers(3))]
        rows.append((i, " ".join(words)))
    assert min(len(t) for _, t in rows) > toxicity.TRAIN_CHARS
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert isinstance(model, dict)
    new = spark.createDataFrame([(1, " ".join(good)), (2, " ".join([*good[:150], "grubble snarkle vextor", *good[150:]]))], "doc_id long, text string")
    low, high = (r.score for r in toxicity.score(new, model).orderBy("doc_id").collect())
    assert low < 0.5 < high
