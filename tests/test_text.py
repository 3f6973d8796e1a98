"""Query analysis, masking, chunks, sources, policy and the SQL surface on small hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import chunking, policy, search, store, vectors
from recollect.plans import sqlapi
from recollect.sources import transcripts


def test_query_analysis():
    assert T.query_tokens("What about training runs and logs/x.py") == ["training", "traine", "runs", "logs/x.py"]
    assert T.anchor_tokens(["abc", "a1b", "longerword"]) == ["a1b", "longerword"]
    assert T.focus_query("what happened in the session about retry limits") == "retry limits"
    assert T.needs_literal("see app/x.py") and not T.needs_literal("plain words")
    assert T.phrase_queries("what was the plan") == [["what", "was", "the", "plan"], ["the", "plan"]]
    assert T.split_pieces("aa bb cc", 5) == ["aa bb", "cc"] or all(len(p) <= 5 for p in T.split_pieces("aa bb cc", 5))


@pytest.mark.parametrize(("text", "masked"), [
    ("sk-ant-" + "a" * 20, "[redacted anthropic key]"), ("max_tokens=4096", "max_tokens=4096"), ("SLACK_BOT_TOKEN=abcdef123456", "SLACK_BOT_TOKEN=[redacted]"),
    ("https://u:secretpw@h/x", "https://u:[redacted]@h/x"), ("password: true", "password: true"), ("token_count: 120", "token_count: 120")])
def test_redact(spark, text, masked):
    df = spark.createDataFrame([(text,)], "t string").select(T.redact(F.col("t")).alias("t"))
    assert df.first().t == masked
    assert df.select(T.redact(F.col("t"))).first()[0] == masked


def test_regexp_functions(spark):
    r = spark.createDataFrame([("Abc\nabc",), (None,)], "t string").select(T.regexp(F.col("t"), "c.a"), T.regexp_extract(F.col("t"), "zzz"), T.regexp_extract(F.col("t"), "b", 3), T.regexp_count(F.col("t"), "ABC")).collect()
    assert [tuple(x) for x in r] == [(True, None, None, 2), (False, None, None, 0)]


def test_times(spark):
    r = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2023-11-14T22:13:20Z",), ("no",)], "t string").select(T.iso_time(F.col("t")).cast("long")).collect()
    assert [x[0] for x in r] == [1700000000] * 3 + [None]


def test_pack_covers_every_block_and_overlaps():
    blocks = [(i, chr(97 + i % 26) * 400) for i in range(40)]
    out = chunking.pack(blocks, 1200, 400)
    assert {e for own, _, _ in out for e, _ in own} == set(range(40))
    assert all(a[0][-1] == b[0][0] for a, b in zip(out, out[1:], strict=False))
    assert all(sum(len(b) for _, b in own) <= 1200 for own, _, _ in out)
    big = chunking.pack([(0, "x" * 3000)], 1200, 400)
    assert [(a, z) for _, a, z in big] == [(0, 1200), (800, 2000), (1600, 2800), (2400, 3000)]
    exact = chunking.pack([(0, "x" * 1200), (1, "y" * 100)], 1200, 400)
    assert [len(own) for own, _, _ in exact] == [1, 2]
    assert [len(own) for own, _, _ in chunking.pack([(0, "x" * 1200), (1, "y" * 100)], 1200, 400, strict=True)] == [1, 1]


def by_hand(blocks, size, overlap, strict):
    """Chunks found by trying every stretch of blocks, shortest first."""
    out, at, carry = [], 0, []
    place = [sum(len(t) for _, t in blocks[:i]) for i in range(len(blocks) + 1)]
    while at < len(blocks):
        if len(blocks[at][1]) > size:
            text, cut = blocks[at][1], 0
            while True:
                out.append(([(blocks[at][0], text[cut : cut + size])], place[at] + cut, place[at] + min(len(text), cut + size)))
                if cut + size >= len(text):
                    break
                cut += max(1, size - overlap)
            at, carry = at + 1, []
            continue
        first = at - len(carry)
        if carry and strict and place[at + 1] - place[first] > size:
            first = at
        end = at + 1
        while end < len(blocks) and len(blocks[end][1]) <= size and place[end + 1] - place[first] <= size:
            end += 1
        out.append((blocks[first:end], place[first], place[end]))
        held = [k for k in range(first, end) if place[end] - place[k] <= overlap]
        carry = list(range(held[0] if held else end - 1, end)) if overlap else []
        at = end
        if at < len(blocks) and len(blocks[at][1]) > size:
            carry = []
    return [c for c in out if any(t.strip() for _, t in c[0])]


def test_pack_against_every_stretch():
    g = random.Random(6)
    for _ in range(300):
        size, overlap = g.randint(5, 40), g.randint(0, 15)
        blocks = [(i, "".join(g.choice("ab ") for _ in range(g.randint(1, g.choice([6, 20, 90])))) + "x") for i in range(g.randint(0, 14))]
        for strict in (False, True):
            assert chunking.pack(blocks, size, overlap, strict) == by_hand(blocks, size, overlap, strict)


def test_packing_block_by_block(monkeypatch):
    g = random.Random(8)
    for held in (0, 1, 3):
        monkeypatch.setattr(chunking, "HELD", held)
        for _ in range(300):
            size, overlap = g.randint(5, 40), g.randint(0, 15)
            blocks = [(i, "".join(g.choice("ab ") for _ in range(g.randint(1, g.choice([6, 20, 90])))) + "x") for i in range(g.randint(0, 20))]
            for strict in (False, True):
                p = chunking.Packer(size, overlap, strict)
                got = [c for b in blocks for c in p.add(*b)] + list(p.done())
                assert got == chunking.pack(blocks, size, overlap, strict)


def test_chunks_of_sessions(spark):
    turns = [("c:1", i, ("user", "assistant", "system")[i % 3], "", f"turn {i} " + "word " * (i * 37 % 400)) for i in range(30)] + [("c:2", 0, "user", "t", "short")]
    heads = [("c:1", "c", "T", "/w", "2024"), ("c:2", "c", "U", "", "2025")]
    got = chunking.chunk_sessions(spark.createDataFrame(heads, "source_ref string, source_name string, title string, cwd string, updated_at string"), spark.createDataFrame(turns, "source_ref string, event_index int, role string, ts string, text string"), 2000, 400).collect()
    blocks = [(i, f"{r.upper()}\n{t}\n") for _, i, r, _, t in turns[:30] if r != "system"]
    want = by_hand(blocks, 2000, 400, False)
    own = sorted((r for r in got if r.source_ref == "c:1"), key=lambda r: r.chunk_index)
    assert [(r.event_start, r.event_end, r.char_start, r.char_end) for r in own] == [(b[0][0], b[-1][0], a, z) for b, a, z in want]
    for r, (b, *_) in zip(own, want, strict=True):
        text = " ".join(("Title: T Source: c Source ref: c:1 CWD: /w Updated: 2024 " + "\n".join(t for _, t in b)).split())
        assert r.text == (text if len(text) <= 3200 else text[:3197].rstrip() + "...")
    assert [r.text for r in got if r.source_ref == "c:2"] == ["Title: U Source: c Source ref: c:2 CWD: Updated: 2025 USER [t] short"]


def test_claude_transcript(spark, tmp_path):
    rows = [
        {"type": "user", "message": {"content": "please fix the build"}, "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w", "entrypoint": "cli"},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "on it"}, {"type": "tool_use", "name": "Bash", "input": {"command": "make"}}]}, "timestamp": "2026-01-01T00:01:00Z"},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "ok  done"}]}, "timestamp": "2026-01-01T00:02:00Z"},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join([*map(json.dumps, rows), "not json", "x" * 600_000]))
    (tmp_path / "s2.jsonl").write_text(json.dumps(rows[1]))
    got = transcripts.events(spark, "claude", str(tmp_path / "s1.jsonl")).orderBy("event_index").collect()
    assert [(r.role, r.text) for r in got] == [("user", "please fix the build"), ("assistant", "on it"), ("actions", "[Bash] make"), ("tool_result", "ok done")]
    own = transcripts.sessions(spark, "claude", str(tmp_path)).collect()
    assert [(r.source_ref, r.cwd, r.human_turns, r.title) for r in own] == [("claude:s1", "/w", 1, "please fix the build")]
    with pytest.raises(ValueError, match="unknown source"):
        transcripts.events(spark, "other", str(tmp_path))


def test_codex_and_prompts(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, [
        {"type": "event_msg", "payload": {"type": "user_message", "message": "hello there"}, "timestamp": "t"},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "hi"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": '{"command": "ls"}'}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": "a b"}}])))
    got = transcripts.events(spark, "codex", str(tmp_path / "c.jsonl")).orderBy("event_index").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hello there"), ("assistant", "hi"), ("actions", "[shell] ls"), ("tool_result", "a b")]
    (tmp_path / "h.jsonl").write_text("\n".join(map(json.dumps, [{"display": "/clear", "timestamp": 1700000000000, "sessionId": "s"}, {"display": "do it now", "timestamp": 1700000000000, "sessionId": "s", "project": "/w"}, {"display": "bad", "timestamp": "x"}])))
    got = transcripts.prompts(spark, "claude", str(tmp_path / "h.jsonl")).collect()
    assert [(r.session_id, r.ts, r.cwd, r.text) for r in got] == [("s", "2023-11-14T22:13:20+00:00", "/w", "do it now")]


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = store.merged(old, new, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.merged(once, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_hidden_fails_closed(spark):
    rows = spark.createDataFrame([("a", "p", False, "t"), ("b", "q", False, "t"), ("c", "p", True, "t"), ("d", "p", False, "t")], "source_ref string, project string, catch_all boolean, title string")
    private = spark.createDataFrame([("d",)], "source_ref string")
    none = spark.createDataFrame([], "source_ref string, level string")
    levels = spark.createDataFrame([("p", "share")], "project string, level string")
    got = {r.source_ref: r.hidden for r in policy.hidden_from_team(rows, private, none, levels).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": True}


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO t VALUES (1)", "SELECT 1; SELECT 2", "SELECT * FROM secret", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SET a = b", "SELECT * FROM parquet.`/etc`", "SHOW TABLES"])
def test_sql_refuses_commands(spark, sql):
    with pytest.raises(sqlapi.Refused):
        sqlapi.run(spark, sql, {"t": spark.range(3).withColumnRenamed("id", "a")})


def test_sql_runs(spark):
    t = spark.createDataFrame([(1, "Alpha like x"), (2, "beta")], "a int, s string")
    assert sqlapi.run(spark, "SELECT a FROM t WHERE s LIKE 'alpha%' AND s REGEXP 'ALPHA'", {"t": t})["rows"] == [[1]]
    out = sqlapi.run(spark, "WITH x AS (SELECT a FROM t) SELECT a FROM x ORDER BY a", {"t": t}, limit=1)
    assert out["rows"] == [[1]] and out["truncated"]


def test_search_modes(spark):
    rows = spark.createDataFrame([(i, f"r{i}", f"text about topic{i} and things", "title", i, "2024-01-01", [1.0, float(i)]) for i in range(6)], "id int, source_ref string, text string, title string, chunk_index int, updated_at string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 1.0],)], "q array<float>")
    with pytest.raises(ValueError, match="unknown mode"):
        search.search(rows, "x", q, mode="other")
    assert search.search(rows, "topic3", q, mode="vector").count() == 6
    assert [r.id for r in search.search(rows, "topic3", q).collect()] == [3]
    assert len(rows.select(vectors.embed(8)("text").alias("v")).first().v) == 8


def test_search_loop():
    seen = []

    def run(q):
        seen.append(q)
        return [{"ref": "a", "score": 100.0, "title": "other title", "cwd": "/x/folder"}]

    assert search.search_loop(run, "where is the retry limit")[0]["ref"] == "a"
    assert "folder" in seen


REFUSED = [
    "SELECT pw FROM secret /* , secret as ( */", "SELECT ', secret AS (' AS x, pw FROM secret", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM t",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT pw FROM secret WHERE 1 IN (WITH secret AS (SELECT 1 AS a) SELECT a FROM secret)",
    "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1) SELECT * FROM a", "SELECT (SELECT max(pw) FROM secret) FROM t", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM t JOIN secret",
    "SELECT * FROM default.t", "SELECT * FROM IDENTIFIER('secret')", "SELECT * FROM range(10)", "DROP TABLE t", "INSERT INTO t SELECT 1", "SET x = 1", "SELECT 1; SELECT 2", "SHOW TABLES",
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SELECT input_file_name() FROM t", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM secret)", "SELECT spark_partition_id() FROM t",
    "SELECT * FROM t LATERAL VIEW java_method('a', 'b') x", "DESCRIBE t", "EXPLAIN SELECT 1", "CACHE TABLE t",
]
ALLOWED = [
    ("SELECT a FROM t WHERE b LIKE 'HE%'", [[1]]), ("SELECT count(*) FROM T -- it's , x AS (", [[2]]), ("WITH x AS (SELECT a FROM t), y AS (SELECT a FROM x) SELECT max(a) FROM y", [[2]]),
    ("SELECT a FROM t WHERE b REGEXP 'W.RLD' /* ' */", [[2]]), ("SELECT t.a FROM t JOIN (SELECT 1 AS a) u ON t.a = u.a", [[1]]), ("SELECT x FROM t LATERAL VIEW explode(array(a, 7)) v AS x WHERE x = 7 LIMIT 1", [[7]]),
    ("WITH RECURSIVE n AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM n WHERE k < 3) SELECT max(k) FROM n", [[3]]), ("SELECT row_number() OVER (ORDER BY a DESC) FROM t WHERE a IN (SELECT a FROM t) ORDER BY 1", [[1], [2]]),
    ("SELECT a FROM t WHERE a = (SELECT max(a) FROM t)", [[2]]), ("SELECT json_extract('{\"k\": 5}', '$.k')", [["5"]]), ("SELECT CASE WHEN a > 1 THEN upper(b) ELSE b END FROM t WHERE a BETWEEN 2 AND 3", [["WORLD"]]),
    ("SELECT a FROM t UNION SELECT a FROM t ORDER BY a", [[1], [2]]), ("SELECT sum(a) FROM t GROUP BY b HAVING sum(a) > 1", [[2]]), ("SELECT * FROM (VALUES (1), (2)) AS v(x) EXCEPT SELECT 1", [[2]]),
]


@pytest.mark.parametrize("sql", REFUSED)
def test_sql_refuses(spark, sql):
    spark.createDataFrame([("x",)], "pw string").createOrReplaceTempView("secret")
    t = spark.createDataFrame([(1, "hello"), (2, "world")], "a int, b string")
    with pytest.raises(sqlapi.Refused):
        sqlapi.run(spark, sql, {"t": t})


@pytest.mark.parametrize(("sql", "rows"), ALLOWED)
def test_sql_answers(spark, sql, rows):
    t = spark.createDataFrame([(1, "hello"), (2, "world")], "a int, b string")
    assert sqlapi.run(spark, sql, {"t": t})["rows"] == rows


def test_messages_are_split(spark):
    g = random.Random(4)
    texts = ["".join(g.choice(["word", "a", " ", "  ", "\n", "\n\n", "é"]) for _ in range(g.randint(0, 90))) for _ in range(60)] + [None, "", " \n ", "x" * 95]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.split_messages(F.col("text"), 40).alias("m")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.id]
        if text is None:
            assert r.m is None
        elif not text.strip():
            assert r.m == ["(empty response)"]
        else:
            assert all(0 < len(p) <= 40 or not p for p in r.m) and "".join("".join(r.m).split()) == "".join(text.split())
            first = text.strip()
            if len(first) > 40:  # the first cut by hand
                cut = next((k for sep in ("\n\n", "\n", " ") if (k := first.rfind(sep, 0, 40)) > 0), 40)
                assert r.m[0] == first[:cut].rstrip()
