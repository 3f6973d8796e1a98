"""Smaller sources and message functions."""

import json

import pytest
from pyspark.sql import functions as F

from recollect.functions import messages as M
from recollect.operators import policy
from recollect.sources import logs, transcripts


def test_viewer_and_chat(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, [
        {"type": "user", "message": {"content": "hi"}, "timestamp": "t"},
        {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "x", "input": {"a": 1}}, {"type": "text", "text": "yo"}]}}])) + "\n" + "x" * 600_000)
    got = logs.viewer_events(spark, str(tmp_path / "a.jsonl")).orderBy("no").collect()
    assert [(r.kind, r.text) for r in got] == [("user", "hi"), ("thinking", "hm"), ("tool_use", '{"a":1}'), ("assistant", "yo"), ("oversized", "line left out")]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"type": "message", "role": r, "text": t}) for r, t in [("user", "q"), ("assistant", "a"), ("assistant", "b")]))
    m = logs.chat_messages(spark, str(tmp_path / "c.jsonl"))
    assert [r.asked for r in logs.retrievals(m).collect()] == ["q", "q"]
    assert {r.text for r in logs.chat_messages(spark, str(tmp_path / "c.jsonl"), 1).collect()} == {"b"}
    assert logs.recent_files(spark, [str(tmp_path)], 1).count() == 1
    with pytest.raises(ValueError, match="unknown source"):
        logs.paths("x", "/")


def test_messages(spark):
    rows = [
        ("**Al B** (via x-bot): did it run?\n-# \u27e6bot ask id=r1 actor=u%201 name=A%2BB\u27e7", "ok"),
        ("<@12> <@!a|b> \u27e6bot ans id=r2\u27e7 yes,\nit did", "/clear"),
        ("plain question here", "Go ahead!"),
        ("x\n_\u27e6bot ans\u27e7_  ", "/ask about it"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, u string").orderBy("i")
    r = df.select(M.relayed(F.col("t")).alias("e"), M.stripped(F.col("t")).alias("s"), M.owner_voice(F.col("u")).alias("w")).collect()
    assert tuple(r[0].e) == ("ask", "r1", "u 1", "A+B", "did it run?", "Al B") and r[0].s == "**Al B** (via x-bot): did it run?"
    assert tuple(r[1].e) == ("ans", "r2", "", "", "yes,\nit did", "") and r[1].s == "yes,\nit did"
    assert r[2].e is None and r[2].s == "plain question here"
    assert tuple(r[3].e)[:2] == ("ans", "") and r[3].s == "x"
    assert [x.w for x in r] == [False, False, False, True]
    x = spark.createDataFrame([("claude:abc:chunk:3", "-home-a-b", ["/a/b/c", "/a/b/d"], " A b/C!! ")], "r string, g string, f array<string>, k string")
    assert tuple(x.select(M.session_id(F.col("r")), logs.folder_of(F.col("g")), logs.common_folder(F.col("f")), M.safe_session_key(F.col("k")), M.safe_session_key(F.lit("//"))).first()) == ("abc", "/home/a/b", "/a/b", "a-b-c", "main")


def test_inferred_folder(spark):
    rows = [
        (["/w/a/", "/w/b", "/w/a"], ["/x/y.py"], "/w/a"), ([], ["/p/q/a.py", "/p/q/r/b.py"], "/p/q"), ([], ["/p/a", "/q/a", "/q/b"], "/q"), (["rel"], ["also/rel", "/h/.gemini/x"], ""),
        ([], ["/home/u/a/x", "/home/u/b/y", "/home/u/b/z"], "/home/u/b"), ([], ["/p/q/a.py"], "/p/q"),
    ]
    df = spark.createDataFrame(rows, "c array<string>, p array<string>, want string")
    assert all(r.got == r.want for r in df.select("want", logs.inferred_folder(F.col("c"), F.col("p"), "/home/u").alias("got")).collect())


def test_sections(spark):
    text = "**hi there**\n## One\nx\n- y\n# What you *overlooked*\n- first\n  goes on\nnote\n* second\n---\nafter\n\n### **Two**\n"
    got = [(r.kind, r.title, r.body) for r in M.sections(spark.createDataFrame([(1, text), (2, ""), (3, "***\nonly")], "id int, text string")).orderBy("id", "no").collect()]
    assert got == [
        ("intro", "", "hi there"), ("article", "One", "x\n- y"), ("overlooked", "", "first goes on"), ("overlooked", "", "second"), ("note", "", "note"),
        ("note", "", "after"), ("article", "Two", ""), ("intro", "", "only")]


def test_codex_rejects(spark, tmp_path):
    def write(name, meta):
        lines = [{"type": "session_meta", "payload": meta}, {"type": "event_msg", "payload": {"type": "user_message", "message": f"hello from {name}"}}]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))

    write("plain", {"cwd": "/w", "originator": "codex-tui", "source": "cli"})
    write("sub", {"cwd": "/w", "thread_source": "subagent"})
    write("exec", {"cwd": "/w", "originator": "codex_exec", "source": "exec"})
    names = lambda **k: {r.source_ref for r in transcripts.sessions(spark, "codex", str(tmp_path), **k).collect()}
    assert names() == {"codex:plain", "codex:exec"} and names(executed=False) == {"codex:plain"}
    with pytest.raises(ValueError, match="unknown source"):
        transcripts.adapter("codex", ["claude"])


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("\n".join(json.dumps({"n": i, "pad": "x" * 50}) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = transcripts.lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 1
        assert [r.n for r in rows.orderBy("line_no").select(transcripts.field("$.n", "int").alias("n")).collect()] == list(range(3000))
        capped = transcripts.lines(spark, str(tmp_path), max_bytes=7000).orderBy("line_no").select(transcripts.field("$.n", "int").alias("n")).collect()
        assert [r.n for r in capped] == list(range(len(capped))) and 90 < len(capped) < 110
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_viewer_of_other_dialects(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, [
        {"type": "session_meta", "payload": {"type": "message"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": " hi "}},
        {"type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "a"}, {"text": "b"}]}}, {"type": "response_item", "payload": {"type": "local_shell_call", "action": {"cmd": "ls"}}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": {"output": "done"}}}, {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "x" * 8100}]}}])))
    got = [(r.kind, r.tool, r.text) for r in logs.viewer_events(spark, str(tmp_path / "x.jsonl"), dialect="codex").orderBy("no").collect()]
    assert got[:4] == [("user", "", "hi"), ("thinking", "", "ab"), ("tool_use", "local shell call", '{"cmd":"ls"}'), ("tool_result", "output", "done")]
    assert got[4][0] == "assistant" and got[4][2].endswith("x\n\u2026 (+100 more chars)") and len(got) == 5
    (tmp_path / "y.jsonl").write_text("\n".join(map(json.dumps, [
        {"type": "USER_INPUT", "content": "<USER_REQUEST> fix it </USER_REQUEST>"}, {"type": "PLANNER_RESPONSE", "thinking": "hm", "content": "ok", "tool_calls": [{"name": "run", "args": {"a": 1}}]}, {"type": "STEP", "content": "out"}])))
    got = [(r.kind, r.text) for r in logs.viewer_events(spark, str(tmp_path / "y.jsonl"), 4, "antigravity").orderBy("no").collect()]
    assert got == [("user", "fix it"), ("thinking", "hm"), ("assistant", "ok"), ("tool_use", '{"a":1}')]


def test_artifacts_and_records(spark, tmp_path):
    for ident, files in {"c1": {"walkthrough.md": "did /home/u/p/a.py\n", "task.md": "see file:///home/u/p/b.py", "other.md": "no"}, "c2": {"task.md": "has a transcript"}, "c3": {"task.md": "  "}}.items():
        (tmp_path / ident).mkdir()
        for name, text in files.items():
            (tmp_path / ident / name).write_text(text)
    events = logs.artifact_events(spark, str(tmp_path))
    got = [(r.source_ref, r.event_index, r.text) for r in events.orderBy("source_ref", "event_index").collect()]
    assert got == [("antigravity:c1", 0, "[task.md]\nsee file:///home/u/p/b.py"), ("antigravity:c1", 1, "[walkthrough.md]\ndid /home/u/p/a.py"), ("antigravity:c2", 0, "[task.md]\nhas a transcript")]
    known = spark.createDataFrame([("antigravity:c2",)], "source_ref string")
    assert [(r.source_ref, r.cwd) for r in logs.artifact_sessions(events, known).collect()] == [("antigravity:c1", "/home/u/p")]
    history = spark.createDataFrame([("a", "/w", "", 1), ("a", "", "", 2), ("b", "", "", 1), ("c", "/x", "slash_command", 1), ("", "/y", "", 1)], "session_id string, workspace string, type string, ts int")
    meta = spark.createDataFrame([("a", "T", ["file:///z"], False), ("b", "", ["file:///my%20dir"], False), ("d", "U", None, True)], "session_id string, title string, workspaces array<string>, internal boolean")
    assert {tuple(r) for r in logs.recorded(history, meta).collect()} == {("a", "/w", "T", True), ("b", "/my dir", "", True)}


def test_row_privacy(spark):
    rows = [("a#1", True, False, False, True), ("b", True, False, False, True), ("c", False, True, False, True), ("d", False, False, True, True), ("e", False, False, None, True), ("f", False, False, True, False), ("g", False, False, False, True)]
    df = spark.createDataFrame(rows, "source_ref string, stamped boolean, folder_private boolean, hidden boolean, agent boolean")
    got = {r.source_ref: r.private for r in policy.private_rows(df, spark.createDataFrame([("a",)], "source_ref string")).collect()}
    assert got == {"a#1": False, "b": True, "c": True, "d": True, "e": True, "f": False, "g": False}
    shown = policy.visible(spark.createDataFrame([("my prompt", "Title: my prompt Source: x\nrest", False)], "title string, text string, hidden boolean"), False).first()
    assert (shown.title, shown.text) == ("", "Title: (owner-only) Source: x\nrest")


def test_side_tables(spark):
    s = spark.createDataFrame([("1", "t", "2024", "f1"), ("1", "t", "2025", "f2")], "session_id string, title string, updated_at string, file_path string")
    one = logs.newest_copies(s)
    assert [r.file_path for r in one.collect()] == ["f2"]
    titles = spark.createDataFrame([("1", "A human title")], "session_id string, thread_name string")
    assert logs.with_titles(one, titles).first().title == "A human title"
    files = spark.createDataFrame([("c", False, 9, "p1"), ("c", True, 1, "p2")], "conversation string, is_full boolean, size int, path string")
    assert logs.best_transcripts(files).first().path == "p2"
