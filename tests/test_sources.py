"""Transcripts as a data source and a stream, and discovery as one path from files."""

import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from recollect.sources import discovery, tailing, transcripts


def test_ranges_meet_every_line_once():
    g = random.Random(3)
    for _ in range(200):
        lines = [b"x" * g.choice([0, 1, 5, 40, 90]) for _ in range(g.randint(0, 12))]
        data = b"\n".join(lines)
        want, at = [], 0
        for line in data.split(b"\n"):
            want.append((at, len(line), line if len(line) <= 50 else None))
            at += len(line) + 1
        if not want[-1][1]:
            want.pop()  # what follows the last line feed is no line
        cuts = sorted({0, len(data) + 1, *(g.randint(0, len(data)) for _ in range(3))})
        tailing.CHUNK = g.choice([1, 7, 1 << 20])
        got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in tailing.lines_in(io.BytesIO(data), a, b, 50)]
        tailing.CHUNK = 1 << 20
        assert got == want


def user(text, **more):
    return json.dumps({"type": "user", "message": {"content": text}, "timestamp": "2026-01-01T00:00:00Z", **more})


def test_format_reads_ranges_and_skips_long_lines(spark, tmp_path):
    folder = tmp_path / "projects" / "p"
    folder.mkdir(parents=True)
    long = user("y" * 700_000)
    rows = [user(f"line {i} é") for i in range(5000)]
    (folder / "a.jsonl").write_text("\n".join([*rows[:100], long, *rows[100:]]), encoding="utf-8")
    (folder / "b.jsonl").write_text("")
    (folder / "c.txt").write_text("no")
    (tmp_path / "other.jsonl").write_text("no")
    tailing.register(spark)
    for split in (10_000, 1 << 26):
        df = spark.read.format("claude").option("splitBytes", split).load(str(tmp_path))
        got = df.orderBy("at").collect()
        assert [r.value for r in got if r.value is not None] == rows and [r.size for r in got if r.value is None] == [len(long.encode())]
        assert split > 10_000 or df.rdd.getNumPartitions() > 50
    assert spark.read.format("transcript_lines").load(str(tmp_path)).select("path").distinct().count() == 2
    assert spark.read.format("claude").option("headBytes", 200).load(str(tmp_path)).count() < 5
    assert transcripts.claude_events(transcripts.tailed(spark.read.format("claude").load(str(tmp_path)))).count() == 5000


def test_growing_files_are_tailed_once(spark, tmp_path):
    src, seen = tmp_path / "src", []
    src.mkdir()
    tailing.register(spark)

    def go():
        stream = spark.readStream.format("transcript_lines").load(str(src))
        q = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r.value for r in df.orderBy("path", "at").collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    (src / "a.jsonl").write_text("one\ntwo\nthr")
    go()
    assert seen == ["one", "two"]  # the third line isn't whole yet
    with open(src / "a.jsonl", "a") as f:
        f.write("ee\nfour\n")
    (src / "b.jsonl").write_text("five\n")
    go()
    assert seen == ["one", "two", "three", "four", "five"]
    (src / "a.jsonl").write_text("new\n")  # rotated
    go()
    assert seen == ["one", "two", "three", "four", "five", "new"]


def put(path, rows, mtime):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)))
    os.utime(path, (mtime, mtime))


def codex(text, ident, **meta):
    return [{"type": "session_meta", "payload": {"id": ident, "cwd": "/w/a", **meta}}, {"type": "event_msg", "payload": {"type": "user_message", "message": text}, "timestamp": "2026-01-01T00:00:00Z"}]


def test_codex_discovery(spark, tmp_path):
    day = tmp_path / "sessions/2026/01/01"
    put(day / "s1.jsonl", [*codex("an old copy of it", "s1"), *codex("said later", "s1")[1:]], 100)
    put(tmp_path / "archived_sessions" / "s1.jsonl", codex("the new copy", "s1"), 200)
    put(day / "s2.jsonl", codex("another session", "s2", cwd="/private/x"), 300)
    put(day / "s3.jsonl", codex("by a subagent", "s3", source={"subagent": "review"}), 400)
    put(day / "s4.jsonl", codex("run by a program", "s4", source="exec", originator="codex_exec"), 500)
    put(day / "s5.jsonl", codex("the newest of all", "s5"), 600)
    found = lambda **more: {r.session_id: r.path.split("/")[-2] for r in discovery.discovered(spark, "codex", str(tmp_path), **more).collect()}
    assert found() == {"s1": "archived_sessions", "s2": "01", "s4": "01", "s5": "01"}
    public = lambda cwd, _: ~cwd.startswith("/private/")
    assert set(found(executed=False, allowed=public)) == {"s1", "s5"}
    assert set(found(executed=False, allowed=public, max_files=1)) == {"s5"}
    assert set(found(allowed=public, executed=False, max_files=2)) == {"s1", "s5"}  # what is left out takes no place
    got = {r.source_ref: (r.title, r.user_turns) for r in discovery.sessions(spark, "codex", str(tmp_path), public, executed=False).collect()}
    assert got == {"codex:s1": ("the new copy", 1), "codex:s5": ("the newest of all", 1)}
    both = [str(day / "s1.jsonl"), str(tmp_path / "archived_sessions" / "s1.jsonl")]
    assert [(r.title, r.user_turns) for r in transcripts.sessions(spark, "codex", both).collect()] == [("the new copy", 1)]  # one copy, not both in one


def test_antigravity_discovery(spark, tmp_path):
    step = lambda i, text: {"step_index": i, "source": "USER_EXPLICIT", "type": "USER_INPUT", "created_at": "2026-11-05T15:00:00Z", "content": text}
    logs = lambda c: tmp_path / "brain" / c / ".system_generated/logs"
    put(logs("c1") / "transcript.jsonl", [step(0, "short form of it")] * 3, 900)
    put(logs("c1") / "transcript_full.jsonl", [step(0, "the full transcript")], 100)
    put(logs("c2") / "transcript.jsonl", [step(0, "only a short one")], 200)
    got = {r.source_ref: r.title for r in discovery.sessions(spark, "antigravity", str(tmp_path)).collect()}
    assert got == {"antigravity:c1": "the full transcript", "antigravity:c2": "only a short one"}
    events = transcripts.events(spark, "antigravity", str(tmp_path / "brain/*/.system_generated/logs/*.jsonl")).collect()
    assert sorted((r.source_ref, r.text) for r in events) == [("antigravity:c1", "the full transcript"), ("antigravity:c2", "only a short one")]


def test_claude_discovery(spark, tmp_path):
    put(tmp_path / "projects/a/s1.jsonl", [json.loads(user("a question of mine", cwd="/w/a", entrypoint="cli"))], 100)
    put(tmp_path / "projects/a/s2.jsonl", [json.loads(user("a helper's work", isSidechain=True))], 200)
    put(tmp_path / "projects/b/s3.jsonl", [json.loads(user("from an editor", cwd="/w/b", entrypoint="ide"))], 300)
    assert {r.session_id: r.entrypoints for r in discovery.discovered(spark, "claude", str(tmp_path)).collect()} == {"s1": ["cli"], "s3": ["ide"]}
    cli = lambda _, entrypoints: F.array_contains(entrypoints, "cli")
    assert [r.source_ref for r in discovery.sessions(spark, "claude", str(tmp_path), cli).collect()] == ["claude:s1"]
    with pytest.raises(ValueError, match="unknown source"):
        transcripts.adapter("other")
