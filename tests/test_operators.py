"""Operators whose results need more than a query to be seen: files, snippets, loops, errors."""

import json
import re

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import lexical, policy, results, search, sharing, store, windows


def test_json_members(spark):
    df = spark.createDataFrame([('{"a": "1", "b": {"c": 2}}',), ("no",), (None,), ("[1]",)], "j string")
    got = [json.loads(r.j) for r in df.select(store.with_json(F.col("j"), "$.a", F.lit("x")).alias("j")).collect()]
    assert [g["a"] for g in got] == ["x"] * 4 and got[0]["b"] == {"c": 2}
    odd = spark.createDataFrame([('{"a": null, "n": 1.5, "t": true, "l": [1, null], "u": "\\u00e9\\""}',)], "j string")
    assert json.loads(odd.select(store.with_json(F.col("j"), "$.a", F.lit(7))).first()[0]) == {"a": "7", "n": 1.5, "t": True, "l": [1, None], "u": 'é"'}


def test_compaction_of_vectors(spark, tmp_path):
    rows = [(1, "[0.5, 1.0]"), (2, "[]"), (3, None), (4, "")]
    spark.createDataFrame(rows, "id int, embedding string").repartition(4).write.parquet(str(tmp_path / "a"))
    store.compacted(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    out = spark.read.parquet(str(tmp_path / "b"))
    assert {r.id: r.embedding for r in out.collect()} == {1: [0.5, 1.0], 2: None, 3: None, 4: None}
    assert len(list((tmp_path / "b").glob("part-*"))) == 1


def test_rebuild_counts_what_is_written(spark, tmp_path):
    rows = [(f"s{i % 3}", f"r{i % 5}", f"2024-{i:02d}", "t", "/w", f"x{i}") for i in range(1, 12)]
    df = spark.createDataFrame(rows, "source_name string, source_ref string, updated_at string, title string, cwd string, text string")
    got = {r.source_name: (r.sessions, r.chunks) for r in store.rebuilt(df, str(tmp_path / "i")).collect()}
    assert got == {s: (len({r[1] for r in rows if r[0] == s}), sum(r[0] == s for r in rows)) for s in ("s0", "s1", "s2")}
    assert spark.read.parquet(str(tmp_path / "i")).where("content_hash is null").count() == 0


def test_logs_are_appended_and_put_away(spark, tmp_path):
    log, away = str(tmp_path / "log"), str(tmp_path / "away")
    for i in range(3):
        store.appended(spark.createDataFrame([(i,)], "n int"), log)
    assert spark.read.json(log).count() == 3
    assert store.archived(spark, log, away, "2024") == f"{away}/2024" and spark.read.json(f"{away}/2024").count() == 3
    assert store.archived(spark, log, away, "2024") == ""
    store.appended(spark.createDataFrame([(1,)], "n int"), log)
    with pytest.raises(FileExistsError):
        store.archived(spark, log, away, "2024")
    store.write_overview(spark.createDataFrame([("a", 1)], "tool string, n int"), str(tmp_path / "o"))
    assert [tuple(r) for r in store.read_overview(spark, str(tmp_path / "o"), "tool string, n int").collect()] == [("a", 1)]


def test_ties_have_one_winner(spark):
    old = spark.createDataFrame([(1, "a", 5)], "id int, v string, imported_at int")
    for rows in ([(1, "b", 7), (1, "c", 7), (1, "z", 6)], [(1, "z", 6), (1, "c", 7), (1, "b", 7)]):
        assert [tuple(r) for r in store.merged(old, spark.createDataFrame(rows, old.schema), "id").collect()] == [(1, "c", 7)]


def around(text, needle, width, most):
    out, at, low = [], 0, text.lower()
    while len(out) < most and (at := low.find(needle.lower(), at)) >= 0:
        a, z = max(0, at - width // 2), min(len(text), at + len(needle) + width // 2)
        out.append(("..." if a else "") + text[a:z].strip() + ("..." if z < len(text) else ""))
        at += len(needle)
    return out


def test_snippets_against_a_loop(spark):
    texts = ["", "no such word", "alpha beta " * 40 + "USER [1]\nthe Retry.limit was raised\n" + "gamma " * 90 + "retry.limit again and limits", "retry.limit" * 30, "a limit [truncated] tool_result " * 9 + "x" * 400 + " retry of limit"]
    query = "what happened in the session about retry.limit limits"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.s for r in df.select("id", results.snippets(F.col("text"), query, 3, 120).alias("s")).collect()}
    quality = {r.s: r.q for r in df.select(F.explode(results.snippets(F.col("text"), query, 99, 120)).alias("s")).distinct().select("s", results.snippet_quality(F.col("s")).alias("q")).collect()}
    terms = T.query_tokens(query)
    assert T.focus_query(query) == "retry.limit limits"
    for i, t in enumerate(texts):
        found = list(dict.fromkeys(around(t, "retry.limit limits", 120, 8)))
        for w in terms:
            if len(found) < 24:
                found = list(dict.fromkeys(found + around(t, w, 120, 3)))
        want = sorted(found, key=lambda s: -(40 * sum(w in s.lower() for w in terms) + quality[s]))[:3] if found else []
        assert got[i] == want, i
    assert df.select(results.snippets(F.col("text"), "the", 3).alias("s")).where("size(s) > 0").count() == 0


def test_places_for_kinds_of_events(spark):
    rows = [
        ("user", "please raise retry limit quota"), ("assistant", "looking"), ("actions", "[Bash] grep retry"), ("tool_result", " ".join(["retry limit quota status"] * 3)),
        ("user", "and the quota"), ("assistant", "the retry limit is raised with the quota"), ("tool_result", "nothing"), ("assistant", "done at last"),
    ]
    events = spark.createDataFrame([("s", i, r, t, "") for i, (r, t) in enumerate(rows)], "source_ref string, event_index int, role string, text string, ts string")
    got = [(r.event_index, r.snippet) for r in results.event_snippets(events, "what happened with retry limit quota status", 4).orderBy("no").collect()]
    assert got[0][0] == 0 and got[0][1] == "USER\nplease raise retry limit quota\nASSISTANT\nlooking\n"
    assert 7 in [i for i, _ in got] and 3 in [i for i, _ in got] and len(got) == 4  # the last turn and the tool output have places
    plain = [r.event_index for r in results.event_snippets(events, "and the quota", 1).collect()]
    assert plain == [4]  # the phrase


def test_read_budgets(spark):
    events = spark.createDataFrame([("s", i, "user", "x" * 100, "") for i in range(20)], "source_ref string, event_index int, role string, text string, ts string")
    got = search.read_window(events, "s", 5, 3, 3, 2, max_chars=400).collect()
    window = [r for r in got if r.part == "window"]
    assert sum(len(r.block) for r in window) == 232 and [r.event_index for r in window] == [2, 3, 4]
    assert sum(len(r.block) for r in got if r.part == "tail") == 168
    whole = search.read(events, "s", "nothing here", 300).collect()
    assert [r.event_index for r in whole] == [8, 9]  # the last twelve, as far as they fit
    assert search.read(events.withColumn("text", F.when(F.col("event_index") == 4, "the needle").otherwise(F.col("text"))), "s", "needle", 300).first().event_index == 4


def test_two_stage_scores(spark):
    heads = spark.createDataFrame([("a", "fix retry limit", "/w"), ("b", "other", "/w"), ("c", "none", "/w")], "source_ref string, title string, cwd string")
    events = spark.createDataFrame([("a", 0, "user", "hello"), ("b", 0, "user", "retry limit"), ("b", 1, "tool_result", "retry limit"), ("c", 0, "assistant", "zzz")], "source_ref string, event_index int, role string, text string")
    got = {r.source_ref: r.score for r in search.session_scores(heads, events, "retry limit").collect()}
    plain = 80 + 2 * 1.25 + 1.5 * 4  # the phrase, each term once, two terms
    assert got == {"a": round(1.35 * (plain + 2 * 8) + 40, 4), "b": round(1.25 * plain + 40, 4)}  # a's title holds both terms, b's first turn does


def test_score_of_a_text(spark):
    query = "raise retry.limit quota status today"
    terms = T.query_tokens(query)
    texts = ["", "retry.limit", "raise the quota and retry.limit " + "x y " * 3 + "status", "raise quota status " + "pad " * 60 + "retry.limit", "we raise retry.limit quota status today"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", search.score_text(F.col("t"), F.lit("Retry.limit of the quota"), F.lit("/w/status"), query).alias("s"))
    got = {r.i: r.s for r in df.collect()}

    def want(text):
        words = re.findall(T.TOKEN, text.lower())
        n = {t: words.count(t) for t in terms if t in words}
        said = 80 if query in text.lower() else 0
        if not said and (len(n) < 3 or not any(t in n for t in T.anchor_tokens(terms))):
            return 0
        at = [i for i, w in enumerate(words) if w in terms]
        best = max((len({words[j] for j in at if i - 40 <= j <= i}) for i in at), default=0)
        prox = 5 * best * best if len(at) >= 3 and best >= 3 else 0
        each = sum(1 + 0.25 * min(c, 2) + 8 * (t in "retry.limit of the quota") + 4 * (t in "/w/status") for t, c in n.items())
        return said + each + 1.5 * len(n) ** 2 + prox

    assert got == {i: pytest.approx(want(t)) for i, t in enumerate(texts)} and got[1] == 0 and got[3] > 0


def test_search_without_exact_hits_uses_vectors(spark):
    rows = [(i, f"plain text {i}", f"s{i}", i, "t", [1.0, float(i)]) for i in range(6)]
    chunks = spark.createDataFrame(rows, "id int, text string, source_ref string, chunk_index int, title string, embedding array<double>")
    vector = spark.createDataFrame([([0.0, 1.0],)], "q array<double>")
    assert [r.id for r in search.search(chunks, "unheardof words", vector, limit=2).collect()] == [5, 4]
    assert {r.id for r in search.search(chunks, "plain text", vector, limit=9).collect()} == set(range(6))
    with pytest.raises(ValueError, match="unknown mode"):
        search.search(chunks, "x", mode="other")


def test_index_equals_scan(spark, tmp_path):
    texts = ["red fox and red hen", "the fox", "", None, "red red red", "fox red fox red fox red", "fo xr ed"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    index = lexical.Index.write(rows.fillna("", ["text"]), str(tmp_path / "i"))
    for terms, prefix in ((["red", "fox"], False), (["re", "fo"], True), (["none"], False)):
        a, b = ({r.id: round(r.bm25, 9) for r in lexical.scored(x, terms, prefix).collect()} for x in (rows.fillna("", ["text"]), index))
        assert a == b
    for words in (["red", "fox"], ["fox", "red", "fox"], ["red", "red"]):
        a, b = ({r.id: r.hits for r in lexical.phrase(x, words).select("id", "hits").collect()} for x in (rows.fillna("", ["text"]), index))
        assert a == b


def test_many_hits_of_one_session_leave_room(spark):
    rows = [(i, "needle " * 5, "", "big") for i in range(100)] + [(100 + i, "needle", "", f"s{i}") for i in range(20)]
    got = lexical.instant_hits(spark.createDataFrame(rows, "id int, text string, title string, source_ref string"), "needle", 8).collect()
    assert len(got) == 8 and len({r.source_ref for r in got}) == 8


def test_memory_fallback(spark):
    rows = spark.createDataFrame([(1, "p1", "aa", "session", [0.2, 0.0]), (2, "p2", "bb", "session", [0.05, 0.0]), (3, "p3", "cc", "session", [0.1, 0.0])], "id int, parent string, text string, kind string, embedding array<double>")
    vector = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert [r.id for r in search.semantic_memory(rows, vector, "zzz").collect()] == [1, 3]  # 0.16 and 0.08; 0.04 is too little
    assert search.semantic_memory(rows.where("id = 2"), vector, "zzz").count() == 0


def test_search_loop():
    asked = []

    def run(q):
        asked.append(q)
        return [{"ref": q, "score": 100.0 + len(asked), "title": "some title", "cwd": "/w/proj"}]

    got = search.search_loop(run, "what happened in the session about retry limits", planner=lambda q, hits: ["planned"])
    assert asked[0].startswith("what happened") and "retry limits" in asked and "planned" in asked
    assert got == sorted(got, key=lambda r: (-r["score"], r["ref"]))
    assert not search.needs_iteration([600, 100]) and search.needs_iteration([]) and search.needs_iteration([200, 190])


def test_query_variants():
    q = 'what was the final status of "the long job" about retries'
    got = search.query_variants(q, [{"title": "T", "cwd": "/w/proj/"}], 12, {"RETRIES": "backoff limit"})
    assert got == [
        q, "retries", 'the long job" about retries', 'the final status of "the long job" about retries', "the long job", "was final status statu long job retries retrie",
        "latest current status progress retries", "retries backoff limit", "backoff limit", "T", "proj"]
    assert search.query_variants("x") == ["x"]


def test_loop_stops_in_time():
    ticks = iter(range(100))
    asked = []
    search.search_loop(lambda q: asked.append(q) or [], "search for one two three", planner=lambda q, h: ["more"], seconds=2, clock=lambda: next(ticks))
    assert len(asked) <= 2


def test_projects_to_review(spark):
    known = spark.createDataFrame([("a", "2020", 1, True), ("b", "2020", 1, False), ("c", "2020", 1, False), ("d", "2020", 1, False), ("e", "2020", 1, True)], "key string, first_seen string, sessions int, reviewed boolean")
    current = spark.createDataFrame([("a", 2, False), ("b", 3, True), ("c", 3, False), ("f", 1, True), ("g", 1, False)], "key string, sessions int, worthy boolean")
    got = {r.key: (r.first_seen, r.sessions, r.reviewed) for r in store.reviewed_projects(known, current, "2024").collect()}
    assert got == {"a": ("2020", 2, True), "b": ("2020", 3, False), "e": ("2020", 1, True), "f": ("2024", 1, False)}
    first = {r.key: r.reviewed for r in store.reviewed_projects(known.limit(0), current, "2024", True).collect()}
    assert first == dict.fromkeys("abcfg", True)


def test_handles_and_summaries(spark):
    from recollect.functions import messages
    from recollect.sources import transcripts

    rows = [(" My.Bot! ", ["x"], "n", "my.bot"), ("", ["A long alias", "Bobby", "al", "x"], "n", "al"), (None, None, "Ada L. King of the very long name", "ada-l-king-of-the-ve"), ("--", [], "", "owner")]
    df = spark.createDataFrame(rows, "o string, a array<string>, n string, want string")
    assert all(r.got == r.want for r in df.select("want", messages.handle(F.col("o"), F.col("a"), F.col("n")).alias("got")).collect())
    turns = [("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("user", "u3"), ("user", "u4"), ("assistant", "a2"), ("assistant", "a3")]
    own = transcripts.summarised(spark.createDataFrame([("T", turns), ("only", [])], "title string, turns array<struct<role:string,text:string>>")).collect()
    assert own[0].short_summary == "u1 Last assistant note: a3" and own[0].detailed_summary == "Title: T. Recent user turns: u2; u3; u4. Recent assistant notes: a2; a3."
    assert (own[1].short_summary, own[1].detailed_summary) == ("only", "Title: only.")


def test_scope_errors(spark):
    rules = spark.createDataFrame([("en", "default", "blacklist", *[[]] * 9, False)], sharing.POLICY)
    for action, kind, value in (("drop", "workdir", "x"), ("exclude", "other", "x"), ("exclude", "workdir", " ")):
        with pytest.raises(ValueError):
            sharing.scope_changed(rules, action, "en", kind, value)
    assert sharing.scope_changed(rules, "set_visibility", "en", value="whitelist").first()["mode"] == "whitelist"
    out = sharing.scope_changed(sharing.scope_changed(rules, "exclude", "en", "entrypoint", "SDK"), "exclude", "en", "entrypoint", "sdk").first()
    assert out["excluded_entrypoints"] == ["sdk"]
    with pytest.raises(ValueError, match="unknown scope"):
        policy.scoped(rules, "other", "x")


def test_busy_keys_are_cut_at_pauses(spark):
    times = [0, 1, 2, 61, 62, 63, 200, 201, 259, 260, 261]
    rows = spark.createDataFrame([("k", float(t), i) for i, t in enumerate(times)], "k string, s double, event_id int").selectExpr("k", "timestamp_seconds(s) AS ts", "event_id")
    got = {r.event_id: r.allowed for r in windows.rate_limited(rows, "k", "ts", 2, 60).collect()}
    seen, want = [], {}
    for i, t in enumerate(times):
        seen = [x for x in seen if t - x < 60]
        want[i] = len(seen) < 2
        seen += [t] if want[i] else []
    assert got == want


def test_folder_classes_and_toggles(spark):
    df = spark.createDataFrame([("",), ("/home/a",), ("/home/a/Documents/Chats/x",), ("/w/workspaces/p",), ("/w/p/",)], "c string")
    got = [r.x for r in df.select(policy.workdir_classes(F.col("c"), "/home/a").alias("x")).collect()]
    assert got == [["empty", "no_project"], ["home_default", "no_project"], ["documents_chat"], ["workspace"], ["project"]]
    one = spark.createDataFrame([(["a", "b"],)], "r array<string>")
    assert one.select(policy.toggled(F.col("r"), F.lit("c"), True), policy.toggled(F.col("r"), F.lit("a"), False)).first()[:] == (["a", "b", "c"], ["b"])


def test_prompt_search_by_index(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta"]
    prompts = spark.createDataFrame([(i, f"s{i % 7}", " ".join(words[k] for k in range(4) if i >> k & 1) + f" more{i % 3}") for i in range(64)], "id int, session_id string, text string")
    index = lexical.Index.write(prompts.select("id", "text"), str(tmp_path / "i"))
    for query in ("alpha gamma", "beta", "alpha beta gamma delta nothing"):
        a, b = (search.prompt_search(prompts, query, 20, x).collect() for x in (None, index))
        assert a == b and a


def test_digest_of_few_sessions(spark):
    schema = "id long, tool string, title string, text string, updated_at string, short_summary string, detailed_summary string"
    rows = [(1, "claude", "parser bug", "the parser fails; parser again", "2024-01-01T10", "short one", "long one"), (2, "codex", None, None, None, None, None)]
    got = [r.line for r in search.prompt_digest(spark.createDataFrame(rows, schema), "parser", recent=1).collect()]
    assert got[1:] == [
        "Global overview: 2 total sessions Claude 1, Codex 1.", "Current user query for memory matching: parser", "Potentially relevant prior trajectories:", "- [claude][2024-01-01] parser bug: short one",
        "Recent trajectories with more detail:", "- [claude][2024-01-01] long one", "Older trajectory catalog:", "- [codex][] : ", got[-1]]
    empty = [r.section for r in search.prompt_digest(spark.createDataFrame([], schema), "x y").collect()]
    assert empty == [0, 1, 2, 6] and [r.section for r in search.prompt_digest(spark.createDataFrame([], schema)).collect()] == [0, 1, 6]


def test_origins_are_written_once(spark, tmp_path):
    from recollect.operators.buckets import Buckets

    rows = spark.createDataFrame([(i, f"s{i % 4}", None if i == 3 else "no json" if i == 2 else '{"x": {"y": 1}}') for i in range(40)], "id long, source_ref string, metadata_json string")
    held = Buckets.create(spark, str(tmp_path / "t"), "id bigint, source_ref string, metadata_json string", ["id"], 4).merge(rows)
    origins = spark.createDataFrame([("s0", "automated", "sdk"), ("s1", "interactive", None), ("s1", "automated", "a"), ("s2", "interactive", "b"), ("s3", "unknown", "c"), ("none", "automated", "d"), (None, "automated", "e")], "source_ref string, origin string, origin_detail string")
    once = store.origins_written(held, origins)
    got = {r.id: r.metadata_json for r in once.read().collect()}
    assert len(got) == 40 and got[3] is None and got[7] == '{"x": {"y": 1}}'
    assert json.loads(got[0]) == {"x": {"y": 1}, "origin": "automated", "origin_detail": "sdk"} and json.loads(got[2]) == {"origin": "interactive", "origin_detail": "b"}
    assert json.loads(got[1])["origin"] == "interactive"
    again = store.origins_written(once, origins)
    assert again.live["folders"] == once.live["folders"]
    assert {tuple(r) for r in store.origin_counts(once.read()).collect()} == {("automated", "sdk", 1), ("interactive", "", 1), ("interactive", "b", 1), ("unknown", "", 1)}


def test_overview_without_decisions(spark):
    empty = {k: spark.createDataFrame([], k) for k in ("project string, level string", "project string, suggested string, reason string", "project string, ref string", "ref string", "session_id string, level string", "source_ref string, title string")}
    projects = spark.createDataFrame([("p", 1, "2024")], "project string, sessions long, last string")
    assert [tuple(r) for r in sharing.overview(projects, *empty.values()).collect()] == [("p", 1, "2024", *[None] * 7)]
