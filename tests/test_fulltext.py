"""The segmented full-text index against counting by hand, its versions, literals, and full text inside SQL."""

import math
import random

import pytest

from recollect.functions import text as T
from recollect.operators import fulltext, lexical
from recollect.plans import sqlapi

ROWS = "id long, source_ref string, title string, cwd string, text string"
VOCABULARY = ["а", "привет", "мир", "über", "größe", "go", "x", "café", "naïve", "ein", "zwei", "ab", "abc", "abcd", "the"]


def row(g, i):
    some = lambda n: " ".join(g.choices(VOCABULARY, k=g.randint(0, n)))
    return i, f"s{i // 3}", some(4), "/w/" + g.choice(VOCABULARY), some(30)


def by_hand(rows, asked, weights):
    """{id: score} by the formula, each phrase counted in each field."""
    docs = [(r[0], [T.words_of(x or "") for x in r[2:5]]) for r in rows]
    mean = sum(len(w) for _, fields in docs for w in fields) / max(1, len(docs))

    def times(words, c):
        n = 0
        for i in range(len(words) - len(c.words) + 1):
            here = words[i : i + len(c.words)]
            n += here[:-1] == list(c.words[:-1]) and (here[-1].startswith(c.words[-1]) if c.prefix else here[-1] == c.words[-1])
        return n

    counts = {i: [[times(w, c) if c.field in (None, f) else 0 for f, w in zip(fulltext.FIELDS, fields, strict=True)] for c in asked] for i, fields in docs}
    out = {}
    for i, fields in docs:
        length, score = sum(map(len, fields)), 0.0
        for k, own in enumerate(counts[i]):
            n = sum(any(x[k]) for x in counts.values())
            idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
            q = sum(a * b for a, b in zip(own, weights, strict=True))
            score += (idf if idf > 0 else 1e-6) * q * 2.2 / (q + 1.2 * (0.25 + 0.75 * length / mean)) if q else 0
        if any(any(x) for x in counts[i]):
            out[i] = score
    return out


def agree(index, rows, queries):
    for k, q in enumerate(queries):
        asked = fulltext.clauses(q)
        for weights in ((1.0, 1.0, 1.0), (4.0, 2.0, 1.0))[k % 2 :][:1]:
            want = by_hand(rows, asked, weights)
            got = {r.id: r.score for r in index.scored(asked, weights).collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want), q
            report: dict = {}
            top = [round(r.score, 9) for r in index.top(asked, 10, weights, report).collect()]
            assert top == sorted((round(s, 9) for s in want.values()), reverse=True)[:10], q
            assert report.get("read", 0) <= report.get("blocks", 0)


def test_scores_through_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 16)
    monkeypatch.setattr(fulltext, "FIRST", 5)
    monkeypatch.setattr(fulltext, "FANOUT", 3)
    g = random.Random(1)
    rows = [row(g, i) for i in range(400)] + [(9000, "z", None, None, None)]
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    path = str(tmp_path / "index")
    index = fulltext.FullText.write(make(rows), path)
    agree(index, rows, ["привет", "title:über", '"ein zwei"', "ab*", 'text:"uber große"', '"а привет" the title:ab*', "cwd:go cafe naive"])
    state = {r[0]: r for r in rows}
    for _ in range(3):  # the third makes one segment of those before
        changed = {i: row(g, i) for i in (g.randrange(500) for _ in range(20))}
        index = index.add(make(list(changed.values())))
        state |= changed
    assert len(index.live["segments"]) <= 3
    index = index.delete(spark.createDataFrame([("s5",), ("z",), ("none",)], "ref string"))
    state = {i: r for i, r in state.items() if r[1] not in ("s5", "z")}
    agree(fulltext.FullText.open(spark, path), list(state.values()), ["title:über мир", '"а привет" the'])
    table = [row(g, i) if i % 50 == 0 else r for i, r in sorted(state.items()) if i % 97]
    index = index.sync(make(table))
    assert index.sync(make(table)).version == index.version  # nothing has changed
    index.vacuum()
    agree(fulltext.FullText.open(spark, path), table, ["title:über мир", "ab*"])


def test_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    first = fulltext.FullText.write(spark.createDataFrame([(1, "a", "t", "", "one")], ROWS), path)
    more = spark.createDataFrame([(2, "b", "t", "", "two")], ROWS)
    second = first.add(more, batch="7")
    assert second.add(more, batch="7").version == second.version  # the batch is there already
    with pytest.raises(fulltext.Conflict):
        first.add(more)
    found = lambda index, q: {r.id for r in index.scored(fulltext.clauses(q)).collect()}
    assert found(first, "two") == set() and found(second, "two") == {2}  # a reader keeps to its version
    third = second.delete(spark.createDataFrame([("a",), ("b",)], "ref string"))
    assert third.size()[0] == 0 and found(third, "one two") == set()
    assert found(third.add(more), "two") == {2}


def test_skips_blocks(spark, tmp_path):
    rows = [(i, "s", "", "", "word " * (9 if i % 3000 == 7 else 1) + "pad " * (5 + i % 11)) for i in range(30_000)]
    index = fulltext.FullText.write(spark.createDataFrame(rows, ROWS), str(tmp_path / "index"))
    report: dict = {}
    got = {r.id for r in index.top(fulltext.clauses("word pad"), 10, report=report).collect()}
    assert got == {i for i in range(30_000) if i % 3000 == 7}
    assert report["read"] < report["blocks"] / 2


def test_literals(spark, tmp_path):
    g = random.Random(4)
    rows = [(i, f"s{i // 3}", None, None, "".join(g.choices("abÄ жß😀c ", k=g.randint(0, 60)))) for i in range(700)] + [(9000, "n", None, None, None)]
    table = spark.createDataFrame(rows, ROWS)
    index = fulltext.FullText.write(table, str(tmp_path / "index"), substrings=True)
    new = [(i, "q", None, None, f"abcd жaa{i}") for i in range(650, 750)]
    for step in range(2):
        for needle in ("aä", "abc", " ", "жß", "😀", "zzz", "AB", "cab "):
            hits = {r[0]: 100 + 10 * min(5, r[4].lower().count(needle.lower())) for r in rows if r[4] and needle.lower() in r[4].lower()}
            assert {r.id: r.score for r in index.literal(table, needle).collect()} == hits
            if needle in ("aä", "cab ", "zzz"):
                assert [r.id for r in index.literal(table, needle, newest=3).orderBy("id").collect()] == sorted(hits)[-3:]
                assert index.holding(needle).count() <= max(20, 2 * len(hits))  # few rows are read in vain
        if not step:
            rows = [r for r in rows if r[0] not in range(650, 700)] + new
            table = spark.createDataFrame(rows, ROWS)
            index = index.add(spark.createDataFrame(new, ROWS))
    with pytest.raises(ValueError, match="without substrings"):
        fulltext.FullText.write(table, str(tmp_path / "other")).holding("a")


def test_boolean_queries(spark, tmp_path):
    texts = ["a b", "a", "b c", "c а", "a b c", "", "über a-b"]
    index = fulltext.FullText.write(spark.createDataFrame([(i, "s", "a" if i == 3 else "", "", t) for i, t in enumerate(texts)], ROWS), str(tmp_path / "index"))
    for query, want in (("a b", {0, 4, 6}), ("a OR c", {0, 1, 2, 3, 4, 6}), ("a NOT b", {1, 3}), ("(a OR b) c", {2, 3, 4}), ("text:(a) OR c NOT b", {0, 1, 3, 4, 6}), ("title:a", {3}), ("а", {3}), ("b + c", {2, 4}), ('"A-B"', {0, 4, 6}), ("UBE*", {6}), ("--", set())):
        assert {r.id for r in index.match(query).collect()} == want, query
    for query in ("a OR", "(a", "NEAR(a b)", "AND a", "a ^b", ""):
        with pytest.raises(fulltext.Syntax):
            fulltext.parsed(query)


def test_index_follows_its_table(spark, tmp_path):
    held = lambda rows: {r.id for r in lexical.bm25(lexical.indexed(rows, "name"), ["word"]).collect()}
    one, two = (spark.createDataFrame([(i, "word")], "id int, text string") for i in (1, 2))
    assert held(one) == {1} and held(two) == {2}
    path = str(tmp_path / "t")
    one.write.parquet(path)
    assert held(spark.read.parquet(path)) == {1}
    two.write.mode("append").parquet(path)
    assert held(spark.read.parquet(path)) == {1, 2}


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    rows = [(1, "s1", "Über uns", "/a", "hello world and the привет мир of many other words in here that go on for so long that it is cut"), (2, "s1", "b", "/b", "world hello"), (3, "s2", "hello", "/x", "nothing")]
    table = spark.createDataFrame(rows, ROWS)
    return {"chunks": table}, {"chunks": fulltext.FullText.write(table, str(tmp_path_factory.mktemp("fts") / "index"))}


@pytest.mark.parametrize(("sql", "rows"), [
    ("SELECT c.id, m.rank < 0 FROM chunks c JOIN fts_match('hello world') m ON c.id = m.id ORDER BY m.rank", [[2, True], [1, True]]),
    ("SELECT rowid, snippet(chunks_fts, 2, '[', ']', '...', 14) FROM chunks_fts WHERE chunks_fts MATCH '\"hello world\"' ORDER BY bm25(chunks_fts)", [[1, "hello world and the привет мир of many other words in here that go..."]]),
    ("SELECT id FROM chunks WHERE id IN (SELECT rowid FROM chunks_fts WHERE chunks_fts MATCH 'title:hello OR title:uber') ORDER BY id", [[1], [3]]),
    ("SELECT f.title FROM chunks_fts f JOIN chunks c ON c.id = f.rowid WHERE chunks_fts MATCH 'мир NOT nothing' ORDER BY rank LIMIT 3", [["Über uns"]]),
    ("SELECT a.id FROM fts_match('chunks', 'hello') a JOIN fts_match('world') b ON a.id = b.id ORDER BY 1", [[1], [2]]),
    ("SELECT sum(id) OVER w FROM chunks WINDOW w AS (PARTITION BY cwd ORDER BY id)", [[1], [2], [3]]),
    ("SELECT id FROM chunks WHERE text LIKE '%match ''x''%' OR id = 1", [[1]]),
])
def test_sql_search(spark, chunks, sql, rows):
    assert sqlapi.run(spark, sql, chunks[0], indexes=chunks[1])["rows"] == rows


@pytest.mark.parametrize("sql", [
    "SELECT id, sum(1) OVER w FROM chunks WINDOW w AS (ORDER BY reflect('java.lang.System', 'setProperty', 'pwned', 'yes'))",
    "SELECT id, sum(1) OVER w FROM chunks WINDOW w AS (PARTITION BY id = (SELECT length(max(pw)) - 6 FROM secret))",
    "SELECT * FROM chunks_fts", "SELECT * FROM chunks WHERE text MATCH 'x'", "SELECT * FROM secret_fts WHERE secret_fts MATCH 'x'", "SELECT * FROM fts_match('a OR')", "SELECT * FROM fts_match(text)",
    "SELECT pw FROM secret WHERE chunks_fts MATCH 'x'", "SELECT rowid FROM chunks_fts WHERE chunks_fts MATCH 'a' UNION SELECT rowid FROM chunks_fts WHERE chunks_fts MATCH 'b'",
])
def test_sql_search_refuses(spark, chunks, sql):
    spark.createDataFrame([("x",)], "pw string").createOrReplaceTempView("secret")
    with pytest.raises(sqlapi.Refused):
        sqlapi.run(spark, sql, chunks[0], indexes=chunks[1])
    assert spark._jvm.System.getProperty("pwned") is None


def test_runs_of_code_points_are_written_only_for_who_asks(spark, tmp_path):
    from recollect.plans import fulltexts

    spark.createDataFrame([(i, f"text {i} of the", "en", "src1") for i in range(20)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = fulltexts.index(spark, str(tmp_path))
    assert not plain.live["substrings"]
    full = fulltexts.index(spark, str(tmp_path), substrings=True)
    assert full.live["substrings"] and full.path != plain.path
    assert fulltexts.index(spark, str(tmp_path)).path == full.path
