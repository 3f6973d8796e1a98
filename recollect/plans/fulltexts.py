"""Queries over the segmented full-text index.

The chunks of French documents are written in Cyrillic letters here, so that words of
two scripts lie in one index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext, lexical
from . import sqlapi
from .catalogue import CHUNKS, chunks, query

LATIN, CYRILLIC = "abdeiklmnoprstu", "абдеиклмнопрсту"
#: All chunks with the text they are indexed by.
MIXED = f"{CHUNKS}, mixed AS (SELECT * REPLACE (CASE WHEN source_name = 'fr' THEN translate(text, '{LATIN}', '{CYRILLIC}') ELSE text END AS text) FROM chunks)"
WEIGHTS = (4.0, 2.0, 1.0)
_HELD: dict[tuple[str, str], tuple[tuple, str, bool]] = {}


def mixed(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).withColumn("text", F.when(F.col("source_name") == "fr", F.translate("text", LATIN, CYRILLIC)).otherwise(F.col("text")))


def index(s: SparkSession, d: str, substrings: bool = False) -> fulltext.FullText:
    """The index of mixed(), written when this application first asks for it or its table has changed; with substrings only once a query needs them, as they are most of its bytes."""
    rows = mixed(s, d)
    key, now = (s.sparkContext.applicationId, d), lexical.state(rows)
    held = _HELD.get(key, (None, "", False))
    if held[0] != now or substrings and not held[2]:
        path = f"{lexical.shared(s)}/fulltext-{uuid.uuid4().hex}"
        fulltext.FullText.write(rows, path, substrings=substrings)
        _HELD[key] = now, path, substrings
    return fulltext.FullText.open(s, _HELD[key][1])


def scored_sql(asked: list[fulltext.Clause], weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rows: str = "mixed") -> str:
    """CTEs up to scored(id, score, n0, n1, ...): BM25 over the fields' words, each clause counted by its definition."""
    lists = ", ".join(f"regexp_extract_all(strip_accents(lower(coalesce({f}, ''))), '[\\p{{L}}\\p{{N}}]+') AS w_{f}" for f in fulltext.FIELDS)

    def times(c: fulltext.Clause, f: str) -> str:
        if c.field not in (None, f):
            return "0"
        tests = [f"starts_with(w_{f}[i + {j}], '{w}')" if c.prefix and j == len(c.words) - 1 else f"w_{f}[i + {j}] = '{w}'" for j, w in enumerate(c.words)]
        return f"len(list_filter(range(1, len(w_{f}) + {2 - len(c.words)}), lambda i: {' AND '.join(tests)}))"

    counts = ", ".join(f"{times(c, f)} AS c{i}_{f}" for i, c in enumerate(asked) for f in fulltext.FIELDS)
    n = ", ".join(f"c{i}_title + c{i}_cwd + c{i}_text AS n{i}" for i in range(len(asked)))
    df = ", ".join(f"count(*) FILTER (WHERE n{i} > 0) AS df{i}" for i in range(len(asked)))
    q = [f"({weights[0]} * c{i}_title + {weights[1]} * c{i}_cwd + {weights[2]} * c{i}_text)" for i in range(len(asked))]
    idf = [f"CASE WHEN ln((docs - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df{i} + 0.5) / (df{i} + 0.5)) END" for i in range(len(asked))]
    score = " + ".join(f"({idf[i]}) * {q[i]} * 2.2 / ({q[i]} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(asked)))
    some = " + ".join(f"n{i}" for i in range(len(asked)))
    return f"""lists AS (SELECT id, {lists} FROM {rows}), counts AS (SELECT id, len(w_title) + len(w_cwd) + len(w_text) AS len, {counts} FROM lists),
times AS (SELECT *, {n} FROM counts), whole AS (SELECT count(*) AS docs, avg(len) AS mean, {df} FROM times),
scored AS (SELECT times.*, {score} AS score FROM times, whole WHERE {some} > 0)"""


def top_sql(text: str, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), k: int = 10) -> str:
    return f"WITH {MIXED}, {scored_sql(fulltext.clauses(text), weights)} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT {k}"


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round("score", 6).alias("score"))


SCRIPTS = "cion y де ле a über"


@query("fts_scripts_and_short_words", top_sql(SCRIPTS))
def _(s, d):
    return rounded(index(s, d).top(fulltext.clauses(SCRIPTS)))


TITLES = "title:que title:the ле"


@query("fts_fields_weighted", top_sql(TITLES, WEIGHTS, 20))
def _(s, d):
    return rounded(index(s, d).top(fulltext.clauses(TITLES), 20, WEIGHTS))


TITLED = fulltext.clauses("title:the*")


@query("fts_title_prefix", f"WITH {MIXED}, {scored_sql(TITLED)} SELECT id, c0_title AS hits, round(score, 6) AS score FROM scored")
def _(s, d):
    rows = index(s, d).scored(TITLED)
    return rows.select("id", F.col("f0_title").cast("long").alias("hits"), F.round("score", 6).alias("score"))


PHRASES = fulltext.clauses('"of the" "de la" "де ле" cwd:"src1" "the an"*')


@query("fts_phrases", f"WITH {MIXED}, {scored_sql(PHRASES)} SELECT id, round(score, 6) AS score FROM scored")
def _(s, d):
    return rounded(index(s, d).scored(PHRASES))


COMMON = "with erth inan onder"


@query("fts_common_words_top", top_sql(COMMON, k=25))
def _(s, d):
    return rounded(index(s, d).top(fulltext.clauses(COMMON), 25))


CHANGED = fulltext.clauses("changed the cion title:changed")
#: What is left after a first lot, changes of some of it and of new rows, and sessions that went.
AFTER = """after AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'changed ' || title ELSE title END AS title, cwd,
  CASE WHEN id % 5 = 0 THEN 'changed ' || left(text, 200) ELSE text END AS text FROM mixed WHERE (id % 3 <> 0 OR id % 5 = 0) AND (id // 10) % 7 <> 0)"""


@query("fts_after_changes", f"WITH {MIXED}, {AFTER}, {scored_sql(CHANGED, rows='after')} SELECT id, round(score, 6) AS score FROM scored")
def _(s, d):
    """Written, changed and cut down in four versions; statistics are those of the rows that are left."""
    rows = mixed(s, d)
    held = fulltext.FullText.write(rows.where("id % 3 <> 0"), f"{lexical.shared(s)}/fulltext-{uuid.uuid4().hex}")
    new = rows.where("id % 5 = 0").withColumn("title", F.concat(F.lit("changed "), "title")).withColumn("text", F.concat(F.lit("changed "), F.substring("text", 1, 200)))
    held = held.add(new).delete(rows.where("floor(id / 10) % 7 = 0").select(F.col("source_ref").alias("ref")))
    return rounded(held.scored(CHANGED))


@query("substring_search", f"WITH {MIXED} SELECT id, CAST(100 + 10 * least((length(lower(text)) - length(replace(lower(text), 'he ou', ''))) // 5, 5) AS INT) AS score FROM mixed WHERE contains(lower(text), 'he ou')")
def _(s, d):
    return index(s, d, substrings=True).literal(mixed(s, d), "he ou").select("id", "score")


@query("substring_short", f"WITH {MIXED} SELECT id, CAST(100 + 10 * least(length(lower(text)) - length(replace(lower(text), 'ß', '')), 5) AS INT) AS score FROM mixed WHERE contains(lower(text), 'ß') ORDER BY id DESC LIMIT 100")
def _(s, d):
    return index(s, d, substrings=True).literal(mixed(s, d), "ß", newest=100).select("id", "score")


STATEMENT = """SELECT c.cwd, count(*) AS n, round(min(m.rank), 6) AS best FROM chunks c JOIN fts_match('(de OR де) NOT "de la"') m ON c.id = m.id
WHERE c.id NOT IN (SELECT rowid FROM chunks_fts WHERE chunks_fts MATCH 'title:the') GROUP BY c.cwd"""
_EITHER = [fulltext.Clause(("de",)), fulltext.Clause(("де",)), fulltext.Clause(("de", "la"))]


@query("sql_match", f"""WITH {MIXED}, {scored_sql(_EITHER)},
titled AS (SELECT id FROM lists WHERE list_contains(w_title, 'the'))
SELECT m.cwd, count(*) AS n, round(min(-score), 6) AS best FROM scored JOIN mixed m USING (id) WHERE (n0 > 0 OR n1 > 0) AND n2 = 0 AND id NOT IN (SELECT id FROM titled) GROUP BY m.cwd""")
def _(s, d):
    return sqlapi.query(s, STATEMENT, {"chunks": mixed(s, d)}, {"chunks": index(s, d)})
