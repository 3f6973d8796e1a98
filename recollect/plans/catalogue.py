"""The registered queries over the driver's tables, each with a DuckDB statement of the same result.

Stand-ins: a document is a chunk (source_name = lang, cwd = source, session =
doc_id / 10), a conversation is a session, an event is a prompt of user_id, and
row n of embeddings is the vector of document n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import messages as M
from ..functions import text as T
from ..operators import catalog, chunking, lexical, policy, search, store, vectors, windows

NOW = "2024-01-31 00:00:00"
TERMS = ["with", "that", "inan"]
PHRASE = "of the"
QUERY = "the and with"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    return df.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("source_name"), F.col("source").alias("cwd"),
        F.concat(F.lit("s"), F.floor(F.col("doc_id") / 10).cast("string")).alias("session_id"),
        F.concat("lang", F.lit(":s"), F.floor(F.col("doc_id") / 10).cast("string")).alias("source_ref"),
        (F.col("doc_id") % 10).cast("int").alias("chunk_index"), T.normalize_text(F.substring("text", 1, 400), 90).alias("title"),
        F.format_string("2024-%02d-%02d", (F.col("doc_id") % 12 + 1).cast("int"), (F.col("doc_id") % 28 + 1).cast("int")).alias("updated_at"))


def postings(spark: SparkSession, d: str) -> lexical.Index:
    """The index of all documents, written once a session."""
    return lexical.indexed(chunks(spark, d).select("id", "text"), f"{d}/documents")


#: The same stand-in in DuckDB; ws folds all white space as the library does.
CHUNKS = r"""chunks AS (SELECT doc_id AS id, text, lang AS source_name, source AS cwd, 's' || (doc_id // 10) AS session_id,
  lang || ':s' || (doc_id // 10) AS source_ref, CAST(doc_id % 10 AS INT) AS chunk_index,
  CASE WHEN length(w) > 90 THEN rtrim(substr(w, 1, 87)) || '...' ELSE w END AS title,
  printf('2024-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS updated_at
  FROM (SELECT *, trim(regexp_replace(substr(text, 1, 400), '[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS w FROM documents))"""


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """One text a conversation."""
    rows = conversations(spark, d).groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), " ").alias("text"), F.count("*").alias("turns"))
    return rows.withColumn("title", F.substring("text", 1, 60)).withColumn("updated_at", F.lpad(F.col("id").cast("string"), 10, "0"))


SESSIONS = """sessions AS (SELECT conv_id AS id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS turns,
  substr(string_agg(text, ' ' ORDER BY turn), 1, 60) AS title, lpad(CAST(conv_id AS VARCHAR), 10, '0') AS updated_at FROM conversations GROUP BY conv_id)"""


def vector0(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def bm25_sql(terms: list[str], prefix: bool = False, rows: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to scored(id, bm25, tf0..)."""
    tests = [f"starts_with(x, '{t}')" if prefix else f"x = '{t}'" for t in terms]
    tf = ", ".join(f"len(list_filter(w, lambda x: {c})) AS tf{i}" for i, c in enumerate(tests))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len / mean_len))" for i in range(len(terms)))
    some = " + ".join(f"tf{i}" for i in range(len(terms)))
    return f"""words AS (SELECT {key} AS id, regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}') AS w FROM {rows}),
counted AS (SELECT id, len(w) AS len, {tf} FROM words), stats AS (SELECT count(*) AS docs, avg(len) AS mean_len, {df} FROM counted),
scored AS (SELECT counted.*, {part} AS bm25 FROM counted, stats WHERE {some} > 0)"""


def prox_sql(terms: list[str], rows: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to prox(id, best, score): self-join on positions up to 40 apart."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""toks AS (SELECT {key} AS id, regexp_extract_all(lower(text), '[a-z0-9_./:-]{{3,}}') AS w FROM {rows}),
hits AS (SELECT id, pos, term FROM (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM toks) WHERE term IN ({listed})),
near AS (SELECT a.id, a.pos, count(DISTINCT b.term) AS n FROM hits a JOIN hits b ON a.id = b.id AND b.pos BETWEEN a.pos - 40 AND a.pos GROUP BY a.id, a.pos),
prox AS (SELECT id, CAST(max(n) AS INT) AS best, CAST(CASE WHEN count(*) >= 3 AND max(n) >= 3 THEN 5 * max(n) * max(n) ELSE 0 END AS INT) AS score FROM near GROUP BY id)"""


Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query with its oracle."""

    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


# full text


@query("bm25_topk", f"WITH {bm25_sql(TERMS)} SELECT id, round(bm25, 4) AS score FROM scored ORDER BY score DESC, id LIMIT 10")
def _(s, d):
    return lexical.bm25(postings(s, d), TERMS)


@query("bm25_prefix", f"WITH {bm25_sql(['erth', 'ouv'], True)} SELECT id, round(bm25, 4) AS score FROM scored ORDER BY score DESC, id LIMIT 10")
def _(s, d):
    return lexical.bm25(postings(s, d), ["erth", "ouv"], prefix=True)


@query("phrase_search", "WITH j AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'), '  ') || ' ' AS t FROM documents) SELECT id, CAST((length(t) - length(replace(t, ' with  that ', ''))) / 12 AS INT) AS hits FROM j WHERE contains(t, ' with  that ')")
def _(s, d):
    return lexical.phrase(postings(s, d), ["with", "that"]).select("id", "hits")


@query("literal_search", "SELECT doc_id AS id, CAST(100 + 10 * least((length(lower(text)) - length(replace(lower(text), 'mit license', ''))) // 11, 5) AS INT) AS score FROM documents WHERE contains(lower(text), 'mit license') ORDER BY doc_id DESC LIMIT 5000")
def _(s, d):
    return lexical.literal(chunks(s, d), "MIT License").select("id", "score")


def exact_sql(terms: list[str], phrase: list[str], least: int) -> str:
    """CTEs up to exact(id, score): the best of the phrase and the gated term leg."""
    matched = " + ".join(f"CAST(tf{i} > 0 AS INT)" for i in range(len(terms)))
    words = "  ".join(phrase)
    return f"""{bm25_sql(terms)}, {prox_sql(terms)},
joined AS (SELECT doc_id AS id, text FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}'), '  ') || ' ', ' {words} ')),
{bm25_sql(phrase, rows='joined', key='id').replace('words AS', 'pwords AS').replace('FROM words', 'FROM pwords').replace('counted AS', 'pcounted AS').replace('FROM counted', 'FROM pcounted').replace('counted.*', 'pcounted.*').replace('stats AS', 'pstats AS').replace(', stats', ', pstats').replace('scored AS', 'pscored AS')},
top AS (SELECT *, {matched} AS m FROM scored WHERE {matched} >= {least} ORDER BY bm25 DESC, id LIMIT 300),
legs AS (SELECT id, 180 + 80 / (1 + abs(bm25)) AS score FROM pscored UNION ALL SELECT top.id, 50 / (1 + abs(bm25)) + 3 * m * m + coalesce(prox.score, 0) FROM top LEFT JOIN prox ON top.id = prox.id),
exact AS (SELECT id, round(max(score), 4) AS score FROM legs GROUP BY id ORDER BY score DESC, id LIMIT 300)"""


@query("exact_scores_max_merge", f"WITH {exact_sql(['the', 'and', 'with'], ['the', 'and', 'with'], 2)} SELECT id, score FROM exact")
def _(s, d):
    return lexical.exact_scores(chunks(s, d).select("id", "text"), QUERY, index=postings(s, d))


@query("proximity_window", f"WITH {prox_sql(['the', 'and', 'with', 'that'])} SELECT id, best, score FROM prox")
def _(s, d):
    return lexical.proximity(chunks(s, d).select("id", "text"), ["the", "and", "with", "that"])


@query("instant_hits", f"""WITH {CHUNKS}, {bm25_sql(['theth', 'oner'], True, 'chunks', 'id')},
h AS (SELECT s.id, c.source_ref, round(bm25, 4) AS score, CAST(tf0 > 0 AS INT) + CAST(tf1 > 0 AS INT) + 2 * (CAST(len(list_filter(tw, lambda x: starts_with(x, 'theth'))) > 0 AS INT) + CAST(len(list_filter(tw, lambda x: starts_with(x, 'oner'))) > 0 AS INT)) AS hits
  FROM scored s JOIN (SELECT id, source_ref, regexp_extract_all(lower(title), '[a-z0-9_]{{3,}}') AS tw FROM chunks) c ON s.id = c.id),
best AS (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY hits DESC, score DESC, id) AS r FROM h)
SELECT id, source_ref, hits, score FROM best WHERE r = 1 ORDER BY hits DESC, score DESC, id LIMIT 8""")
def _(s, d):
    return lexical.instant_hits(chunks(s, d), "theth oner", index=postings(s, d))


@query("document_frequency_idf", "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]{3,}')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(1 + ln((any_value(n) + 1) / (count(*) + 1)), 4) AS idf FROM t, n GROUP BY term")
def _(s, d):
    return lexical.document_frequency(chunks(s, d).select("id", "text"))


def lexical_sql(terms: list[str], said: str) -> str:
    c = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS c{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE c{i} > 0) AS df{i}" for i in range(len(terms)))
    d = "(" + " + ".join(f"CAST(c{i} > 0 AS INT)" for i in range(len(terms))) + ")"
    weighted = " + ".join(f"CASE WHEN c{i} > 0 THEN (1 + 0.25 * least(c{i}, 2)) * (1 + ln((n + 1) / (df{i} + 1))) ELSE 0 END" for i in range(len(terms)))
    return f"""WITH {SESSIONS}, {prox_sql(terms, 'sessions', 'id')},
c AS (SELECT id, text, {c} FROM (SELECT id, text, regexp_extract_all(lower(text), '[a-z0-9_./:-]{{3,}}') AS w FROM sessions)), st AS (SELECT count(*) AS n, {df} FROM c)
SELECT c.id, round(CASE WHEN contains(lower(text), '{said}') THEN 50 ELSE 0 END + {weighted} + 2 * {d} * {d} + coalesce(prox.score, 0), 4) AS score
FROM c CROSS JOIN st LEFT JOIN prox ON c.id = prox.id WHERE {d} > 0 ORDER BY score DESC, c.id LIMIT 10"""


@query("lexical_session_search", lexical_sql(["onder", "erth", "thin"], "onder erth thin"))
def _(s, d):
    return lexical.lexical_sessions(sessions(s, d).select("id", "text"), "onder erth thin")


# vectors and ranking


@query("vector_topk", f"SELECT e.vec_id AS id, round(100 * {DOT}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {DOT} > 0 ORDER BY score DESC, id LIMIT 10")
def _(s, d):
    return vectors.vector_topk(table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), vector0(s, d))


@query("vector_topk_filtered", f"SELECT e.vec_id AS id, round(100 * {DOT}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {DOT} > 0 AND e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY score DESC, id LIMIT 10")
def _(s, d):
    only = chunks(s, d).where("source_name = 'en'")
    return vectors.vector_topk(table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), vector0(s, d), 10, only)


@query("hybrid_search", f"""WITH {CHUNKS}, edocs AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
{exact_sql(['the', 'and', 'with'], ['the', 'and', 'with'], 2).replace('FROM documents', 'FROM edocs')},
v AS (SELECT e.vec_id AS id, round(100 * {DOT}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {DOT} > 0 AND e.vec_id IN (SELECT id FROM exact) ORDER BY score DESC, id LIMIT 50),
h AS (SELECT id, sum(score) AS score FROM (SELECT id, score FROM exact UNION ALL SELECT id, score FROM v) GROUP BY id),
a AS (SELECT h.id, c.source_ref, CASE WHEN contains(lower(c.text), '"match_kind"') THEN 0.35 ELSE 1 END * (h.score + 0 + CASE WHEN chunk_index <= 1 THEN 25 ELSE 0 END)
  + exp(-greatest(0, (epoch(TIMESTAMP '{NOW}') - epoch(CAST(c.updated_at AS TIMESTAMP))) / 86400.0) / 30) * 30 AS score FROM h JOIN chunks c ON h.id = c.id)
SELECT id, source_ref, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY round(score, 4) DESC, id) AS r FROM a) WHERE r <= 2 ORDER BY round(score, 4) DESC, id LIMIT 10""")
def _(s, d):
    rows = embedded(s, d)
    return search.search(rows, QUERY, vector0(s, d), now=NOW, index=lexical.indexed(rows.select("id", "text"), f"{d}/embedded"))


@query("semantic_memory_search", f"""WITH {CHUNKS}, n AS (SELECT c.id, c.source_ref, {DOT} AS cosine, len(list_intersect(['onder', 'erth'], regexp_extract_all(lower(c.text), '[a-z0-9_./:-]{{3,}}'))) / 2 AS overlap, c.chunk_index
  FROM chunks c JOIN embeddings e ON c.id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
k AS (SELECT *, 0.8 * cosine + 0.4 * overlap + CASE WHEN chunk_index > 0 THEN 0.03 ELSE 0 END AS score FROM n WHERE cosine > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY score DESC, id) AS r FROM k WHERE score >= 0.2 OR overlap >= 0.25)
SELECT id, round(score, 4) AS score, round(overlap, 4) AS overlap FROM r WHERE r = 1 ORDER BY round(score, 4) DESC, id LIMIT 10""")
def _(s, d):
    rows = embedded(s, d).withColumn("parent", F.col("source_ref")).withColumn("kind", F.when(F.col("chunk_index") > 0, "chunk").otherwise("session"))
    return search.semantic_memory(rows, vector0(s, d), "onder erth")


@query("overview_search", f"""WITH {SESSIONS}, b AS (SELECT id, updated_at, CASE WHEN contains(lower(title), 'erth') THEN 5 ELSE 0 END + CASE WHEN contains(lower(title), 'onder') THEN 5 ELSE 0 END
  + (length(lower(text)) - length(replace(lower(text), 'erth', ''))) // 4 + (length(lower(text)) - length(replace(lower(text), 'onder', ''))) // 5 AS base, row_number() OVER (ORDER BY updated_at DESC, id) AS r FROM sessions)
SELECT id, round(base + CASE WHEN r <= 20 THEN 0.75 ELSE 0 END, 4) AS score FROM b WHERE base > 0 ORDER BY score DESC, id LIMIT 10""")
def _(s, d):
    return search.overview_search(sessions(s, d), "erth onder")


@query("prompt_search_and_or_fallback", f"""WITH p AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, text FROM conversations WHERE role = 'user'), {bm25_sql(['erth', 'anan', 'then'], rows='p', key='id')},
h AS (SELECT s.*, p.session_id, p.text, CAST(tf0 > 0 AS INT) + CAST(tf1 > 0 AS INT) + CAST(tf2 > 0 AS INT) AS hits FROM scored s JOIN p ON s.id = p.id),
g AS (SELECT * FROM h WHERE hits = 3 OR (SELECT max(hits) FROM h) < 3),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, substr(text, 1, 200) ORDER BY hits DESC, round(bm25, 4) DESC, id) AS r FROM g)
SELECT id, hits FROM r WHERE r = 1 ORDER BY hits DESC, round(bm25, 4) DESC, id LIMIT 10""")
def _(s, d):
    rows = conversations(s, d).where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "text")
    return search.prompt_search(rows, "erth anan then")


@query("channel_merge", """WITH c AS (SELECT 's' || (doc_id // 10) AS ref, 'lexical' AS channel, CAST(doc_id % 7 AS DOUBLE) AS score, 1 AS is_chunk FROM documents WHERE contains(lower(text), 'erth')
UNION ALL SELECT 's' || (doc_id // 10), 'local', CAST(doc_id % 11 AS DOUBLE), 0 FROM documents WHERE contains(lower(text), 'onder')),
m AS (SELECT ref, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels, max(struct_pack(a := is_chunk, b := score)) AS best FROM c GROUP BY ref)
SELECT ref, channels, best.b AS score, best.a AS is_chunk FROM m""")
def _(s, d):
    c = chunks(s, d)
    leg = lambda word, name, mod, chunk: c.where(F.contains(F.lower("text"), F.lit(word))).select(F.col("session_id").alias("ref"), F.lit(name).alias("channel"), (F.col("id") % mod).cast("double").alias("score"), F.lit(chunk).alias("is_chunk"))
    return search.merge_channels([leg("erth", "lexical", 7, 1), leg("onder", "local", 11, 0)])


# scalars


@query("tokenize_counts", "SELECT doc_id AS id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_./:-]{3,}') AS t FROM documents)")
def _(s, d):
    t = T.tokens(F.col("text"))
    return chunks(s, d).select("id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("distinct_tokens"))


@query("normalize_text", "SELECT doc_id AS id, CASE WHEN length(w) > 200 THEN rtrim(substr(w, 1, 197)) || '...' ELSE w END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS w FROM documents)")
def _(s, d):
    return chunks(s, d).select("id", T.normalize_text(F.col("text"), 200).alias("preview"))


@query("content_hash", "SELECT doc_id AS id, sha256(lang || chr(10) || source || chr(10) || text) AS hash, substr(sha1(text), 1, 16) AS text_hash FROM documents")
def _(s, d):
    return chunks(s, d).select("id", T.stable_hash(F.col("source_name"), F.col("cwd"), F.col("text")).alias("hash"), T.text_hash(F.col("text")).alias("text_hash"))


@query("query_term_coverage", "SELECT doc_id AS id, len(list_intersect(['with', 'that', 'from'], regexp_extract_all(lower(text), '[a-z0-9_./:-]{3,}'))) AS matched FROM documents")
def _(s, d):
    want = F.array(*map(F.lit, ["with", "that", "from"]))
    return chunks(s, d).select("id", F.size(F.array_intersect(want, T.tokens(F.col("text")))).cast("long").alias("matched"))


@query("snippet_first_match", r"""WITH t AS (SELECT doc_id AS id, trim(regexp_replace(text, '[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t FROM documents),
p AS (SELECT id, t, greatest(1, strpos(lower(t), 'license') - 80) AS b FROM t WHERE contains(lower(t), 'license'))
SELECT id, CASE WHEN b > 1 THEN '...' ELSE '' END || trim(substr(t, b, 160)) || CASE WHEN b + 160 <= length(t) THEN '...' ELSE '' END AS snippet FROM p""")
def _(s, d):
    rows = chunks(s, d).where(F.contains(F.lower("text"), F.lit("license")))
    return rows.select("id", T.snippet(F.col("text"), "license").alias("snippet"))


@query("redact_secrets_count", r"""WITH r AS (SELECT doc_id AS id, 'key sk-ant-' || repeat('a', 20) || ' aws AKIA' || upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) || ' n ' || doc_id AS t FROM documents)
SELECT id, regexp_replace(regexp_replace(t, '\bsk-ant-[A-Za-z0-9_-]{16,}', '[redacted anthropic key]', 'g'), '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b', '[redacted aws key]', 'g') AS masked FROM r""")
def _(s, d):
    rows = chunks(s, d).select("id", F.concat(F.lit("key sk-ant-" + "a" * 20 + " aws AKIA"), F.upper(F.substring(F.md5(F.col("id").cast("string")), 1, 16)), F.lit(" n "), F.col("id").cast("string")).alias("t"))
    return rows.select("id", T.redact(F.col("t")).alias("masked"))


@query("json_extract_metadata", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("regexp_suite", r"SELECT doc_id AS id, regexp_matches(text, '(?is)licen[sc]ed? under') AS hit, CASE WHEN regexp_matches(text, '(?is)under the (\w+)') THEN regexp_extract(text, '(?is)under the (\w+)', 1) END AS name, len(regexp_extract_all(text, '(?is)under')) AS n FROM documents")
def _(s, d):
    c = F.col("text")
    return chunks(s, d).select("id", T.regexp(c, "licen[sc]ed? under").alias("hit"), T.regexp_extract(c, r"under the (\w+)", 1).alias("name"), T.regexp_count(c, "under").cast("long").alias("n"))


@query("recency_score", f"SELECT event_id, round(exp(-greatest(0, (epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400.0) / 30) * 30, 4) AS bonus FROM events")
def _(s, d):
    age = (F.lit(NOW).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400.0
    return table(s, d, "events").select("event_id", F.round(T.recency(age, False), 4).alias("bonus"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Texts of which some begin as injected ones do, every opening in turn.
OPENED = "SELECT conv_id, turn, CASE WHEN (conv_id * 7 + turn) % 2 = 0 THEN ([" + ", ".join(map(quoted, T.INJECTED)) + f"])[CAST((conv_id + turn) % {len(T.INJECTED)} AS INT) + 1] || ' ' || text ELSE text END AS text FROM conversations WHERE role = 'user'"


@query("user_text_filter", f"WITH o AS ({OPENED}) SELECT conv_id, turn FROM o WHERE length(trim(text)) >= 3 AND " + " AND ".join(f"NOT starts_with(trim(text), {quoted(p)})" for p in T.INJECTED))
def _(s, d):
    opening = F.element_at(F.array(*map(F.lit, T.INJECTED)), ((F.col("conv_id") + F.col("turn")) % len(T.INJECTED)).cast("int") + 1)
    text = F.when((F.col("conv_id") * 7 + F.col("turn")) % 2 == 0, F.concat(opening, F.lit(" "), "text")).otherwise(F.col("text"))
    return conversations(s, d).where("role = 'user'").withColumn("text", text).where(T.is_user_text(F.col("text"))).select("conv_id", "turn")


# catalogue


@query("project_breakdown", f"WITH {CHUNKS} SELECT source_name, cwd, count(DISTINCT session_id) AS sessions, count(DISTINCT CASE WHEN chunk_index > 4 THEN session_id END) AS human_sessions, count(*) AS chunks, max(updated_at) AS updated_at FROM chunks GROUP BY ALL ORDER BY sessions DESC, chunks DESC, source_name, cwd LIMIT 20")
def _(s, d):
    return catalog.project_breakdown(chunks(s, d), F.col("chunk_index") > 4)


@query("index_stats", f"WITH {CHUNKS} SELECT source_name, count(DISTINCT session_id) AS sessions, count(*) AS chunks, CAST(sum(CAST(id < 500 AS INT)) AS BIGINT) AS embedded, CAST(count(*) - sum(CAST(id < 500 AS INT)) AS BIGINT) AS missing FROM chunks GROUP BY GROUPING SETS ((source_name), ())")
def _(s, d):
    return catalog.index_stats(chunks(s, d), F.col("id") < 500)


@query("sync_status", f"WITH {CHUNKS} SELECT source_name, count(*) AS records, max(updated_at) AS imported_at, arg_max(sha256(text), (updated_at, id)) AS newest_hash FROM chunks GROUP BY source_name")
def _(s, d):
    return catalog.sync_status(chunks(s, d).withColumn("imported_at", F.col("updated_at")).withColumn("content_hash", F.sha2("text", 256)))


@query("clusters", "SELECT json_extract_string(props, '$.k') AS cluster, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def _(s, d):
    return catalog.clusters(table(s, d, "events").withColumnRenamed("user_id", "session_id"), "props", "$.k")


@query("footprint_sample", "SELECT (SELECT count(*) FROM documents) AS rows, round(avg(n), 4) AS mean_chars, round((SELECT count(*) FROM documents) * avg(n), 2) AS chars FROM (SELECT length(text) AS n FROM documents ORDER BY doc_id DESC LIMIT 300)")
def _(s, d):
    return catalog.footprint(chunks(s, d))


@query("monthly_enumeration", f"WITH {CHUNKS} SELECT substr(updated_at, 1, 7) AS month, count(DISTINCT session_id) AS sessions FROM chunks WHERE regexp_matches(text, '(?is)licen[sc]e') GROUP BY 1")
def _(s, d):
    return catalog.monthly(chunks(s, d), "licen[sc]e")


@query("session_rollup", f"WITH {CHUNKS} SELECT source_ref, count(*) AS chunks, max(updated_at) AS updated_at, arg_max(title, (updated_at, id)) AS title FROM chunks GROUP BY source_ref")
def _(s, d):
    return catalog.session_rollup(chunks(s, d))


@query("grown_sessions", f"WITH {CHUNKS} SELECT source_ref, count(*) AS chunks FROM chunks GROUP BY source_ref HAVING count(*) >= 3 + 2")
def _(s, d):
    c = chunks(s, d)
    return catalog.grown_sessions(c, c.select("source_ref").distinct().withColumn("seen", F.lit(3)), 2).select("source_ref", "chunks")


@query("conversation_threads", "SELECT CAST(conv_id AS VARCHAR) AS thread, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user, arg_max(text, turn) AS last_text, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def _(s, d):
    return catalog.threads(conversations(s, d))


@query("person_registry", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (WHERE event_type = 'click') AS chats, count(*) FILTER (WHERE event_type <> 'click') AS observed, string_agg(event_type, ',' ORDER BY r) FILTER (WHERE r <= 10) AS topics FROM r GROUP BY user_id""")
def _(s, d):
    return catalog.person_registry(table(s, d, "events"))


@query("workdir_frequency", "SELECT source AS cwd, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    return catalog.frequencies(chunks(s, d), "cwd")


@query("tool_counts", "SELECT n_name AS source_name, count(customer.c_custkey) AS sessions FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
def _(s, d):
    nation = table(s, d, "nation")
    rich = table(s, d, "customer").where("c_acctbal > 9000").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source_name"))
    return catalog.tool_counts(rich, nation.select(F.col("n_name").alias("source_name")))


@query("budget_totals", "SELECT event_type AS tool, count(*) FILTER (WHERE user_id % 5 <> 0) AS calls, round(sum(value) FILTER (WHERE user_id % 5 <> 0), 4) AS seconds, count(*) FILTER (WHERE user_id % 5 = 0) AS extensions FROM events GROUP BY 1")
def _(s, d):
    return catalog.budget_totals(table(s, d, "events").withColumnRenamed("event_type", "tool"), "tool", "value", F.col("user_id") % 5 == 0)


@query("freshness", "SELECT l_returnflag AS source_name, max(l_shipdate) AS newest_file, max(l_shipdate) FILTER (WHERE l_linenumber = 1) AS indexed_at, max(l_shipdate) > max(l_shipdate) FILTER (WHERE l_linenumber = 1) AS stale FROM lineitem GROUP BY 1")
def _(s, d):
    rows = table(s, d, "lineitem").withColumnRenamed("l_returnflag", "source_name")
    return catalog.freshness(rows.withColumn("mtime", F.col("l_shipdate")), rows.where("l_linenumber = 1").withColumn("indexed_at", F.col("l_shipdate")))


@query("repeats_filter", "SELECT doc_id AS id FROM (SELECT doc_id, count(*) OVER (PARTITION BY substr(text, 1, 200)) AS n FROM documents) WHERE n <= 2")
def _(s, d):
    return catalog.repeats_dropped(chunks(s, d), "text").select("id")


@query("owner_voice_window", f"""WITH said AS (SELECT event_id, ts, CASE event_id % 7 WHEN 0 THEN ' Go ahead! ' WHEN 1 THEN '/clear' WHEN 2 THEN '/ask ' || event_type WHEN 3 THEN 'Continue from where we were' WHEN 4 THEN 'you are a test Agent, ' || event_type WHEN 5 THEN 'ok' ELSE 'look at ' || event_type END AS text FROM events)
SELECT event_id FROM said WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 96 HOUR AND ts <= TIMESTAMP '{NOW}' AND event_id % 7 IN (2, 6)""")
def _(s, d):
    k = F.col("event_id") % 7
    told = F.when(k == 0, " Go ahead! ").when(k == 1, "/clear").when(k == 2, F.concat(F.lit("/ask "), "event_type")).when(k == 3, "Continue from where we were").when(k == 4, F.concat(F.lit("you are a test Agent, "), "event_type")).when(k == 5, "ok").otherwise(F.concat(F.lit("look at "), "event_type"))
    rows = windows.trailing(table(s, d, "events"), "event_id", "ts", NOW, 96).withColumn("text", told)
    return rows.where(M.owner_voice(F.col("text"))).select("event_id")


# windows


@query("session_cap", "SELECT doc_id AS id FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY lang, doc_id // 10 ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 2 ORDER BY n_chars DESC, doc_id LIMIT 500")
def _(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), F.concat("lang", F.lit(":"), F.floor(F.col("doc_id") / 10).cast("string")).alias("source_ref"))
    return search.capped(rows, 2, 500).select("id")


@query("recent_older_slices", f"WITH {SESSIONS}, r AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS no FROM sessions) SELECT id, CASE WHEN no <= 8 THEN 'recent' ELSE 'older' END AS slice FROM r WHERE no <= 40")
def _(s, d):
    return windows.recency_slices(sessions(s, d).select("id", "updated_at"), [F.desc("updated_at"), F.col("id")]).select("id", "slice")


@query("equal_split_chunks", "SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / ceil(count(*) OVER (PARTITION BY conv_id) / 4)) AS INT) AS part FROM conversations")
def _(s, d):
    return windows.equal_split(conversations(s, d), "conv_id", "turn").select("conv_id", "turn", "part")


@query("event_window", "SELECT conv_id, turn, sha256(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), '|')) AS near FROM conversations")
def _(s, d):
    rows = windows.event_window(conversations(s, d), "conv_id", "turn", 1, 2, "text")
    return rows.select("conv_id", "turn", F.sha2(F.array_join("near", "|"), 256).alias("near"))


@query("last_user_turn", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations")
def _(s, d):
    return windows.with_last_user_turn(conversations(s, d), "conv_id", "turn").select("conv_id", "turn", "asked")


@query("adjacent_dedupe", """WITH said AS (SELECT conv_id, turn * 2 + k AS turn, role, text FROM conversations, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR length(text) % 3 = 0)
SELECT conv_id, turn FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS t, row_number() OVER w AS n FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n = 1 OR r IS DISTINCT FROM role OR t IS DISTINCT FROM text""")
def _(s, d):
    rows = conversations(s, d).select("conv_id", "role", "text", F.explode(F.when(F.length("text") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"), F.col("turn").alias("t"))
    rows = rows.select("conv_id", (F.col("t") * 2 + F.col("k")).alias("turn"), "role", "text")
    return windows.adjacent_dropped(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn")


@query("budget_window", "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE used <= 1500 OR r = 1")
def _(s, d):
    return windows.in_budget(conversations(s, d), "conv_id", "turn", "text", 1500).select("conv_id", "turn")


def query_tokens_sql(c: str) -> str:
    """The tokens of a query with their light stems, without stop words, as a list."""
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    forms = """[w, CASE WHEN length(w) > 5 AND suffix(w, 'ing') THEN CASE WHEN suffix(w, 'ining') THEN left(w, length(w) - 3) || 'e' ELSE left(w, length(w) - 3) END END,
      CASE WHEN length(w) > 4 AND suffix(w, 's') THEN left(w, length(w) - 1) END]"""
    words = f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9_./:-]{{3,}}'), lambda w: w NOT IN ({stop}))"
    return f"list_distinct(list_filter(flatten(list_transform({words}, lambda w: {forms})), lambda x: x IS NOT NULL AND x NOT IN ({stop})))"


@query("idle_sessionize", f"""WITH s AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'give me more of ' || event_type || ' numbers' WHEN 1 THEN event_type WHEN 2 THEN 'please begin something new ' || event_id WHEN 3 THEN 'compare ' || event_type || ' across regions and quarters' ELSE 'run this ' || event_type || ' again with other settings' END AS text FROM events),
b AS (SELECT *, lag(text) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s), t AS (SELECT *, {query_tokens_sql('text')} AS own, {query_tokens_sql('before')} AS old FROM b),
g AS (SELECT *, regexp_matches(lower(text), '\\b(more|updates?|up to date|up-to-date|latest|still|again|so far|by now|any (?:news|update|change)|anything else|recap|remind|that one|those|these|it)\\b') OR len(own) <= 2
  OR coalesce(len(list_intersect(list_filter(own, lambda x: length(x) >= 5), list_filter(old, lambda x: length(x) >= 5))) > 0, false) AS follows,
  epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM t)
SELECT event_id, user_id, CAST(sum(CASE WHEN since IS NULL OR since > CASE WHEN NOT follows THEN 900 ELSE 21600 END * CAST(1000000 AS BIGINT) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g""")
def _(s, d):
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(F.lit("give me more of "), "event_type", F.lit(" numbers"))).when(k == 1, F.col("event_type")).when(k == 2, F.concat(F.lit("please begin something new "), F.col("event_id").cast("string"))).when(k == 3, F.concat(F.lit("compare "), "event_type", F.lit(" across regions and quarters"))).otherwise(F.concat(F.lit("run this "), "event_type", F.lit(" again with other settings")))
    rows = table(s, d, "events").withColumn("text", text)
    rows = rows.withColumn("before", F.lag("text").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    gap = F.when(M.looks_like_followup(F.col("text"), F.col("before")), 21600).otherwise(900)
    return windows.idle_sessions(rows, "user_id", "ts", gap).select("event_id", "user_id", "session_no")


@query("rolling_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def _(s, d):
    return windows.rolling_count(table(s, d, "events"), "user_id", "ts", 3600).select("event_id", "n")


@query("debounce_groups", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS began, count(*) AS messages FROM n GROUP BY user_id, k""")
def _(s, d):
    return windows.debounced(table(s, d, "events"), "user_id", "ts", "30 minutes").select("user_id", F.unix_micros("began").alias("began"), "messages")


@query("rate_limiter_feedback", """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run AS (SELECT event_id, user_id, n, true AS allowed, [t] AS seen FROM e WHERE n = 1
UNION ALL SELECT e.event_id, e.user_id, e.n, len(list_filter(r.seen, lambda x: e.t - x < 3600000000)) < 2,
  CASE WHEN len(list_filter(r.seen, lambda x: e.t - x < 3600000000)) < 2 THEN list_append(list_filter(r.seen, lambda x: e.t - x < 3600000000), e.t) ELSE list_filter(r.seen, lambda x: e.t - x < 3600000000) END
  FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT event_id, user_id, allowed FROM run""")
def _(s, d):
    return windows.rate_limited(table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 2, 3600).select("event_id", "user_id", "allowed")


@query("nearest_in_time_match", """WITH p AS (SELECT v.event_id AS id, b.event_id AS match_id, abs(epoch_us(v.ts) - epoch_us(b.ts)) AS gap FROM events v JOIN events b ON v.user_id = b.user_id AND v.event_type = 'view' AND b.event_type = 'purchase' WHERE abs(epoch_us(v.ts) - epoch_us(b.ts)) <= 43200000000)
SELECT id, match_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, match_id) AS r FROM p) WHERE r = 1""")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts", "event_type")
    return windows.nearest_in_time(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", 43_200).select("id", "match_id", "gap")


@query("mention_bonus", "SELECT conv_id, turn, CAST(greatest(0, 300 - 20 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1)) AS INT) AS bonus FROM conversations")
def _(s, d):
    return windows.mentions(conversations(s, d), "conv_id", "turn").select("conv_id", "turn", F.col("bonus").cast("int").alias("bonus"))


# stores and joins


@query("refresh_diff", "WITH o AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 10 <> 7) SELECT coalesce(o.doc_id, n.doc_id) AS id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.n_chars = n.n_chars THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def _(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return store.diff(rows.where("id % 10 <> 3"), rows.where("id % 10 <> 7").withColumn("n_chars", F.col("n_chars") + F.when(F.col("id") % 10 == 5, 1).otherwise(0)), "id", "n_chars")


@query("import_merge_counts", "WITH x AS (SELECT doc_id % 10 AS m FROM documents) SELECT CASE WHEN m = 3 THEN 'inserted' WHEN m = 7 THEN 'kept' WHEN m = 5 THEN 'updated' ELSE 'unchanged' END AS outcome, count(*) AS n FROM x GROUP BY 1")
def _(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("string").alias("hash"))
    return store.merge_counts(rows.where("id % 10 <> 3"), rows.where("id % 10 <> 7").withColumn("hash", F.when(F.col("id") % 10 == 5, "x").otherwise(F.col("hash"))), "id", "hash")


@query("new_projects_diff", "WITH k AS (SELECT DISTINCT source AS p FROM documents WHERE doc_id % 2 = 0), c AS (SELECT DISTINCT source AS p FROM documents WHERE doc_id % 3 = 0) SELECT coalesce(k.p, c.p) AS project, CASE WHEN k.p IS NULL THEN 'pending' WHEN c.p IS NULL THEN 'dropped' ELSE 'known' END AS state FROM k FULL JOIN c ON k.p = c.p")
def _(s, d):
    rows = table(s, d, "documents").withColumnRenamed("source", "project")
    return store.new_projects(rows.where("doc_id % 2 = 0").select("project").distinct(), rows.where("doc_id % 3 = 0").select("project").distinct())


@query("typed_semi_decided_anti", "SELECT doc_id AS source_ref FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND NOT EXISTS (SELECT 1 FROM benchmark WHERE item_id = d.doc_id)")
def _(s, d):
    labels = table(s, d, "labels").withColumnRenamed("doc_id", "source_ref")
    rows = table(s, d, "documents").select(F.col("doc_id").alias("source_ref"))
    return policy.review_candidates(rows, labels.where("quality = 1"), labels.where("toxic = 1"), table(s, d, "benchmark").select(F.col("item_id").alias("source_ref")))


@query("prefix_range_lookup", f"WITH {CHUNKS} SELECT id, source_ref FROM chunks WHERE id % 10 = 1 AND source_ref >= 'en:s1' AND source_ref < 'en:s2' ORDER BY updated_at DESC, source_ref LIMIT 1")
def _(s, d):
    rows = chunks(s, d).where("id % 10 = 1").select("id", "source_ref", "updated_at")
    return store.prefix_lookup(rows, "source_ref", "en:s1", "updated_at").select("id", "source_ref")


@query("purge_disallowed", "SELECT doc_id AS id FROM documents WHERE source NOT IN ('src1', 'src2')")
def _(s, d):
    rows = chunks(s, d)
    return store.deleted(rows, rows.where(F.col("cwd").isin("src1", "src2")).select("cwd"), "cwd").select("id")


@query("merge_upsert", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 4 = 0")
def _(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return store.merged(rows.where("id % 5 <> 0"), rows.where("id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1), "id")


@query("feed_trim", "SELECT 'many' AS feed, event_id AS seq FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 400) UNION ALL SELECT 'few', n_nationkey FROM nation")
def _(s, d):
    rows = table(s, d, "events").select(F.col("event_id").alias("seq"))
    few = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq"))  # under the limit: all stay
    many = store.trimmed_feed(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))
    return many.select(F.lit("many").alias("feed"), "seq").unionByName(store.trimmed_feed(few.where("seq < 9"), few.where("seq >= 9")).select(F.lit("few").alias("feed"), "seq"))


@query("push_batches", "SELECT doc_id AS id, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 50 AS INT) AS batch FROM documents")
def _(s, d):
    return store.batched(chunks(s, d), "source_name", "id").select("id", "batch")


@query("retitle_corrections", f"WITH {CHUNKS} SELECT id, CASE WHEN id % 6 = 0 THEN 'fixed ' || id ELSE title END AS title FROM chunks")
def _(s, d):
    rows = chunks(s, d).select("id", "title")
    return store.corrected(rows, rows.where("id % 6 = 0").select("id", F.concat(F.lit("fixed "), F.col("id").cast("string")).alias("title")), "id", "title")


# policy


@query("row_visibility", f"""WITH {CHUNKS} SELECT c.id, '' AS title FROM chunks c LEFT JOIN (SELECT 'src' || n_nationkey AS project, CASE WHEN n_regionkey < 3 THEN 'share' ELSE 'hide' END AS level FROM nation) p ON c.cwd = p.project
LEFT JOIN labels l ON l.doc_id = c.id WHERE NOT (coalesce(l.toxic, 0) = 1 OR (l.quality IS NOT NULL AND l.quality = 0) OR (l.quality IS NULL AND coalesce(p.level <> 'share', true)))""")
def _(s, d):
    rows = chunks(s, d).drop("source_ref").withColumn("source_ref", F.col("id")).withColumn("project", F.col("cwd")).withColumn("catch_all", F.lit(False))
    labels = table(s, d, "labels").withColumnRenamed("doc_id", "source_ref")
    levels = table(s, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("project"), F.when(F.col("n_regionkey") < 3, "share").otherwise("hide").alias("level"))
    decided = labels.select("source_ref", F.when(F.col("quality") == 1, "share").otherwise("hide").alias("level"))
    return policy.visible(policy.hidden_from_team(rows, labels.where("toxic = 1"), decided, levels), owner=False).select("id", "title")


@query("origin_classify", r"""WITH s AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'origin=batch x' END AS marker, conv_id % 7 = 0 AS side, CASE WHEN conv_id % 5 = 0 THEN '/home/a/.agent-worktrees/x' ELSE '/home/a' END AS cwd,
  CASE WHEN conv_id % 3 = 0 THEN 'sdk' ELSE 'cli' END AS entry, count(*) FILTER (WHERE role = 'user') AS human FROM conversations GROUP BY conv_id),
d AS (SELECT conv_id, CASE WHEN marker IS NOT NULL THEN 'batch' WHEN side THEN 'subagent' WHEN regexp_matches(cwd, '(?i)/\.[^/]*worktrees?/') THEN 'orchestrated' WHEN entry = 'sdk' THEN 'sdk' WHEN human = 0 THEN 'no-user-turns' ELSE '' END AS detail FROM s)
SELECT conv_id, CASE WHEN detail = '' THEN 'interactive' ELSE 'automated' END AS origin, detail FROM d""")
def _(s, d):
    c = F.col("conv_id")
    rows = conversations(s, d).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("human"))
    o = policy.origin(F.when(c % 11 == 0, "origin=batch x"), c % 7 == 0, F.when(c % 5 == 0, "/home/a/.agent-worktrees/x").otherwise("/home/a"), F.array(F.when(c % 3 == 0, "sdk").otherwise("cli")), F.col("human"))
    return rows.select("conv_id", o.alias("o")).select("conv_id", "o.origin", "o.detail")


@query("workdir_policy", "SELECT doc_id AS id FROM documents WHERE (source = 'src1' OR contains(source, '5')) AND NOT contains(source, '15')")
def _(s, d):
    rules = lambda *r: F.array(*map(F.lit, r))
    fit = policy.allowed(F.concat(F.lit("/"), F.col("cwd")), F.lit("whitelist"), rules("/src1", "5"), rules("15"))
    return chunks(s, d).where(fit).select("id")


# sessions cut into chunks


@query("chunk_conversations")
def _(s, d):
    rows = conversations(s, d).withColumn("source_ref", F.concat(F.lit("conv:"), F.col("conv_id").cast("string")))
    head = rows.groupBy("source_ref").agg(F.lit("conv").alias("source_name"), F.min_by(F.substring("text", 1, 60), "turn").alias("title"), F.lit("").alias("cwd"), F.lit("2024-01-01").alias("updated_at"))
    turns = rows.select("source_ref", F.col("turn").cast("int").alias("event_index"), "role", F.lit("").alias("ts"), "text")
    return chunking.chunk_sessions(head, turns)


def queries() -> dict:
    from . import fulltexts, more, upkeep  # noqa: F401  register their own

    return dict(Q)


def oracle_sql() -> dict:
    queries()
    return dict(O)
