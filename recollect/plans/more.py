"""Registered queries on sharing, results, statistics, stateful rules and maintenance, with their DuckDB statements.

The stand-ins are those of the catalogue; a user of events is a person, a channel or a tool.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import messages as M
from ..functions import text as T
from ..operators import catalog, lexical, policy, results, search, sharing, store, windows
from .catalogue import CHUNKS, NOW, SESSIONS, bm25_sql, chunks, conversations, postings, query, sessions, table

WS = r"'[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def squeezed(column: str, limit: int) -> str:
    """normalize_text in DuckDB."""
    w = f"trim(regexp_replace({column}, {WS}, ' ', 'g'))"
    return f"CASE WHEN length({w}) > {limit} THEN rtrim(substr({w}, 1, {limit - 3})) || '...' ELSE {w} END"


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


# windows of time and visibility


@query("eligible_window", f"WITH {CHUNKS} SELECT id FROM chunks WHERE lower(source_name) = 'en' AND updated_at >= '2024-03' AND updated_at <= '2024-06-10~'")
def _(s, d):
    return search.in_window(chunks(s, d), "2024-03", "2024-06-10", "EN").select("id")


STAMPED = "prompts AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text, CASE WHEN conv_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS source_name, printf('2024-01-%02dT%02d:59:59', conv_id % 28 + 1, turn % 24) AS ts FROM conversations WHERE role = 'user')"


def prompts(s, d):
    rows = conversations(s, d).where("role = 'user'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text", F.when(F.col("conv_id") % 2 == 0, "codex").otherwise("claude").alias("source_name"), F.format_string("2024-01-%02dT%02d:59:59", (F.col("conv_id") % 28 + 1).cast("int"), (F.col("turn") % 24).cast("int")).alias("ts"))


@query("prompt_range", f"WITH {STAMPED} SELECT id FROM prompts WHERE ts >= '2024-01-03' AND ts <= '2024-01-09T23:59:59' AND source_name = 'codex'")
def _(s, d):
    return catalog.prompts_between(prompts(s, d), "2024-01-03", "2024-01-09", "codex").select("id")


@query("policy_exclusions", """SELECT conv_id, (conv_id % 3 = 0) AS entry, (conv_id % 10 = 4 OR conv_id % 10 = 5) AS session, (conv_id % 2 = 0 AND conv_id % 5 IN (1, 2)) AS origin FROM (SELECT DISTINCT conv_id FROM conversations)""")
def _(s, d):
    c = F.col("conv_id")
    rows = conversations(s, d).select("conv_id").distinct()
    entry = sharing.entrypoint_blocked(F.array(F.lit("cli"), F.when(c % 3 == 0, "SDK-Cli").otherwise("vscode")), strings(" sdk-cli ", ""))
    own = F.when(c % 10 == 4, "Claude:ABC").when(c % 10 == 5, " xyz ").otherwise(F.concat(F.lit("claude:"), c.cast("string")))
    origin = sharing.origin_excluded(F.when(c % 2 == 0, "automated").otherwise("interactive"), F.concat(F.lit(" D"), (c % 5).cast("string")), strings("d1", "D2"), F.lit(False))
    return rows.select("conv_id", entry.alias("entry"), sharing.session_blocked([own, F.lit(None).cast("string")], strings("abc", "XYZ")).alias("session"), origin.alias("origin"))


@query("private_workdirs", "SELECT doc_id AS id, source IN ('src1', 'src3') OR doc_id % 9 = 0 AS private FROM documents")
def _(s, d):
    cwd = F.concat(F.lit(" /w/"), "cwd", F.lit("/"))
    return chunks(s, d).select("id", sharing.workdir_private(cwd, F.when(F.col("id") % 9 == 0, strings("no_project")).otherwise(strings("project")), strings("/w/src1", "/w/src3/", "/w"), strings("No_Project")).alias("private"))


def policies(s):
    none: list = []
    rows = [
        ("en", "default", "blacklist", none, ["/w/src1", "5"], none, none, none, none, ["s3"], none, none, False),
        ("en", "work", "whitelist", ["/w/src2"], none, none, none, none, none, none, none, none, False),
        ("fr", "default", "whitelist", ["src"], ["/w/src2"], none, none, none, none, none, none, none, False),
    ]
    return s.createDataFrame(rows, sharing.POLICY)


#: default lets all folders in but src1 and those with a 5, and no session s3; work has src2 alone; fr all but src2.
ALLOWED = "(lang = 'en' AND CASE WHEN doc_id % 3 = 0 THEN source = 'src2' ELSE source <> 'src1' AND NOT contains(source, '5') AND doc_id // 10 <> 3 END) OR (lang = 'fr' AND source <> 'src2')"


@query("visible_to_accounts", f"SELECT doc_id AS id FROM documents WHERE {ALLOWED} OR doc_id % 17 = 0")
def _(s, d):
    rows = chunks(s, d).select(
        "id", "source_name", F.when(F.col("id") % 17 == 0, "manual").otherwise("trajectory").alias("source_type"), F.when(F.col("id") % 3 == 0, "work").alias("account"),
        F.concat(F.lit("/w/"), "cwd").alias("cwd"), "session_id", F.concat("source_name", F.lit(":"), "session_id").alias("source_ref"))
    return sharing.visible_to_accounts(rows, policies(s), strings("project")).select("id")


@query("purge_to_policy", """WITH own AS (SELECT lang, doc_id // 10 AS session, max(source) AS source FROM documents GROUP BY ALL)
SELECT doc_id AS id FROM documents JOIN own USING (lang) WHERE own.session = doc_id // 10 AND ((lang = 'en' AND (own.source NOT IN ('src1', 'src7') AND NOT contains(own.source, '5') AND own.session <> 3 AND own.session <> 4)) OR (lang = 'fr' AND own.source NOT IN ('src2', 'src7')))""")
def _(s, d):
    rules = sharing.scope_changed(policies(s).where("account = 'default'"), "exclude", "en", "session", "en:s4")
    for source in ("en", "fr"):
        rules = sharing.scope_changed(rules, "exclude", source, "workdir", "/w/src7")
    rules = sharing.scope_changed(sharing.scope_changed(rules, "exclude", "fr", "workdir", "/w/src8"), "unexclude", "fr", "workdir", "/W/SRC8")
    rows = chunks(s, d).withColumn("cwd", F.concat(F.lit("/w/"), "cwd"))
    return sharing.purged_to_policy(rows, rules, strings("project")).select("id")


FOLDERS = ["/home/a", "/home/a/Code", "/home/a/code/x", "/tmp/z", "/home/a/.claude/p", "", "/home/ab", "/srv/work", "/home/a/Documents/Codex/1", "/home/a/Downloads/"]


@query("catch_all_folders", "SELECT doc_id AS id, doc_id % 10 IN (0, 1, 3, 4, 5, 9) AS catch_all FROM documents")
def _(s, d):
    cwd = F.element_at(strings(*FOLDERS), (F.col("id") % 10).cast("int") + 1)
    return chunks(s, d).select("id", sharing.catch_all(cwd, "/home/a").alias("catch_all"))


@query("gui_chats", """SELECT conv_id, conv_id % 2 = 0 AND (conv_id % 10 = 8 OR (conv_id % 10 IN (0, 1, 3, 4, 5, 9) AND (conv_id % 3 = 0 OR conv_id % 3 = 2))) AS gui FROM (SELECT DISTINCT conv_id FROM conversations)""")
def _(s, d):
    c = F.col("conv_id")
    ids = conversations(s, d).select("conv_id").distinct()
    rows = ids.select("conv_id", F.when(c % 2 == 0, "Codex ").otherwise("claude").alias("source_name"), F.concat(F.lit("codex:S"), c.cast("string"), F.lit("#2")).alias("session_id"), F.element_at(strings(*FOLDERS), (c % 10).cast("int") + 1).alias("cwd"))
    known = ids.where(c % 3 != 2).select(F.concat(F.lit("s"), c.cast("string")).alias("session_id"), F.when(c % 3 == 0, "Codex Desktop").otherwise("codex-tui").alias("originator"), F.lit("").alias("source"))
    return sharing.gui_chats(rows, known, "/home/a", "/home/a/Documents/Codex").select("conv_id", "gui")


@query("purge_by_origin", "SELECT doc_id AS id FROM documents WHERE (lang, doc_id // 10) NOT IN (SELECT DISTINCT lang, doc_id // 10 FROM documents WHERE doc_id % 30 = 7 AND lang = 'en' OR doc_id % 40 = 3)")
def _(s, d):
    meta = F.to_json(F.struct(F.when(F.col("id") % 30 == 7, "automated").otherwise("interactive").alias("origin"), F.when(F.col("id") % 40 == 3, "sdk").alias("origin_detail")))
    rows = chunks(s, d).withColumn("metadata_json", meta)
    return sharing.purged_by_detail(sharing.purged_by_origin(rows, "automated", ["en"]), "sdk").select("id")


SUGGESTED = """s AS (SELECT doc_id AS source_ref, CASE doc_id % 4 WHEN 0 THEN 'ask' WHEN 1 THEN 'team' WHEN 2 THEN 'owner' ELSE 'team' END AS level, CASE WHEN doc_id % 5 = 0 THEN 'why ' || doc_id ELSE '' END AS question,
 CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'none' END AS confidence, doc_id % 6 = 0 AS hop, n_chars AS chunks FROM documents)"""


def suggested(s, d):
    k = F.col("doc_id")
    return table(s, d, "documents").select(
        k.alias("source_ref"), F.when(k % 4 == 0, "ask").when(k % 4 == 2, "owner").otherwise("team").alias("level"), F.when(k % 5 == 0, F.concat(F.lit("why "), k.cast("string"))).otherwise("").alias("question"),
        F.lit("so").alias("reason"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "low").otherwise("none").alias("confidence"), (k % 6 == 0).alias("hop"), F.col("n_chars").alias("chunks"))


def answered(s, d):
    rows = table(s, d, "labels").where("quality is not null")
    return rows.select(F.col("doc_id").alias("source_ref"), F.when(F.col("quality") == 1, "owner").otherwise("reviewer").alias("by"), F.when(F.col("doc_id") % 2 == 0, "team").otherwise("exclude").alias("level"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("decided_at"))


def numbered(rows):
    """Rows in their order; the number stands for it."""
    return rows.limit(200).select("source_ref")


@query("review_queue", f"""WITH {SUGGESTED}, q AS (SELECT * FROM s WHERE (level = 'ask' OR question <> '') AND source_ref NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND source_ref NOT IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT source_ref FROM q ORDER BY level <> 'ask', NOT hop, chunks DESC, source_ref LIMIT 200""")
def _(s, d):
    private = table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_ref"))
    return numbered(sharing.to_decide(suggested(s, d), private, answered(s, d)))


@query("recommended_queue", f"""WITH {SUGGESTED}, q AS (SELECT * FROM s WHERE level = 'team' AND question = '' AND source_ref NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND source_ref NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL))
SELECT source_ref FROM q ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, NOT hop, chunks DESC, source_ref LIMIT 200""")
def _(s, d):
    private = table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_ref"))
    return numbered(sharing.recommended(suggested(s, d), private, answered(s, d)))


@query("sessions_to_review", f"""WITH {SUGGESTED}, seen AS (SELECT doc_id AS source_ref, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 40 END AS old, CASE WHEN quality = 1 THEN 'team' ELSE 'owner' END AS lv, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'n' END AS name FROM labels)
SELECT source_ref FROM (SELECT s.source_ref, s.chunks % 101 AS chunks, s.hop FROM s LEFT JOIN seen USING (source_ref) WHERE old IS NULL OR s.chunks % 101 >= 2 * greatest(old, 25) OR (lv = 'team' AND name = '')) ORDER BY NOT hop, chunks DESC, source_ref LIMIT 200""")
def _(s, d):
    rows = suggested(s, d).select("source_ref", (F.col("chunks") % 101).alias("chunks"), F.col("hop").alias("hosted"), F.lit("").alias("last"))
    k = F.col("doc_id")
    seen = table(s, d, "labels").select(k.alias("source_ref"), F.when(k % 3 == 0, 5).otherwise(40).alias("chunks"), F.when(F.col("quality") == 1, "team").otherwise("owner").alias("level"), F.when(k % 7 == 0, "").otherwise("n").alias("name"))
    return numbered(sharing.to_review(rows, seen))


@query("preference_examples", f"""WITH {SUGGESTED}, o AS (SELECT doc_id AS source_ref, CASE WHEN doc_id % 2 = 0 THEN 'team' ELSE 'exclude' END AS chosen, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS made FROM labels WHERE quality = 1),
r AS (SELECT o.*, s.level, question, coalesce(level = 'ask' OR question <> '', false) AS asked, coalesce(level IN ('team', 'owner') AND level <> chosen, false) AS "over" FROM o LEFT JOIN s USING (source_ref)),
t AS (SELECT *, row_number() OVER (ORDER BY NOT asked, NOT "over", made DESC, source_ref) AS no FROM r)
SELECT CAST(no AS INT) AS no, source_ref, CASE WHEN coalesce(question, '') <> '' THEN question WHEN level IS NULL THEN '' ELSE 'so' END AS said, CASE chosen WHEN 'team' THEN 'to share' ELSE 'to exclude it from the index' END AS chose FROM t WHERE no <= 30""")
def _(s, d):
    return sharing.preference_examples(suggested(s, d), answered(s, d))


@query("channel_members", "SELECT CAST(user_id AS VARCHAR) AS author_id, 'u' || (max(event_id) % 3) AS name, user_id % 4 = 0 AS is_bot FROM events GROUP BY user_id")
def _(s, d):
    k = F.col("user_id")
    feed = table(s, d, "events").select(k.cast("string").alias("author_id"), F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string")).alias("author_name"), F.col("event_id").alias("seq"), (k % 4 == 0).alias("is_bot"), "ts")
    return sharing.members(feed, "7").select("author_id", "name", "is_bot")


# results


TOP = f"WITH {CHUNKS}, {bm25_sql(['erth', 'ouv'], True, 'chunks', 'id')}, top AS (SELECT c.*, round(bm25, 4) AS score, row_number() OVER (ORDER BY round(bm25, 4) DESC, c.id) AS no FROM scored s JOIN chunks c ON s.id = c.id QUALIFY no <= 10)"


def top(s, d):
    """The ten best chunks of a search, numbered in order."""
    best = lexical.bm25(postings(s, d), ["erth", "ouv"], prefix=True)
    no = F.row_number().over(W.orderBy(F.desc("score"), "id"))
    return chunks(s, d).join(F.broadcast(best), "id").withColumn("no", no)


@query("result_payload", f"{TOP} SELECT source_ref, title, round(score, 4) AS score, {squeezed('text', 500)} AS text_preview, {squeezed('text', 240)} AS summary_short, CAST(id AS VARCHAR) AS chunk_id, CAST(chunk_index AS VARCHAR) AS chunk_index, 'x' || id AS account FROM top")
def _(s, d):
    meta = F.to_json(F.struct(F.concat(F.lit("x"), F.col("id").cast("string")).alias("account"), F.lit("old").alias("chunk_id")))
    rows = results.payload(top(s, d).withColumn("metadata_json", meta), "exact")
    return rows.select("source_ref", "title", "score", "text_preview", "summary_short", F.col("metadata.chunk_id").alias("chunk_id"), F.col("metadata.chunk_index").alias("chunk_index"), F.col("metadata.account").alias("account"))


@query("compact_result", f"{TOP} SELECT source_ref, nullif(title, '') AS title, score, ['chunk_id', 'chunk_index'] AS kept, CASE WHEN id % 2 = 0 THEN [{squeezed('text', 700)}, 'b', 'c'] END AS snippets FROM top")
def _(s, d):
    rows = results.payload(top(s, d).withColumn("metadata_json", F.lit('{"account": "x", "origin": ""}')).withColumn("odd", F.col("id") % 2 == 1), "exact")
    more = F.when(F.col("metadata.chunk_id").cast("long") % 2 == 0, F.array("text_full", F.lit("b"), F.lit("c"), F.lit("d")))
    texts = chunks(s, d).select(F.col("id").cast("string").alias("of_id"), F.col("text").alias("text_full"))
    rows = rows.join(texts, F.col("metadata.chunk_id") == F.col("of_id")).withColumn("snippets", more)
    return results.compact(rows).select("source_ref", "title", "score", F.array_sort(F.map_keys("metadata")).alias("kept"), "snippets")


@query("snippet_candidates", r"""WITH t AS (SELECT doc_id AS id, text, string_split(lower(text), 'license') AS p FROM documents WHERE contains(lower(text), 'license')),
a AS (SELECT id, text, k, length(array_to_string(p[1:k], 'license')) + 1 AS pos FROM t, unnest(range(1, least(len(p) - 1, 3) + 1)) AS u(k)),
c AS (SELECT *, greatest(1, pos - 50) AS b, least(length(text), pos + 6 + 50) AS z FROM a)
SELECT id, list(CASE WHEN b > 1 THEN '...' ELSE '' END || regexp_replace(regexp_replace(substr(text, b, z - b + 1), '^[ \t\n\r\f\x0b]+', ''), '[ \t\n\r\f\x0b]+$', '') || CASE WHEN z < length(text) THEN '...' ELSE '' END ORDER BY k) AS found FROM c GROUP BY id""")
def _(s, d):
    rows = chunks(s, d).where(F.contains(F.lower("text"), F.lit("license")))
    return rows.select("id", results.snippet_candidates(F.col("text"), "license", 100, 3).alias("found"))


@query("snippet_quality", r"""WITH l AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'USER [x]' || chr(10) WHEN 1 THEN chr(10) || 'Assistant [y] ' WHEN 2 THEN 'a [Exec_command] tool_result ' WHEN 3 THEN 'This session is being continued "match_kind" ' WHEN 4 THEN 'Source ref: codex:1 ' ELSE '' END || substr(text, 1, 100) AS t FROM documents)
SELECT id, CAST(CASE id % 6 WHEN 0 THEN 30 WHEN 1 THEN 8 WHEN 2 THEN -46 WHEN 3 THEN -85 WHEN 4 THEN -60 ELSE 0 END AS INT) AS worth FROM l""")
def _(s, d):
    k = F.col("id") % 6
    head = F.when(k == 0, "USER [x]\n").when(k == 1, "\nAssistant [y] ").when(k == 2, "a [Exec_command] tool_result ").when(k == 3, 'This session is being continued "match_kind" ').when(k == 4, "Source ref: codex:1 ").otherwise("")
    return chunks(s, d).select("id", results.snippet_quality(F.concat(head, F.substring("text", 1, 100))).alias("worth"))


@query("excerpt_of_terms", """WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]{3,}') AS w FROM documents WHERE contains(lower(text), 'license')),
h AS (SELECT id, w, list_position(list_transform(w, lambda x: x IN ('license', 'under')), true) AS hit FROM w WHERE list_has_any(w, ['license', 'under'])), b AS (SELECT *, greatest(1, least(greatest(hit - 3, 1), len(w) - 13)) AS b FROM h)
SELECT id, CASE WHEN b > 1 THEN '...' ELSE '' END || array_to_string(w[b : b + 13], ' ') || CASE WHEN b + 14 <= len(w) THEN '...' ELSE '' END AS excerpt FROM b""")
def _(s, d):
    rows = chunks(s, d).where(F.contains(F.lower("text"), F.lit("license")))
    rows = rows.where(F.arrays_overlap(T.terms(F.col("text")), strings("license", "under")))
    return rows.select("id", results.excerpt(F.col("text"), ["license", "under"]).alias("excerpt"))


@query("evidence_in_budget", f"""{TOP}, b AS (SELECT no, '### Candidate ' || no || chr(10) || 'Source ref: ' || source_ref || chr(10) || 'Tool: ' || source_name || chr(10) || 'Updated: ' || updated_at || chr(10) || 'Title: ' || title || chr(10) || 'Working directory: ' || cwd || chr(10) || chr(10) || 'Parsed trajectory evidence:' || chr(10) || text AS block FROM top),
u AS (SELECT *, 9000 - 5 - coalesce(sum(length(block) + 2) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 2 AS room FROM b)
SELECT CAST(no AS INT) AS no, sha256(CASE WHEN length(block) > room THEN rtrim(substr(block, 1, CAST(greatest(0, room - 30) AS BIGINT))) || chr(10) || chr(10) || '[truncated]' ELSE block END) AS block FROM u WHERE room > 0""")
def _(s, d):
    rows = results.evidence(top(s, d).withColumn("transcript", F.col("text")), 9000, "intro")
    return rows.select("no", F.sha2("block", 256).alias("block"))


@query("answer_sources", """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS ref, event_type = 'purchase' AS rd, event_id AS no, value FROM events WHERE event_id % 50 = 0),
b AS (SELECT ref, max(struct_pack(a := rd, n := no, v := value)) AS b FROM r GROUP BY ref), c AS (SELECT ref, b.a AS rd, b.n AS no, b.v AS v, (SELECT count(*) FROM b WHERE b.a) AS reads FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY rd ORDER BY v DESC, ref) AS place FROM c)
SELECT ref AS source_ref, CASE WHEN rd THEN 'read' ELSE 'match' END AS kind, 't' || no AS title, v AS score FROM p WHERE rd OR place <= 6 - reads""")
def _(s, d):
    log = table(s, d, "events").where("event_id % 50 = 0").select(F.col("event_id").alias("no"), F.col("user_id").cast("string").alias("source_ref"), F.when(F.col("event_type") == "purchase", "read").otherwise("").alias("kind"), F.concat(F.lit(" t"), F.col("event_id").cast("string")).alias("title"), F.col("value").alias("score"))
    return results.answer_sources(log)


@query("candidate_boosts", f"{TOP} SELECT source_ref AS ref, CAST(max(60 - 4 * (no - 1)) AS DOUBLE) AS boost FROM top WHERE id % 5 <> 0 GROUP BY 1")
def _(s, d):
    kind = F.when(F.col("id") % 5 == 0, "manual").otherwise("trajectory")
    parent = F.when(F.col("id") % 2 == 0, F.col("source_ref"))
    rows = top(s, d).select("no", kind.alias("source_type"), parent.alias("parent_source_ref"), F.concat("source_ref", F.lit(":chunk:2")).alias("source_ref"))
    return search.candidate_boosts(rows)


@query("merged_candidates", f"""WITH {CHUNKS}, a AS (SELECT source_ref AS ref, CAST(id % 7 AS DOUBLE) AS score, 1 AS is_chunk, 'lexical' AS channel FROM chunks WHERE contains(lower(text), 'erth') ORDER BY score DESC, ref LIMIT 20),
b AS (SELECT source_ref AS ref, CAST(id % 11 AS DOUBLE) AS score, 0 AS is_chunk, 'local' AS channel FROM chunks WHERE contains(lower(text), 'onder') ORDER BY score DESC, ref LIMIT 20), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
m AS (SELECT ref, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels, max(struct_pack(a := is_chunk, b := score)) AS best FROM u GROUP BY ref)
SELECT ref, channels, best.b AS score, best.a AS is_chunk FROM m""")
def _(s, d):
    c = chunks(s, d)
    leg = lambda word, mod, chunk: c.where(F.contains(F.lower("text"), F.lit(word))).select(F.col("source_ref").alias("ref"), (F.col("id") % mod).cast("double").alias("score"), F.lit(chunk).alias("is_chunk"))
    return search.candidates({"lexical": leg("erth", 7, 1), "local": leg("onder", 11, 0)}, 5, False)


@query("merged_metadata", """WITH r AS (SELECT doc_id // 10 AS ref, CAST(doc_id % 7 AS DOUBLE) AS score, doc_id, source FROM documents WHERE doc_id % 7 <> doc_id // 10 % 3),
g AS (SELECT ref, max(score) AS top FROM r GROUP BY ref) SELECT 's' || g.ref AS ref, g.top AS score, (SELECT max(source) FROM r WHERE r.ref = g.ref AND r.score = g.top) AS cwd, (SELECT count(DISTINCT 'k' || CAST(r.score AS INT)) FROM r WHERE r.ref = g.ref) + 1 AS keys FROM g""")
def _(s, d):
    score = (F.col("doc_id") % 7).cast("double")
    session = F.floor(F.col("doc_id") / 10)
    rows = table(s, d, "documents").where(F.col("doc_id") % 7 != session % 3).select(
        F.concat(F.lit("s"), session.cast("string")).alias("ref"), score.alias("score"), F.lit(1).alias("is_chunk"), F.lit("x").alias("channel"),
        F.create_map(F.lit("cwd"), F.col("source"), F.concat(F.lit("k"), score.cast("int").cast("string")), F.lit("1")).alias("metadata"), F.lit("").alias("cwd"))
    rows = rows.groupBy("ref", "score", "is_chunk", "channel", "cwd").agg(F.max_by("metadata", F.col("metadata.cwd")).alias("metadata"))
    out = search.merge_channels([rows])
    return out.select("ref", "score", "cwd", F.size("metadata").cast("long").alias("keys"))


@query("adjusted_score", f"""WITH {CHUNKS}, r AS (SELECT id, id % 200 AS k, id % 13 = 0 AS generated, len(list_intersect(['erth', 'onder'], regexp_extract_all(lower(title), '[a-z0-9_./:-]{{3,}}'))) AS hits, contains(lower(text), 'source ref: ') OR id % 11 = 0 AS echo, updated_at FROM chunks),
a AS (SELECT *, (100 + 35 * hits + CASE WHEN k <= 1 THEN 25 ELSE 0 END) * CASE WHEN k > 120 AND hits = 0 THEN 0.8 ELSE 1 END * CASE WHEN echo THEN 0.35 ELSE 1 END * CASE WHEN generated THEN 0.2 ELSE 1 END AS s FROM r)
SELECT id, round(s + exp(-greatest(0, (epoch(TIMESTAMP '{NOW}') - epoch(CAST(updated_at AS TIMESTAMP))) / 86400.0) / 30) * 30, 4) AS score FROM a""")
def _(s, d):
    rows = chunks(s, d).withColumn("chunk_index", (F.col("id") % 200).cast("int")).withColumn("generated", F.col("id") % 13 == 0).withColumn("score", F.lit(100.0))
    body = F.when(F.col("id") % 11 == 0, F.concat("text", F.lit(' "match_kind"'))).otherwise(F.col("text"))
    rows = rows.withColumn("text", F.concat(F.lit('Title: "match_kind" Updated: 2024-01-01 '), body))
    return rows.select("id", search.adjusted(rows, "erth onder", NOW).alias("score"))


@query("final_rank", f"""WITH {CHUNKS} SELECT id, CAST(10 + 28 * len(list_intersect(['erth', 'onder'], regexp_extract_all(lower(title), '[a-z0-9_]{{3,}}'))) + 8 * CAST(cwd = 'src1' AS INT) + CASE WHEN id % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 15 ELSE 0 END AS DOUBLE) AS score FROM chunks""")
def _(s, d):
    rows = chunks(s, d)
    return rows.select("id", search.final_rank(F.lit(10.0), "search erth onder src1", F.regexp_replace("title", "(?i)(?<![a-z0-9_])(search|src1)(?![a-z0-9_])", ""), F.col("cwd"), F.col("id") % 2 == 0, F.col("id") % 3 == 0).alias("score"))


EVENTS = "e AS (SELECT 'c' || conv_id AS source_ref, turn AS event_index, role, text FROM conversations)"


def events(s, d):
    return conversations(s, d).select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source_ref"), F.col("turn").cast("int").alias("event_index"), "role", "text", F.lit("").alias("ts"))


@query("read_window", f"WITH {EVENTS} SELECT CAST(event_index AS INT) AS event_index, text FROM e WHERE source_ref = 'c3' AND (event_index BETWEEN 1 AND 3 OR event_index > (SELECT max(event_index) FROM e WHERE source_ref = 'c3') - 2)")
def _(s, d):
    return search.read_window(events(s, d), "c3", 2, 1, 1, 2).select("event_index", "text")


@query("read_session", f"""WITH {EVENTS}, b AS (SELECT event_index, upper(role) || chr(10) || text || chr(10) AS block FROM e WHERE source_ref = 'c3')
SELECT CAST(event_index AS INT) AS event_index, block FROM b""")
def _(s, d):
    return search.read(events(s, d), "c3", "erth", 1_000_000)


@query("related_chunks", f"""WITH {CHUNKS}, own AS (SELECT id, text, chunk_index FROM chunks WHERE source_ref = 'en:s2'), {bm25_sql(['erth', 'onder'], False, 'own', 'id')},
lit AS (SELECT id, 100.0 + 10 * least((length(lower(text)) - length(replace(lower(text), 'erth onder', ''))) // 10, 5) AS score FROM own WHERE contains(lower(text), 'erth onder')),
legs AS (SELECT * FROM lit UNION ALL SELECT id, 50 / (1 + abs(bm25)) + 3 * (CAST(tf0 > 0 AS INT) + CAST(tf1 > 0 AS INT)) ** 2 FROM scored) SELECT id, round(max(score), 4) AS score FROM legs GROUP BY id ORDER BY score DESC, id LIMIT 2""")
def _(s, d):
    return search.related_chunks(chunks(s, d), "en:s2", "erth onder")


# statistics


@query("memory_stats", """WITH m AS (SELECT lang AS source_name, CASE WHEN doc_id % 3 = 0 THEN 'shared' ELSE 'private' END AS scope, CASE WHEN doc_id % 4 = 0 THEN 'session' ELSE 'chunk' END AS record_kind FROM documents)
SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM m UNION ALL SELECT 'scope', scope, count(*) FROM m GROUP BY scope UNION ALL SELECT 'source_name', source_name, count(*) FROM m GROUP BY source_name UNION ALL SELECT 'record_kind', record_kind, count(*) FROM m GROUP BY record_kind""")
def _(s, d):
    k = F.col("doc_id")
    return catalog.memory_stats(table(s, d, "documents").select(F.col("lang").alias("source_name"), F.when(k % 3 == 0, "shared").otherwise("private").alias("scope"), F.when(k % 4 == 0, "session").otherwise("chunk").alias("record_kind")))


@query("prompt_stats", f"WITH {STAMPED} SELECT source_name, count(*) AS prompts, min(ts) AS first_ts, max(ts) AS last_ts FROM prompts GROUP BY GROUPING SETS ((source_name), ())")
def _(s, d):
    return catalog.prompt_stats(prompts(s, d))


@query("index_health", f"WITH {CHUNKS} SELECT count(*) AS total, count(*) FILTER (WHERE id < 500) AS embedded, count(DISTINCT CASE WHEN id % 40 = 3 THEN source_ref END) AS automated, max(updated_at) AS indexed_at FROM chunks")
def _(s, d):
    rows = chunks(s, d).withColumn("metadata_json", F.when(F.col("id") % 40 == 3, '{"origin": "automated"}').otherwise("{}")).withColumn("indexed_at", F.col("updated_at"))
    return catalog.health(rows, F.col("id") < 500)


@query("vector_signature", f"WITH {CHUNKS} SELECT count(*) AS n, coalesce(max(id), 0) AS max_id, coalesce(max(updated_at), '') AS indexed_at FROM chunks WHERE id < 500")
def _(s, d):
    return catalog.signature(chunks(s, d).withColumn("indexed_at", F.col("updated_at")), F.col("id") < 500)


@query("entrypoint_frequency", "SELECT entrypoint, count(*) AS n FROM (SELECT unnest([event_type, 'e' || (user_id % 3)]) AS entrypoint FROM events) GROUP BY 1")
def _(s, d):
    return catalog.entrypoint_frequency(table(s, d, "events").select(F.array("event_type", F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string"))).alias("entrypoints")))


@query("collapsed_projects", "WITH c AS (SELECT CASE WHEN doc_id % 4 = 0 THEN '/home/a' WHEN doc_id % 4 = 1 THEN '/home/a' WHEN doc_id % 4 = 2 THEN '/home/ab/' || source ELSE '/home/a/deep' END AS folder, lang || (doc_id // 10) AS session FROM documents) SELECT folder, count(DISTINCT session) AS sessions, count(*) AS chunks FROM c GROUP BY folder ORDER BY sessions DESC, folder LIMIT 20")
def _(s, d):
    k = F.col("id") % 4
    cwd = F.when(k == 0, "/home/a").when(k == 1, F.concat(F.lit("/home/a/"), "cwd")).when(k == 2, F.concat(F.lit("/home/ab/"), "cwd")).otherwise(F.concat(F.lit("/home/a/deep/"), "cwd"))
    rows = chunks(s, d).withColumn("cwd", cwd).withColumn("session_id", F.concat("source_name", "session_id"))
    return catalog.collapsed_projects(rows, ["/home/a", "/home/a/deep/"])


@query("dashboard_state", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id < 300) AS embedded, count(*) FILTER (WHERE doc_id >= 300) AS missing, round(count(*) FILTER (WHERE doc_id < 300) / count(*), 4) AS coverage, count(*) FILTER (WHERE doc_id < 300) / count(*) >= 0.5 AS semantic, CASE WHEN count(*) FILTER (WHERE doc_id < 300) / count(*) >= 0.5 THEN ['index'] ELSE ['index', 'semantic search: partial'] END AS warnings FROM documents")
def _(s, d):
    return catalog.dashboard(chunks(s, d), F.col("id") < 300, True)


@query("exported_records", f"""WITH {SESSIONS}, own AS (SELECT id, 'conv:' || id AS ref, title, updated_at, text FROM sessions), newest AS (SELECT * FROM own ORDER BY updated_at DESC, ref LIMIT 20),
t AS (SELECT n.ref, n.title, n.updated_at, c.turn, c.role, c.text, CAST(floor((row_number() OVER (PARTITION BY n.ref ORDER BY c.turn) - 1) / ceil(count(*) OVER (PARTITION BY n.ref) / 4)) AS INT) AS part FROM conversations c JOIN newest n ON c.conv_id = n.id),
p AS (SELECT ref, title, updated_at, part, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE coalesce(text, '') <> '') AS raw FROM t GROUP BY ALL),
x AS (SELECT *, 'Source: conv' || chr(10) || 'Session title: ' || title || chr(10) || 'Session ref: ' || ref || chr(10) || 'Chunk ' || (part + 1) || chr(10) || coalesce(raw, '') AS body FROM p)
SELECT ref AS source_ref, 'session' AS kind, NULL AS parent, title, sha256(text) AS text, sha256(ref || chr(10) || 'session' || chr(10) || updated_at || chr(10) || text) AS content_hash FROM own
UNION ALL SELECT ref || ':chunk:' || part, 'chunk', ref, title || ' [chunk ' || (part + 1) || ']', sha256({squeezed('body', 4000)}), sha256(ref || chr(10) || 'chunk' || chr(10) || part || chr(10) || updated_at || chr(10) || coalesce(raw, '')) FROM x""")
def _(s, d):
    own = sessions(s, d).select(F.concat(F.lit("conv:"), F.col("id").cast("string")).alias("source_ref"), F.lit("conv").alias("source_name"), "title", "updated_at", "text")
    turns = conversations(s, d).select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("source_ref"), "turn", "role", "text")
    return catalog.exported(own, turns).select("source_ref", "kind", "parent", "title", F.sha2("text", 256).alias("text"), "content_hash")


# stateful rules


@query("trailing_window", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 12 HOUR AND ts <= TIMESTAMP '{NOW}'")
def _(s, d):
    return windows.trailing(table(s, d, "events"), "user_id", "ts", NOW, 12).select("event_id")


@query("compaction_trigger", "SELECT user_id, count(*) AS messages, sum(length(event_type || event_id)) AS chars, count(*) - 12 AS compactable FROM events GROUP BY user_id HAVING (count(*) > 20 OR sum(length(event_type || event_id)) > 150) AND count(*) > 12")
def _(s, d):
    rows = table(s, d, "events").withColumn("said", F.concat("event_type", F.col("event_id").cast("string")))
    return windows.to_compact(rows, "user_id", "event_id", "said", 20, 150, 12)


@query("log_rotation", "SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 401) AS INT) AS segment FROM events")
def _(s, d):
    return windows.rotated(table(s, d, "events"), "event_type", "event_id").select("event_id", "segment")


@query("unread_counts", "WITH r AS (SELECT user_id, max(event_id) AS read_seq FROM events WHERE event_id % 3 = 0 GROUP BY 1), k AS (SELECT DISTINCT user_id FROM events) SELECT k.user_id, count(e.event_id) AS unread FROM k LEFT JOIN r USING (user_id) LEFT JOIN events e ON e.user_id = k.user_id AND e.event_id > coalesce(read_seq, 0) AND e.event_id % 4 <> 0 AND e.event_type <> 'click' GROUP BY k.user_id")
def _(s, d):
    e = table(s, d, "events")
    feed = e.select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 4 == 0).alias("is_self"), (F.col("event_type") == "click").alias("local"))
    read = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("read_seq"))
    return windows.unread(feed, read, "user_id")


@query("requests_waiting", f"SELECT event_id, epoch(TIMESTAMP '{NOW}') - epoch(ts) <= 300000 AND event_id % 3 <> 0 AS waiting, event_id % 2 = 0 OR epoch(ts) > epoch(TIMESTAMP '{NOW}') - 600000 AS kept FROM events")
def _(s, d):
    now = float(1706659200)  # NOW in epoch seconds
    rows = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").cast("double").alias("created"), F.when(F.col("event_id") % 3 == 0, strings()).otherwise(strings("b")).alias("bots"), (F.col("event_id") % 2 == 1).alias("sent"))
    wait = windows.waiting(rows, now, 300_000).select("event_id", F.lit(True).alias("w"))
    kept = windows.retained(rows, now, 600_000).select("event_id", F.lit(True).alias("k"))
    no = F.lit(False)
    return rows.join(wait, "event_id", "left").join(kept, "event_id", "left").select("event_id", F.coalesce("w", no).alias("waiting"), F.coalesce("k", no).alias("kept"))


@query("budget_pacing", "SELECT round(least(600, 90 + e), 1) AS budget, round(e, 1) AS extension, round(x, 1) AS spent, round(greatest(0, least(600, 90 + e) - x), 1) AS remaining FROM (SELECT sum(CASE WHEN event_id % 100 = 0 THEN 1.5 ELSE 0 END) AS e, CAST(sum(event_id % 7) / 100 AS DOUBLE) AS x FROM events)")
def _(s, d):
    k = F.col("event_id")
    log = table(s, d, "events").select(F.when(k % 100 == 0, 1.5).otherwise(0.0).alias("extension_seconds"), (k % 7).alias("n"))
    return windows.paced(log.groupBy().agg(F.sum("extension_seconds").alias("extension_seconds"), (F.sum("n") / 100).alias("seconds")))


@query("briefing_prompts", f"""WITH r AS (SELECT max(ts) AS last FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-29'), w AS (SELECT greatest(least(coalesce(last, TIMESTAMP '{NOW}' - INTERVAL 36 HOUR), TIMESTAMP '{NOW}' - INTERVAL 36 HOUR), TIMESTAMP '{NOW}' - INTERVAL 4 DAY) AS since, TIMESTAMP '{NOW}' - INTERVAL 14 DAY AS backdrop FROM r),
p AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN 'look at ' || (event_id % 40) ELSE 'what of ' || event_id END AS text FROM events, w WHERE ts >= backdrop)
SELECT 'u' || user_id AS source_ref, epoch_us(ts) AS at, text, 't' || user_id AS title, CASE WHEN ts >= since THEN 'recent' ELSE 'backdrop' END AS slice FROM (SELECT *, count(*) OVER (PARTITION BY substr(text, 1, 200)) AS n FROM p), w WHERE n < 3 AND user_id % 5 <> 0""")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    runs = e.where("event_type = 'purchase'").select(F.col("ts").alias("started_at"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("look at "), (F.col("event_id") % 40).cast("string"))).otherwise(F.concat(F.lit("what of "), F.col("event_id").cast("string")))
    user = F.col("user_id").cast("string")
    rows = e.select(F.concat(F.lit("u"), user).alias("source_ref"), "ts", F.lit("").alias("cwd"), text.alias("text"))
    info = e.select(F.concat(F.lit("u"), user).alias("source_ref"), F.concat(F.lit("t"), user).alias("title"), F.lit("/w").alias("cwd"), F.when(F.col("user_id") % 5 == 0, "automated").otherwise("").alias("origin"))
    out = windows.briefing(rows, info, windows.briefing_since(runs, NOW, "2024-01-29"), M.owner_voice(F.col("text")))
    return out.select("source_ref", F.unix_micros("ts").alias("at"), "text", "title", "slice")


@query("discovery_skips", "SELECT doc_id AS path, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN 'skip' END AS verdict FROM documents")
def _(s, d):
    listing = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), F.lit("p").alias("policy"))
    old = listing.where("path % 2 = 0").withColumn("size", F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("policy", F.when(F.col("path") % 5 == 0, "q").otherwise("p"))
    return windows.skipped(listing, old.withColumn("verdict", F.lit("skip"))).select("path", "verdict")


# maintenance


@query("backfill_order", f"WITH {CHUNKS} SELECT id, (SELECT greatest(count(*) - 64, 0) FROM chunks WHERE id % 3 <> 0) AS remaining FROM chunks WHERE id % 3 <> 0 ORDER BY updated_at DESC, id DESC LIMIT 64")
def _(s, d):
    return store.backfill(chunks(s, d), F.col("id") % 3 == 0, 64).select("id", "remaining")


@query("stale_selection", f"WITH {CHUNKS} SELECT id, (SELECT greatest(count(*) - 50, 0) FROM chunks WHERE id % 4 IN (1, 2)) AS remaining FROM chunks WHERE id % 4 IN (1, 2) ORDER BY updated_at DESC, id LIMIT 50")
def _(s, d):
    state = F.when(F.col("id") % 4 == 1, "new").when(F.col("id") % 4 == 2, "changed").when(F.col("id") % 4 == 3, "removed").otherwise("same")
    rows = chunks(s, d)
    return store.stale(rows.select("id", state.alias("state")), rows.select("id", "updated_at"), "id", 50).select("id", "remaining")


@query("import_validation", "SELECT doc_id AS id, substr(text, 1, 40) AS text, (SELECT count(*) FROM documents WHERE doc_id % 6 IN (0, 1)) AS rejected FROM documents WHERE doc_id % 6 NOT IN (0, 1)")
def _(s, d):
    k = F.col("doc_id") % 6
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(k == 0, "odd").otherwise("session").alias("kind"), F.when(k == 1, " ").otherwise("t").alias("title"), "text")
    return store.imported(rows, ["title"], ["session", "chunk"], {"text": 40}).select("id", "text", "rejected")


@query("json_set", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'automated' AS origin FROM events")
def _(s, d):
    rows = table(s, d, "events").select("event_id", store.with_json(store.with_json(F.col("props"), "$.origin", F.lit("x")), "$.origin", F.lit("automated")).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").cast("int").alias("k"), F.get_json_object("j", "$.origin").alias("origin"))


@query("scoped_memory", "SELECT doc_id AS id, 'private' AS asked FROM documents WHERE doc_id % 3 <> 0 AND lang = 'en' UNION ALL SELECT doc_id, 'shared' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'target_user' FROM documents WHERE doc_id % 3 <> 0 AND lang = 'fr'")
def _(s, d):
    rows = chunks(s, d).select("id", F.when(F.col("id") % 3 == 0, "shared").otherwise("private").alias("scope"), F.col("source_name").alias("owner_id"))
    legs = [policy.scoped(rows, scope, "en", "fr").select("id", F.lit(scope).alias("asked")) for scope in ("private", "shared", "target_user")]
    return legs[0].unionByName(legs[1]).unionByName(legs[2])


@query("human_titles", "SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 4")
def _(s, d):
    k = F.col("id") % 5
    title = F.when(k == 0, "0123abcd-0123-x").when(k == 1, "rollout-2024-01-02T10").when(k == 2, "brave-red-fox").when(k == 3, "  ").otherwise(F.concat(F.lit("Fix the build of "), "cwd"))
    return chunks(s, d).where(T.is_human_title(title)).select("id")


@query("sensitive_words", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' My ' || upper(list_extract([{", ".join("'{}'".format(w.replace("'", "''")) for w in T.SENSITIVE)}], CAST(doc_id % {len(T.SENSITIVE)} AS INT) + 1)) || '.' ELSE text END AS text FROM documents)
SELECT doc_id AS id FROM t WHERE """ + " OR ".join("contains(lower(text), '{}')".format(w.replace("'", "''")) for w in T.SENSITIVE))
def _(s, d):
    """A third of the chunks get one of the words each."""
    word = F.element_at(F.array(*map(F.lit, T.SENSITIVE)), (F.col("id") % len(T.SENSITIVE) + 1).cast("int"))
    text = F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" My "), F.upper(word), F.lit("."))).otherwise(F.col("text"))
    return chunks(s, d).where(T.is_sensitive(text)).select("id")


@query("token_estimates", "SELECT doc_id AS id, CAST(greatest(1, round_even(length(text) / 4.0, 0)) AS INT) AS tokens FROM documents")
def _(s, d):
    return chunks(s, d).select("id", T.token_estimate(F.col("text")).alias("tokens"))


@query("tags_and_slugs", r"""SELECT doc_id AS id, regexp_replace(regexp_replace(lower(lang || ' / ' || source || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, [lang, source] AS tags FROM documents""")
def _(s, d):
    rows = chunks(s, d)
    return rows.select("id", T.slugify(F.concat("source_name", F.lit(" / "), "cwd", F.lit("!"))).alias("slug"), T.tags(F.concat(F.upper("source_name"), F.lit(" , "), "cwd", F.lit(",,"), "source_name")).alias("tags"))

