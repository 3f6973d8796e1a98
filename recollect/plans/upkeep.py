"""Queries of the as-of join, packed vectors and the bucketed table, over the shop's tables and the embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import asof, buckets, catalog, embeddings, lexical, packed, search, sharing, store
from .catalogue import CHUNKS, DOT, SESSIONS, chunks, query, sessions, table


@query("asof_nearest_click", """WITH s AS (SELECT row_number() OVER () AS no, sale_id, client_id, sold_at AS ts FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT no, sale_id, click_id, abs(epoch_us(s.ts) - epoch_us(c.ts)) AS gap, epoch_us(c.ts) AS theirs FROM s JOIN clicks c ON s.client_id = c.client_id AND c.ts BETWEEN s.ts - INTERVAL 6 HOUR AND s.ts + INTERVAL 6 HOUR),
r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY gap, theirs, click_id) AS r FROM p)
SELECT s.sale_id, r.click_id, r.gap FROM s LEFT JOIN r ON s.no = r.no AND r.r = 1""")
def _(s, d):
    """Each sale's nearest click of its client, within six hours."""
    sales = table(s, d, "sales").select("sale_id", "client_id", F.col("sold_at").alias("ts")).where("client_id is not null and ts is not null")
    clicks = table(s, d, "clicks").select("client_id", F.col("click_id").alias("id"), "ts")
    return asof.nearest(sales, clicks, "client_id", 6 * 3600, outer=True).select("sale_id", F.col("match_id").alias("click_id"), "gap")


@query("packed_vector_topk", f"SELECT e.vec_id AS id, round({DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {DOT} DESC, id LIMIT 15")
def _(s, d):
    rows = table(s, d, "embeddings").withColumnRenamed("vec_id", "id")
    path = f"{lexical.shared(s)}/packed-{uuid.uuid4().hex}"
    packed.packed(rows).write.parquet(path)
    q = rows.where("id = 0").select("embedding").first()[0]  # one vector
    return packed.topk(s.read.parquet(path), rows, list(q), 15).select("id", F.round("score", 6).alias("score"))


@query("bucketed_merge", """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC, valid_at DESC) AS r FROM (SELECT DISTINCT * FROM client_changes) WHERE client_id IS NOT NULL)
SELECT client_id, seq, op, segment, city, balance FROM ranked WHERE r = 1 AND op IS DISTINCT FROM 'D'""")
def _(s, d):
    """The clients as their change log leaves them, merged in three batches, the middle one twice."""
    rows = table(s, d, "client_changes").where("client_id is not null").select("client_id", "seq", "op", "segment", "city", "balance", F.struct("seq", "change_id", "valid_at").alias("imported_at"))
    last = rows.groupBy("client_id").agg(F.max_by(F.struct("*"), "imported_at").alias("r"))
    held = buckets.Buckets.create(s, f"{lexical.shared(s)}/clients-{uuid.uuid4().hex}", "client_id bigint, seq bigint, op string, segment string, city string, balance double, imported_at struct<seq bigint, change_id bigint, valid_at timestamp_ntz>", ["client_id"], 16)
    third = F.pmod(F.xxhash64("imported_at"), F.lit(3))
    for no in (0, 1, 1, 2):  # by time of change: a later batch has later changes of some clients
        part = rows.where(third == no) if no < 2 else rows.where(third == 2).unionByName(last.select("r.*"))
        held = held.merge(part, batch=str(no))
    return held.read().where("op is null or op <> 'D'").drop("imported_at")


@query("embedding_backfill", f"WITH {CHUNKS} SELECT id, updated_at FROM chunks ORDER BY updated_at DESC, id LIMIT 150")
def _(s, d):
    """Two lots of learnt embeddings, newest chunks first: which chunks have theirs then."""
    rows = chunks(s, d)
    model = embeddings.fit(rows, dims=32, vocabulary=3000)
    store = buckets.Buckets.create(s, f"{lexical.shared(s)}/vectors-{uuid.uuid4().hex}", embeddings.VECTORS, ["id"], 8)
    for _ in range(2):
        store, _left = embeddings.backfill(store, rows, model, 75)
    return store.read().where("size(embedding) = 32").select("id", "updated_at")


@query("sync_latest_by_ref", """WITH m AS (SELECT 'src' || (event_id % 3) AS source_name, 's' || user_id AS source_ref, md5(props || event_type) AS content_hash, CAST(ts AS DATE) AS imported_at, ts AS updated_at, event_type AS record_kind, event_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY source_name, source_ref ORDER BY imported_at DESC, updated_at DESC, content_hash DESC) AS r FROM m),
t AS (SELECT source_name, count(*) AS records, max(imported_at) AS imported_at FROM m GROUP BY source_name)
SELECT source_name, source_ref, content_hash, updated_at, record_kind, records, t.imported_at FROM r JOIN t USING (source_name) WHERE r = 1""")
def _(s, d):
    e = table(s, d, "events")
    rows = e.select(
        F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("source_name"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("source_ref"),
        F.md5(F.concat("props", "event_type")).alias("content_hash"), F.to_date("ts").alias("imported_at"), F.col("ts").alias("updated_at"), F.col("event_type").alias("record_kind"))
    return catalog.latest_by_ref(rows)


@query("project_sessions", f"""WITH {CHUNKS} SELECT source_ref, max(session_id) AS session_id, max(title) AS title, max(updated_at) AS updated_at, count(*) AS chunks, CAST(max(CASE WHEN id % 4 = 0 THEN 'automated' END) AS VARCHAR) AS origin
FROM chunks WHERE source_name = 'en' AND (cwd = 'src1' OR starts_with(cwd || '/' || id, 'src1/')) GROUP BY source_ref""")
def _(s, d):
    """Chunks lie in folders of their own below their source's."""
    rows = chunks(s, d).withColumn("cwd", F.concat("cwd", F.lit("/"), F.col("id").cast("string")))
    meta = F.when(F.col("id") % 4 == 0, F.lit('{"origin": "automated"}')).otherwise(F.lit("{}"))
    return catalog.project_sessions(rows.withColumn("metadata_json", meta), "en", "src1", rooted=True)


@query("origins_written_back", f"""WITH {CHUNKS}, o AS (SELECT source_ref, max(id) % 3 AS k FROM chunks GROUP BY source_ref)
SELECT id, id AS own, CASE k WHEN 0 THEN 'automated' WHEN 1 THEN 'interactive' ELSE 'old' END AS origin, CASE k WHEN 0 THEN 'sdk' WHEN 1 THEN '' END AS origin_detail FROM chunks JOIN o USING (source_ref)""")
def _(s, d):
    """Origins of sessions written into their chunks' metadata in a bucketed table; twice, as a job that is run again."""
    rows = chunks(s, d)
    meta = F.format_string('{"own": %d, "nested": {"a": [1, 2]}, "origin": "old"}', "id")
    held = buckets.Buckets.create(s, f"{lexical.shared(s)}/origins-{uuid.uuid4().hex}", "id bigint, source_ref string, metadata_json string", ["id"], 16).merge(rows.select("id", "source_ref", meta.alias("metadata_json")))
    k = F.max("id") % 3
    origins = rows.groupBy("source_ref").agg(F.when(k == 0, "automated").when(k == 1, "interactive").otherwise("odd").alias("origin"), F.when(k == 0, "sdk").alias("origin_detail"))
    for _ in range(2):
        held = store.origins_written(held, origins)
    return held.read().where(F.get_json_object("metadata_json", "$.nested.a[1]") == "2").select(
        "id", F.get_json_object("metadata_json", "$.own").cast("long").alias("own"), F.get_json_object("metadata_json", "$.origin").alias("origin"), F.get_json_object("metadata_json", "$.origin_detail").alias("origin_detail"))


@query("sharing_overview", f"""WITH {CHUNKS}, c AS (SELECT *, source_name || '|' || cwd AS project, CAST(substr(session_id, 2) AS BIGINT) AS no FROM chunks),
p AS (SELECT project, count(DISTINCT session_id) AS sessions, max(updated_at) AS last FROM c GROUP BY project),
g AS (SELECT project, sessions % 4 AS told FROM p WHERE sessions % 4 <> 3),
f AS (SELECT DISTINCT project, source_ref AS ref, session_id, no FROM c WHERE no % 7 = 0 AND project IN (SELECT project FROM g)),
t AS (SELECT source_ref AS ref, max(title) AS title FROM chunks GROUP BY source_ref),
x AS (SELECT DISTINCT source_ref AS ref FROM chunks JOIN labels ON id = doc_id WHERE toxic = 1)
SELECT p.project, p.sessions, p.last, CASE p.sessions % 3 WHEN 0 THEN 'team' WHEN 1 THEN 'owner' END AS level, CASE WHEN g.told IS NOT NULL THEN 'level ' || g.told END AS suggested, CASE WHEN g.told IS NOT NULL THEN 'so' END AS reason,
 f.ref, t.title, CASE WHEN f.ref IS NOT NULL THEN x.ref IS NOT NULL END AS private, CASE WHEN f.no % 5 = 0 THEN 'team' WHEN x.ref IS NOT NULL THEN 'owner' END AS session_level
FROM p LEFT JOIN g USING (project) LEFT JOIN f USING (project) LEFT JOIN t ON f.ref = t.ref LEFT JOIN x ON f.ref = x.ref""")
def _(s, d):
    c = chunks(s, d).withColumn("project", F.concat_ws("|", "source_name", "cwd")).withColumn("no", F.substring("session_id", 2, 20).cast("long"))
    projects = c.groupBy("project").agg(F.countDistinct("session_id").alias("sessions"), F.max("updated_at").alias("last"))
    k = F.col("sessions")
    decisions = projects.select("project", F.when(k % 3 == 0, "team").when(k % 3 == 1, "owner").alias("level"))
    suggestions = projects.where(k % 4 != 3).select("project", F.concat(F.lit("level "), (k % 4).cast("string")).alias("suggested"), F.lit("so").alias("reason"))
    private = c.join(table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").select(F.col("source_ref").alias("ref"))
    own = c.where("no % 5 = 0").select("session_id", F.lit("team").alias("level"))
    return sharing.overview(projects, decisions, suggestions, c.where("no % 7 = 0").select("project", F.col("source_ref").alias("ref")), private, own, c)


@query("prompt_digest", f"""WITH {SESSIONS}, s AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'codex' ELSE 'claude' END AS tool, substr(text, 1, 40) AS short, substr(text, 1, 90) AS long,
  row_number() OVER (ORDER BY updated_at DESC, id) AS r FROM sessions),
b AS (SELECT *, '- [' || tool || '][' || substr(updated_at, 1, 10) || '] ' AS head, 5 * (contains(lower(title), 'erth')::INT + contains(lower(title), 'onder')::INT)
  + (length(lower(text)) - length(replace(lower(text), 'erth', ''))) // 4 + (length(lower(text)) - length(replace(lower(text), 'onder', ''))) // 5 + CASE WHEN r <= 20 THEN 0.75 ELSE 0 END AS score FROM s),
m AS (SELECT *, row_number() OVER (ORDER BY score DESC, updated_at DESC, id) AS q FROM b WHERE score > 0),
c AS (SELECT tool, count(*) AS n FROM s GROUP BY tool)
SELECT 0 AS section, 0 AS place, 'Trajectory memory is available from prior local agent sessions.' AS line
UNION ALL SELECT 1, 0, 'Global overview: ' || sum(n) || ' total sessions ' || string_agg(upper(substr(tool, 1, 1)) || substr(tool, 2) || ' ' || n, ', ' ORDER BY tool) || '.' FROM c
UNION ALL SELECT 2, 0, 'Current user query for memory matching: erth onder'
UNION ALL SELECT 3, 0, 'Potentially relevant prior trajectories:' WHERE EXISTS (SELECT 1 FROM m)
UNION ALL SELECT 3, q, head || title || ': ' || short FROM m WHERE q <= 4
UNION ALL SELECT 4, 0, 'Recent trajectories with more detail:'
UNION ALL SELECT 4, r, head || long FROM b WHERE r <= 20
UNION ALL SELECT 5, 0, 'Older trajectory catalog:' WHERE EXISTS (SELECT 1 FROM b WHERE r > 20)
UNION ALL SELECT 5, r, head || title || ': ' || short FROM b WHERE r > 20 AND r <= 28
UNION ALL SELECT 6, 0, 'Treat these summaries as hints, not ground truth. If exact provenance matters, inspect the source trajectory file.'""")
def _(s, d):
    rows = sessions(s, d).withColumn("tool", F.when(F.col("id") % 3 == 0, "codex").otherwise("claude"))
    return search.prompt_digest(rows.withColumn("short_summary", F.substring("text", 1, 40)).withColumn("detailed_summary", F.substring("text", 1, 90)), "erth onder")
