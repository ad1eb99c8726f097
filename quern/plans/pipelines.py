"""Queries of change capture, health, aggregates, events and generic shapes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import dates
from quern.operators import events, fts, health, ingest, reconcile, review
from quern.plans.base import query
from quern.plans.binding import EVT, MEM, MSG, evt, mem, msg, table

DISK = "disk AS (SELECT doc_id, '/m/' || doc_id || '.md' AS path, sha256(text) AS hash, doc_id % 17 <> 0 AS ok, doc_id % 19 <> 0 AS walked, text FROM documents WHERE doc_id % 4 <> 3)"
INDEX = "idx AS (SELECT doc_id, '/m/' || doc_id || '.md' AS path, CASE WHEN doc_id % 6 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 4 <> 1)"


def sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A disk and an index that agree in part: the binding's rules say which files each has."""
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    path = F.concat(F.lit("/m/"), i.cast("string"), F.lit(".md")).alias("path")
    disk = d.where(i % 4 != 3).select("doc_id", path, F.sha2("text", 256).alias("hash"), (i % 17 != 0).alias("ok"), (i % 19 != 0).alias("walked"), "text")
    index = d.where(i % 4 != 1).select("doc_id", path, F.when(i % 6 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("hash"))
    return disk, index


@query("j6_index_diff", f"WITH {DISK}, {INDEX} SELECT coalesce(d.path, i.path) AS path, CASE WHEN d.path IS NULL THEN 'drop' WHEN NOT d.ok AND i.path IS NOT NULL THEN 'drop_invalid' WHEN NOT d.ok THEN 'invalid' WHEN i.path IS NULL THEN 'add' WHEN i.hash <> d.hash THEN 'change' ELSE 'keep' END AS action FROM disk d FULL OUTER JOIN idx i ON d.path = i.path")
def j6(spark, sf) -> DataFrame:
    return reconcile.index_diff(*sides(spark, sf))


@query("j4_coverage", f"WITH {DISK}, {INDEX} SELECT path, CASE WHEN NOT walked THEN 'never_walked' WHEN NOT ok THEN 'invalid' ELSE 'not_yet_indexed' END AS reason FROM disk WHERE path NOT IN (SELECT path FROM idx)")
def j4(spark, sf) -> DataFrame:
    return health.coverage(*sides(spark, sf))


@query("h2_verdict", f"WITH {DISK}, {INDEX}, g AS (SELECT * FROM disk WHERE path NOT IN (SELECT path FROM idx)) SELECT (SELECT count(*) FROM disk) AS on_disk, (SELECT count(*) FROM idx) AS indexed, count_if(NOT walked OR NOT ok) AS rejected, CASE WHEN count_if(NOT walked OR NOT ok) = 0 AND (SELECT count(*) FROM disk) = (SELECT count(*) FROM idx) THEN 'ok' ELSE 'problem' END AS status FROM g")
def h2(spark, sf) -> DataFrame:
    return health.verdict(*sides(spark, sf)).select("on_disk", "indexed", F.col("rejected").cast("long").alias("rejected"), "status")


@query("a11_percent", "SELECT source, count(*) AS discoverable, count(l.doc_id) AS indexed, round(100.0 * count(l.doc_id) / count(*), 4) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def a11(spark, sf) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id").distinct().withColumn("have", F.lit(True))
    joined = table(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id", "left").withColumn("have", F.coalesce("have", F.lit(False)))
    return health.percent(joined, "source", "have")


@query("j3_unembedded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def j3(spark, sf) -> DataFrame:
    return ingest.unembedded(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("j12_fts_consistency", f"WITH {MSG}, i AS (SELECT message_uuid FROM msg WHERE turn % 5 <> 0 UNION ALL SELECT message_uuid || '-old' FROM msg WHERE turn = 0) SELECT message_uuid, 'orphan' AS problem FROM i WHERE message_uuid NOT IN (SELECT message_uuid FROM msg) UNION ALL SELECT message_uuid, 'unindexed' FROM msg WHERE regexp_matches(lower(content), '[\\p{{L}}\\p{{N}}]') AND message_uuid NOT IN (SELECT message_uuid FROM i)")
def j12(spark, sf) -> DataFrame:
    m = msg(spark, sf)
    index = m.where("turn % 5 <> 0").select("message_uuid").unionByName(m.where("turn = 0").select(F.concat("message_uuid", F.lit("-old")).alias("message_uuid")))
    orphans, missing = fts.consistency(m, index, "message_uuid", F.col("content"))
    return orphans.withColumn("problem", F.lit("orphan")).unionByName(missing.withColumn("problem", F.lit("unindexed")))


@query("j13_files_without_chunks", f"WITH {MEM} SELECT file_path FROM mem WHERE chunk_id NOT IN (SELECT doc_id FROM labels)")
def j13(spark, sf) -> DataFrame:
    m = mem(spark, sf)
    chunks = m.join(table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi").select("file_path")
    return health.files_without_chunks(m.select("file_path"), chunks)


LIVE = "live AS (SELECT '/t/' || doc_id AS path, CAST(1700000000 + doc_id AS BIGINT) AS m, CAST(octet_length(encode(text)) AS BIGINT) AS s, text AS data, doc_id FROM documents WHERE text IS NOT NULL)"
ARCH = "arch AS (SELECT path, CASE WHEN doc_id % 5 = 1 THEN substr(data, 1, 40) WHEN doc_id % 5 = 2 THEN 'other' || data WHEN doc_id % 5 = 3 THEN 'zz' ELSE data END AS old, CASE WHEN doc_id % 5 = 4 THEN m ELSE m - 1 END AS mm, s AS ss, CASE WHEN doc_id % 5 = 2 THEN 'backfill' ELSE 'live' END AS origin FROM live WHERE doc_id % 5 <> 0)"


@query("j7_archive_reconcile", f"WITH {LIVE}, {ARCH}, j AS (SELECT live.*, old, mm, ss, origin FROM live LEFT JOIN arch USING (path)), a AS (SELECT *, CASE WHEN old IS NULL THEN 'copied' WHEN mm = m AND ss = s THEN 'skipped_unchanged' WHEN starts_with(data, old) THEN 'replaced_append' WHEN origin = 'backfill' THEN 'replaced_backfill' ELSE 'diverged_sidecar' END AS action FROM j) SELECT path, action, CASE WHEN action = 'diverged_sidecar' THEN path || '.' || substr(sha256(data), 1, 8) END AS sidecar FROM a")
def j7(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    live = table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.lit("/t/"), i.cast("string")).alias("path"), (F.lit(1700000000) + i).alias("mtime_unix"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").cast("binary").alias("data"), "text")
    held = live.where(i % 5 != 0)
    archive = held.select("path", F.when(i % 5 == 1, F.substring("text", 1, 40)).when(i % 5 == 2, F.concat(F.lit("other"), "text")).when(i % 5 == 3, F.lit("zz")).otherwise(F.col("text")).cast("binary").alias("data"))
    manifest = held.select("path", F.when(i % 5 == 4, F.col("mtime_unix")).otherwise(F.col("mtime_unix") - 1).alias("mtime_unix"), "size_bytes", F.when(i % 5 == 2, "backfill").otherwise("live").alias("origin"))
    return reconcile.archive_reconcile(live.select("path", "mtime_unix", "size_bytes", "data"), archive, manifest)


@query("j9_backfill", f"WITH {MSG} SELECT session_id, count(*) AS n_lines, md5(string_agg(content, chr(10) ORDER BY line_number, message_uuid)) AS body_md5 FROM msg WHERE session_id NOT IN (SELECT session_id FROM msg WHERE role = 'system') GROUP BY 1")
def j9(spark, sf) -> DataFrame:
    m = msg(spark, sf)
    return reconcile.backfill(m, m.where("role = 'system'").select("session_id")).select("session_id", "n_lines", F.md5("body").alias("body_md5"))


@query("a13_reassemble", f"WITH {MSG} SELECT session_id, count(*) AS n_lines, md5(string_agg(content, chr(10) ORDER BY line_number, message_uuid)) AS body_md5 FROM msg GROUP BY 1")
def a13(spark, sf) -> DataFrame:
    return reconcile.reassemble(msg(spark, sf)).select("session_id", "n_lines", F.md5("body").alias("body_md5"))


@query("sk12_forget", f"WITH {MSG} SELECT message_uuid FROM msg WHERE session_id NOT IN (SELECT session_id FROM msg WHERE role = 'system')")
def sk12(spark, sf) -> DataFrame:
    m = msg(spark, sf)
    return reconcile.forget({"messages": m.select("session_id", "message_uuid")}, m.where("role = 'system'").select("session_id").distinct())["messages"].select("message_uuid")


@query("j5_new_bodies", "WITH h AS (SELECT doc_id, '/l/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(text) AS bh FROM documents WHERE text IS NOT NULL), p AS (SELECT DISTINCT bh FROM h WHERE doc_id % 10 = 0) SELECT min(path) AS path FROM h WHERE bh NOT IN (SELECT bh FROM p) GROUP BY bh")
def j5(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    legacy = d.select("doc_id", F.concat(F.lit("/l/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.col("text").alias("body"))
    present = legacy.where("doc_id % 10 = 0").select(reconcile.body_hash(F.col("body")).alias("body_hash")).distinct()
    return reconcile.new_bodies(legacy, present).select("path")


@query("a1_file_timestamps", f"WITH {MEM} SELECT '/m/' || source AS file_path, max(updated) AS updated, max(created) AS created, max(last_confirmed) AS last_confirmed FROM mem GROUP BY 1")
def a1(spark, sf) -> DataFrame:
    return review.file_times(mem(spark, sf).withColumn("file_path", F.concat(F.lit("/m/"), "source")))


@query("a7_inverted_tags", f"WITH {MEM}, t AS (SELECT file_path, unnest([source, 'n' || (chunk_id % 3)]) AS key FROM mem) SELECT DISTINCT key, file_path AS file FROM t WHERE key IS NOT NULL")
def a7(spark, sf) -> DataFrame:
    m = mem(spark, sf).withColumn("tags", F.array_compact(F.array("source", F.concat(F.lit("n"), (F.col("chunk_id") % 3).cast("string")))))
    return review.inverted(m, "tags")


@query("a7_alias_targets", f"WITH {MEM} SELECT 'al' || (chunk_id % 40) AS alias, max(file_path) AS file_path FROM mem GROUP BY 1")
def a7_alias(spark, sf) -> DataFrame:
    return review.alias_targets(mem(spark, sf).withColumn("aliases", F.array(F.concat(F.lit("al"), (F.col("chunk_id") % 40).cast("string")))))


@query("a12_manifest_hash", "WITH f AS (SELECT source, sha256(doc_id || '.txt' || chr(9) || (1700000000 + doc_id) || chr(9) || octet_length(encode(text))) AS line FROM documents WHERE text IS NOT NULL), b AS (SELECT source, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM f GROUP BY source, line[1:3]) SELECT source, sha256(string_agg(h, chr(10) ORDER BY h)) AS manifest FROM b GROUP BY source")
def a12(spark, sf) -> DataFrame:
    files = table(spark, sf, "documents").where("text is not null").select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), (F.lit(1700000000) + F.col("doc_id")).alias("mtime_unix"), F.octet_length("text").alias("size_bytes"))
    return review.manifest_hash(files, "source")


@query("j14_any_chunk", "SELECT s.source, t.lang FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s LEFT JOIN (SELECT source, min_by(lang, doc_id) AS lang FROM documents WHERE lang IS NOT NULL GROUP BY source) t USING (source)")
def j14(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").where("source is not null")
    chunks = d.where("lang is not null").select(F.col("source").alias("file_path"), F.col("doc_id").alias("chunk_id"), "lang")
    return review.any_chunk(d.select(F.col("source").alias("file_path")).distinct(), chunks, "lang").select(F.col("file_path").alias("source"), "lang")





ELAPSED = "CAST(floor(epoch(ts)) - floor(epoch(last_value(CASE WHEN event_type = '{}' THEN ts END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS BIGINT) AS {}"


@query("w14_elapsed", f"WITH {EVT} SELECT event_id, {ELAPSED.format('click', 'since_user')}, {ELAPSED.format('purchase', 'since_assistant')} FROM evt")
def w14(spark, sf) -> DataFrame:
    return events.elapsed(evt(spark, sf), {"click": "since_user", "purchase": "since_assistant"}).select("event_id", "since_user", "since_assistant")


@query("st6_first_threshold", f"WITH {EVT} SELECT session_id, min(ts) AS ts FROM evt WHERE value >= 60 GROUP BY 1")
def st6(spark, sf) -> DataFrame:
    return events.first_over(evt(spark, sf), "value", 60.0)


CLAIMS = "claims AS (SELECT CAST(c_custkey AS VARCHAR) AS session_id, 't' || c_custkey AS task_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"
LEDGER = "ledger AS (SELECT session_id, ts FROM evt WHERE event_type = 'error' AND event_id % 3 = 0)"


#: Codes of stops by number: the first three and the last are of limits, as case does not matter.
CODES = ("rate_limit", "billing_error", "usage_limit", "overloaded", "invalid_request", "Rate_Limit")


def freeze_parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = evt(spark, sf).where("event_type = 'error'")
    freezes = e.select("session_id", "ts", "event_id", F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("event_id") % 6 + 1).cast("int")).alias("code"), F.lit("").alias("message"))
    claims = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("task_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "in_progress").otherwise("open").alias("status"))
    return freezes, claims, e.where("event_id % 3 = 0").select("session_id", "ts")


@query("j11_claims", f"WITH {EVT}, {CLAIMS}, {LEDGER} SELECT event_id, task_id FROM evt e JOIN claims USING (session_id) WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.session_id = e.session_id AND l.ts = e.ts)")
def j11(spark, sf) -> DataFrame:
    return events.claimed(*freeze_parts(spark, sf)).select("event_id", "task_id")


@query("st7_resume_tick", f"WITH {EVT}, {CLAIMS}, {LEDGER} SELECT session_id, ts, ts + INTERVAL 60 MINUTE AS ready_at FROM evt e JOIN claims USING (session_id) WHERE event_type = 'error' AND event_id % 6 IN (0, 1, 2, 5) AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.session_id = e.session_id AND l.ts = e.ts) AND ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 DAY AND ts + INTERVAL 60 MINUTE <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, session_id LIMIT 1")
def st7(spark, sf) -> DataFrame:
    return events.resume_tick(*freeze_parts(spark, sf), dt.datetime(2024, 1, 20)).select("session_id", "ts", "ready_at")


@query("a16_ledger_outcomes", f"WITH {EVT} SELECT count_if(event_type = 'click') AS claims, count_if(event_type = 'purchase') AS launched, count_if(event_type = 'error') AS failed, count_if(event_type = 'click') - count_if(event_type = 'purchase') - count_if(event_type = 'error') AS unknown FROM evt")
def a16(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    ledger = evt(spark, sf).select(F.when(kind == "click", "claim").when(kind == "purchase", "launched").when(kind == "error", "failed").alias("outcome"))
    return health.outcomes(ledger)


@query("sc9_discover_dirs", "SELECT split_part(url, '/', 3) AS dir, count_if(page_id % 3 = 0) AS md, count(*) AS texts FROM pages GROUP BY 1 ORDER BY md DESC, texts DESC, dir")
def sc9(spark, sf) -> DataFrame:
    from quern.sources.files import rank_dirs

    pages = table(spark, sf, "pages").select(F.split("url", "/")[2].alias("dir"), F.when(F.col("page_id") % 3 == 0, "md").otherwise("txt").alias("ext"))
    return rank_dirs(pages)


EXTRA, DROPPED = ["rst", "md"], ["json"]


@query("so3_ext_algebra", "SELECT source, list_sort(list_filter(list_distinct([source, 'md', 'json', 'rst', 'md']), lambda x: x <> 'json'))[1] AS first_ext, len(list_filter(list_distinct([source, 'md', 'json', 'rst', 'md']), lambda x: x <> 'json')) AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def so3(spark, sf) -> DataFrame:
    from quern.sources.files import extensions

    base = F.array(F.col("source"), F.lit("md"), F.lit("json"))
    exts = extensions(base, EXTRA, DROPPED)
    return table(spark, sf, "documents").where("source is not null").select("source").distinct().select("source", F.array_min(exts).alias("first_ext"), F.size(exts).cast("long").alias("n"))


@query("so2_set_difference", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def so2(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").distinct().join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("a2_counts", "SELECT (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) AS files")
def a2(spark, sf) -> DataFrame:
    n = lambda t, name: table(spark, sf, t).agg(F.count("*").alias(name))
    return n("conversations", "messages").join(F.broadcast(n("embeddings", "vectors"))).join(F.broadcast(n("documents", "files")))


@query("st1_stream_ingest", f"WITH {MSG} SELECT session_id, count(*) AS n FROM msg WHERE role <> 'system' GROUP BY 1")
def st1(spark, sf) -> DataFrame:
    from quern.streaming.ingest import stream_counts

    return stream_counts(spark, sf)


@query("st5_stream_last_seen", f"WITH {EVT} SELECT session_id, max(CASE WHEN event_type = 'click' THEN ts END) AS last_user, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_assistant FROM evt GROUP BY 1")
def st5(spark, sf) -> DataFrame:
    from quern.streaming.events import stream_last_seen

    return stream_last_seen(spark, sf)


@query("st6_stream_threshold", f"WITH {EVT} SELECT DISTINCT session_id FROM evt WHERE value >= 60")
def st6_stream(spark, sf) -> DataFrame:
    from quern.streaming.events import stream_first_over

    return stream_first_over(spark, sf, 60.0)


@query("a3_last_indexed", f"WITH {MEM} SELECT max(updated) AS indexed_at, max(1700000000 + chunk_id) AS newest_mtime, count(DISTINCT file_path) AS files FROM mem")
def a3(spark, sf) -> DataFrame:
    return health.last_indexed(mem(spark, sf).withColumns({"indexed_at": F.col("updated"), "mtime_unix": F.lit(1700000000) + F.col("chunk_id")}))


@query("j8_now_excluded", f"WITH {MSG} SELECT jsonl_path, cwd LIKE '%/p1%' OR cwd LIKE '/home/u/p_' AND cwd LIKE '%4' AS gone FROM (SELECT jsonl_path, min_by(cwd, line_number) AS cwd FROM msg GROUP BY 1)")
def j8(spark, sf) -> DataFrame:
    m = msg(spark, sf)
    held = m.groupBy("jsonl_path").agg(F.min_by("cwd", "line_number").alias("cwd"))
    kept, gone = reconcile.now_excluded(held, ["p1", "*/p4"])
    return kept.select("jsonl_path", F.lit(False).alias("gone")).unionByName(gone.select("jsonl_path", F.lit(True).alias("gone")))


@query("sc14_transcript_count", f"WITH {MSG} SELECT least(count(DISTINCT jsonl_path), 60) AS n FROM msg")
def sc14(spark, sf) -> DataFrame:
    return health.counted(msg(spark, sf).select("jsonl_path").distinct(), 60)


@query("h7_silent_empty", "SELECT t.*, stored > 0 AND hits = 0 AND filtered = 0 AS suspect FROM (SELECT source, count(*) AS stored, count_if(text LIKE '%zzq%') AS hits, count_if(doc_id % 7 = 0 AND source < 'src3') AS filtered FROM documents WHERE source IS NOT NULL GROUP BY source) t")
def h7(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").where("source is not null")
    n = d.groupBy("source").agg(F.count("*").alias("stored"), F.count_if(F.col("text").contains("zzq")).alias("hits"), F.count_if((F.col("doc_id") % 7 == 0) & (F.col("source") < "src3")).alias("filtered"))
    return n.withColumn("suspect", health.silent_empty(F.col("stored"), F.col("hits"), F.col("filtered")))


@query("f29_session_dates", "SELECT conv_id, turn, strftime(make_timestamp((1767225600 + conv_id * 3600 + turn * 60) * 1000000) + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d') AS day FROM conversations")
def f29(spark, sf) -> DataFrame:
    at = (F.lit(1767225600) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("long")
    return table(spark, sf, "conversations").select("conv_id", "turn", dates.session_date(at, "Asia/Kolkata").alias("day"))
