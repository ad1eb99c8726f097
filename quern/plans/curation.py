"""Queries of text rules, ingest, curation, review and state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULTS
from quern.functions import chunks, dates, text
from quern.functions.globs import exclude_regex
from quern.operators import ingest, recall, review, state
from quern.plans.base import query
from quern.plans.binding import MEM, MSG, jsonl, mem, msg, table

#: Phrases put before texts by number, so that every rule has something to find.
LEADS = ("When deploying check the logs ", "always use the helper ", "the repo lives in /srv/git ", "use api_key=abcd1234efgh ", "- remember: rotate the logs. ", "", "my password is hunter2 ", "decision: keep it small. ")
LEAD_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LEADS)) + " END || text"
LINES_SQL = f"(SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no FROM (SELECT doc_id, string_split_regex({LEAD_SQL}, '\\r\\n|[\\n\\x0B-\\r\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM documents))"


def led(df: DataFrame) -> Column:
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in LEADS]), (F.col("doc_id") % 8 + 1).cast("int")), F.col("text"))


def any_of(patterns, col: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


def rx(p: str) -> str:
    return p.replace("'", "''")


CLASSED = f"CASE WHEN {any_of(text.SECRETS, 't')} THEN 'knowledge' WHEN regexp_matches(t, '{rx(text.WHEN)}') THEN 'when' WHEN regexp_matches(t, '{rx(text.LOCATION)}') THEN 'topic' WHEN regexp_matches(t, '{rx(text.ALWAYS)}') THEN 'always' ELSE 'knowledge' END"
NAMED = "CASE WHEN length(f) > 70 THEN f[1:70] || '…' WHEN f = '' THEN 'untitled' ELSE f END"


@query("f16_classify", f"SELECT doc_id, {CLASSED} AS layer FROM (SELECT doc_id, {LEAD_SQL} AS t FROM documents)")
def f16(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.layer_guess(led(d)).alias("layer"))


@query("f15_secret_shapes", f"SELECT doc_id, {any_of(text.SECRETS, 't')} AS secret FROM (SELECT doc_id, {LEAD_SQL} AS t FROM documents)")
def f15(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.has_secret(led(d)).alias("secret"))


@query("f17_names", f"SELECT doc_id, layer, {NAMED} AS name, substr(trim(regexp_replace(regexp_replace(lower({NAMED}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 50) AS cut FROM (SELECT doc_id, {CLASSED} AS layer, trim(regexp_extract(trim(t, ' ' || chr(10) || chr(13) || chr(9)), '^([^.\\n!?]*)', 1)) AS f FROM (SELECT doc_id, {LEAD_SQL} AS t FROM documents))")
def f17(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("t", F.concat(F.element_at(F.array(*[F.lit(x) for x in LEADS]), (F.col("doc_id") % 8 + 1).cast("int")), F.col("text")))
    m = text.frontmatter(F.col("t"))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(m["name"]), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 50)
    return d.select("doc_id", m["type"].alias("layer"), m["name"].alias("name"), slug.alias("cut"))


@query("f13_slugs", f"WITH {MSG} SELECT DISTINCT cwd, coalesce(nullif(trim(regexp_replace(lower(split_part(cwd, '/', 4)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM msg")
def f13(spark, sf) -> DataFrame:
    return msg(spark, sf).select("cwd").distinct().withColumn("slug", text.slug(F.col("cwd")))


NOTE_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(line, '{rx(p)}') THEN rtrim(trim(regexp_extract(line, '{rx(p)}', 1)), '.') END" for p in text.NOTES) + ")"


NOTES_SQL = f"(SELECT doc_id, line_no, note FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(note) ORDER BY line_no) AS n FROM (SELECT doc_id, line_no, {NOTE_SQL} AS note FROM {LINES_SQL}) WHERE note <> '') WHERE n = 1)"


@query("f21_note_candidates", f"SELECT * FROM {NOTES_SQL}")
def f21(spark, sf) -> DataFrame:
    """Notes of every line of every text."""
    d = table(spark, sf, "documents")
    return review.note_candidates(d.select("doc_id", led(d).alias("t")), "doc_id", "t")


@query("a15_distinct_snippets", f"SELECT doc_id, line_no, note FROM (SELECT *, row_number() OVER (PARTITION BY lower(note) ORDER BY doc_id, line_no) AS n FROM {NOTES_SQL}) WHERE n = 1")
def a15(spark, sf) -> DataFrame:
    return review.distinct_snippets(f21(spark, sf), "note", "doc_id", "line_no")


def marked_up(spark, sf) -> DataFrame:
    """Documents with headings before and inside of their text."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n## More\n"), "text").alias("body"))


@query("f1_chunks", f"""WITH RECURSIVE b AS (SELECT doc_id, string_split('# Title ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '## More' || chr(10) || text, chr(10)) AS l FROM documents),
 x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM b), h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AS head FROM x),
 s AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h),
 t AS (SELECT doc_id, section, max(CASE WHEN head THEN trim(regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1)) END) AS heading, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS text, min(i) AS first, max(i) AS last FROM s GROUP BY ALL),
 u AS (SELECT *, string_split_regex(text, '\\n\\s*\\n') AS p FROM t WHERE text <> ''),
 q AS (SELECT * REPLACE (CASE WHEN strlen(text) <= {DEFAULTS.chunk_bytes} THEN [text] WHEN len(p) > 1 AND regexp_matches(split_part(p[1], chr(10), 1), '^#{{1,6}}\\s+.+$') THEN list_concat([p[1] || chr(10) || chr(10) || p[2]], p[3:]) ELSE p END AS p) FROM u),
 k AS (SELECT doc_id, section, 1 AS i, 0 AS g, strlen(p[1]) AS size FROM q UNION ALL
  SELECT k.doc_id, k.section, k.i + 1, CASE WHEN size + strlen(p[k.i + 1]) > {DEFAULTS.chunk_bytes} THEN g + 1 ELSE g END, CASE WHEN size + strlen(p[k.i + 1]) > {DEFAULTS.chunk_bytes} THEN strlen(p[k.i + 1]) ELSE size + strlen(p[k.i + 1]) END FROM k JOIN q USING (doc_id, section) WHERE k.i < len(p)),
 m AS (SELECT doc_id, section, g, heading, first, last, regexp_replace(string_agg(p[i], chr(10) || chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS text, sum(length(p[i]) - length(replace(p[i], chr(10), '')) + 2) AS n FROM k JOIN q USING (doc_id, section) GROUP BY ALL),
 c AS (SELECT *, first + coalesce(sum(n) OVER (PARTITION BY doc_id, section ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins, (g = max(g) OVER (PARTITION BY doc_id, section)) AS closing FROM m)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section NULLS FIRST, g) - 1 AS INTEGER) AS chunk_no, heading, text, CAST(begins AS INTEGER) AS line_start, CAST(CASE WHEN closing THEN last ELSE least(begins + n - 1, last) END AS INTEGER) AS line_end FROM c WHERE text <> ''""")
def f1(spark, sf) -> DataFrame:
    return chunks.chunks(marked_up(spark, sf), "doc_id", "body", DEFAULTS.chunk_bytes)


@query("f1_sections", """WITH b AS (SELECT doc_id, string_split('# Title ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '## More' || chr(10) || text, chr(10)) AS l FROM documents),
 x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM b), h AS (SELECT *, regexp_matches(line, '^#{1,6}\\s+.+$') AS head FROM x),
 s AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
 SELECT doc_id, CAST(section AS BIGINT) AS section, max(CASE WHEN head THEN trim(regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)) END) AS heading, CAST(min(i) AS INTEGER) AS line_start, count(*) AS n_lines FROM s GROUP BY doc_id, section HAVING max(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) = 1""")
def f1_sections(spark, sf) -> DataFrame:
    return chunks.section_rows(marked_up(spark, sf), "doc_id", F.col("body")).select("doc_id", "section", "heading", "line_start", "n_lines")


@query("f22_hashes", "SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 8) AS sidecar, substr(sha256(text), 1, 16) AS cache_key, octet_length(encode(text)) AS n_bytes FROM documents")
def f22(spark, sf) -> DataFrame:
    h = F.sha2("text", 256)
    return table(spark, sf, "documents").select("doc_id", h.alias("content_hash"), F.substring(h, 1, 8).alias("sidecar"), text.cache_key(F.col("text")).alias("cache_key"), F.octet_length("text").cast("long").alias("n_bytes"))


STRIPPED = "nullif(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '')"
DISPOSED = f"CASE WHEN role NOT IN ('user', 'assistant') THEN 'skipped' WHEN {STRIPPED} IS NULL THEN 'no_text' ELSE 'message' END"


@query("sc4_dispositions", f"WITH {MSG} SELECT {DISPOSED} AS disposition, count(*) AS n FROM msg GROUP BY 1")
def sc4(spark, sf) -> DataFrame:
    return ingest.counters(ingest.messages(jsonl(msg(spark, sf))))


@query("f7_flatten", f"WITH {MSG} SELECT message_uuid, {STRIPPED} AS content, CAST(epoch(ts) AS BIGINT) AS timestamp_unix, line_number FROM msg WHERE {DISPOSED} = 'message'")
def f7(spark, sf) -> DataFrame:
    return ingest.messages(jsonl(msg(spark, sf))).where("disposition = 'message'").select("message_uuid", "content", "timestamp_unix", "line_number")


@query("sk4_first_writer", f"WITH {MSG}, two AS (SELECT session_id, content, jsonl_path, line_number FROM msg UNION ALL SELECT session_id, content, jsonl_path || '.copy', line_number FROM msg) SELECT session_id, md5(content) AS message_uuid, jsonl_path, line_number FROM (SELECT *, row_number() OVER (PARTITION BY session_id, md5(content) ORDER BY jsonl_path, line_number) AS n FROM two) WHERE n = 1 AND session_id NOT IN (SELECT session_id FROM msg WHERE line_number = 1 AND role = 'system')")
def sk4(spark, sf) -> DataFrame:
    m = msg(spark, sf).withColumn("message_uuid", F.md5("content"))
    two = m.unionByName(m.withColumn("jsonl_path", F.concat("jsonl_path", F.lit(".copy"))))
    held = m.where("line_number = 1 and role = 'system'").select("session_id")
    return ingest.first_writer(two.join(held, "session_id", "left_anti")).select("session_id", "message_uuid", "jsonl_path", "line_number")


@query("pr12_transcript_cwd", f"WITH {MSG} SELECT jsonl_path, min_by(cwd, line_number) AS cwd FROM msg WHERE line_number <= 50 GROUP BY 1")
def pr12(spark, sf) -> DataFrame:
    return ingest.transcript_cwd(jsonl(msg(spark, sf)))


@query("sk8_import_messages", "SELECT sha1('notes' || chr(0) || source || '/' || doc_id || '.txt') AS message_uuid, sha1('notes' || chr(0) || source) AS session_id, strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_iso, 'document' AS role, octet_length(encode(doc_id || '.txt' || chr(10) || chr(10) || text)) AS n_bytes FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def sk8(spark, sf) -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    files = table(spark, sf, "documents").where("source is not null").select(F.concat("source", F.lit("/"), name).alias("rel_to_source"), name.alias("rel_to_session"), F.col("source").alias("session"), F.concat(F.lit("/in/"), "source").alias("folder"), (F.lit(1700000000) + F.col("doc_id")).alias("mtime_unix"), "text")
    return ingest.document_messages(files, "notes").select("message_uuid", "session_id", "timestamp_iso", "role", F.octet_length("content").cast("long").alias("n_bytes"))


DAYS = "date_diff('day', CAST(coalesce(last_confirmed, updated) AS DATE), DATE '2026-06-01')"
LAYER = "split_part(file_path, '/', 3)"


@query("w10_overdue", f"WITH {MEM} SELECT file_path, CAST({DAYS} AS INTEGER) AS age_days FROM mem WHERE {LAYER} IN ('always', 'knowledge') AND {DAYS} > 180")
def w10(spark, sf) -> DataFrame:
    return review.overdue(mem(spark, sf)).select("file_path", "age_days")


@query("w11_confidence_order", f"WITH {MEM}, k AS (SELECT file_path, CASE WHEN suspected_at IS NOT NULL THEN 0 WHEN last_confirmed IS NULL THEN 2 WHEN date_diff('day', CAST(last_confirmed AS DATE), DATE '2026-06-01') > 180 THEN 1 END AS severity FROM mem WHERE {LAYER} = 'always' AND invalidated_at IS NULL), f AS (SELECT * FROM k WHERE severity IS NOT NULL) SELECT file_path, severity, greatest((SELECT count(*) FROM f) - 6, 0) AS more FROM f ORDER BY severity, file_path LIMIT 6")
def w11(spark, sf) -> DataFrame:
    return review.confidence(mem(spark, sf).where(F.col("file_path").startswith("/m/always/"))).select("file_path", "severity", "more")


def ago(n: str, unit: str) -> str:
    return f"CAST({n} AS INTEGER) || ' {unit}' || CASE WHEN CAST({n} AS INTEGER) = 1 THEN '' ELSE 's' END || ' ago'"


AGE = "date_diff('day', CAST(updated AS DATE), DATE '2026-06-01')"


@query("f11_relative_age", f"WITH {MEM} SELECT chunk_id, CASE WHEN {AGE} <= 0 THEN 'today' WHEN {AGE} < 7 THEN {ago(AGE, 'day')} WHEN {AGE} < 30 THEN {ago(f'({AGE}) // 7', 'week')} WHEN {AGE} < 365 THEN {ago(f'({AGE}) // 30', 'month')} ELSE {ago(f'({AGE}) // 365', 'year')} END AS age FROM mem")
def f11(spark, sf) -> DataFrame:
    return mem(spark, sf).select("chunk_id", text.relative_age(F.datediff(F.lit(DEFAULTS.today), dates.to_date(F.col("updated")))).alias("age"))


@query("f12_tags", f"WITH {MEM} SELECT chunk_id, CASE WHEN {DAYS} > 180 THEN ' [review?]' ELSE '' END AS tag FROM mem")
def f12(spark, sf) -> DataFrame:
    return mem(spark, sf).select("chunk_id", review.review_tag(dates.first_filled(F.col("last_confirmed"), F.col("updated"))).alias("tag"))


@query("pr7_layers", f"WITH {MEM} SELECT {LAYER} AS layer, count(*) AS n FROM mem GROUP BY 1")
def pr7(spark, sf) -> DataFrame:
    from quern.operators.search import layer_of

    return mem(spark, sf).groupBy(layer_of(F.col("file_path"), "/m").alias("layer")).agg(F.count("*").alias("n"))


GLOBS = ["*/topics/*", "src1", "/m/when/[12]*.md"]


@query("pr3_exclude_globs", f"WITH {MEM} SELECT chunk_id FROM mem WHERE NOT (regexp_matches(file_path, '^.*/topics/.*$') OR contains(source, 'src1') OR regexp_matches(file_path, '^/m/when/[12].*\\.md$'))")
def pr3(spark, sf) -> DataFrame:
    regex = exclude_regex(GLOBS)
    return mem(spark, sf).where(~F.col("file_path").rlike(regex) & ~F.coalesce(F.col("source").rlike(regex), F.lit(False))).select("chunk_id")


@query("pr13_snippets", "SELECT doc_id, array_to_string(string_split(text[1:300], chr(10))[1:3], chr(10)) AS snippet FROM documents")
def pr13(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


REFINED = "score * CASE WHEN role = 'user' THEN 1.5 ELSE 1.0 END * (1 - least(0.5, 0.5 * greatest(length(content) - 200, 0) / 2000.0))"


def candidates(spark, sf) -> DataFrame:
    return msg(spark, sf).withColumn("score", ((F.col("conv_id") * 31 + F.col("turn") * 17) % 97) / 97.0)


CAND = f"{MSG}, c AS (SELECT *, ((conv_id * 31 + turn * 17) % 97) / 97.0 AS score FROM msg)"


@query("w7_rerank", f"WITH {CAND} SELECT message_uuid, round({REFINED}, 6) AS refined, CAST(row_number() OVER (ORDER BY round({REFINED}, 6) DESC, score DESC, session_id, message_uuid) AS INTEGER) AS position FROM c")
def w7(spark, sf) -> DataFrame:
    return recall.rerank(candidates(spark, sf)).select("message_uuid", "refined", "position")


SCOPE = f"{MSG}, k AS (SELECT * FROM msg WHERE cwd IN ('/home/u/p1', '/home/u/p2', '/home/u/p3') AND ts >= TIMESTAMP '2026-01-10 00:00:00' - INTERVAL 4 DAY), s AS (SELECT session_id, max(ts) AS newest FROM k GROUP BY 1 ORDER BY newest DESC, session_id LIMIT 20)"


@query("a6_scope_sessions", f"WITH {SCOPE} SELECT message_uuid FROM k WHERE session_id IN (SELECT session_id FROM s)")
def a6(spark, sf) -> DataFrame:
    import dataclasses

    m = msg(spark, sf).withColumn("slug", text.slug(F.col("cwd")))
    return recall.apply_scope(m, ["p1", "p2", "p3"], dt.datetime(2026, 1, 10), dataclasses.replace(DEFAULTS, scope_days=4), most=20).select("message_uuid")


@query("a8_batches", f"WITH {MSG} SELECT split_part(cwd, '/', 4) AS slug, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM msg GROUP BY 1 HAVING slug <> 'p0'")
def a8(spark, sf) -> DataFrame:
    plan = recall.batches(msg(spark, sf).withColumn("slug", text.slug(F.col("cwd"))))
    return recall.open_batches(plan, spark.createDataFrame([("p0",)], "slug string"))


@query("a8_batch_sessions", f"WITH {MSG} SELECT DISTINCT split_part(cwd, '/', 4) AS slug, session_id FROM msg")
def a8_sessions(spark, sf) -> DataFrame:
    return recall.batch_sessions(msg(spark, sf).withColumn("slug", text.slug(F.col("cwd"))))


@query("w8_top_n_deferred", f"WITH {CAND} SELECT message_uuid, CAST(row_number() OVER (ORDER BY score DESC, message_uuid) AS INTEGER) AS position, CASE WHEN row_number() OVER (ORDER BY score DESC, message_uuid) <= 30 THEN 'active' ELSE 'deferred' END AS status FROM c")
def w8(spark, sf) -> DataFrame:
    return recall.top_n(candidates(spark, sf), 30, F.desc("score"), "message_uuid").select("message_uuid", "position", "status")


@query("w9_layer_groups", f"WITH x AS (SELECT doc_id, {CLASSED} AS layer FROM (SELECT doc_id, {LEAD_SQL} AS t FROM documents)) SELECT doc_id, layer, CAST(CASE layer WHEN 'always' THEN 0 WHEN 'when' THEN 1 WHEN 'topic' THEN 2 ELSE 3 END AS INTEGER) AS layer_order, CAST(row_number() OVER (PARTITION BY layer ORDER BY doc_id) AS INTEGER) AS rank FROM x")
def w9(spark, sf) -> DataFrame:
    return recall.by_layer(f16(spark, sf), "doc_id").select("doc_id", "layer", "layer_order", "rank")


@query("u1_confirm", f"WITH {MEM} SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN '2026-06-01' ELSE last_confirmed END AS last_confirmed, CASE WHEN chunk_id % 2 <> 0 THEN suspected_at END AS suspected_at FROM mem")
def u1(spark, sf) -> DataFrame:
    return state.confirm(mem(spark, sf), F.col("chunk_id") % 2 == 0, DEFAULTS.today).select("chunk_id", "last_confirmed", "suspected_at")


@query("u3_invalidate", f"WITH {MEM} SELECT chunk_id, CASE WHEN chunk_id % 5 = 1 AND invalidated_at IS NULL THEN '2026-06-01T12:00:00' ELSE invalidated_at END AS invalidated_at, CASE WHEN chunk_id % 5 = 1 AND invalidated_at IS NULL THEN '2026-06-01' ELSE updated END AS updated FROM mem")
def u3(spark, sf) -> DataFrame:
    return state.invalidate(mem(spark, sf), F.col("chunk_id") % 5 == 1, DEFAULTS.now)[0].select("chunk_id", "invalidated_at", "updated")


@query("u2_suspect_refused", f"WITH {MEM} SELECT chunk_id FROM mem WHERE chunk_id % 5 = 1 AND invalidated_at IS NOT NULL")
def u2(spark, sf) -> DataFrame:
    return state.suspect(mem(spark, sf), F.col("chunk_id") % 5 == 1, DEFAULTS.now, "old")[1].select("chunk_id")


#: Release tags by part: some are no versions.
TAG_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'v' || p_size % 4 || '.' || p_partkey % 12 || '.' || p_partkey % 7 WHEN 1 THEN 'release-' || p_size ELSE p_size % 4 || '.' || p_partkey % 13 || '.' || p_partkey % 3 END"


def tags(spark, sf) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    text_of = lambda c: c.cast("string")
    dotted = lambda a, b, c: F.concat_ws(".", text_of(a), text_of(b), text_of(c))
    size = F.col("p_size")
    return p.select(F.when(k % 5 == 0, F.concat(F.lit("v"), dotted(size % 4, k % 12, k % 7))).when(k % 5 == 1, F.concat(F.lit("release-"), text_of(size))).otherwise(dotted(size % 4, k % 13, k % 3)).alias("tag"), "p_partkey")


VERSIONED = f"v AS (SELECT tag, regexp_extract_all(tag, '\\d+') AS p, p_partkey FROM (SELECT {TAG_SQL} AS tag, p_partkey FROM part) WHERE regexp_matches(tag, '^v?\\d+\\.\\d+\\.\\d+$'))"
NUMBERS = "CAST(p[1] AS INTEGER) AS major, CAST(p[2] AS INTEGER) AS minor, CAST(p[3] AS INTEGER) AS patch"


@query("f26_semver", f"WITH {VERSIONED}, d AS (SELECT DISTINCT tag, {NUMBERS} FROM v) SELECT *, CAST(row_number() OVER (ORDER BY major DESC, minor DESC, patch DESC, tag) AS INTEGER) AS place FROM d")
def f26(spark, sf) -> DataFrame:
    from quern.store import numbered

    v = tags(spark, sf).select("tag", text.version(F.col("tag")).alias("v")).where("v is not null").distinct().select("tag", "v.*")
    return numbered(v, [F.desc("major"), F.desc("minor"), F.desc("patch"), F.col("tag")], "place")


@query("a9_max_severity", f"WITH {VERSIONED} SELECT major, minor, patch, max(severity) AS severity FROM (SELECT {NUMBERS}, CAST(p_partkey % 4 AS INTEGER) AS severity FROM v) GROUP BY ALL")
def a9(spark, sf) -> DataFrame:
    return review.severities(tags(spark, sf).withColumn("severity", (F.col("p_partkey") % 4).cast("int")))


@query("a9_newest_version", f"WITH {VERSIONED} SELECT {NUMBERS} FROM v ORDER BY major DESC, minor DESC, patch DESC LIMIT 1")
def a9_newest(spark, sf) -> DataFrame:
    return review.newest_version(tags(spark, sf))


CONFIRMED = "coalesce(last_confirmed, '')"


@query("f12_confidence_tags", f"WITH {MEM} SELECT chunk_id, CASE WHEN invalidated_at IS NOT NULL THEN '' ELSE CASE WHEN suspected_at IS NOT NULL THEN ' ⚠ suspected (since ' || suspected_at || CASE WHEN chunk_id % 2 = 0 THEN ' — old' ELSE '' END || ')' ELSE '' END || CASE WHEN last_confirmed IS NOT NULL THEN ' · confirmed ' || last_confirmed ELSE ' · unconfirmed' END END AS tag FROM mem")
def f12_confidence(spark, sf) -> DataFrame:
    why = F.when(F.col("chunk_id") % 2 == 0, "old")
    return mem(spark, sf).select("chunk_id", review.confidence_tag(F.lit(None).cast("string"), F.col("invalidated_at"), F.col("suspected_at"), why, F.col("last_confirmed")).alias("tag"))


HOOKED = "SELECT DISTINCT 'on_' || event_type AS event, 'h' || (event_id % 7) || CASE WHEN event_id % 2 = 0 THEN '.sh' ELSE '.py' END AS handler FROM events"


def hook_settings(spark, sf) -> DataFrame:
    """Settings as nested JSON: for each kind of event, blocks of commands."""
    name = F.concat(F.lit("h"), (F.col("event_id") % 7).cast("string"), F.when(F.col("event_id") % 2 == 0, ".sh").otherwise(".py"))
    wired = table(spark, sf, "events").select(F.concat(F.lit("on_"), "event_type").alias("event"), name.alias("handler")).distinct()
    command = F.struct(F.concat(F.lit("/opt/hooks/"), "handler", F.lit(" --quiet")).alias("command"))
    blocks = wired.groupBy("event").agg(F.collect_list(F.struct(F.array(command).alias("hooks"))).alias("blocks"))
    return blocks.select(F.to_json(F.struct(F.map_from_arrays(F.array("event"), F.array("blocks")).alias("hooks"))).alias("settings"))


@query("a17_wired_handlers", HOOKED)
def a17(spark, sf) -> DataFrame:
    return review.wired_commands(review.hook_events(hook_settings(spark, sf)))


@query("j15_missing_handlers", f"SELECT h.handler FROM (VALUES ('h1.py'), ('h2.sh'), ('h9.sh'), ('h8.py')) h(handler) WHERE handler NOT IN (SELECT handler FROM ({HOOKED}))")
def j15(spark, sf) -> DataFrame:
    return review.missing_handlers(hook_settings(spark, sf), ["h1.py", "h2.sh", "h9.sh", "h8.py"])


@query("st10_due_notices", "SELECT event_id, ts IS NULL OR ts > TIMESTAMP '2024-01-20' OR ts <= TIMESTAMP '2024-01-19' AS due, ts <= TIMESTAMP '2024-01-06' AS stale, event_id % 3 = 0 AS dismissed FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events)")
def st10(spark, sf) -> DataFrame:
    now, at = dt.datetime(2024, 1, 20), F.col("ts").cast("timestamp_ntz")
    shown = F.when(F.col("event_id") % 3 == 0, "1.2.0")
    return table(spark, sf, "events").select("event_id", review.throttle_due(at, now).alias("due"), review.is_stale(at, now).alias("stale"), review.dismissed(F.lit("1.2.0"), shown).alias("dismissed"))
