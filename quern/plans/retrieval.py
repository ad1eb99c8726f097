"""Queries of vector search, keyword search, temporal ranking and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULTS
from quern.functions import vectors
from quern.operators import fts, keyword_index, recall, search
from quern.operators.vector_index import VectorIndex
from quern.plans.base import query
from quern.plans.binding import MEM, MSG, embedded, msg, query_vector, table, with_vector
from quern.store import staged

Q0 = "q0 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
NEAR = f"{Q0}, {MEM}, near AS (SELECT m.*, round(list_cosine_similarity(e.embedding::DOUBLE[], q), 6) AS cosine_score FROM mem m JOIN embeddings e ON e.vec_id = m.chunk_id % (SELECT count(*) FROM embeddings) CROSS JOIN q0 ORDER BY cosine_score DESC, chunk_id LIMIT 25)"
BOOST = """CASE WHEN split_part(file_path, '/', 3) IN ('always', 'knowledge') THEN 0.03
  ELSE 0.03 * exp(-greatest(0, date_diff('day', CAST(updated AS DATE), DATE '2026-06-01')) / 180.0) END"""
PROBES = 12
TERMS = ["than", "tion"]
#: The keyword side of the twelve probes: one term each.
TERM_OF_PROBE = ["the", "of", "and", "than", "tion", "er", "this", "with", "ther", "ing", "from", "that"]


@query("w1_cosine_topk", f"WITH {Q0} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine_score FROM embeddings CROSS JOIN q0 ORDER BY cosine_score DESC, vec_id LIMIT 10")
def w1(spark, sf) -> DataFrame:
    return search.cosine_topk(table(spark, sf, "embeddings"), query_vector(spark, sf), 10, "vec_id").select("vec_id", "cosine_score")


def probes(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") < PROBES).select(F.col("vec_id").alias("probe"), F.col("embedding").alias("query"))


def probe_sql(score: str) -> str:
    return f"SELECT probe, vec_id, cosine_score, CAST(rank AS INTEGER) AS rank FROM (SELECT p.vec_id AS probe, e.vec_id, round({score}, 6) AS cosine_score, row_number() OVER (PARTITION BY p.vec_id ORDER BY round({score}, 6) DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings p ON p.vec_id < 12) WHERE rank <= 5"


@query("w1_multi_probe_topk", probe_sql("list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[])"))
def w1_probes(spark, sf) -> DataFrame:
    return search.probes_topk(table(spark, sf, "embeddings"), probes(spark, sf), 5, "vec_id")


@query("w2_l2_topk", probe_sql("-list_distance(e.embedding::DOUBLE[], p.embedding::DOUBLE[])"))
def w2_l2(spark, sf) -> DataFrame:
    return search.probes_topk(table(spark, sf, "embeddings"), probes(spark, sf), 5, "vec_id", metric="l2")


@query("w2_ivf_exact", "SELECT probe, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT p.vec_id AS probe, e.vec_id, round(-list_distance(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(-list_distance(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings p ON p.vec_id % 100 = 0) WHERE rank <= 10")
def w2_ivf(spark, sf) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 100, over an inverted-file index, by bounds of its lists."""
    e = table(spark, sf, "embeddings")
    index = VectorIndex.build(e, "vec_id", cosine=False)
    return index.search(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("query")), 10, exact=True)


HASHED = """WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS token FROM documents),
 c AS (SELECT doc_id, token, count(*) AS times FROM t WHERE token <> '' GROUP BY ALL), h AS (SELECT doc_id, times, sha256(token) AS d FROM c),
 p AS (SELECT doc_id, times, CAST(('0x' || substr(d, 4 * i + 1, 4)) AS INTEGER) AS seed, 1 - 2 * (CAST(('0x' || substr(d, 4 * i + 1, 2)) AS INTEGER) % 2) AS sign FROM h, range(16) r(i)),
 s AS (SELECT doc_id, CAST(seed % 384 AS INTEGER) AS slot, CAST(sum(sign * times) AS BIGINT) AS weight FROM p GROUP BY ALL)"""


@query("f3_hashing_embed", f"{HASHED} SELECT doc_id, slot, weight FROM s")
def f3(spark, sf) -> DataFrame:
    return vectors.hash_slots(table(spark, sf, "documents"), "doc_id", F.col("text"), DEFAULTS.dim).select("doc_id", F.col("slot").cast("int").alias("slot"), "weight")


@query("f3_unit_vectors", f"{HASHED}, n AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM s GROUP BY doc_id) SELECT doc_id, count_if(weight <> 0) AS filled, round(max(weight / n), 6) AS largest, round(sum(weight * weight / (n * n)), 6) AS squares FROM s JOIN n USING (doc_id) GROUP BY doc_id")
def f3_unit(spark, sf) -> DataFrame:
    made = vectors.embed(table(spark, sf, "documents"), "doc_id", F.col("text"), DEFAULTS.dim)
    e = F.col("embedding")
    return made.select("doc_id", F.size(F.filter(e, lambda x: x != 0)).cast("long").alias("filled"), F.round(F.array_max(e), 6).alias("largest"), F.round(vectors.dot(e, e), 6).alias("squares"))


@query("w4_temporal_rank", f"WITH {NEAR} SELECT chunk_id, file_path, cosine_score, round(cosine_score + {BOOST}, 6) AS final_score FROM near WHERE coalesce(valid_from, created) <= '2026-06-01' AND invalidated_at IS NULL ORDER BY final_score DESC, chunk_id LIMIT 5")
def w4(spark, sf) -> DataFrame:
    return search.search_memory(embedded(spark, sf), query_vector(spark, sf)).select("chunk_id", "file_path", "cosine_score", "final_score")


@query("w4_include_invalidated", f"WITH {NEAR} SELECT chunk_id, cosine_score, round(cosine_score + {BOOST} - CASE WHEN invalidated_at IS NULL THEN 0 ELSE 1000 END, 6) AS final_score FROM near WHERE coalesce(valid_from, created) <= '2026-06-01'")
def w4_all(spark, sf) -> DataFrame:
    near = search.cosine_topk(embedded(spark, sf), query_vector(spark, sf), DEFAULTS.overfetch, "chunk_id")
    return search.temporal_rank(near, include_invalidated=True).select("chunk_id", "cosine_score", F.round("final_score", 6).alias("final_score"))


TOKS = "toks AS (SELECT message_uuid, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS t FROM msg)"
TF2 = f"{TOKS}, tf AS (SELECT message_uuid, len(t) AS dl, len(list_filter(t, lambda x: x = 'than')) AS tf0, len(list_filter(t, lambda x: x = 'tion')) AS tf1 FROM toks), tot AS (SELECT count(*) AS n, avg(dl) AS a, count_if(tf0 > 0) AS d0, count_if(tf1 > 0) AS d1 FROM tf)"


def part(f: str, d: str) -> str:
    return f"greatest(ln((n - {d} + 0.5) / ({d} + 0.5)), 1e-6) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * dl / a))"


TWO = f"{part('tf0', 'd0')} + {part('tf1', 'd1')}"


@query("w3_bm25_topk", f"WITH {MSG}, {TF2} SELECT message_uuid, round({TWO}, 6) AS score FROM tf CROSS JOIN tot WHERE tf0 > 0 AND tf1 > 0 ORDER BY round({TWO}, 6) DESC, message_uuid LIMIT 20")
def w3(spark, sf) -> DataFrame:
    return fts.bm25(msg(spark, sf), "message_uuid", F.col("content"), [[t] for t in TERMS]).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "message_uuid").limit(20)


@query("a14_index_bm25", f"WITH {MSG}, {TF2} SELECT message_uuid, round({TWO}, 6) AS score FROM tf CROSS JOIN tot WHERE tf0 > 0 AND tf1 > 0")
def a14(spark, sf) -> DataFrame:
    m = msg(spark, sf)
    return fts.bm25_indexed(fts.postings(m, "message_uuid", F.col("content")), fts.doc_stats(m, "message_uuid", F.col("content")), "message_uuid", TERMS).withColumn("score", F.round("score", 6))


@query("a14_postings", f"WITH {MSG}, {TOKS}, x AS (SELECT message_uuid, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM toks) SELECT term, message_uuid, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS places FROM x GROUP BY ALL")
def a14_postings(spark, sf) -> DataFrame:
    return fts.postings(msg(spark, sf), "message_uuid", F.col("content")).select("term", "message_uuid", F.array_join(F.col("positions").cast("array<string>"), ",").alias("places"))


@query("w3_bm25_phrase", f"WITH {MSG}, {TOKS}, tf AS (SELECT message_uuid, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf0 FROM toks), tot AS (SELECT count(*) AS n, avg(dl) AS a, count_if(tf0 > 0) AS d0 FROM tf) SELECT message_uuid, round({part('tf0', 'd0')}, 6) AS score FROM tf CROSS JOIN tot WHERE tf0 > 0")
def w3_phrase(spark, sf) -> DataFrame:
    return fts.bm25(msg(spark, sf), "message_uuid", F.col("content"), fts.query_phrases("of-the")).withColumn("score", F.round("score", 6))


@query("w3_bm25_porter")
def w3_porter(spark, sf) -> DataFrame:
    """Stemmed search; the stemmer is no SQL function, so this has tests of its own."""
    return fts.bm25(msg(spark, sf), "message_uuid", F.col("content"), fts.stem_phrases([[t] for t in TERMS]), stemmed=True).withColumn("score", F.round("score", 6))


def stored_index(spark, sf) -> tuple[DataFrame, DataFrame]:
    blocks, _, totals = keyword_index.build(msg(spark, sf), "message_uuid", F.col("content"))
    return staged(blocks, "blocks", layout=keyword_index.LAYOUT), totals


@query("w3_indexed_topk", f"WITH {MSG}, {TF2} SELECT message_uuid, round({TWO}, 6) AS score FROM tf CROSS JOIN tot WHERE tf0 > 0 AND tf1 > 0 ORDER BY round({TWO}, 6) DESC, message_uuid LIMIT 20")
def w3_indexed(spark, sf) -> DataFrame:
    """The search of w3_bm25_topk over a stored index, from the buckets of the greatest bounds on."""
    return keyword_index.topk(*stored_index(spark, sf), [[t] for t in TERMS], 20).withColumnRenamed("id", "message_uuid")


@query("w3_indexed_phrase", f"WITH {MSG}, {TOKS}, tf AS (SELECT message_uuid, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf0 FROM toks), tot AS (SELECT count(*) AS n, avg(dl) AS a, count_if(tf0 > 0) AS d0 FROM tf) SELECT message_uuid, round({part('tf0', 'd0')}, 6) AS score FROM tf CROSS JOIN tot WHERE tf0 > 0")
def w3_indexed_phrase(spark, sf) -> DataFrame:
    return keyword_index.topk(*stored_index(spark, sf), fts.query_phrases("of-the"), None).withColumnRenamed("id", "message_uuid")


VEC = "vec AS (SELECT message_uuid, session_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q), 6) AS score FROM msg JOIN embeddings e ON e.vec_id = (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings) CROSS JOIN q0)"


def message_vectors(spark, sf) -> DataFrame:
    return with_vector(spark, sf, msg(spark, sf), F.col("conv_id") * 7 + F.col("turn"))


def session_hits(spark, sf, n: int = 25) -> tuple[DataFrame, DataFrame]:
    """Keyword and vector hits of the messages (session_id, message_uuid, score, rank)."""
    found = fts.bm25(msg(spark, sf), "message_uuid", F.col("content"), [[TERMS[0]]]).withColumn("score", F.round("score", 6)).withColumn("session_id", F.split("message_uuid", "-")[0])
    near = search.cosine_topk(message_vectors(spark, sf), query_vector(spark, sf), n, "message_uuid").withColumnRenamed("cosine_score", "score")
    top = found.orderBy(F.desc("score"), "message_uuid").limit(n)
    rank = lambda df: df.select("session_id", "message_uuid", "score", F.row_number().over(Window.orderBy(F.desc("score"), "message_uuid")).alias("rank"))
    return rank(top), rank(near)


ONE = part("tf0", "d0")
HITS = f"{Q0}, {MSG}, {TF2}, {VEC}, f AS (SELECT split_part(message_uuid, '-', 1) AS session_id, message_uuid, round({ONE}, 6) AS score, 'fts' AS tier FROM tf CROSS JOIN tot WHERE tf0 > 0 ORDER BY round({ONE}, 6) DESC, message_uuid LIMIT 25), v AS (SELECT session_id, message_uuid, score, 'vec' AS tier FROM vec ORDER BY score DESC, message_uuid LIMIT 25), hits AS (SELECT * FROM f UNION ALL SELECT * FROM v)"


@query("a4_hybrid_merge", f"WITH {HITS} SELECT session_id, message_uuid, score, tier FROM (SELECT *, row_number() OVER (PARTITION BY session_id, message_uuid ORDER BY score DESC, tier) AS n FROM hits) WHERE n = 1 ORDER BY score DESC, session_id, message_uuid LIMIT 5")
def a4(spark, sf) -> DataFrame:
    found, near = session_hits(spark, sf)
    return search.merge_hits(found, near, ["session_id", "message_uuid"], DEFAULTS.k).select("session_id", "message_uuid", "score", "tier")


@query("so1_union_hits", f"WITH {HITS} SELECT session_id, message_uuid, score, tier FROM hits")
def so1(spark, sf) -> DataFrame:
    found, near = session_hits(spark, sf)
    cols = ["session_id", "message_uuid", "score"]
    return found.select(*cols, F.lit("fts").alias("tier")).unionByName(near.select(*cols, F.lit("vec").alias("tier")))


@query("w5_layered_search", f"""WITH {HITS}, {NEAR.removeprefix(Q0 + ', ')}, best AS (SELECT message_uuid, score, row_number() OVER (PARTITION BY session_id, message_uuid ORDER BY score DESC, tier) AS n, session_id FROM hits),
 s AS (SELECT 'session' AS tier, message_uuid AS id, score FROM best WHERE n = 1 ORDER BY score DESC, session_id, message_uuid LIMIT 5),
 m AS (SELECT 'memory' AS tier, CAST(chunk_id AS VARCHAR) AS id, round(cosine_score + {BOOST}, 6) AS score FROM near WHERE coalesce(valid_from, created) <= '2026-06-01' AND invalidated_at IS NULL ORDER BY score DESC, chunk_id LIMIT 5)
 SELECT * FROM m UNION ALL SELECT * FROM s""")
def w5(spark, sf) -> DataFrame:
    found, near = session_hits(spark, sf)
    sessions = search.merge_hits(found, near, ["session_id", "message_uuid"], DEFAULTS.k).select(F.lit("session").alias("tier"), F.col("message_uuid").alias("id"), "score")
    memory = search.search_memory(embedded(spark, sf), query_vector(spark, sf)).select(F.lit("memory").alias("tier"), F.col("chunk_id").cast("string").alias("id"), F.col("final_score").alias("score"))
    return memory.unionByName(sessions)


def promoted(dead: str, least: float) -> str:
    """Promotion where memory hits must reach a score; those that are invalidated count as filtered."""
    return f"""WITH {HITS}, {NEAR.removeprefix(Q0 + ', ')}, good AS (SELECT * FROM near WHERE cosine_score >= {least}), n AS (SELECT (SELECT count(*) FROM good WHERE NOT ({dead})) AS n_memory, (SELECT count(*) FROM good WHERE {dead}) AS n_filtered, (SELECT count(*) FROM hits) AS n_sessions) SELECT *, n_memory = 0 AND n_filtered = 0 AND n_sessions > 0 AS promote FROM n"""


def promotion(spark, sf, least: float) -> DataFrame:
    found, near = session_hits(spark, sf)
    hits = search.cosine_topk(embedded(spark, sf), query_vector(spark, sf), DEFAULTS.overfetch, "chunk_id").where(F.col("cosine_score") >= least)
    dead = F.col("invalidated_at").isNotNull()
    return search.promotion(hits.where(~dead), hits.where(dead), found.select("message_uuid").union(near.select("message_uuid")))


@query("w6_promotion", promoted("invalidated_at IS NOT NULL", 0.3))
def w6(spark, sf) -> DataFrame:
    return promotion(spark, sf, 0.3)


@query("w6_promotion_due", promoted("invalidated_at IS NOT NULL", 1.01))
def w6_due(spark, sf) -> DataFrame:
    """No memory is as near as that, so what sessions know should become one."""
    return promotion(spark, sf, 1.01)


A5 = f"""{MSG}, {TOKS}, w AS (SELECT message_uuid, unnest(t) AS term FROM toks), tf AS (SELECT message_uuid, term, count(*) AS f FROM w WHERE term IN ({", ".join(f"'{t}'" for t in TERM_OF_PROBE)}) GROUP BY ALL),
 df AS (SELECT term, count(*) AS d FROM tf GROUP BY term), dl AS (SELECT message_uuid, len(t) AS dl FROM toks), tot AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), q(term, query_idx) AS (VALUES {", ".join(f"('{t}', {i})" for i, t in enumerate(TERM_OF_PROBE))}),
 k AS (SELECT query_idx, split_part(message_uuid, '-', 1) AS session_id, message_uuid, 0 AS tier_rank, round({part('f', 'd')}, 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (message_uuid) JOIN q USING (term) CROSS JOIN tot),
 v AS (SELECT p.vec_id AS query_idx, m.session_id, m.message_uuid, 1 AS tier_rank, round(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM msg m JOIN embeddings e ON e.vec_id = (m.conv_id * 7 + m.turn) % (SELECT count(*) FROM embeddings) JOIN embeddings p ON p.vec_id < 12),
 x AS (SELECT *, row_number() OVER (PARTITION BY query_idx, tier_rank ORDER BY score DESC, message_uuid) AS rank FROM (SELECT * FROM k UNION ALL SELECT * FROM v)),
 best AS (SELECT *, row_number() OVER (PARTITION BY session_id, message_uuid ORDER BY score DESC, query_idx, tier_rank, rank) AS n FROM x WHERE rank <= 5)"""


def recalled(spark, sf) -> DataFrame:
    """The first hits of each probe in either tier, one row a message."""
    found, rows = keyword_index.scanned(msg(spark, sf), "message_uuid", F.col("content"), set(TERM_OF_PROBE), "conv_id", "turn")  # the only scan of the messages
    n = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("average")).first()
    words = keyword_index.probe_scores(found, {i: [[t]] for i, t in enumerate(TERM_OF_PROBE)}, n.n, n.average)
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "id")
    words = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DEFAULTS.per_probe).select(F.col("id").alias("message_uuid"), "score", F.col("probe").alias("query_idx"), F.lit(0).alias("tier_rank"), "rank")
    vectors_of = with_vector(spark, sf, rows.select(F.col("id").alias("message_uuid"), "conv_id", "turn"), F.col("conv_id") * 7 + F.col("turn"))
    near = search.probes_topk(vectors_of.select("message_uuid", "embedding"), probes(spark, sf), DEFAULTS.per_probe, "message_uuid")
    hits = near.select("message_uuid", F.col("cosine_score").alias("score"), F.col("probe").cast("int").alias("query_idx"), F.lit(1).alias("tier_rank"), "rank").unionByName(words)
    return recall.keep_best(hits.withColumn("session_id", F.split("message_uuid", "-")[0]), ["session_id", "message_uuid"], DEFAULTS.recall_most)


@query("a5_probe_recall", f"WITH {A5} SELECT session_id, message_uuid, score, query_idx AS matched_query, tier_rank FROM best WHERE n = 1 ORDER BY score DESC, query_idx, tier_rank, rank, session_id, message_uuid LIMIT 50")
def a5(spark, sf) -> DataFrame:
    return recalled(spark, sf).select("session_id", "message_uuid", "score", F.col("query_idx").alias("matched_query"), "tier_rank")


@query("j10_dedupe_memory", "WITH c AS (SELECT vec_id AS cand, embedding::DOUBLE[] AS e FROM embeddings WHERE label = 0), k AS (SELECT vec_id AS mem_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label <> 0), x AS (SELECT cand, mem_id, round(list_cosine_similarity(c.e, k.e), 6) AS s FROM c, k), r AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY s DESC, mem_id) AS n FROM x) SELECT cand, mem_id AS nearest, s AS similarity, s >= 0.8 AS captured FROM r WHERE n = 1")
def j10(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    cands, corpus = e.where("label = 0").select(F.col("vec_id").alias("cand"), "embedding"), e.where("label <> 0").select(F.col("vec_id").alias("mem_id"), "embedding")
    return recall.split_captured(cands, corpus, "cand", "mem_id", DEFAULTS.recall_similarity)
