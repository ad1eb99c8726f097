"""A stored keyword index: postings clustered by term, in blocks that carry a bound of their scores.

Rows are dealt to buckets of about BUCKET rows in the order of their lengths, so that a bucket's shortest row says much
about all of its rows. A block holds the postings of one term in one bucket, with their number, the greatest frequency
and the least length among them; blocks are range-partitioned and sorted by term and written in small pages, so that a
search reads the pages of its own terms. How many rows a term has, which buckets hold all terms and what score a bucket
can reach at most follow from the blocks' heads, without their postings: a top-k search evaluates the buckets of the
greatest bounds first, and then those alone whose bound reaches the k-th score. Totals are one row a build.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.fts import FLOOR, K1, B, stems, tokens
from quern.store import staged

#: Rows of a bucket, and buckets that a search looks at before it has a threshold.
BUCKET, FIRST = 1024, 16
#: How blocks are written: a page is the least that a reader can leave out.
LAYOUT = {"parquet.page.row.count.limit": "256", "parquet.block.size": str(16 << 20)}
#: Scores are compared as they are reported, to six digits.
DIGITS, SLACK = 6, 2e-6


def clustered(entries: DataFrame) -> DataFrame:
    """term, bucket, n, max_tf, min_dl, entries of rows (term, bucket, id, dl, positions), sorted by term."""
    tf = F.size("positions")
    made = entries.groupBy("term", "bucket").agg(F.count("*").alias("n"), F.max(tf).alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct("id", "dl", "positions")).alias("entries"))
    return made.repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket")


def build(docs: DataFrame, id_col: str, text: Column, stemmed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, stats, totals): clustered(); id, dl and bucket of every row; and one row of docs and tokens.

    A null text has no tokens. Ids are expected to be distinct; an empty table gives no blocks and totals of 0.
    """
    made = docs.select(F.col(id_col).alias("id"), F.coalesce(stems(text) if stemmed else tokens(text), F.array().cast("array<string>")).alias("toks")).withColumn("dl", F.size("toks"))
    ordered = staged(made.repartitionByRange("dl", "id").sortWithinPartitions("dl", "id").withColumn("at", F.monotonically_increasing_id()), "tokens")
    ordered = ordered.withColumn("bucket", F.xxhash64(F.lit(uuid.uuid4().hex), F.floor(F.col("at") / BUCKET)))  # of this build alone
    each = ordered.select("id", "dl", "bucket", F.posexplode("toks").alias("position", "term")).repartition("term", "bucket")  # both aggregates stay there
    entries = each.groupBy("term", "bucket", "id").agg(F.first("dl").alias("dl"), F.sort_array(F.collect_list("position")).alias("positions"))
    return clustered(entries), ordered.select("id", "dl", "bucket"), ordered.agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))


def entries_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("term", "bucket", F.explode("entries").alias("e")).select("term", "bucket", "e.id", "e.dl", "e.positions")


def without(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """The blocks without the postings of some ids (id)."""
    return clustered(entries_of(blocks).join(ids, "id", "left_anti"))


def idf(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), FLOOR)


def part(tf: Column, dl: Column, average: float) -> Column:
    """A term's share of a score, without its weight: grows with tf, falls with dl."""
    f = tf.cast("double")
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / F.lit(average)))


def topk(blocks: DataFrame, totals: DataFrame, phrases: list[list[str]], k: int | None) -> DataFrame:
    """id and score (rounded) of the k best rows that hold all phrases, ties by id; of all of them where k is None."""
    none = blocks.select(F.explode("entries.id").alias("id"), F.lit(0.0).alias("score")).limit(0)
    told = totals.agg(F.sum("docs").alias("n"), F.sum("tokens").alias("t")).first()
    if not phrases or not told.n or not told.t:
        return none
    average = told.t / told.n
    if any(len(p) > 1 for p in phrases):
        scored = probe_scores(hits(blocks, {t for p in phrases for t in p}), {0: phrases}, told.n, average).select("id", "score")
        return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)
    times = Counter(p[0] for p in phrases)
    mine = blocks.where(F.col("term").isin(*times))
    heads = staged(mine.select("term", "bucket", "n", "max_tf", "min_dl"), "heads")
    df = {r.term: r.df for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term of the query
    if len(df) < len(times):
        return none
    weight = F.create_map(*[F.lit(x) for t, c in times.items() for x in (t, c * idf(told.n, df[t]))])
    bound = F.sum(weight[F.col("term")] * part(F.col("max_tf"), F.col("min_dl"), average))
    buckets = staged(heads.groupBy("bucket").agg(bound.alias("bound"), F.count_distinct("term").alias("terms")).where(F.col("terms") == len(times)).select("bucket", "bound"), "buckets")

    def evaluated(some: DataFrame) -> DataFrame:
        rows = entries_of(some).select("id", (weight[F.col("term")] * part(F.size("positions"), F.col("dl"), average)).alias("part"))
        found = rows.groupBy("id").agg(F.sum("part").alias("score"), F.count("*").alias("found")).where(F.col("found") == len(times))
        return found.select("id", F.round("score", DIGITS).alias("score"))

    if k is None:
        return evaluated(mine.join(buckets, "bucket", "left_semi"))
    best = (F.desc("score"), F.col("id"))
    ahead = [r.bucket for r in buckets.orderBy(F.desc("bound"), "bucket").limit(FIRST).collect()]
    if not ahead:
        return none
    first = staged(evaluated(mine.where(F.col("bucket").isin(ahead))).orderBy(*best).limit(k), "first")
    row = first.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    rest = buckets.where(~F.col("bucket").isin(ahead))
    if row.n >= k:
        rest = rest.where(F.col("bound") >= row.least - SLACK)
    if rest.isEmpty():
        return first.orderBy(*best).limit(k)
    return first.unionByName(evaluated(mine.join(rest, "bucket", "left_semi"))).orderBy(*best).limit(k)


# ------------------------------------------------------------------ many queries over one scan


def hits(blocks: DataFrame, terms: set[str]) -> DataFrame:
    """id, dl, term and positions of the terms' postings: one scan for all of them."""
    return entries_of(blocks.where(F.col("term").isin(*sorted(terms)))).select("id", "dl", "term", "positions")


def scanned(docs: DataFrame, id_col: str, text: Column, terms: set[str], *more: str) -> tuple[DataFrame, DataFrame]:
    """hits() of rows that have no index, and id, dl and the columns of more of every row, by one scan."""
    toks = docs.select(F.col(id_col).alias("id"), *more, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("toks"))
    placed = F.transform("toks", lambda t, i: F.struct(t.alias("term"), i.alias("position")))
    held = staged(toks.select("id", *more, F.size("toks").alias("dl"), F.filter(placed, lambda x: x["term"].isin(*sorted(terms))).alias("held")), "scanned")
    each = held.select("id", "dl", F.inline("held"))
    return each.groupBy("id", "dl", "term").agg(F.sort_array(F.collect_list("position")).alias("positions")), held.drop("held")


def probe_scores(found: DataFrame, probes: dict[int, list[list[str]]], n: int, average: float) -> DataFrame:
    """probe, id and score (rounded) of the rows that hold all phrases of a probe, for all probes at once.

    found: rows of hits(). The probes' terms are a small table that the postings are joined with; a row's postings of a
    probe come together and every phrase is counted where its terms stand side by side.
    """
    spark = found.sparkSession
    asked = [(p, t) for p, phrases in probes.items() for t in sorted({t for x in phrases for t in x})]
    if not asked:
        return found.select(F.lit(0).alias("probe"), "id", F.lit(0.0).alias("score")).limit(0)
    of_term = F.broadcast(spark.createDataFrame(asked, "probe int, term string"))  # bounded by the queries
    of_probe = F.broadcast(spark.createDataFrame([(p, x) for p, x in probes.items() if x], "probe int, phrases array<array<string>>"))
    met = found.join(of_term, "term").groupBy("probe", "id").agg(F.first("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    at = lambda t: F.coalesce(F.try_element_at("m", t), F.array().cast("array<int>"))

    def times(phrase: Column) -> Column:
        one = lambda p: F.forall(F.sequence(F.lit(1), F.size(phrase) - 1), lambda j: F.array_contains(at(F.get(phrase, j)), p + j))
        whole = F.filter(at(F.get(phrase, F.lit(0))), lambda p: one(p))
        return F.when(F.size(phrase) == 1, F.size(at(F.get(phrase, F.lit(0))))).otherwise(F.size(whole))

    tfs = staged(met.join(of_probe, "probe").select("probe", "id", "dl", F.transform("phrases", times).alias("tfs")), "counts")
    seen = tfs.select("probe", F.posexplode("tfs").alias("phrase", "tf")).where("tf > 0").groupBy("probe", "phrase").agg(F.count("*").alias("df")).collect()  # a row a phrase
    df = {(r.probe, r.phrase): r.df for r in seen}
    weights = [(p, [idf(n, df.get((p, i), 0)) for i in range(len(x))]) for p, x in probes.items() if x]
    weighed = tfs.where(F.forall("tfs", lambda t: t > 0)).join(F.broadcast(spark.createDataFrame(weights, "probe int, idf array<double>")), "probe")
    parts = F.zip_with("tfs", "idf", lambda t, w: w * part(t, F.col("dl"), average))
    return weighed.select("probe", "id", F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), DIGITS).alias("score"))
