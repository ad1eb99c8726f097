"""Mixing sources to target weights by cube-method balanced sampling.

Every document gets the whole part of its source's repetition rate; the fractional rest is an inclusion probability.
The flight phase moves three probabilities at a time along the null space of the balancing constraints (words and
documents), so that both totals keep their values while one probability becomes 0 or 1. It runs in blocks of a
source; what the blocks leave undecided (two documents each) flies again in fewer blocks, until one block of each
source is left, whose last documents are landed by giving up the count first and the words last. Rows that repeat id and size are
one unit of the flight and move together, so that reruns agree; the words' total counts every row, the documents' total
counts such a unit once.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import read_table, staged

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents of a flight block, about.
BLOCK = 4000
EDGE = 1e-9


def word_count(col):
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, weight and target of every source of (source, size).

    Sources by code point, null last, take the weights in turn and share `share` of all sizes; targets stop at
    `most` times their source's size. Sources in order of the level at which they stop: those that stop before the
    level of the rest are full, the rest share what is left by weight. The windows go over one row a source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("full", most * F.col("source_size"))
    order = (F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("full") > F.col("weight") * F.col("level"))
    shared = F.coalesce(F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("full") / F.col("weight"))).over(every), F.lit(float("inf")))
    return leveled.withColumn("target", F.least("full", F.col("weight") * shared)).select("source", "source_size", "weight", "target")


def fly(sizes: list[float], chances: list[float], rng: random.Random, land: bool) -> list[float]:
    """Chances after the flight phase: 0 or 1 but for at most two; with land 0 or 1 for all."""
    p = list(chances)
    active: list[int] = []

    def settle() -> None:
        active[:] = [i for i in active if EDGE < p[i] < 1 - EDGE]

    def move(u: list[float]) -> None:
        up = min(((1 - p[i]) / d if d > 0 else -p[i] / d) for i, d in zip(active, u, strict=True) if d)
        down = min((p[i] / d if d > 0 else (p[i] - 1) / d) for i, d in zip(active, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(active, u, strict=True):
            p[i] += step * d
            if p[i] < EDGE:
                p[i] = 0.0
            elif p[i] > 1 - EDGE:
                p[i] = 1.0
        settle()

    for i in range(len(p)):
        active.append(i)
        settle()
        while len(active) == 3:
            a, b, c = (sizes[k] for k in active)
            u = [b - c, c - a, a - b]
            move(u if any(u) else [1.0, -1.0, 0.0])
    while land and active:
        if len(active) == 2:
            a, b = (sizes[k] for k in active)
            top = max(abs(a), abs(b))
            move([b / top, -a / top] if top else [1.0, -1.0])
        else:
            p[active[0]] = 1.0 if rng.random() < p[active[0]] else 0.0
            active.clear()
    return p


def flight(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's flight; its order and its random numbers depend on its rows only, so that reruns agree."""
    pdf = pdf.sort_values(["mark", "doc_id", "size"], kind="stable").reset_index(drop=True)
    rng = random.Random(f"{pdf['mark'].iloc[0]}:{len(pdf)}:{int(pdf['round'].iloc[0])}")
    pdf["chance"] = fly(pdf["bulk"].astype(float).tolist(), pdf["chance"].tolist(), rng, bool(pdf["last"].iloc[0]))
    return pdf


#: Ids travel as strings: in pandas, long ids beside a null one would become floats.
UNIT = "doc_id string, source string, size long, n long, source_size long, target double, whole long, bulk double, chance double, mark long, blocks long, round long, last boolean, block long"


def copies(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, n, source_size, target, copies of every distinct (doc_id, source, size); n rows have it.

    Rows that agree in all three are one unit, taken or left together. Sources of size 0 have target 0 and take
    nothing. Only these small columns are shuffled; a hot source is dealt over blocks of about `block` units.
    """
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(sizes, weights, share, most)
    many = sizes.groupBy("source").agg(F.count("*").alias("rows"))
    about = staged(targets.join(many.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = units.join(about.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", F.least(rate, F.lit(most)))
    whole = F.floor(F.col("rate") + EDGE)
    pending = joined.select(
        F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "n", "source_size", "target", whole.cast("long").alias("whole"), (F.col("size") * F.col("n")).cast("double").alias("bulk"),
        F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("chance"), F.xxhash64("doc_id", "source", "size").alias("mark"), F.ceil(F.col("rows") / F.lit(float(block))).cast("long").alias("blocks"),
    )
    done: DataFrame | None = None
    turn = 0
    while True:
        turn += 1
        dealt = pending.withColumns({"round": F.lit(turn).cast("long"), "last": F.col("blocks") <= 1, "block": F.pmod(F.xxhash64("mark", F.lit(turn)), F.col("blocks"))})
        flown = staged(dealt.groupBy("source", "block").applyInPandas(flight, UNIT), "flown")
        settled = flown.where((F.col("chance") <= 0) | (F.col("chance") >= 1))
        done = settled if done is None else done.unionByName(settled)
        open_ = flown.where((F.col("chance") > 0) & (F.col("chance") < 1))
        if open_.isEmpty():
            break
        # two of a block are left; a source whose blocks were few comes together now
        pending = open_.withColumn("blocks", F.ceil(F.col("blocks") * 2 / F.lit(float(block))).cast("long")).drop("round", "last", "block")
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "n", "source_size", "target", (F.col("whole") + F.col("chance").cast("long")).alias("copies"))


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))


def mix_report(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, **cols: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies of every row.

    A null text has size 0; a null source is a source of its own, the last. A null id is an id like any other. Repeated
    rows share their fate. An empty
    table gives no rows. Reruns agree: blocks and random numbers come from hashes of the rows.
    """
    made = copies(staged(sized(df, **cols), "sizes"), weights, share, most)
    each = made.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with all columns; rows that are not taken go."""
    marked = docs.withColumn("__size", word_count(F.col("text")))
    made = copies(staged(sized(docs), "sizes"), weights, share, most).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__of"), F.col("copies").alias("__copies"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__of"))
    return marked.join(made, on).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[docs[c] for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
