"""Quality rules: base rules, and gradient-boosted trees over document statistics with monotonic constraints.

The trees are grown in numpy on binned statistics of a bounded sample of labelled documents, flattened into node
arrays, and walked for all rows and trees of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import keep, map_texts, read_table, text_chunks

#: Labelled rows that the trees learn from, at most: those with the least hashes of their ids.
TRAIN_ROWS = 16_000
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
DIGITS, CAPITALS, POINTS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and the direction in which the score may move with each: down, up or free.
FEATURES = {"words": 0, "chars_per_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "digit_share": 0, "capital_share": 0, "point_share": 0, "bar_share": -1, "longest_word": 0, "words_per_line": 0, "top_word_share": 0}


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows found twice or more, the first finds included."""
    if len(ids) < 4:
        return 0
    ids = ids.astype(np.int64)
    pair = ids[:-1] * distinct + ids[1:]
    if distinct < 1 << 21:
        code = pair[:-1] * distinct + ids[2:]
    else:
        code = np.unique(pair[:-1], return_inverse=True)[1] * distinct + ids[2:]
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    if not again.any():
        return 0
    inside = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= again
    return int(inside.sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """BASE as integers and FEATURES as numbers of one whole text; a null or empty text has zeros."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(BASE), [0.0] * len(FEATURES)
    places: dict[bytes, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in words), dtype=np.int64, count=n)
    bare = text.translate(None, BLANKS)
    chars = len(bare.decode())
    size = len(bare)
    symbols = size - len(bare.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    dups = len(lines) - len(set(lines))
    again = repeated_words(ids, len(places))
    share = lambda drop: (size - len(bare.translate(None, drop))) / size
    counts = np.bincount(ids)
    return [n, chars, symbols, dups, again], [float(np.log1p(n)), chars / n, symbols / chars, dups / len(lines), again / n, len(places) / n, share(DIGITS), share(CAPITALS), share(POINTS), text.count(b"|") / n, float(np.log1p(max(map(len, words)))), float(np.log1p(n / len(lines))), int(counts.max()) / n]


@dataclass
class Trees:
    """Boosted trees as flat node arrays; a leaf points at itself, so every walk takes depth steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality 1 for every row of statistics."""
        if not len(x):
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: int = 20) -> Trees:
    """Boosts regression trees on the logistic loss. signs: +1, -1 or 0 for each column.

    A split on a constrained column must order its children's values, and hands both children the bound halfway
    between, so that no later split below can break the order. Ties take the first column, then the lowest bin.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    rate_1 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(rate_1 / (1 - rate_1)))
    raw = np.full(n, base)
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    value: list[float] = []
    roots = []

    def leaf(v: float) -> int:
        feature.append(0)
        threshold.append(0.0)
        left.append(len(left))
        right.append(len(right))
        value.append(v)
        return len(value) - 1

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = leaf(rate * float(np.clip(g / (h + ridge), low, high)))
        best = (1e-6, -1, -1, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j in range(width):
                b = binned[rows, j]
                size = len(edges[j]) + 1
                gs, hs, ns = np.cumsum(np.bincount(b, grad[rows], size))[:-1], np.cumsum(np.bincount(b, hess[rows], size))[:-1], np.cumsum(np.bincount(b, minlength=size))[:-1]
                vl, vr = np.clip(gs / (hs + ridge), low, high), np.clip((g - gs) / (h - hs + ridge), low, high)
                gain = lambda v, g_, h_: v * g_ - 0.5 * (h_ + ridge) * v * v
                won = gain(vl, gs, hs) + gain(vr, g - gs, h - hs) - gain(np.clip(g / (h + ridge), low, high), g, h)
                won[(ns < least) | (len(rows) - ns < least) | (signs[j] * (vr - vl) < 0)] = -1
                if len(won) and (k := int(won.argmax())) >= 0 and won[k] > best[0]:
                    best = (float(won[k]), j, k, float(vl[k] + vr[k]) / 2)
        if best[1] < 0:
            raw[rows] += value[at]
            return at
        _, j, k, middle = best
        mine = binned[rows, j] <= k
        feature[at], threshold[at], value[at] = j, float(edges[j][k]), 0.0
        bounds = ((low, high), (low, high)) if not signs[j] else ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle))
        left[at] = grow(rows[mine], grad, hess, level + 1, *bounds[0])
        right[at] = grow(rows[~mine], grad, hess, level + 1, *bounds[1])
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(n), y - p, p * (1 - p), 0, -4.0, 4.0))
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), base, depth)


STAT_SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in BASE), ("stats", pa.list_(pa.float64()))])
STAT_TYPES = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", stats array<double>"


def document_statistics(df: DataFrame) -> DataFrame:
    """doc_id, BASE and stats (FEATURES in order) of every row of a DataFrame of keep()."""

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        found = [statistics(t) for t in texts]
        return {"doc_id": ids, **{n: [b[i] for b, _ in found] for i, n in enumerate(BASE)}, "stats": [s for _, s in found]}

    return map_texts(df, run, STAT_SCHEMA, STAT_TYPES)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from labels (doc_id, quality); of several labels of a document the least counts. None without both classes.

    docs is a DataFrame of keep(). The sample is bounded by rows, so its ids may be broadcast and its statistics
    (numbers only) gathered.
    """
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = {r.doc_id: r.y for r in sample.collect()}
    if len(set(chosen.values())) < 2:
        return None
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")
    got = document_statistics(docs.join(F.broadcast(ids), "doc_id", "left_semi")).where("n_words > 0").select("doc_id", "stats").collect()
    got.sort(key=lambda r: (r.doc_id, r.stats))
    x, y = np.array([r.stats for r in got]).reshape(len(got), len(FEATURES)), np.array([chosen[r.doc_id] for r in got], dtype=float)
    return fit(x, y, np.array(list(FEATURES.values()))) if len(set(y.tolist())) > 1 else None


def judge(df: DataFrame, trees: Trees | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, BASE, base_failed, score and kept of every row, in one pass without a shuffle.

    base_failed: fewer than 50 words, or over half of the words repeat. kept: not base_failed and a score of the
    trees from threshold on; without trees (no labels of both kinds) the base rules alone decide and score is 1.
    Null and empty texts fail the base rules. Repeated rows stay; an empty table gives no rows; other columns are not
    read. The trees (a few thousand numbers) travel with the task.
    """
    schema = pa.schema([*(f for f in STAT_SCHEMA if f.name != "stats"), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        found = [statistics(t) for t in texts]
        b = np.array([x for x, _ in found], dtype=np.int64).reshape(len(found), len(BASE))
        failed = (b[:, 0] < 50) | (100 * b[:, 4] > 50 * b[:, 0])
        score = trees.score(np.array([s for _, s in found]).reshape(len(found), len(FEATURES))) if trees is not None else np.ones(len(found))
        return {"doc_id": ids, **{n: b[:, i] for i, n in enumerate(BASE)}, "base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; one pass, no join."""
    trees = learn(keep(docs, "doc_id", "text"), labels)
    cols, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi in text_chunks(batch, at):
                part = batch.slice(lo, hi - lo)
                found = [statistics(t) for t in part.column(at).cast(pa.binary()).to_pylist()]
                b = np.array([x for x, _ in found], dtype=np.int64)
                good = ~((b[:, 0] < 50) | (100 * b[:, 4] > 50 * b[:, 0]))
                if trees is not None:
                    good &= trees.score(np.array([s for _, s in found])) >= threshold
                yield part.filter(pa.array(good))

    return docs.select(*cols).mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, learn(keep(docs, "doc_id", "text"), read_table(spark, sf_dir, "labels")))
