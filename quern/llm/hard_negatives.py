"""Hard-negative mining by vantage-point trees over norm-augmented integer vectors.

With M the greatest norm, a row x gets one more component, sqrt(M^2 - |x|^2), and an anchor q a zero: the squared
distance of the two is |q|^2 + M^2 - 2 q.x, so that rows by score are rows by distance, nearest first, and a window of
scores is an annulus around the anchor.

A vantage-point tree over a bounded sample deals all rows to leaves; of each leaf the range of distances to every
vantage point above it is known, and leaves are cut further, by a hash, into blocks of about BLOCK_ROWS rows. An anchor
goes to the leaves that its annulus meets. There a tree over the block's rows is traversed nearest first: a heap holds
subtrees by the highest score that their bounds allow and rows by their exact score, subtrees outside the annulus are
not opened, and the walk ends when the k rows that it is for have come out. Bounds are floats with a slack, scores are
integers and decide.

Two walks are made: one for positives, k rows of the anchor's label, from the anchor outward; one for negatives, for
all windows of an anchor at once, from the greatest positive's score outward. The sample also gives each walk a score
that its k-th row reaches at least, so that far leaves need not be asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import read_table, staged
from quern.llm.int_vectors import integers, kept_vectors

K, LEAST, OF = 5, 80, 100
#: Rows of the sample that the upper tree is fitted on and that gives first bounds; its leaves at most.
SAMPLE, MOST_LEAVES = 4096, 256
#: Rows of a block, about, and of a leaf of its tree at most.
BLOCK_ROWS, BUCKET = 4096, 64
#: Of M: what float distances may be wrong by, far more than they are.
SLACK = 1e-6
#: Stands for a null id, which comes last.
NO_ID = (1 << 63) - 1
LOWEST = -(1 << 62)


def augmented(x: np.ndarray, most: int) -> np.ndarray:
    """The further component of every row; most: the greatest squared norm."""
    return np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0).astype(np.float64))


def rows_apart(x: np.ndarray, a: np.ndarray, v: np.ndarray, b: float | np.ndarray, most: int) -> np.ndarray:
    """Distances of augmented rows (x, a) to augmented rows or one row (v, b)."""
    dots = (x * v).sum(axis=1).astype(np.float64)
    return np.sqrt(np.maximum(2.0 * (most - dots - a * b), 0.0))


def vantage(x: np.ndarray, a: np.ndarray, rows: np.ndarray, most: int) -> tuple[int, np.ndarray]:
    """A vantage point for some rows, of five the one whose distances spread most, and the rows' distances to it."""
    best: tuple[float, int, np.ndarray] | None = None
    for i in rows[np.linspace(0, len(rows) - 1, min(5, len(rows))).astype(int)].tolist():
        far = rows_apart(x[rows], a[rows], x[i], a[i], most)
        if best is None or far.std() > best[0]:
            best = (float(far.std()), i, far)
    return best[1], best[2]


class Upper:
    """A balanced tree of vantage points in heap order from 1; 2 ** depth leaves."""

    def __init__(self, x: np.ndarray, most: int, depth: int):
        self.most, self.depth, n = most, depth, 1 << depth
        self.points, self.extra, self.radius = np.zeros((n, x.shape[1]), dtype=np.int64), np.zeros(n), np.zeros(n)
        a = augmented(x, most)
        members = {1: np.arange(len(x))}
        for node in range(1, n):
            rows = members.pop(node)
            if not len(rows):
                rows = np.arange(len(x))[:1]
            at, far = vantage(x, a, rows, most)
            self.points[node], self.extra[node], self.radius[node] = x[at], a[at], float(np.median(far))
            inside = far <= self.radius[node]
            members[2 * node], members[2 * node + 1] = rows[inside], rows[~inside]

    def deal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of every row, from 0, and its distances to the vantage points above (rows x depth)."""
        node, a, far = np.ones(len(x), dtype=np.int64), augmented(x, self.most), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            far[:, level] = rows_apart(x, a, self.points[node], self.extra[node], self.most)
            node = 2 * node + (far[:, level] > self.radius[node])
        return node - (1 << self.depth), far

    def meets(self, q: np.ndarray, tops: np.ndarray, floors: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        """Which leaves (anchors x leaves) may hold a row with a score from floors to tops.

        least and greatest: the range of distances of a leaf's rows to the vantage points above it (leaves x depth).
        """
        near, far = np.zeros((len(q), len(least))), np.full((len(q), len(least)), np.inf)
        squares = (q * q).sum(axis=1)
        for level in range(self.depth):
            node = (np.arange(len(least)) + (1 << self.depth)) >> (self.depth - level)
            d = np.sqrt(np.maximum(squares[:, None] + self.most - 2.0 * (q.astype(np.float64) @ self.points[node].T.astype(np.float64)), 0.0))
            near = np.maximum(near, np.maximum(least[None, :, level] - d, d - greatest[None, :, level]))
            far = np.minimum(far, d + greatest[None, :, level])
        slack = SLACK * float(self.most) ** 0.5 + SLACK
        return (reached(squares[:, None], self.most, near - slack) >= floors[:, None]) & (reached(squares[:, None], self.most, far + slack) <= tops[:, None])


def reached(square, most: int, distance):
    """The score of a row at a distance of an anchor with that squared norm."""
    return (square + most - np.maximum(distance, 0.0) ** 2) / 2


class Tree:
    """A vantage-point tree over a block's rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, most: int):
        self.most, a = most, augmented(x, most)
        self.slack = SLACK * float(most) ** 0.5 + SLACK
        order: list[np.ndarray] = []
        #: Of every node: its vantage point's place in points and its two children with their distances from there, or a range of rows.
        self.nodes: list[tuple] = []
        points: list[int] = []
        size = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal size
            at = len(self.nodes)
            self.nodes.append(())
            if len(rows) > BUCKET:
                point, far = vantage(x, a, rows, most)
                cut = np.argsort(far, kind="stable")
                half = len(rows) // 2
                place = len(points)
                points.append(point)
                sides = [(float(far[c[0]]), float(far[c[-1]]), grow(rows[c])) for c in (cut[:half], cut[half:])]
                self.nodes[at] = (place, *sides)
            else:
                self.nodes[at] = (size, size + len(rows))
                order.append(rows)
                size += len(rows)
            return at

        grow(np.arange(len(ids)))  # halves: as deep as the logarithm of a block's rows
        rows = np.concatenate(order)
        # within these norms a float holds every product and sum, by Cauchy and Schwarz; beyond them integers do
        self.ids, self.labels, self.x = ids[rows], labels[rows], x[rows].astype(np.float64) if most < 1 << 52 else x[rows]
        self.points = x[points].astype(np.float64)

    def walk(self, q: np.ndarray, label: int, own: bool, me: int | None, top: int, floor: int) -> Iterator[tuple[int, int]]:
        """(score, id) of the rows of the label (own) or of other labels, with scores from top down to floor, best first; ties by id."""
        square = int((q * q).sum())
        exact = q.astype(self.x.dtype)
        away = np.sqrt(np.maximum(square + self.most - 2.0 * (self.points @ q.astype(np.float64)), 0.0)).tolist()
        high = (square + self.most) / 2
        heap: list[tuple] = [(float("-inf"), 0, 0, 0.0, float("inf"))]
        while heap:
            key, kind, at, near, far = heappop(heap)
            if kind:
                yield -key, at
                continue
            node = self.nodes[at]
            if len(node) == 3:
                d = away[node[0]]
                for lo, hi, child in node[1:]:
                    n, f = max(near, lo - d, d - hi), min(far, d + hi)
                    best = high - max(n - self.slack, 0.0) ** 2 / 2
                    if best >= floor and high - (f + self.slack) ** 2 / 2 <= top:
                        heappush(heap, (-best, 0, child, n, f))
                continue
            a, b = node
            scores = self.x[a:b] @ exact
            fits = (scores <= top) & (scores >= floor) & ((self.labels[a:b] == label) == own)
            if me is not None:
                fits &= self.ids[a:b] != me
            for k in np.flatnonzero(fits).tolist():
                heappush(heap, (-int(scores[k]), 1, int(self.ids[a + k]), 0.0, 0.0))


def rows_of(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label (moved on where the id is divisible by 7) and v of the rows that take part."""
    kept = kept_vectors(df, id_col, vector_col, label_col).where("label is not null")
    label = F.col("label").cast("long")
    return kept.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "v")


def packed(rows: DataFrame, width: int) -> DataFrame:
    """vec_id, label, vec (the integers' bytes) and square (their squared norm)."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary()), ("square", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(2), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()), pa.array((x * x).sum(axis=1))], schema=schema)

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, vec binary, square long")


def unpacked(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=np.int32) for b in column.to_pylist()]).astype(np.int64) if len(column) else np.zeros((0, 1), dtype=np.int64)


def filled(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


class Index:
    """All rows, dealt to blocks by a tree over a sample."""

    def __init__(self, rows: DataFrame, width: int, k: int = K):
        spark = rows.sparkSession
        self.spark, self.k = spark, k
        flat = staged(packed(rows, width), "vectors")
        told = flat.agg(F.count("*").alias("n"), F.max("square").alias("most")).first()
        self.most = int(told.most)
        sample = flat.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).collect()
        self.sample_x = np.stack([np.frombuffer(r.vec, dtype=np.int32) for r in sample]).astype(np.int64)
        self.sample_ids = np.array([NO_ID if r.vec_id is None else r.vec_id for r in sample])
        self.sample_labels = np.array([r.label for r in sample])
        depth = min(MOST_LEAVES.bit_length() - 1, max(0, (-(-told.n // BLOCK_ROWS) - 1).bit_length()), max(0, len(sample).bit_length() - 3))
        self.upper = Upper(self.sample_x, self.most, depth)
        dealt = staged(self._dealt(flat), "dealt")
        ranges = [f(f"far{i}").alias(f"{n}{i}") for i in range(depth) for n, f in (("lo", F.min), ("hi", F.max))]
        leaves = dealt.groupBy("leaf").agg(F.count("*").alias("n"), *ranges).collect()  # a row a leaf
        self.least, self.greatest = np.full((1 << depth, depth), np.inf), np.full((1 << depth, depth), -np.inf)
        self.parts = np.zeros(1 << depth, dtype=np.int64)
        for r in leaves:
            self.parts[r.leaf] = -(-r.n // BLOCK_ROWS)
            self.least[r.leaf], self.greatest[r.leaf] = [r[f"lo{i}"] for i in range(depth)], [r[f"hi{i}"] for i in range(depth)]
        cut = F.broadcast(spark.createDataFrame([(r.leaf, int(self.parts[r.leaf])) for r in leaves], "leaf int, parts long"))  # MOST_LEAVES rows
        block = F.shiftleft(F.col("leaf").cast("long"), 32) + F.pmod(F.xxhash64("vec_id", "vec"), F.col("parts"))
        self.blocks = dealt.join(cut, "leaf").select(block.alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("mark"), "label", "vec", F.lit(None).cast("array<long>").alias("tops"), F.lit(None).cast("array<long>").alias("floors"))
        self.many = int(self.parts.sum())
        self.flat = flat

    def _dealt(self, flat: DataFrame) -> DataFrame:
        upper = self.upper
        names = [f"far{i}" for i in range(upper.depth)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, far = upper.deal(unpacked(batch.column(2))) if batch.num_rows else (np.zeros(0, dtype=np.int64), np.zeros((0, upper.depth)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), *(pa.array(far[:, i]) for i in range(upper.depth))], names=["vec_id", "label", "vec", "leaf", *names])

        return flat.select("vec_id", "label", "vec").mapInArrow(run, ", ".join(["vec_id long, label long, vec binary, leaf int", *(f"{n} double" for n in names)]))

    def _sent(self, queries: DataFrame, bounded) -> DataFrame:
        """Queries (id, mark, label, vec, tops) with their floors, once for every block that they have to ask."""
        upper, least, greatest, parts = self.upper, self.least, self.greatest, self.parts
        schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("label", pa.int64()), ("vec", pa.binary()), ("tops", pa.list_(pa.int64())), ("floors", pa.list_(pa.int64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    q = unpacked(batch.column(3))
                    tops = batch.column(4).to_pylist()
                    floors = bounded(q, batch.column(0).to_numpy(), batch.column(2).to_numpy(), tops)
                    keep = np.array([len(t) > 0 for t in tops])
                    high, low = np.array([max(t, default=0) for t in tops], dtype=np.float64), np.array([min(f, default=0) for f in floors], dtype=np.float64)
                    asks = upper.meets(q, high, low, least, greatest) & (parts > 0)[None, :] & keep[:, None]
                    row, leaf = np.nonzero(asks)
                    many = parts[leaf]
                    row, leaf = np.repeat(row, many), np.repeat(leaf, many)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    for a in range(0, len(row), 4096):
                        r = pa.array(row[a : a + 4096])
                        block = (leaf[a : a + 4096].astype(np.int64) << 32) + part[a : a + 4096]
                        columns = [pa.array(block), pa.array(np.ones(len(r), dtype=np.int32)), *(batch.column(i).take(r) for i in range(5)), pa.array(floors, pa.list_(pa.int64())).take(r)]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

        return queries.select("id", "mark", "label", "vec", "tops").mapInArrow(run, "block long, kind int, id long, mark long, label long, vec binary, tops array<long>, floors array<long>")

    def _asked(self, sent: DataFrame, answer) -> DataFrame:
        """window, id, mark, other and score: what the blocks answer. A block's rows come first and make its tree."""
        most = self.most
        schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("window", pa.int32()), ("other", pa.int64()), ("score", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, tree = None, None
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for batch in batches:
                out: list[tuple] = []
                key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
                edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
                for a, b in zip(edges, edges[1:], strict=False):
                    part = batch.slice(a, b - a)
                    now = part.column(0)[0].as_py()
                    if now != block:
                        block, tree, held = now, None, []
                    if part.column(1)[0].as_py() == 0:
                        held.append((filled(part.column(2)), part.column(4).to_numpy(), unpacked(part.column(5))))
                        continue
                    if tree is None:
                        tree = Tree(*(np.concatenate([h[i] for h in held]) for i in range(3)), most)
                    for q, me, mark, label, tops, floors in zip(unpacked(part.column(5)), *(part.column(i).to_pylist() for i in (2, 3, 4, 6, 7)), strict=True):
                        out += [(me, mark, *x) for x in answer(tree, q, me, label, tops, floors)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                others = [None if x == NO_ID else x for x in cols[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols[:3], others, cols[4]], schema, strict=True)], schema=schema)

        both = self.blocks.unionByName(sent)
        dealt = both.repartition(max(self.many, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "block").sortWithinPartitions("block", "kind")
        return dealt.mapInArrow(run, "id long, mark long, window int, other long, score long")

    def first(self, answers: DataFrame, keys: list[str]) -> DataFrame:
        """The first k answers of each key, by score and id, with their rank."""
        w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("other").asc_nulls_last())
        return answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)

    def positives(self, anchors: DataFrame) -> DataFrame:
        """id, mark, other, score and rank of the first k other rows of the anchors' labels; anchors: id, mark, label, vec."""
        k, x, ids, labels, most = self.k, self.sample_x, self.sample_ids, self.sample_labels, self.most

        def bounded(q: np.ndarray, me: np.ndarray, label: np.ndarray, tops: list) -> list[list[int]]:
            scores = np.where((labels[None, :] == label[:, None]) & (ids[None, :] != me[:, None]), q @ x.T, LOWEST)
            return [[int(s)] for s in (np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else [LOWEST] * len(q))]

        def answer(tree: Tree, q: np.ndarray, me: int, label: int, tops: list[int], floors: list[int]) -> Iterator[tuple[int, int, int]]:
            for _, (score, other) in zip(range(k), tree.walk(q, label, True, me, tops[0], floors[0]), strict=False):
                yield 0, other, score

        queries = anchors.withColumn("tops", F.array(F.lit(most + 1)))  # no score is above the greatest squared norm
        return self.first(self._asked(self._sent(queries, bounded), answer), ["id", "mark"])

    def negatives(self, anchors: DataFrame, positives: DataFrame, least: int = LEAST, of: int = OF) -> DataFrame:
        """id, mark, window (the positive's rank), other, score and rank of the first k rows of other labels in each positive's window."""
        k, x, labels = self.k, self.sample_x, self.sample_labels

        def bounded(q: np.ndarray, me: np.ndarray, label: np.ndarray, tops: list) -> list[list[int]]:
            scores = q @ x.T
            out = []
            for s, own, windows in zip(scores, label, tops, strict=True):
                s = np.sort(s[labels != own])
                floors = []
                for p in windows:
                    n = int(np.searchsorted(s, p, side="right"))
                    floors.append(max(-(-least * p // of), int(s[n - k]) if n >= k else LOWEST))
                out.append(floors)
            return out

        def answer(tree: Tree, q: np.ndarray, me: int, label: int, tops: list[int], floors: list[int]) -> Iterator[tuple[int, int, int]]:
            left = {w: k for w, (t, f) in enumerate(zip(tops, floors, strict=True)) if t >= f}
            if not left:
                return
            for score, other in tree.walk(q, label, False, None, max(tops[w] for w in left), min(floors[w] for w in left)):
                for w in list(left):
                    if score < floors[w]:
                        del left[w]
                    elif score <= tops[w]:
                        yield w + 1, other, score
                        left[w] -= 1
                        if not left[w]:
                            del left[w]
                if not left:
                    return

        tops = positives.groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")).select("id", "mark", F.col("p.score").alias("tops"))
        return self.first(self._asked(self._sent(anchors.join(tops, ["id", "mark"]), bounded), answer), ["id", "mark", "window"])


def mine(df: DataFrame, anchors: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", k: int = K, least: int = LEAST, of: int = OF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Rows with a null label, or a vector that is null, empty or holds null or non-finite components, take no part, nor
    do rows whose vector has another length than that of the least vec_id. anchors: which of the columns vec_id, label
    and v make an anchor; by default ids divisible by 100. Rows that share an anchor's id are not its positives. Rows
    that repeat id, label and vector are one anchor, but each may be a positive or a negative; rows without an id are
    no anchors and come last among equal scores. A positive whose window is empty, as it is below a score of 0, gives
    no rows, nor does an empty table. Components beyond int_vectors.LARGEST count as that. Other columns are not read.
    """
    rows = rows_of(df, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).limit(1).collect()
    if not first:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = first[0].n
    rows = rows.where(F.size("v") == width)
    index = Index(rows, width, k)
    asked = index.flat if anchors is None else packed(rows.where(anchors), width)
    asked = asked.where("vec_id is not null") if anchors is not None else asked.where("vec_id % 100 = 0")
    asked = staged(asked.select(F.col("vec_id").alias("id"), F.xxhash64("label", "vec").alias("mark"), "label", "vec").distinct(), "anchors")
    positives = staged(index.positives(asked).select("id", "mark", "other", "score", "rank"), "positives")
    negatives = index.negatives(asked, positives, least, of)
    named = positives.select("id", "mark", F.col("rank").alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["id", "mark", "window"]).select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS own, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE own AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
found AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""
