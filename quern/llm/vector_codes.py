"""Vector code compression: a product quantiser over integer vectors with partial-distance search.

Vectors are cut into equal consecutive parts, and a part's code is the index of the nearest entry of that part
position's codebook. The search takes a part's dimensions in descending variance of the codebook: the first one gives
each vector an entry to try, whose complete distance is the best so far; entries whose accumulated distance strictly
exceeds it are masked out before the next dimension, and the entry with the least accumulated distance is completed in
turn, which lowers the best further. Entries that tie with the best stay, so that the lowest index wins.

Codebooks are a few numbers an entry and go to the tasks with the code; of a round each task puts out sums and counts
by entry, which Spark adds up. Nothing of the vectors is shuffled, and all sums are of integers, so that reruns agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read_table, staged
from quern.llm.int_vectors import integers, kept_vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors whose distances to a codebook are held at once.
CHUNK = 4096


def order_of(book: np.ndarray) -> list[int]:
    """Dimensions of a codebook (entries x dimensions) in descending variance, ties by place."""
    spread = book.astype(np.float64).var(axis=0) if len(book) else np.zeros(book.shape[1])
    return np.argsort(-spread, kind="stable").tolist()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lowest of those that tie, and its squared distance for every row of x."""
    first, *others = order_of(book)
    apart = (x[:, first, None] - book[None, :, first]) ** 2

    def complete(entry: np.ndarray) -> np.ndarray:
        return ((x - book[entry]) ** 2).sum(axis=1)

    best = complete(apart.argmin(axis=1))
    row, entry = np.nonzero(apart <= best[:, None])
    so_far = apart[row, entry]
    for d in others:
        so_far = so_far + (x[row, d] - book[entry, d]) ** 2
        live = so_far <= best[row]
        row, entry, so_far = row[live], entry[live], so_far[live]
        # every row has an entry left: the one that set its best distance, or one that ties with it
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(so_far, starts)
        ahead = np.flatnonzero(so_far == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        ahead = ahead[np.r_[True, row[ahead[1:]] != row[ahead[:-1]]]]
        best = np.minimum(best, complete(entry[ahead]))
        live = so_far <= best[row]
        row, entry, so_far = row[live], entry[live], so_far[live]
    done = np.flatnonzero(so_far == best[row])
    done = done[np.r_[True, row[done[1:]] != row[done[:-1]]]]
    return entry[done], best


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) of integer vectors, and their squared distances summed over parts."""
    codes, error = np.empty((len(x), len(books)), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    width = x.shape[1] // len(books)
    for p, book in enumerate(books):
        codes[:, p], away = nearest(x[:, p * width : (p + 1) * width], book)
        error += away
    return codes, error


def decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The integer vectors that codes stand for."""
    return np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1)


def sized_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """The rows that are encoded, and their width: that of the least vec_id among those that can be cut into parts."""
    rows = kept_vectors(df, id_col, vector_col, label_col).where(F.size("v") % parts == 0)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).limit(1).collect()
    width = first[0].n if first else 0
    return rows.where(F.size("v") == width), width


def tallies(rows: DataFrame, width: int, books: list[np.ndarray]) -> DataFrame:
    """slot (part and entry), place and total of a round's assignment: sums by place in a part, at place -1 the count."""
    parts, entries, w = len(books), len(books[0]), width // len(books)
    schema = pa.schema([("slot", pa.int32()), ("place", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, w + 1), dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                x = integers(batch.column(0).slice(lo, CHUNK), width)
                codes, _ = encode(x, books)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    sorted_ = codes[order, p]
                    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                    sums[p, sorted_[starts], :w] += np.add.reduceat(x[order, p * w : (p + 1) * w], starts, axis=0)
                    sums[p, sorted_[starts], w] += np.diff(np.r_[starts, len(order)])
        flat = sums.reshape(parts * entries, w + 1)
        slot, place = np.nonzero(np.broadcast_to(flat[:, w:] > 0, flat.shape))
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(np.where(place == w, -1, place), pa.int32()), pa.array(flat[slot, place])], schema=schema)

    return rows.select("v").mapInArrow(run, "slot int, place int, total long").groupBy("slot", "place").agg(F.sum("total").alias("total"))


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks by part. They start as the parts of the first rows by vec_id; every round assigns all rows and moves
    an entry to the floor of its parts' mean. Only sums, one row an entry and place, come to the driver."""
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = integers(pa.array([r.v for r in head], pa.list_(pa.float64())), width)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        sums = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]
        for r in tallies(rows, width, books).collect():
            sums[r.slot // len(start)][r.slot % len(start), r.place] = r.total  # place -1, the count, is the last
        books = [np.where(s[:, -1:] > 0, s[:, :-1] // np.maximum(s[:, -1:], 1), b) for s, b in zip(sums, books, strict=True)]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, width: int, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (hex, two digits a part) and error of every row."""
    names = ["vec_id", "label", "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = 2 * len(books)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                codes, error = encode(integers(part.column(2), width), books)
                text = codes.astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([text[k : k + digits] for k in range(0, len(text), digits)], pa.string()), pa.array(error)], names=names)

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every row that has a vector, and the codebooks; entries are 256 at most.

    Rows whose vector is null, empty, or holds null or non-finite components go; so do rows whose vector cannot be cut
    into the parts, or has another length than that of the least vec_id. Rows without an id come last in the order of
    ids, repeated ids are told apart by their vectors and stay as rows of their own. Fewer rows than entries make
    smaller codebooks, an empty table gives no rows. Components beyond LARGEST count as that. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    rows, width = sized_vectors(df, id_col, vector_col, label_col, parts)
    if not width:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), []
    books = fit(rows, width, parts, entries, rounds)
    return coded(rows, width, books), books


def code_report(df: DataFrame, **cols: str) -> DataFrame:
    """vec_id, code, error, label_error (the label's sum of errors, nulls together) and codebooks_sha256."""
    made, books = compress(df, **cols)
    made = staged(made, "codes")
    of_label = made.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return made.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(read_table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) AS nth
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
each AS (
  SELECT nth, CAST((i - 1) // (len(v) // 16) AS INTEGER) AS part, CAST((i - 1) % (len(v) // 16) AS INTEGER) AS place, v[i] AS x
  FROM (SELECT nth, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
books0 AS (SELECT part, CAST(nth - 1 AS INTEGER) AS entry, place, x AS c FROM each WHERE nth <= 64),
near1 AS (
  SELECT nth, part, arg_min(entry, d * 64 + entry) AS entry FROM (
    SELECT nth, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM each JOIN books0 USING (part, place) GROUP BY nth, part, entry) GROUP BY nth, part),
books1 AS (
  SELECT part, entry, place, coalesce(m, c) AS c FROM books0 LEFT JOIN (
    SELECT part, entry, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM each JOIN near1 USING (nth, part) GROUP BY part, entry, place) USING (part, entry, place)),
near2 AS (
  SELECT nth, part, arg_min(entry, d * 64 + entry) AS entry FROM (
    SELECT nth, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM each JOIN books1 USING (part, place) GROUP BY nth, part, entry) GROUP BY nth, part),
books2 AS (
  SELECT part, entry, place, coalesce(m, c) AS c FROM books1 LEFT JOIN (
    SELECT part, entry, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM each JOIN near2 USING (nth, part) GROUP BY part, entry, place) USING (part, entry, place)),
near3 AS (
  SELECT nth, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT nth, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM each JOIN books2 USING (part, place) GROUP BY nth, part, entry) GROUP BY nth, part),
coded AS (SELECT nth, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near3 GROUP BY nth),
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM books2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (nth), digest
"""
