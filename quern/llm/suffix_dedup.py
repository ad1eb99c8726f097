"""Exact substring dedup: every byte that a repeated LENGTH-byte string covers, but for the string's first place.

Finding where to look. Winnowing picks anchors in every text: positions whose GRAM bytes have the least hash of some
window. Any LENGTH-byte string holds an anchor that depends on its bytes alone, so equal strings share it. Anchors
seen once are done. An anchor's context is all that a LENGTH-byte string around it can reach; a context seen before
(by the 64-bit hashes of its gram and of itself) repeats as a whole.

Deciding. The first places of the other contexts are dealt by anchor, so that all strings that can be equal meet in
one suffix bucket. A task takes its buckets in order, a bounded block of them at a time: it sorts the suffixes of the
block that start a string. A difference cover of the positions modulo PERIOD is ranked first, by doubling; suffixes are
then sorted by their anchor, their distance from it and the bytes up to the next covered position, and ties, the long
repeats, are resolved by the ranks there. Neighbours that agree in LENGTH bytes are equal strings; all but the first
repeat. A bucket of more than MOST_CONTEXTS contexts is refined until its members can be told apart by counting: its
strings are dealt by their own digest, so no task holds the bucket, however large it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import drop_staged, free_shuffles, keep, map_texts, mix64, read_table, staged

LENGTH, GRAM = 100, 30
WINDOW = LENGTH - GRAM + 1
#: A perfect difference cover: every distance modulo PERIOD is one between two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of contexts that a task sorts at once.
BLOCK_BYTES = 1 << 20
#: Distinct contexts of an anchor that one task sorts together; the buckets of more are refined.
MOST_CONTEXTS = 2000
_rng = np.random.default_rng(20240301)
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers from 0 to n."""
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        for i, b in enumerate((BASE, INVERSE)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, hashes of their grams and of their contexts.

    Of places in one text that agree in anchor and context all are returned; texts too short for a repeat have none.
    """
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    buf = np.frombuffer(data, dtype=np.uint8)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[buf] * up[:n], out=sums[1:])
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = window_least(grams, WINDOW)
    # a place is an anchor if it is the last of the least in some window
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    most = ~window_least(~np.r_[edge, least, edge], WINDOW)  # largest of the windows that hold the place
    at = np.flatnonzero(most == grams)
    left, right = np.maximum(at - (LENGTH - GRAM), 0), np.minimum(at + LENGTH, n)
    contexts = mix64(mix64((sums[right] - sums[left]) * down[left]) + (right - at).astype(np.uint64) * np.uint64(1 << 32) + (at - left).astype(np.uint64) + np.uint64(1))
    return at, grams[at], contexts


def text_names(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, name (hash of the text) and whole_sha256 of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("name"), F.sha2(text.cast("binary"), 256).alias("whole_sha256"))


def found_anchors(docs: DataFrame) -> DataFrame:
    """gram, context, doc_id, place (position * 128 + bytes from there that a context holds), name of every anchor.

    A task puts a text out again only for a smaller id than before; the first place of anything is never lost.
    """
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            cols: list[list[np.ndarray]] = [[], [], [], []]
            waiting = 0
            for i, doc_id in enumerate(ids):
                data = texts[i].as_py() or b""
                mark = hashlib.blake2b(data, digest_size=12).digest()
                if len(data) < LENGTH or seen.get(mark, doc_id + 1) <= doc_id:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen[mark] = doc_id
                at, gram, context = anchors(data)
                # within a text equal contexts: the first is enough for others, the later ones repeat it
                for c, v in zip(cols, (gram.view(np.int64), context.view(np.int64), np.full(len(at), doc_id), at * 128 + np.minimum(len(data) - at, LENGTH)), strict=True):
                    c.append(v)
                waiting += len(at)
                if waiting > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=schema)
                    cols, waiting = [[], [], [], []], 0
            if waiting:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=schema)

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, "gram long, context long, doc_id long, place long")


def words_of(buf: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from every position as a number that sorts like them; buf is padded."""
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out |= buf[k : n + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of keys (the most significant first); equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Ranks by position of the suffixes at the cover's positions, by their first 4 * PERIOD bytes; 0 elsewhere.

    A covered position moved by a period is covered, so ranks by one period double twice.
    """
    by_place = np.zeros(len(words) + 4 * PERIOD, dtype=np.int64)
    rank = dense(words[samples], words[samples + 8], words[samples + 16], words[samples + 24] >> np.uint64(8))
    for reach in (PERIOD, 2 * PERIOD):
        by_place[samples] = rank + 1
        pair = by_place[samples] * (len(samples) + 2) + by_place[samples + reach]
        rank = np.unique(pair, return_inverse=True)[1]
    by_place[samples] = rank + 1
    return by_place


def repeats(contexts: list[bytes], before: np.ndarray, bucket: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which places of the joined contexts start a LENGTH-byte string that starts earlier in the block's buckets.

    before: bytes in a context before its anchor; bucket: its anchor's number; doc and start: where it begins.
    Contexts are laid out so that all anchors stand at the same place modulo PERIOD: strings at equal distance from
    their anchors, the only ones that can be equal but for periodic texts, reach the same covered position.
    """
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    offsets, at = np.empty(len(contexts), dtype=np.int64), 0
    for i, (n, b) in enumerate(zip(sizes.tolist(), before.tolist(), strict=True)):
        at += -(at + b) % PERIOD
        offsets[i] = at
        at += n
    total = at + LENGTH + PERIOD + 32
    buf = np.zeros(total + 8, dtype=np.uint8)
    for o, c in zip(offsets.tolist(), contexts, strict=True):
        buf[o : o + len(c)] = np.frombuffer(c, dtype=np.uint8)
    words = words_of(buf, total)
    positions = np.arange(total - LENGTH)
    in_cover = np.zeros(PERIOD, dtype=bool)
    in_cover[list(COVER)] = True
    rank_at = cover_ranks(words, positions[in_cover[positions % PERIOD]])
    # starts of strings: LENGTH bytes are left in the context
    many = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), many)
    flagged = np.zeros(len(owner), dtype=bool)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    if not len(owner):
        return np.stack([owner, inside])
    p = offsets[owner] + inside
    # the next covered place from each, and the bytes up to there: eight at most in head, the others in rest
    step = np.array([min(d for d in range(PERIOD) if in_cover[(r + d) % PERIOD]) for r in range(PERIOD)])
    residue = p % PERIOD
    reach = step[residue]
    head = np.where(reach > 0, words[p] >> (64 - 8 * np.clip(reach, 1, 8)).astype(np.uint64), np.uint64(0))
    rest = np.where(reach > 8, words[p + 8] >> (64 - 8 * np.clip(reach - 8, 1, 8)).astype(np.uint64), np.uint64(0))
    rank = rank_at[p + reach]
    place = bucket[owner] * PERIOD + residue
    order = np.lexsort((rank, rest, head, place))
    first, second = order[:-1], order[1:]
    same = (place[second] == place[first]) & (head[second] == head[first]) & (rest[second] == rest[first])
    # equal ranks agree beyond a string's end; of others the bytes tell whether they differ before it
    ask = np.flatnonzero(same & (rank[second] != rank[first]))
    x, y = p[first[ask]], p[second[ask]]
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        alike = words[x + k] == words[y + k]
        same[ask[~alike]] = False
        ask, x, y = ask[alike], x[alike], y[alike]
    # of a run of equal strings the first place stays
    new = np.r_[True, ~same]
    run = np.cumsum(new) - 1
    d, at_ = doc[owner][order], (start[owner] + inside)[order]
    least = np.minimum.reduceat(d, np.flatnonzero(new))[run]
    least_at = np.minimum.reduceat(np.where(d == least, at_, np.iinfo(np.int64).max), np.flatnonzero(new))[run]
    flagged[order] = (d != least) | (at_ != least_at)
    return np.stack([owner[flagged], inside[flagged]])


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals [a, b) as maximal ones."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], np.r_[b[:-1][new[1:]], b[-1]]


def sorted_buckets(rows: DataFrame) -> DataFrame:
    """doc_id, a, b: runs of bytes of the contexts (gram, doc_id, place, bytes) that repeat earlier ones of a bucket."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def block(gram: np.ndarray, doc: np.ndarray, place: np.ndarray, contexts: list[bytes]) -> pa.RecordBatch:
        at = place // 128
        start = np.maximum(at - (LENGTH - GRAM), 0)
        owner, inside = repeats(contexts, at - start, np.unique(gram, return_inverse=True)[1], doc, start)
        a = start[owner] + inside
        out = [np.zeros(0, dtype=np.int64)] * 3
        if len(a):
            order = np.lexsort((a, owner))
            a, owner = a[order], owner[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (a[1:] > a[:-1] + LENGTH)]
            last = np.r_[new[1:], True]
            out = [doc[owner[new]], a[new], a[last] + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []

        def taken(parts: list) -> tuple:
            return (*(np.concatenate([p[i] for p in parts]) for i in range(3)), [c for p in parts for c in p[3]])

        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                parts.append((*(part.column(i).to_numpy() for i in range(3)), part.column(3).to_pylist()))
                size += part.column(3).nbytes
                if size < BLOCK_BYTES or parts[0][0][0] == parts[-1][0][-1]:  # one bucket, which may go on
                    continue
                gram, doc, place, contexts = taken(parts)
                cut = int(np.flatnonzero(gram == gram[-1])[0])  # the last bucket may go on
                if cut:
                    yield block(gram[:cut], doc[:cut], place[:cut], contexts[:cut])
                parts = [(gram[cut:], doc[cut:], place[cut:], contexts[cut:])]
                size = sum(map(len, contexts[cut:]))
        if parts:
            yield block(*taken(parts))

    return rows.repartition("gram").sortWithinPartitions("gram").select("gram", "doc_id", "place", "bytes").mapInArrow(run, "doc_id long, a long, b long")


def by_strings(rows: DataFrame) -> DataFrame:
    """The same as sorted_buckets(), one row a string, for the contexts (gram, doc_id, place, bytes) of large buckets.

    Strings of a bucket meet by their 128-bit digest; first places are found by partial aggregates.
    """
    begin = F.greatest(F.floor(F.col("place") / 128).cast("long") - (LENGTH - GRAM), F.lit(0))
    starts = F.sequence(F.lit(0), F.octet_length("bytes") - LENGTH)
    each = rows.where(F.octet_length("bytes") >= LENGTH).withColumn("begin", begin).withColumn("k", F.explode(starts))
    found = each.select(F.unhex(F.md5(F.substring("bytes", F.col("k") + 1, F.lit(LENGTH)))).alias("string"), "doc_id", (F.col("begin") + F.col("k")).alias("a"))
    strings = staged(found, "strings")
    first = strings.groupBy("string").agg(F.min(F.struct("doc_id", "a")).alias("first"), F.max(F.struct("doc_id", "a")).alias("last")).where("first <> last").select("string", "first")
    return strings.join(first, "string").where(F.struct("doc_id", "a") != F.col("first")).select("doc_id", "a", (F.col("a") + LENGTH).alias("b"))


def removals(docs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, runs) with the sorted repeated runs [a, b) of a text, and (doc_id, name, packed) of the texts that may hold them."""
    anchor = found_anchors(docs)
    live = staged(anchor.withColumn("many", F.expr("count(1) over (partition by gram)")).where("many > 1").drop("many"), "live")
    free_shuffles(docs.sparkSession)  # all anchors; those that are alive are written
    of_context = live.groupBy("gram", "context").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    several = of_context.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1").select("gram", (F.col("contexts") > MOST_CONTEXTS).alias("large"))
    wanted = of_context.join(several, "gram").select("gram", "context", "large", F.col("first.doc_id").alias("doc_id"), F.col("first.place").alias("place"))
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "context", "place", "large")).alias("asked"))
    touched = live.select("doc_id").distinct().join(asked, "doc_id", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("packed", pa.binary()), ("gram", pa.list_(pa.int64())), ("place", pa.list_(pa.int64())), ("large", pa.list_(pa.bool_())), ("bytes", pa.list_(pa.binary()))])

    def cut(ids: list[int], texts: list[bytes | None], names: list[int], asked_: list) -> dict:
        pack = zstandard.ZstdCompressor(level=3)
        out: dict = {n: [] for n in schema.names}
        for doc_id, t, name, want in zip(ids, texts, names, asked_, strict=True):
            t = t or b""
            want = want or []
            if want:  # rows may share an id; a context that is not this text's is another's
                at, gram, context = anchors(t)
                mine = set(zip((at * 128 + np.minimum(len(t) - at, LENGTH)).tolist(), context.view(np.int64).tolist(), strict=True))
                want = [w for w in want if (w["place"], w["context"]) in mine]
            for n, v in (("doc_id", doc_id), ("name", name), ("packed", pack.compress(t)), ("gram", [w["gram"] for w in want]), ("place", [w["place"] for w in want]), ("large", [w["large"] for w in want]), ("bytes", [t[max(0, w["place"] // 128 - (LENGTH - GRAM)) : w["place"] // 128 + LENGTH] for w in want])):
                out[n].append(v)
        return out

    texts = docs.withColumn("name", F.xxhash64(F.coalesce("text", F.lit("")))).join(touched, "doc_id")
    held = staged(map_texts(texts, cut, schema, "doc_id long, name long, packed binary, gram array<long>, place array<long>, large array<boolean>, bytes array<binary>", ["name", "asked"]), "held")
    free_shuffles(docs.sparkSession)  # all texts
    contexts = held.select("doc_id", F.explode(F.arrays_zip("gram", "place", "large", "bytes")).alias("c")).select("c.gram", "doc_id", "c.place", "c.large", "c.bytes")
    by_sort = sorted_buckets(contexts.where("not large").drop("large")).unionByName(by_strings(contexts.where("large").drop("large")))
    later = live.join(of_context, ["gram", "context"]).where(F.struct("doc_id", "place") != F.col("first"))
    at = F.floor(F.col("place") / 128).cast("long")
    whole = later.select("doc_id", F.greatest(at - (LENGTH - GRAM), F.lit(0)).alias("a"), (at + F.col("place") % 128).alias("b")).where(F.col("b") - F.col("a") >= LENGTH)
    runs = by_sort.unionByName(whole).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("runs"))
    runs = staged(runs, "runs")
    drop_staged(live)
    return runs, held.select("doc_id", "name", "packed")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: also kept, the remaining bytes) of every row.

    A byte goes if a LENGTH-byte string of the input covers it that starts earlier: in a smaller doc_id, or in the
    same text at an earlier place. Null texts count as empty; texts under LENGTH bytes stay whole; of equal texts the
    one with the least id is judged as it is, the others go as a whole. Rows that repeat id and text share their
    result; of rows that share an id but not a text, a run that is found in one is cut from all at its place; rows
    without an id stay whole; an empty table gives no rows; other columns are not read.
    """
    docs = keep(df, id_col, text_col)
    named = staged(text_names(docs), "texts")
    long = named.where(F.col("n_bytes") >= LENGTH)  # shorter ones, empty ones above all, have nothing to meet for
    origin = long.groupBy("whole_sha256").agg(F.min("doc_id").alias("origin"))
    runs, held = removals(docs, named)
    kinds = "doc_id long, name long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[list] = [[], [], [], [], [], []]
                for doc_id, name, packed, cuts_ in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    t = unpack.decompress(packed)
                    a, b = merged(np.array([x["a"] for x in cuts_], dtype=np.int64), np.array([x["b"] for x in cuts_], dtype=np.int64))
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(t)]
                    kept = b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    for c, v in zip(rows, (doc_id, name, len(t) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        c.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                n = 6 if with_text else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows[:n], types[:n], strict=True)], names=["doc_id", "name", "n_removed", "n_spans", "kept_sha256", "kept"][:n])

    cut = held.join(runs, "doc_id").dropDuplicates(["doc_id", "name"]).select("doc_id", "name", "packed", "runs").mapInArrow(apply, kinds)
    cut = cut.withColumnsRenamed({"doc_id": "d", "name": "m"})
    told = long.join(origin, "whole_sha256").unionByName(named.where(F.col("n_bytes") < LENGTH).withColumn("origin", F.col("doc_id")))
    joined = told.join(cut, (F.col("doc_id") == F.col("d")) & (F.col("name") == F.col("m")), "left")
    copy = F.coalesce(F.col("origin") != F.col("doc_id"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    nothing = F.sha2(F.lit(b""), 256)
    cols = ["doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256")]
    if with_text:
        cols.append(F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return joined.select(*cols)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))
