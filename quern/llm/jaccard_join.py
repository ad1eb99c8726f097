"""Similarity self-join of documents on word n-grams by parity sketches.

A document's set of shingles is XOR-hashed into the words of a sketch: each shingle goes to one of B blocks and flips
that block's word by its own hash. One more shingle on either side changes one word at most, so the number of words in
which two sketches differ is a lower bound of the symmetric difference of their sets. Sizes are dealt into bands; in a
band the difference of two linked sets is at most D, and B is larger than D, so that linked sets agree in a whole word
(pigeonhole): documents are joined on (band, block, word). Blocks without a shingle agree for nothing, so a document
draws its blocks anew, by the next seed, until fewer than B - D of them are empty; it joins under all seeds up to there,
and of two linked sets the one that needs fewer seeds has a word with shingles in common with the other. As linked sets
differ in D words at most, they agree in one of their D + 1 rarest words, so only these are join keys.

A second sketch of single bits prunes candidates by Hamming distance; what is left is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import components, drop_staged, keep, map_texts, mix64, read_table, staged, text_chunks

SKETCH_BITS, MOST_BITS = 1024, 4096
#: Rows of a kind under a join key that one task compares with each other; more are compared tile by tile.
TILE = 2048
#: Groups of up to so many rows are compared many at a time.
SMALL = 48
#: Sets whose sketches a task has put out already are not put out again while it remembers them.
REMEMBERED = 1 << 18
RATIO = math.sqrt(2)
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=8)
def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, BASE, dtype=np.uint64))


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (A-Z lower-cased); fewer words are one shingle."""
    data = b" ".join((t or b"").lower() for t in texts)
    buf = np.frombuffer(data, dtype=np.uint8)
    ends_of = np.cumsum([len(t or b"") + 1 for t in texts])
    full = ~IS_BLANK[buf]
    edge = np.diff(np.r_[np.int8(0), full.view(np.int8), np.int8(0)])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    sizes = ends - starts
    inner = buf[full]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(inner)) - np.repeat(first, sizes)
    table = powers(1 << int(place.max() + 1).bit_length())
    words = mix64(np.add.reduceat(BYTE_VALUES[inner] * table[place], first) + sizes.astype(np.uint64))
    bounds = np.r_[0, np.searchsorted(starts, ends_of)]
    combined = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for j in range(k):
        combined = combined * BASE + words[j : len(words) - k + 1 + j]
    combined = mix64(combined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(combined[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            h = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                h = mix64(h * BASE + words[i : i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit names of a set; equal sets have equal names."""
    other = mix64(s + BASE)
    both = np.array([np.add.reduce(s, dtype=np.uint64), np.bitwise_xor.reduce(s), np.add.reduce(other, dtype=np.uint64), np.bitwise_xor.reduce(other)], dtype=np.uint64)
    h = mix64(both[::2] * BASE + both[1::2] + np.uint64(len(s)))
    return int(h.view(np.int64)[0]), int(h.view(np.int64)[1])


class Bands:
    """Bands of set sizes for links of num/den: least and largest size, D and B of each."""

    def __init__(self, num: int, den: int):
        if not 0.6 * den <= num <= den:
            raise ValueError("the pigeonhole needs a similarity from 0.6 to 1")
        self.num, self.den = num, den
        self.low: list[int] = [1]
        self.most: list[int] = []
        self.blocks: list[int] = []

    def at(self, i: int) -> tuple[int, int, int, int]:
        while len(self.blocks) <= i:
            low = self.low[-1]
            high = max(low, math.ceil(low * RATIO) - 1)
            d = high * (self.den - self.num) // self.num
            b = self.enough(low, d)
            self.low.append(high + 1)
            self.most.append(d)
            self.blocks.append(b)
        return self.low[i], self.low[i + 1] - 1, self.most[i], self.blocks[i]

    @staticmethod
    def enough(n: int, d: int) -> int:
        """Blocks so many that n shingles leave fewer than B - D of them empty, by two deviations if that is possible.

        Half as many more than D at least, so that the words of a passage that many share can be spared.
        """
        best, at = -1e9, d + 1
        for b in range(d + d // 2 + 4, 8 * (d + n) + 16):
            fill = n / b
            empty = b * math.exp(-fill)
            spread = math.sqrt(max(empty * (1 - (1 + fill) * math.exp(-fill)), 0.01))
            score = (b - d - empty) / spread
            if score > best:
                best, at = score, b
            if score >= 2 or b > 4 * n + d and score < best:
                break
        return at

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n shingles can have a partner that is no larger, and its own."""
        found, i = [], 0
        while True:
            low, high, d, _ = self.at(i)
            if high * self.den >= n * self.num and d:
                found.append(i)
            if high >= n:
                return found
            i += 1


@lru_cache(maxsize=8)
def bands_of(num: int, den: int) -> Bands:
    return Bands(num, den)


def sketch_keys(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join keys of a set: hashes of (band, seed, block, word) of its blocks that hold shingles.

    And of each key its sketch (band and seed), and how many of that sketch's keys are more than D + 1: linked sets
    differ in D words at most, so that they agree in one of the first D + 1 in any order of all keys.
    """
    found, sketch, spare = [], [], []
    for i in bands.of(len(s)):
        _, _, d, b = bands.at(i)
        seed = 0
        while True:
            h = mix64(s + np.uint64((seed * 2654435761 + i * 40503 + 1) & 0xFFFFFFFF))
            block = ((h >> np.uint64(32)) * np.uint64(b) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            at = block[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            word = np.bitwise_xor.reduceat(mix64(h[order] + BASE), first)
            found.append(mix64(word + mix64(at[first].astype(np.uint64) + np.uint64(seed << 48) + np.uint64(i << 36))))
            sketch.append(np.full(len(first), i << 12 | seed, dtype=np.int32))
            spare.append(np.full(len(first), len(first) - d - 1, dtype=np.int32))
            if b - len(first) < b - d:  # empty blocks are fewer than the words that must agree
                break
            seed += 1
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    return np.concatenate(found), np.concatenate(sketch), np.concatenate(spare)


def bit_sketch(s: np.ndarray) -> bytes:
    """Parities, each shingle flips one bit: SKETCH_BITS, doubled up to MOST_BITS while sets that link may differ in over a twelfth of them.

    A sketch of twice the size folds to one of the size by XOR of its halves.
    """
    size = SKETCH_BITS
    while size < MOST_BITS and size < 2 * len(s):
        size *= 2
    bit = (mix64(s ^ BASE) >> np.uint64(20)) % np.uint64(size)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(both) - common)


def names(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, mark (hash of the text), n (set size), fp and check (the set's name and another) of every row of keep()."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("check", pa.int64())])

    def run(ids: list[int], texts: list[bytes | None], marks: list[int]) -> dict:
        sets = shingle_sets(texts, k)
        both = [fingerprint(s) for s in sets]
        return {"doc_id": ids, "mark": marks, "n": list(map(len, sets)), "fp": [x for x, _ in both], "check": [x for _, x in both]}

    return map_texts(docs.withColumn("mark", F.xxhash64("text")), run, schema, "doc_id long, mark long, n long, fp long, check long", ["mark"])


def keys(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """key, fp, sketch and spare for every join key of every set; a task puts a set out once."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("sketch", pa.int32()), ("spare", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = bands_of(num, den), set()
        for batch in batches:
            for a, b in text_chunks(batch, 0, 256, 1 << 20):
                made, of = [], []
                for s in shingle_sets(batch.column(0).slice(a, b - a).cast(pa.binary()).to_pylist(), k):
                    fp = fingerprint(s)[0] if len(s) else None
                    if fp is None or fp in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(fp)
                    own = sketch_keys(s, bands)
                    made.append(own)
                    of.append(np.full(len(own[0]), fp, dtype=np.int64))
                if made:
                    key, sketch, spare = (np.concatenate([x[i] for x in made]) for i in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(of)), pa.array(sketch), pa.array(spare)], schema=schema)

    return docs.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "key long, fp long, sketch int, spare int")


def rarest(shared: DataFrame) -> DataFrame:
    """key, fp, least of the keys by which sets have to meet, of rows of keys().

    Keys that one set has come first in the order of all keys, the others by how many rows have them. Of a sketch the
    last ones, its commonest, go as far as they are spare, so that words of a passage that many documents share are no
    keys, and sets without enough keys in common with any other meet nobody.
    """
    over = "over (partition by key)"
    held = shared.select("*", F.expr(f"min(fp) {over}").alias("least"), F.expr(f"max(fp) {over}").alias("largest"), F.expr(f"count(1) {over}").alias("many")).where("least <> largest")
    last = F.dense_rank().over(Window.partitionBy("fp", "sketch").orderBy(F.col("many").desc(), "key"))  # rows may repeat
    left = held.withColumn("last", last).where("last > spare").select("key", "fp")
    return left.withColumns({"least": F.expr(f"min(fp) {over}"), "largest": F.expr(f"max(fp) {over}")}).where("least <> largest").select("key", "fp", "least")


def fetch(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """fp, n, sketch and packed text (zstd) of the documents of wanted (doc_id, fp, check).

    A task puts a set out once, however often its row repeats.
    """
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("packed", pa.binary())])
    done: set[int] = set()

    def run(ids: list[int], texts: list[bytes | None], fps: list[int], checks: list[int]) -> dict:
        pack = zstandard.ZstdCompressor(level=3)
        out: dict = {n: [] for n in schema.names}
        for s, t, *name in zip(shingle_sets(texts, k), texts, fps, checks, strict=True):
            if name[0] not in done and list(fingerprint(s)) == name:  # of rows that share an id only the one that is meant
                done.add(name[0])
                for n, v in (("fp", name[0]), ("n", len(s)), ("sketch", bit_sketch(s)), ("packed", pack.compress(t or b""))):
                    out[n].append(v)
        return out

    return map_texts(docs.join(wanted, "doc_id"), run, schema, "fp long, n long, sketch binary, packed binary", ["fp", "check"])


def verify(pairs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (x, y) of sets that link, by their whole texts."""
    left = nodes.select(F.col("fp").alias("x"), F.col("packed").alias("tx"))
    right = nodes.select(F.col("fp").alias("y"), F.col("packed").alias("ty"))
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, hub = None, None
        for batch in batches:
            xs, ys, tx, ty = (batch.column(i) for i in range(4))
            hits = []
            for at, end in text_chunks(batch, 2, 256, 1 << 20):
                part = slice(at, end)
                y_list = ys[part].to_pylist()
                sets = shingle_sets([unpack.decompress(t) for t in tx[part].to_pylist()], k)
                for i, (s, y) in enumerate(zip(sets, y_list, strict=True)):
                    if y != last:
                        last, hub = y, shingle_sets([unpack.decompress(ty[at + i].as_py())], k)[0]
                    if linked(s, hub, num, den):
                        hits.append(at + i)
            yield pa.RecordBatch.from_arrays([xs.take(pa.array(hits, pa.int64())), ys.take(pa.array(hits, pa.int64()))], schema=schema)

    return pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


class Forest:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def widths(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By sketch size in words: the rows whose sketch has that size or more, and their sketches folded to it."""
    sizes = np.fromiter((len(s) // 8 for s in sketches), dtype=np.int64, count=len(sketches))
    out, size = {}, SKETCH_BITS // 64
    while size * 64 <= MOST_BITS and len(rows := np.flatnonzero(sizes >= size)):
        out[size] = rows, np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], dtype=np.uint64).reshape(-1, size), axis=0) for i in rows.tolist()])
        size *= 2
    return out


def bound(i: np.ndarray, j: np.ndarray, n: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray]], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs of rows i and j that pass the Hamming bound at every size both sketches have; their relative distance."""
    far = np.zeros(len(i), dtype=np.int64)
    for rows, bits in levels.values():
        if not len(i):
            break
        at, to = np.searchsorted(rows, i), np.searchsorted(rows, j)
        most = len(rows) - 1
        has = np.flatnonzero((rows[np.minimum(at, most)] == i) & (rows[np.minimum(to, most)] == j))
        for lo in range(0, len(has), 1 << 14):
            part = has[lo : lo + (1 << 14)]
            far[part] = np.bitwise_count(bits[at[part]] ^ bits[to[part]]).sum(1, dtype=np.int64)
        good = far * (den + num) <= (n[i] + n[j]) * (den - num)
        i, j, far = i[good], j[good], far[good]
    return i, j, far / np.maximum(n[i] + n[j], 1)


def candidates(start: np.ndarray, label: np.ndarray, n: np.ndarray, side: np.ndarray, one: np.ndarray, sketches: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a group (start: first rows) that differ in label and side and pass the Hamming bound; their distance.

    one: in groups of one tile every row is a side of its own. Small groups are paired at once, by distance of rows; in
    larger ones the rows of the commonest label are met by the others.
    """
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    ends = np.r_[start[1:], len(label)]
    size, end_of = np.repeat(ends - start, ends - start), np.repeat(ends, ends - start)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (label[i] != label[j]) & (one[i] | (side[i] != side[j])) & (np.minimum(n[i], n[j]) * den >= num * np.maximum(n[i], n[j]))

    rows = np.arange(len(label))
    for step in range(1, min(SMALL, int(size.max(initial=0)))):
        i = rows[(size <= SMALL) & (rows + step < end_of)]
        i = i[fits(i, i + step)]
        found.append((i, i + step))
    levels = widths(sketches)
    out = [bound(np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found]), n, levels, num, den)] if found else []
    for lo, hi in zip(start.tolist(), ends.tolist(), strict=True):
        if hi - lo <= SMALL:
            continue
        _, kind, many = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
        most = kind == int(many.argmax())
        for i in (np.flatnonzero(~most) + lo).tolist():
            js = np.arange(lo, hi)
            js = js[most | (js > i)]
            js = js[fits(np.full(len(js), i), js)]
            out.append(bound(np.full(len(js), i), js, n, levels, num, den))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def forests(label: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray, many: int) -> list[int]:
    """Which pairs (i, j) to try: edges of so many disjoint spanning forests over the labels, the nearest pairs first."""
    names, kind = np.unique(label, return_inverse=True)
    a, b = np.minimum(kind[i], kind[j]), np.maximum(kind[i], kind[j])
    left = np.lexsort((far, b, a)) if many == 1 else np.argsort(far, kind="stable")
    if many == 1:  # of two labels one pair is enough for a forest
        left = left[np.r_[True, (a[left][1:] != a[left][:-1]) | (b[left][1:] != b[left][:-1])]]
        left = left[np.argsort(far[left], kind="stable")]
    taken: list[int] = []
    for _ in range(many):
        forest, later = Forest(len(names)), []
        for at in left.tolist():
            (taken if forest.join(int(a[at]), int(b[at])) else later).append(at)
        if not later:
            break
        left = np.array(later)
    return taken


def compare(rows: DataFrame, failed: DataFrame, num: int, den: int, many: int) -> DataFrame:
    """Pairs (x, y), with labels p and q, to verify of rows (key, fp, label, n, sketch) that share a key and a tile (a, b).

    In a key, the rows of its commonest label meet all others, and these each other; more than TILE rows of a kind are
    dealt into tiles by a hash of fp, and every two tiles meet in one group. A group puts out no more than many spanning
    forests over its labels, of pairs that pass the Hamming bound and are not in failed (key, a, b, x, y).
    """
    schema = pa.schema([("key", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("p", pa.int64()), ("q", pa.int64())])
    kinds = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    sizes = kinds.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"))
    tiles = sizes.select("key", F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("top.c")) / F.lit(float(TILE))).cast("int").alias("few"), F.ceil(F.col("top.c") / F.lit(float(TILE))).cast("int").alias("lot"))
    of_main = F.col("label") == F.col("main")
    mine = rows.join(tiles, "key").withColumn("mine", F.when(of_main, F.col("few") + F.pmod(F.xxhash64("fp"), F.col("lot"))).otherwise(F.pmod(F.xxhash64("fp"), F.col("few"))).cast("int"))
    others = F.when(of_main, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") + F.col("lot") - 1))
    dealt = mine.where("few > 0").withColumn("other", F.explode(others)).select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "fp", "label", "n", "sketch")

    bad = failed.select("key", "a", "b", F.lit(None).cast("int").alias("mine"), F.col("x").alias("fp"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("sketch"), "y")
    met = dealt.withColumn("y", F.lit(None).cast("long")).unionByName(bad).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def tried(t: pa.Table) -> pa.RecordBatch:
        """Of whole groups."""
        known = pa.compute.is_valid(t.column("y"))
        wrong, t = t.filter(known), t.filter(pa.compute.invert(known))
        key, a, b, side, fp, label, n = (t.column(c).to_numpy() for c in ("key", "a", "b", "mine", "fp", "label", "n"))
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(key)]
        i, j, far = candidates(start, label, n, np.where(a == b, np.arange(len(a)), side), a == b, t.column("sketch").to_pylist(), num, den)
        x, y = np.maximum(fp[i], fp[j]), np.minimum(fp[i], fp[j])
        if wrong.num_rows and len(i):
            cols = ("key", "a", "b", "fp", "y")
            before = set(zip(*(wrong.column(c).to_pylist() for c in cols), strict=True))
            new = np.fromiter((p not in before for p in zip(key[i].tolist(), a[i].tolist(), b[i].tolist(), x.tolist(), y.tolist(), strict=True)), dtype=bool, count=len(i))
            i, j, far, x, y = (v[new] for v in (i, j, far, x, y))
        group = np.searchsorted(start, i, side="right")
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0, True]) if len(order) else np.zeros(1, dtype=np.int64)
        taken: list[int] = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = order[lo:hi]
            taken += at.tolist() if hi - lo == 1 else at[forests(label, i[at], j[at], far[at], many)].tolist()
        at = np.array(taken, dtype=np.int64)
        cols = (key[i[at]], a[i[at]], b[i[at]], x[at], y[at], label[i[at]], label[j[at]])
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4 * TILE):
                part = batch.slice(lo, 4 * TILE)
                held.append(part)
                rows_held += part.num_rows
                if rows_held < 4 * TILE:
                    continue
                t = pa.Table.from_batches(held)
                key, a, b = (t.column(c).to_numpy() for c in ("key", "a", "b"))
                last = (key == key[-1]) & (a == a[-1]) & (b == b[-1])
                cut = int(np.flatnonzero(last)[0])  # the last group may go on; it has 2 * TILE rows at most, and what failed
                if cut:
                    yield tried(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                rows_held = t.num_rows - cut
        if held:
            yield tried(pa.Table.from_batches(held))

    return met.select("key", "a", "b", "mine", "fp", "label", "n", "sketch", "y").mapInArrow(run, "key long, a int, b int, x long, y long, p long, q long")


def all_links(live: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(fp, label) of every node: its component by all links between sets, of rows (key, fp, least) of shared join keys.

    Under every key each set first meets the key's least set. Sets of a key that are in different components after
    that are tried along spanning forests: if every tried pair of a group of sets links, then its other pairs are
    connected without a trial; if one fails, the group is tried again without it, with more forests, until
    none is left to try. So no link between different components is lost, and no round puts out all pairs of a group.
    """
    first = staged(verify(live.where("fp <> least").select(F.col("fp").alias("x"), F.col("least").alias("y")).distinct(), nodes, k, num, den), "links")
    labels = components(first, "x", "y").withColumnRenamed("node", "fp")
    labels = staged(nodes.select("fp").distinct().join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "labels")
    failed = live.sparkSession.createDataFrame([], "key long, a int, b int, x long, y long")
    open_, many = live.select("key", "fp"), 1
    while True:
        told = open_.join(labels, "fp")
        mixed = told.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
        rows = staged(told.join(mixed, "key", "left_semi").join(nodes.select("fp", "n", "sketch"), "fp").select("key", "fp", "label", "n", "sketch"), "mixed")
        tried = staged(compare(rows, failed, num, den, many), "tried")
        good = staged(verify(tried.select("x", "y").distinct(), nodes, k, num, den), "links")
        to = components(tried.join(good, ["x", "y"], "left_semi"), "p", "q").select(F.col("node").alias("label"), F.col("label").alias("to"))
        before, labels = labels, staged(labels.join(to, "label", "left").select("fp", F.coalesce("to", "label").alias("label")), "labels")
        wrong = staged(tried.join(good, ["x", "y"], "left_anti").select("key", "a", "b", "x", "y"), "failed")
        for done in (before, tried, good):
            drop_staged(done)
        if wrong.isEmpty():
            drop_staged(rows)
            return labels
        failed, many = failed.unionByName(wrong), many * 16
        open_ = rows.select("key", "fp").join(wrong.select("key").distinct(), "key", "left_semi")


def grouped(df: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), n, fp, check, and component_id, one row for every row of df."""
    docs = keep(df, id_col, text_col)
    named = staged(names(docs, k), "names")
    live = staged(rarest(keys(docs, k, num, den)), "live")
    full = named.where("n > 0")
    # two sets with one name: the one that is looked at is that of the least (doc_id, check), the others link with nothing
    sets = full.groupBy("fp", "check").agg(F.min("doc_id").alias("doc_id"))
    reps = sets.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "check")).alias("r")).select("fp", "r.doc_id", "r.check")
    nodes = staged(fetch(docs, live.select("fp").distinct().join(reps, "fp"), k), "nodes")
    labels = all_links(live, nodes, k, num, den)
    drop_staged(live)
    drop_staged(nodes)
    members = staged(sets.join(reps.select("fp", "check").join(labels, "fp"), ["fp", "check"]), "members")
    least = staged(members.groupBy("label").agg(F.min("doc_id").alias("least")), "least")  # so that the join can split a large component
    found = members.join(least, "label").select("fp", "check", "least")
    told = sets.join(found, ["fp", "check"], "left").select("fp", "check", F.coalesce("least", "doc_id").alias("component_id"))
    linked_ = full.join(told, ["fp", "check"], "left")
    cols = ["doc_id", "mark", "n", "fp", "check"]
    alone = named.where("n = 0").select(*cols, F.col("doc_id").alias("component_id"))
    return linked_.select(*cols, F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(alone)


def similar(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the least doc_id that links of num/den reach.

    Documents with equal sets are one node; all_links() finds the links between nodes, so groups of copies make no
    pairs among each other, and no link between different components is lost.

    Null, empty and blank texts have no shingle, no link, and are their own component. Repeated rows stay, rows that
    share an id but not a text are nodes of their own; rows without an id share the component of their equals, if they
    have some, and else have none; an empty table gives no rows; other columns are not read.
    """
    return grouped(df, k, num, den, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of linked documents: that of the least doc_id.

    Of rows that share that id and link, the one whose text has the least hash stays, and one of its repetitions;
    rows whose id another, unlinked text shares are judged by their own text. Rows without an id stay.
    """
    rows = staged(grouped(docs, k, num, den).where("doc_id is not null and n > 0").select("doc_id", "mark", "component_id"), "groups")
    first = rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("mark").alias("mark"), F.count("*").alias("c"))
    other = rows.where("doc_id = component_id").join(first.where("c > 1").select("component_id", F.col("mark").alias("m")), "component_id").where("mark <> m")
    gone = rows.where("doc_id <> component_id").select("doc_id", "mark").unionByName(other.select("doc_id", "mark")).distinct()
    again = staged(rows.groupBy("doc_id", "mark").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), "again")
    marked = docs.withColumns({"__at": F.col("doc_id").cast("long"), "__of": F.xxhash64(F.col("text").cast("string"))})
    left = marked.join(gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), (F.col("__at") == F.col("__id")) & (F.col("__of") == F.col("__mark")), "left_anti")
    if not again.isEmpty():
        same = (F.col("__at") == F.col("__id")) & (F.col("__of") == F.col("__mark"))
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["__at", "__of"]))
    return left.select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read_table(spark, sf_dir, "documents"), 4, 85, 100)
