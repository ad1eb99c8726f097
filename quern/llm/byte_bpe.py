"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the vocabulary's pattern. A minimal perfect hash over the vocabulary resolves every pre-token
that is a token itself; the others are merged by a heap of candidate pairs over a linked list of bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import keep, map_texts, sha256

#: Bytes of resolved stretches (white space and what follows) that a Python worker keeps, each with ENTRY more for
#: itself; beyond it they are forgotten and resolved anew. Stretches of over KEPT bytes are never kept.
CACHE_BYTES, ENTRY, KEPT = 160 << 20, 200, 256
NONE: dict[int, int] = {}
LOW, SPREAD = 0xFFFFFFFF, 0x9E3779B97F4A7C15
#: Fixed value: the pattern of the vocabulary's files, for which texts may be split into units first.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A place between a character that is no white space and a white space always parts two matches of the pattern.
UNIT = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space beyond ASCII; texts with it are split as a whole.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class PerfectHash:
    """A minimal perfect hash by displacement: bucket, then (own value xor the bucket's displacement) mod n.

    Built largest bucket first; a bucket's displacement is the first that sends its keys to free places. Buckets of
    one key name their place directly, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.keys, self.buckets = keys, max(1, n // 2)
        self.slots = [-1] * n
        self.shift = [0] * self.buckets
        by: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            by[(h >> 32) % self.buckets].append((h & LOW, i))
        for b in sorted((b for b in range(self.buckets) if len(by[b]) > 1), key=lambda b: -len(by[b])):
            d = 0
            while len(free := {p for low, _ in by[b] if self.slots[p := ((low ^ d) * SPREAD >> 13) % n] < 0}) < len(by[b]):
                d += 1
            self.shift[b] = d
            for low, i in by[b]:
                self.slots[((low ^ d) * SPREAD >> 13) % n] = i
        free = [p for p in range(n) if self.slots[p] < 0]
        for b in range(self.buckets):
            if len(by[b]) == 1:
                p = free.pop()
                self.shift[b], self.slots[p] = -1 - p, by[b][0][1]

    def get(self, key: bytes) -> int:
        """The key's place in the list, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        i = self.slots[((h & LOW ^ d) * SPREAD >> 13) % self.n if d >= 0 else -1 - d]
        return i if self.keys[i] == key else -1


@dataclass
class ByteBpe:
    """Ranks, tokens and the pattern. Ids are the ranks of the file."""

    tokens: dict[int, bytes]
    whole: PerfectHash
    ids: list[int]
    pairs: dict[int, dict[int, int]]  # by left id, then right id
    byte_ids: list[int]
    pattern: regex.Pattern
    texts: list[bytes]
    decimals: list[bytes]
    kind: str
    units: bool  # the pattern is the one for which UNIT is right
    cache: dict[bytes, bytes] = field(default_factory=dict)
    held: int = 0  # bytes of the cache

    @classmethod
    def load(cls, rank_file: str, pattern: str) -> ByteBpe:
        with open(rank_file, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in rows}
        keys = list(ranks)
        pairs: dict[int, dict[int, int]] = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs.setdefault(a, {})[b] = r
        top = max(ranks.values()) + 1
        texts = [b""] * top
        for t, r in ranks.items():
            texts[r] = t
        return cls({r: t for t, r in ranks.items()}, PerfectHash(keys), [ranks[k] for k in keys], pairs, [ranks[bytes([i])] for i in range(256)], regex.compile(pattern), texts, [b"%d" % i for i in range(top)], "H" if top <= 1 << 16 else "I", pattern == SPLIT)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: lowest rank first, leftmost among equals.

        An entry of the heap holds rank and place; it is stale once the pair at its place has another rank.
        """
        sym = list(map(self.byte_ids.__getitem__, piece))
        n = len(sym)
        bits = 12 if n < 4096 else 40  # small integers where they do
        low = (1 << bits) - 1
        rows, none = self.pairs, NONE
        push, pop = heapq.heappush, heapq.heappop
        now = [rows.get(a, none).get(b, -1) for a, b in zip(sym, sym[1:], strict=False)]
        now.append(-1)
        heap = [r << bits | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            rank, i = top >> bits, top & low
            if now[i] != rank:
                continue
            j = after[i]
            sym[i], sym[j], now[j] = rank, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = r = rows.get(rank, none).get(sym[k], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = r = rows.get(sym[h], none).get(rank, -1)
                if r >= 0:
                    push(heap, r << bits | h)
        return [s for s in sym if s >= 0]

    def resolve(self, text: str) -> bytes:
        """Ids of a text that is split by the pattern: whole pre-tokens first, merges for the others."""
        found: list[int] = []
        for piece in self.pattern.findall(text):
            data = piece.encode()
            i = self.whole.get(data)
            if i >= 0:
                found.append(self.ids[i])
            else:
                found += self.merge(data)
        return array(self.kind, found).tobytes()

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a whole UTF-8 text, without special tokens."""
        if not self.units or not text.isascii() and WIDE_SPACE.search(text.decode()):
            return np.frombuffer(self.resolve(text.decode()), dtype=self.kind)
        units = UNIT.findall(text)
        cache = self.cache
        if self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        rare: dict[bytes, bytes] = {}
        for u in set(units).difference(cache):
            found = self.resolve(u.decode())
            if len(u) > KEPT:
                rare[u] = found
            else:
                cache[u] = found
                self.held += len(u) + len(found) + ENTRY
        parts = (rare[u] if u in rare else cache[u] for u in units) if rare else map(cache.__getitem__, units)
        return np.frombuffer(b"".join(parts), dtype=self.kind)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))


_models: dict[tuple[str, str], ByteBpe] = {}


def model(rank_file: str, pattern: str) -> ByteBpe:
    """The worker's own copy; vocabulary files are installed on every machine."""
    return _models.get((rank_file, pattern)) or _models.setdefault((rank_file, pattern), ByteBpe.load(rank_file, pattern))


def encode_texts(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of token ids) of every row; a null text has none. One pass without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        m = model(rank_file, pattern)
        return {"doc_id": ids, "ids": [m.encode(t or b"").astype(np.int32) for t in texts]}

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, data (bytes) of the ids of every row of encode_texts(); null ids give no bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        m = model(rank_file, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], schema=schema)

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encodes, then decodes the ids.

    A null text is encoded as an empty one (no ids, digests of no bytes). Repeated rows stay; an empty table gives
    no rows; other columns are not read. Ids of a text live only while its row is made, so no shuffle and no disk.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        m = model(rank_file, pattern)
        out: dict = {n: [] for n in schema.names}
        out["doc_id"] = ids
        for t in texts:
            found = m.encode(t or b"").tolist()
            out["n_tokens"].append(len(found))
            out["ids_sha256"].append(sha256(b" ".join(map(m.decimals.__getitem__, found))))
            out["decoded_sha256"].append(sha256(m.decode(found)))
        return out

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from quern.llm.common import read_table

    return digests(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
