"""Token counts under a piece BPE model with byte fallback, by rank-synchronous array merging.

Texts are cut where no piece of the vocabulary can reach across: before a run of blanks and around newlines.
The distinct cuts of a chunk that are not known yet are held as one ragged numpy array of piece ids. In each
round every sequence applies its own lowest-rank pair; all sequences move together. What is left when no
sequence can merge are the tokens; characters without a piece count one token for each of their bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import keep, map_texts

#: Bytes of known cuts that a Python worker keeps (each with ENTRY more for itself); beyond it they are forgotten and
#: counted anew. Cuts of over KEPT bytes are never kept.
CACHE_BYTES, ENTRY, KEPT = 96 << 20, 150, 256
#: Longer cuts (text without blanks) are merged by themselves, rank by rank over linked places.
LONG = 1024
BLANK = "▁"
NEVER = np.iinfo(np.int32).max
SLOT_BITS, SPREAD = 20, np.uint64(0x9E3779B97F4A7C15)


@dataclass
class PieceTable:
    """A model's pieces as arrays; an id is a place in the list of mergeable pieces, best first."""

    char_ids: np.ndarray  # by code point; n - 1 where no piece is that character
    slot_keys: np.ndarray  # open addressing: left id * n + right id of every pair that makes a piece, or -1
    slot_made: np.ndarray  # the piece that the pair makes
    rank: np.ndarray  # by id; pieces of equal score share a rank
    alone: np.ndarray  # by id: some pair with this piece ranks no lower than it, so its merges go one at a time
    n: int
    cuts: re.Pattern
    dummy_prefix: bool
    cache: dict[bytes, int] = field(default_factory=dict)
    held: int = 0  # bytes of the cache

    @classmethod
    def load(cls, model_file: str) -> PieceTable:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        best = sorted((p for p in model.pieces if p.type == 1), key=lambda p: -p.score)
        pieces = [p.piece for p in best]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece has a blank inside")
        ids = {p: i for i, p in enumerate(pieces)}
        n = len(pieces) + 1
        pairs = {ids[p[:k]] * n + ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        keys = np.array(sorted(pairs), dtype=np.int64)
        made = np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)
        rank = np.r_[np.unique([-p.score for p in best], return_inverse=True)[1], 0].astype(np.int32)
        alone = np.zeros(n, dtype=bool)
        for side in (keys // n, keys % n):
            alone[side[rank[made] <= rank[side]]] = True
        # Runs of blanks merge from the left, so a longest blank piece followed by one more blank is a cut of its own.
        longest = max((len(p) for p in pieces if not p.strip(BLANK)), default=1)
        line = "" if any("\n" in p and len(p) > 1 for p in pieces) else r"\n"
        cuts = re.compile((" {%d}(?= )| *[^ %s]+| +" % (longest, line) + (r"|\n+" if line else "")).encode())
        char_ids = np.full(0x110000, n - 1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                char_ids[ord(p)] = i
        slot_keys, slot_made = np.full(1 << SLOT_BITS, -1, dtype=np.int64), np.zeros(1 << SLOT_BITS, dtype=np.int32)
        if 2 * len(keys) > len(slot_keys):
            raise ValueError("too many pairs for the table")
        slot, todo = (keys.view(np.uint64) * SPREAD >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            put = todo[slot_keys[slot[todo]] < 0]
            slot_keys[slot[put]] = keys[put]
            slot_made[slot[put]] = made[put]
            todo = todo[slot_keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) % len(slot_keys)
        table = cls(char_ids, slot_keys, slot_made, rank, alone, n, cuts, norm.add_dummy_prefix)
        if table.count([b" " * longest, b" " * (2 * longest)]) != [1, 2]:
            raise ValueError("runs of blanks do not merge from the left")
        return table

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair of ids: the id it makes, and its rank or NEVER."""
        key = left.astype(np.int64) * self.n + right
        slot = (key.view(np.uint64) * SPREAD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        made, rank = np.zeros(len(key), dtype=np.int32), np.full(len(key), NEVER, dtype=np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            there = self.slot_keys[slot]
            hit = there == key
            at = open_[hit]
            made[at] = self.slot_made[slot[hit]]
            rank[at] = self.rank[made[at]]
            on = ~hit & (there >= 0)
            open_, key, slot = open_[on], key[on], (slot[on] + 1) & (len(self.slot_keys) - 1)
        return made, rank

    def count(self, cuts: list[bytes]) -> list[int]:
        """Tokens of each cut (none of them empty)."""
        other = self.n - 1
        texts = [c.decode().replace(" ", BLANK) for c in cuts]
        flat = "".join(texts)
        codes = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32)
        sym = self.char_ids[codes]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        who = np.arange(len(texts))
        total = np.zeros(len(texts), dtype=np.int64)
        if len(odd := np.flatnonzero(sym == other)):
            more = 0 + (codes[odd] > 0x7F) + (codes[odd] > 0x7FF) + (codes[odd] > 0xFFFF)
            np.add.at(total, np.repeat(who, lengths)[odd], more)
        # made and rank at a place are of the pair of this symbol and the next one
        made, rank = self.find(sym, np.r_[sym[1:], other])
        rank[np.cumsum(lengths) - 1] = NEVER
        while len(who):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            if (done := least == NEVER).any():
                total[who[done]] += lengths[done]
                on = np.repeat(~done, lengths)
                sym, made, rank = sym[on], made[on], rank[on]
                who, lengths, least = who[~done], lengths[~done], least[~done]
                if not len(who):
                    break
            here = np.flatnonzero(rank == np.repeat(least, lengths))
            ends = np.cumsum(lengths)
            seq = np.searchsorted(ends, here, side="right")
            leftmost = np.r_[True, seq[1:] != seq[:-1]]
            if len(here) > len(who):
                # of overlapping equal pairs every second one, from the left
                first = np.r_[True, here[1:] != here[:-1] + 1]
                run = np.maximum.accumulate(np.where(first, np.arange(len(here)), 0))
                take = leftmost | ((np.arange(len(here)) - run) % 2 == 0) & ~self.alone[made[here]]
                here, seq = here[take], seq[take]
            sym[here] = made[here]
            left = np.ones(len(sym), dtype=bool)
            left[here + 1] = False
            place = here - np.arange(len(here))
            sym, made, rank = sym[left], made[left], rank[left]
            lengths = lengths - np.bincount(seq, minlength=len(lengths))
            flags = np.zeros(len(sym), dtype=bool)
            flags[place] = True
            flags[np.maximum(place - 1, 0)] = True
            stale = np.flatnonzero(flags)
            made[stale], rank[stale] = self.find(sym[stale], sym[np.minimum(stale + 1, len(sym) - 1)])
            rank[np.cumsum(lengths) - 1] = NEVER
        return total.tolist()

    def count_long(self, cut: bytes) -> int:
        """Tokens of one long cut: as count(), but places are linked and those of one rank are listed together.

        A round takes the lowest rank that any pair has and merges all its pairs, so that its cost is that of the
        pairs that it merges, not of the whole cut.
        """
        other = self.n - 1
        codes = np.frombuffer(cut.decode().replace(" ", BLANK).encode("utf-32-le"), dtype=np.uint32)
        sym = self.char_ids[codes]
        n = len(sym)
        odd = codes[sym == other]
        total = n + int(((odd > 0x7F).astype(np.int64) + (odd > 0x7FF) + (odd > 0xFFFF)).sum())
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        made, rank = self.find(sym, np.r_[sym[1:], other])
        rank[n - 1] = NEVER
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] != NEVER]
            if not len(at):
                return
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            ranks = rank[at]
            edges = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1], True])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                r = int(ranks[lo])
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(at[lo:hi])

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            here = np.unique(np.concatenate(places.pop(r)))
            here = here[rank[here] == r]  # others have changed since
            if not len(here):
                continue
            later = here[:0]
            if len(here) > 1:
                # of overlapping equal pairs every second one, from the left
                first = np.r_[True, here[1:] != after[here[:-1]]]
                run = np.maximum.accumulate(np.where(first, np.arange(len(here)), 0))
                take = ((np.arange(len(here)) - run) % 2 == 0) & ~self.alone[made[here]]
                take[0] = True
                later, here = here[~take], here[take]
            gone = after[here]
            sym[here] = made[here]
            rank[gone] = NEVER
            after[here] = on = after[gone]
            inner = on < n
            before[on[inner]] = here[inner]
            total -= len(here)
            left = before[here]
            stale = np.unique(np.r_[here, left[left >= 0]])
            right = after[stale]
            made[stale], rank[stale] = self.find(sym[stale], sym[np.minimum(right, n - 1)])
            rank[stale[right >= n]] = NEVER
            put(np.union1d(stale, later))
        return total

    def cut(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        text = text.replace(b"\xe2\x96\x81", b" ")
        if self.dummy_prefix:
            text = b" " + text
        return self.cuts.findall(text)

    def count_texts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each whole text; distinct cuts are merged once while the cache keeps them."""
        cuts = [self.cut(t) for t in texts]
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        new = set().union(*cuts).difference(self.cache)
        rare = {c: self.count_long(c) if len(c) > LONG else 0 for c in new if len(c) > KEPT}
        ragged = sorted(new.difference(rare), key=len) + [c for c in rare if len(c) <= LONG]
        for part in portions(ragged):
            for c, n in zip(part, self.count(part), strict=True):
                if len(c) > KEPT:
                    rare[c] = n
                else:
                    self.cache[c] = n
                    self.held += len(c) + ENTRY
        get = self.cache.__getitem__
        if not rare:
            return [sum(map(get, c)) for c in cuts]
        return [sum(rare[x] if x in rare else get(x) for x in c) for c in cuts]


def portions(cuts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of cuts of so many bytes, or 50,000 cuts, at most."""
    start = size = 0
    for i, c in enumerate(cuts):
        if i > start and (size + len(c) > most or i - start >= 50_000):
            yield cuts[start:i]
            start, size = i, 0
        size += len(c)
    if start < len(cuts):
        yield cuts[start:]


_tables: dict[str, PieceTable] = {}


def count_tokens(df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; a null text counts as empty and has no tokens.

    Rows are handled one by one, so repeated ids give repeated rows; an empty table gives no rows; other columns
    are not read. One pass without a shuffle. A worker's memory: a chunk, the model and CACHE_BYTES of known cuts; very
    long texts without blanks take time in proportion to their length times its logarithm.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        table = _tables.get(model_file) or _tables.setdefault(model_file, PieceTable.load(model_file))
        texts = [t or b"" for t in texts]
        return {"doc_id": ids, "n_bytes": list(map(len, texts)), "n_tokens": table.count_texts(texts)}

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.common import read_table

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
