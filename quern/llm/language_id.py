"""Language identification by interpolated Kneser-Ney character language models.

A model is read word by word: a word's letters between two boundary marks, so that a text's cross-entropy is the
sum over its words and every distinct word is scored once. All languages' n-grams lie in sorted arrays of 64-bit
hashes, one row of values for each; a search in them scores a batch of words under all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, keep, map_texts, read_table, staged

#: Documents of each language that a model learns from, at most: those with the least hashes of their ids.
TRAIN_DOCS = 600
#: Ids that are sent to every task, at most; more are joined by a shuffle.
MOST_SENT = 200_000
ORDER = 5
#: Bytes of scored words that a Python worker keeps, each with ENTRY more for itself. Longer runs without blanks than
#: KEPT bytes are not kept, and letters are read in words of WORD at most.
CACHE_BYTES, ENTRY, KEPT, WORD = 96 << 20, 150, 256, 64
FIELD = np.uint64(0x9E3779B97F4A7C15)
LETTERS = regex.compile(r"\p{L}{1,%d}" % WORD)
MARK = 1  # the code of a word's boundary; characters follow


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, each with a mark before and behind, as codes; and each place's number within its word."""
    flat = np.frombuffer("".join(f"\x01{w}\x01" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes) - sizes
    return flat, np.arange(len(flat)) - np.repeat(starts, sizes)


def grams(flat: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each place, for n from 0 to order; n-grams do not leave the word (0 there)."""
    out = [np.ones(len(flat), dtype=np.uint64)]
    for n in range(1, order + 1):
        before = np.r_[np.uint64(0), out[-1][:-1]] if n > 1 else out[0]
        h = (before ^ (before >> np.uint64(29))) * FIELD + flat * np.uint64(0xBF58476D1CE4E5B9)
        h[place < n - 1] = 0
        out.append(h)
    return out


@dataclass
class Models:
    """Per order: sorted n-gram hashes with each language's discounted share, sorted contexts with its back-off weight."""

    langs: list[str]
    shares: list[tuple[np.ndarray, np.ndarray]]
    weights: list[tuple[np.ndarray, np.ndarray]]
    alphabet: int
    slope: float = 8.0
    offset: float = 0.0
    least: float = 0.5
    cache: dict[bytes, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    held: int = 0  # bytes of the cache

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of -log p of each word's letters and its end under every language, and their number."""
        if not words:
            return np.zeros((0, len(self.langs))), np.zeros(0)
        flat, place = codes_of(words)
        hashes = grams(flat, place, ORDER)
        p = np.full((len(flat), len(self.langs)), 1.0 / self.alphabet)
        for n in range(1, ORDER + 1):
            on = place >= max(1, n - 1)
            p[on] = look(self.shares[n - 1], hashes[n][on], 0.0) + look(self.weights[n - 1], np.r_[np.uint64(0), hashes[n - 1][:-1]][on] if n > 1 else hashes[0][on], 1.0) * p[on]
        cost = -np.log(p)
        cost[place == 0] = 0
        starts = np.flatnonzero(place == 0)
        return np.add.reduceat(cost, starts, axis=0), np.diff(np.r_[starts, len(flat)]) - 1.0

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Costs under every language and number of places of each blank-separated word, over its runs of letters."""
        runs = [LETTERS.findall(w.decode().lower()) for w in words]
        cost, count = self.costs([r for x in runs for r in x])
        owner = np.repeat(np.arange(len(words)), [len(x) for x in runs])
        return np.stack([*(np.bincount(owner, cost[:, k], minlength=len(words)) for k in range(len(self.langs))), np.bincount(owner, count, minlength=len(words))], 1)

    def score_texts(self, texts: list[bytes | None]) -> tuple[list[str], list[float], list[bool], list[float | None]]:
        """Language, calibrated score, rejected and cross-entropy of each whole text."""
        width = len(self.langs)
        words = [(t or b"").split() for t in texts]
        if self.table is None or self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
            self.table = np.zeros((0, width + 1), dtype=np.float64)
        table, rare = self.table, {}
        if new := list(set().union(*words).difference(self.cache)):
            new.sort(key=lambda w: len(w) > KEPT)  # those that are kept come first
            rows = np.concatenate([self.rows(part) for part in portions(new)])
            at = dict(zip(new, range(len(table), len(table) + len(new)), strict=True))
            table = np.concatenate([table, rows])
            kept = sum(len(w) <= KEPT for w in new)
            self.cache.update((w, at[w]) for w in new[:kept])
            self.held += sum(map(len, new[:kept])) + kept * (ENTRY + 8 * (width + 1))
            rare = {w: at[w] for w in new[kept:]}
            self.table = table[: len(table) - len(rare)]
        langs, scores, rejected, entropy = [], [], [], []
        known = self.cache.__getitem__
        get = (lambda w: rare[w] if w in rare else known(w)) if rare else known
        for w in words:
            total = table[np.fromiter(map(get, w), dtype=np.int64, count=len(w))].sum(0, dtype=np.float64)
            if not total[width]:
                for a, v in ((langs, "und"), (scores, 0.0), (rejected, True), (entropy, None)):
                    a.append(v)
                continue
            mean = total[:width] / total[width]
            best = int(mean.argmin())
            rest = float(np.min(np.delete(mean, best))) if width > 1 else float(np.log(self.alphabet))
            score = float(1 / (1 + np.exp(-(self.slope * (rest - mean[best]) + self.offset))))
            langs.append(self.langs[best])
            scores.append(score)
            rejected.append(score < self.least)
            entropy.append(float(mean[best]))
        return langs, scores, rejected, entropy


def portions(words: list[bytes], most: int = 1 << 18) -> Iterator[list[bytes]]:
    """Runs of words of so many bytes at most, or single ones."""
    start = size = 0
    for i, w in enumerate(words):
        if i > start and size + len(w) > most:
            yield words[start:i]
            start, size = i, 0
        size += len(w)
    yield words[start:]


def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
    hashes, values = table
    if not len(hashes):
        return np.full((len(keys), values.shape[1]), default)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where((hashes[at] == keys)[:, None], values[at], default)


def fit(counts: dict[str, dict[str, int]]) -> Models:
    """Models from the counts of each language's words (lower-case runs of letters).

    The highest order counts occurrences, lower orders count distinct characters before an n-gram (n-grams at the
    word's start keep occurrences, as nothing stands before them). One discount an order and language: n1/(n1+2 n2).
    """
    langs = sorted(counts)
    alphabet = {chr(MARK)}
    for x in counts.values():
        alphabet.update(*x)
    shares_of: list[list[tuple]] = [[] for _ in range(ORDER)]
    weights_of: list[list[tuple]] = [[] for _ in range(ORDER)]
    for lang in langs:
        words = sorted(counts[lang])
        flat, place = codes_of(words)
        times = np.repeat(np.array([counts[lang][w] for w in words], dtype=np.int64), [len(w) + 2 for w in words])
        hashes = grams(flat, place, ORDER)
        for n in range(1, ORDER + 1):
            on = place >= max(1, n - 1)  # the mark before a word is given, not foretold
            gram, context = hashes[n][on], (np.r_[np.uint64(0), hashes[n - 1][:-1]] if n > 1 else hashes[0])[on]
            keys, first, back = np.unique(gram, return_index=True, return_inverse=True)
            amount = np.bincount(back, times[on], minlength=len(keys))
            if n < ORDER:
                wider = place[on] >= n
                longer = np.unique(np.stack([hashes[n + 1][on][wider], gram[wider]], 1), axis=0)[:, 1]
                distinct = np.bincount(np.searchsorted(keys, longer), minlength=len(keys))
                amount = np.where(distinct > 0, distinct, amount)
            n1, n2 = int((amount == 1).sum()), int((amount == 2).sum())
            off = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
            ctx, where = np.unique(context[first], return_inverse=True)
            total = np.bincount(where, amount, minlength=len(ctx))
            kinds = np.bincount(where, minlength=len(ctx))
            shares_of[n - 1].append((keys, np.maximum(amount - off, 0) / total[where]))
            weights_of[n - 1].append((ctx, off * kinds / total))

    def joined(parts: list[tuple], default: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts])) if parts else np.zeros(0, dtype=np.uint64)
        values = np.full((len(keys), len(parts)), default)
        for i, (k, v) in enumerate(parts):
            values[np.searchsorted(keys, k), i] = v
        return keys, values

    return Models(langs, [joined(x, 0.0) for x in shares_of], [joined(x, 1.0) for x in weights_of], len(alphabet) + 1)


def calibrate(models: Models, margins: np.ndarray, right: np.ndarray) -> None:
    """Slope and offset of the score: logistic regression of being right on the margin, drawn towards a prior."""
    slope, offset = 8.0, 0.0
    if len(margins):
        scale = max(float(np.median(margins)), 1e-3)
        x, w = np.stack([margins / scale, np.ones(len(margins))], 1), np.array([2.0, 0.0])
        prior = w.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-(x @ w)))
            h = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2)
            w = w + np.linalg.solve(h, x.T @ (right - p) - (w - prior))
        slope, offset = max(float(w[0]), 0.1) / scale, float(w[1])
    models.slope, models.offset = slope, offset


def learn(docs: DataFrame, allowed, per_lang: int = TRAIN_DOCS) -> Models | None:
    """Models from rows of docs (doc_id, text, lang) that allowed (a Column) admits; None where there are none.

    At most per_lang documents of each language, by the hashes of their ids; four fifths of them give the models,
    the others the calibration. Words are counted on the executors; the driver gets the sample's distinct words.
    """
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    able = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", (F.xxhash64("doc_id") / 2.0**64 + 0.5).alias("u"))
    # the least hashes lie below this share, but for odds beyond reckoning: so few rows of a language meet to be ranked
    share = able.groupBy("lang").agg(F.count("*").alias("c")).select("lang", (2.0 * per_lang / F.col("c")).alias("share"))
    ids = able.join(share, "lang").where("u <= share").withColumn("k", F.row_number().over(rank)).where(F.col("k") <= per_lang)
    chosen = staged(ids.select("doc_id", F.col("lang").alias("language"), (F.col("k") % 5 == 0).alias("held")), "ids")
    # per_lang ids of each language: small unless there are thousands of languages
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen) if chosen.count() <= MOST_SENT else chosen, "doc_id")
    schema = pa.schema([("language", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    texts = sample.where("not held").select("text", "language")

    def count(batches):
        for batch in batches:
            by: dict[tuple[str, str], int] = {}
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in LETTERS.findall((t or "").lower()):
                    by[lang, w] = by.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in by], pa.string()), pa.array([k[1] for k in by], pa.string()), pa.array(list(by.values()), pa.int64())], schema=schema)

    counts: dict[str, dict[str, int]] = {}
    for r in texts.mapInArrow(count, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r.language, {})[r.word] = r.n
    if not counts:
        return None
    models = fit(counts)
    shipped = docs.sparkSession.sparkContext.broadcast(models)

    def margins(batches):
        m = shipped.value
        m.slope, m.offset = 1.0, 0.0
        for batch in batches:
            langs, scores, _, _ = m.score_texts(batch.column(0).cast(pa.binary()).to_pylist())
            keep_ = [i for i, x in enumerate(langs) if x != "und"]
            real = batch.column(1).to_pylist()
            s = np.clip(np.array([scores[i] for i in keep_]), 1e-12, 1 - 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(np.log(s / (1 - s))), pa.array([float(langs[i] == real[i]) for i in keep_], pa.float64())], names=["margin", "hit"])

    got = sorted(map(tuple, sample.where("held").select("text", "language").mapInArrow(margins, "margin double, hit double").collect()))
    calibrate(models, np.array([g[0] for g in got]), np.array([g[1] for g in got]))
    models.cache, models.table, models.held = {}, None, 0
    return models


def identify(df: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected and cross_entropy (nats a character) of every row, in one pass.

    The language with the least cross-entropy per character; of equals the first by name. A null text, or one without
    a letter, is `und` with score 0; so is everything without models. rejected: the calibrated score is below one
    half; the best guess is still named. Repeated rows stay, an empty table gives none, other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])
    shipped = df.sparkSession.sparkContext.broadcast(models)  # bounded: languages * TRAIN_DOCS documents

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        m = shipped.value
        if m is None:
            return {"doc_id": ids, "lang_pred": ["und"] * len(ids), "score": [0.0] * len(ids), "rejected": [True] * len(ids), "cross_entropy": [None] * len(ids)}
        langs, scores, rejected, entropy = m.score_texts(texts)
        return {"doc_id": ids, "lang_pred": langs, "score": scores, "rejected": rejected, "cross_entropy": entropy}

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    models = learn(docs.select(F.col("doc_id").cast("long"), "text", "lang"), ~held)
    out = identify(docs, models)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
