"""Keyword search: tokens, postings, BM25 over terms and adjacency phrases, Porter stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"
K1, B, FLOOR = 1.2, 0.75, 1e-6


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_phrases(query: str) -> list[list[str]]:
    """Blank-separated words that hold a letter or digit, each as the list of its tokens; all must be found."""
    found = []
    for word in query.lower().split():
        parts = [t for t in re.findall(r"[^\W_]+", word)]
        if parts:
            found.append(parts)
    return found


def postings(docs: DataFrame, id_col: str, text: Column, stemmed: bool = False) -> DataFrame:
    """term, id, positions of every token, or of every token's stem."""
    return docs.select(F.col(id_col), (stems(text) if stemmed else tokens(text)).alias("toks")).select(F.col(id_col), F.posexplode("toks").alias("position", "term")).groupBy("term", id_col).agg(F.sort_array(F.collect_list("position")).alias("positions"))


def doc_stats(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id and number of tokens; stems are as many as their tokens."""
    return docs.select(F.col(id_col), F.size(tokens(text)).alias("dl"))


def phrase_count(toks: Column, phrase: list[str]) -> Column:
    """Adjacent occurrences of a phrase in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    n = len(phrase)
    starts = F.sequence(F.lit(1), F.size(toks) - (n - 1))
    hit = lambda i: F.slice(toks, i, n) == F.array(*[F.lit(p) for p in phrase])
    return F.when(F.size(toks) >= n, F.size(F.filter(starts, hit))).otherwise(0)


def bm25(docs: DataFrame, id_col: str, text: Column, phrases: list[list[str]], stemmed: bool = False) -> DataFrame:
    """id and score of the rows that hold all phrases. One scan finds lengths and counts, one aggregate their totals.

    Only the query's few counts travel: the corpus totals are one row, sent to every task.
    """
    if not phrases:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    made = docs.select(id_col, (stems(text) if stemmed else tokens(text)).alias("toks"))
    tf = made.select(id_col, F.size("toks").alias("dl"), *[phrase_count(F.col("toks"), p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    total = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(phrases)):
        f, d = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(FLOOR))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        every = every & (F.col(f"tf{i}") > 0)
    return tf.join(F.broadcast(total)).where(every).select(id_col, score.alias("score"))


def bm25_indexed(index: DataFrame, stats: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """The same for single terms over a stored index (postings, doc_stats): only the terms' postings are read."""
    hit = index.where(F.col("term").isin(*terms)).select("term", id_col, F.size("positions").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    total = stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    f = F.col("tf").cast("double")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hit.join(F.broadcast(df), "term").join(stats, id_col).join(F.broadcast(total)).select(id_col, "term", part.alias("part"))
    return scored.groupBy(id_col).agg(F.sum("part").alias("score"), F.count("*").alias("found")).where(F.col("found") == len(set(terms))).select(id_col, "score")


def bm25_phrases(index: DataFrame, stats: DataFrame, id_col: str, phrases: list[list[str]]) -> DataFrame:
    """bm25() over a stored index: the query's postings only are read, and meet by row; a row's are bounded by the query."""
    if not phrases:
        return stats.select(id_col, F.lit(0.0).alias("score")).limit(0)
    terms = sorted({t for p in phrases for t in p})
    met = index.where(F.col("term").isin(*terms)).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    empty = F.array().cast("array<int>")
    at = lambda t: F.coalesce(F.element_at("m", F.lit(t)), empty)

    def times(phrase: list[str]) -> Column:
        def whole(p: Column) -> Column:
            hit = F.lit(True)
            for k, t in enumerate(phrase[1:], 1):
                hit = hit & F.array_contains(at(t), p + k)
            return hit

        return F.size(F.filter(at(phrase[0]), whole))

    tf = met.select(id_col, *[times(p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    seen = tf.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
    total = stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).join(F.broadcast(seen))
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(phrases)):
        f, d = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(FLOOR))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        every = every & (F.col(f"tf{i}") > 0)
    return tf.join(stats, id_col).join(F.broadcast(total)).where(every).select(id_col, score.alias("score"))


# -------------------------------------------------------------------------------- Porter's algorithm of 1980

VOWELS = "aeiou"
#: Fixed values of the algorithm: suffix and replacement, by step.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _forms(word: str) -> str:
    """The word as c (consonant) and v (vowel) letters."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in VOWELS or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _forms(stem)))


def _closed(word: str) -> bool:
    return _forms(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a lower-case ASCII word; others stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _forms(w[: -len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _forms(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _closed(w):
                w += "e"
    if w.endswith("y") and "v" in _forms(w[:-1]):
        w = w[:-1] + "i"
    for steps in (STEP2, STEP3):
        hit = max((s for s in steps if w.endswith(s[0])), key=lambda s: len(s[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    end = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _closed(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(word: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(col: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stem(t: str) -> str:
        if t not in known:
            known[t] = porter(fold(t))
        return known[t]

    return col.map(lambda toks: None if toks is None else [stem(t) for t in toks])


def stems(text: Column) -> Column:
    """Tokens with accents folded and Porter-stemmed; stemming has no built-in, so an Arrow batch function does it."""
    return _stems(tokens(text))


def stem_phrases(phrases: list[list[str]]) -> list[list[str]]:
    return [[porter(fold(t)) for t in p] for p in phrases]


def consistency(messages: DataFrame, index: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """Indexed ids without a message, and messages that have tokens but are not indexed."""
    ids = index.select(id_col).distinct()
    return ids.join(messages.select(id_col), id_col, "left_anti"), messages.where(F.size(tokens(text)) > 0).select(id_col).join(ids, id_col, "left_anti")
