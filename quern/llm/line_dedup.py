"""Fuzzy line dedup by MinHash, with DataFrame functions only.

A line's set holds its character shingles: SHINGLE characters from every position. Its MinHash signature is made of the
BOTTOM least hashes (bottom-k) of shingles that the content chooses: the characters from a blank to the third after it,
and SHINGLE characters from every place without a blank of lines whose words have RUN bytes or more on average. Every two
values of a signature are a band, so that lines of a similarity of 0.8 share one with a chance over 99 %.

Lines of a band are paired with the band's first line, pairs are verified by the exact Jaccard similarity of
the whole sets, made from the lines' texts, and distributed union-find over the verified pairs and over equal lines
keeps one line, the first, of each component. Lines of a band that are in different components then all meet each other
under bounds that no similar pair fails (sizes, and parity sketches of the whole sets), those of very large bands by a
prefix filter over their whole sets; what passes is verified in the same way. Of large bands some lines are met by all
first, then more by those whose components still differ, and in the last round all, so that a band of many near copies
does not put out all its pairs. So lines that share a band and are similar are always joined. With exact=True the prefix
filter runs over all lines, and no similar pair lacks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import components, drop_staged, read_table, staged

SHINGLE, BOTTOM, RUN = 12, 4, 12
SIMILAR, OF = 80, 100
#: Lines of a key that all meet each other under it; those of larger keys meet by their rarest shingles.
MANY = 2048
#: Lines of a key that all others meet in the first round, and how many times as many they are in every later one.
HUBS, MORE = 4, 8
#: Words of 64 bits of a line's sketch.
WORDS = 16
#: Lines whose ids are sent to all tasks at once; of more, the texts are shuffled.
MOST_SENT = 2_000_000
BLANKS = " \t\n\x0b\x0c\r"


def has_word(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS)) != ""


def chosen(line: Column) -> Column:
    """Hashes of the shingles that a line's content chooses, repeated ones too."""

    def of_words(words: Column) -> Column:
        runs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda a, i: F.xxhash64(a, F.get(words, i + 1), F.get(words, i + 2)))
        inner = F.transform(F.regexp_extract_all(line, F.lit(rf"(?=([^ ]{{{SHINGLE}}}))"), F.lit(1)), lambda s: F.xxhash64(s))
        return F.when(F.octet_length(line) >= RUN * F.size(words), F.concat(runs, inner)).otherwise(runs)

    return F.transform(F.array(F.split(line, " ", -1)), of_words)[0]  # in a lambda, so that the words are split once


def signed(lines: DataFrame) -> DataFrame:
    """lines with their signature: the BOTTOM least distinct hashes of chosen(line) in order, nulls for those that lack.

    The least is read and taken out BOTTOM times, each in a step of its own, which costs less than to sort all.
    """
    left = lines.withColumn("left", chosen(F.col("line")))
    for k in range(BOTTOM):
        left = left.withColumn(f"least_{k}", F.array_min("left"))
        left = left.withColumn("left", F.array_remove("left", F.col(f"least_{k}")))
    return left.select(*lines.columns, F.array(*[f"least_{k}" for k in range(BOTTOM)]).alias("signature"))


def whole_set(line: Column) -> Column:
    """Hashes of the shingles from every position of a line; a shorter line is one."""

    def cut(data: Column) -> Column:  # four bytes a character
        places = F.sequence(F.lit(1), F.octet_length(data) - (4 * SHINGLE - 1), F.lit(4))
        return F.when(F.octet_length(data) < 4 * SHINGLE, F.array(F.xxhash64(data))).otherwise(F.transform(places, lambda i: F.xxhash64(F.substring(data, i, F.lit(4 * SHINGLE)))))

    return F.transform(F.array(F.encode(line, "UTF-32")), cut)[0]  # in a lambda, so that the line is encoded once


def bands(signature: Column) -> Column:
    """Hashes of every two of the signature's values; of its only one where there are no two; nulls for those that lack."""
    one, *rest = [(F.get(signature, F.lit(i)), F.get(signature, F.lit(j))) for i, j in combinations(range(BOTTOM), 2)]
    return F.array(F.xxhash64(*one), *[F.when(y.isNotNull(), F.xxhash64(x, y)) for x, y in rest])  # a hash skips nulls


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of id and text), line_no, line, lid and crc (hashes of the line) of every line with a word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    split = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.where(has_word(F.col("line"))).withColumns({"lid": F.xxhash64("line"), "crc": F.crc32("line")})


def similar_enough(n: Column | str, similar: int, of: int) -> Column:
    return F.expr(f"cast(ceil({similar} * {n} / {of}) as int)")


def sketches(texts: DataFrame) -> DataFrame:
    """lid, n (size of the whole set) and sketch of every line: WORDS words of parities, each shingle flips one bit.

    One more shingle on either side flips one bit, so two sketches differ in no more bits than the sets in shingles.
    """
    sets = texts.select("lid", F.array_distinct(whole_set(F.col("line"))).alias("s"))  # a step of its own, so that the explode is compiled
    each = sets.select("lid", F.explode_outer("s").alias("h"))  # of explode, Spark would test the size first and make the sets twice
    words = [F.bit_xor(F.expr(f"case when (h >> 6 & {WORDS - 1}) = {i} then shiftleft(1L, cast(h & 63 as int)) else 0L end")).alias(f"word_{i}") for i in range(WORDS)]
    return each.groupBy("lid").agg(F.count("*").alias("n"), *words).select("lid", "n", F.array(*[f"word_{i}" for i in range(WORDS)]).alias("sketch"))


def can_be_similar(x: str, y: str, similar: int, of: int) -> Column:
    """False only for lines (columns n and sketch with these endings) that are not similar, by their sizes and sketches."""
    n, m = F.col(f"n_{x}"), F.col(f"n_{y}")
    far = sum((F.bit_count(F.col(f"sketch_{x}")[i].bitwiseXOR(F.col(f"sketch_{y}")[i])) for i in range(WORDS)), F.lit(0))
    return (of * F.least(n, m) >= similar * F.greatest(n, m)) & (far * (of + similar) <= (n + m) * (of - similar))


def near(pairs: DataFrame, drawn: DataFrame, similar: int, of: int) -> DataFrame:
    """Those of the pairs (x, y) of lines whose sizes and sketches allow that they are similar, with the sum of the sizes (both)."""
    a, b = (drawn.select(F.col("lid").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "xy")
    return pairs.join(a, "x").join(b, "y").where(can_be_similar("x", "y", similar, of)).select(*pairs.columns, (F.col("n_x") + F.col("n_y")).alias("both"))


def linked(pairs: DataFrame, texts: DataFrame, similar: int, of: int) -> DataFrame:
    """Those of the pairs (x, y) of lines, with the sum of the sizes of their whole sets (both), whose whole sets are similar."""
    ta, tb = (texts.select(F.col("lid").alias(k), F.col("line").alias(f"t{k}")) for k in "xy")
    common = F.size(F.array_intersect(whole_set(F.col("tx")), whole_set(F.col("ty"))))
    return pairs.join(ta, "x").join(tb, "y").where((of + similar) * common >= similar * F.col("both")).select(*pairs.columns)


def mixed_groups(rows: DataFrame) -> DataFrame:
    """rows (key, lid, label) of the keys with several labels, with how many lines such a key has and its commonest label."""
    kinds = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    keys = kinds.groupBy("key").agg(F.sum("c").alias("many"), F.count("*").alias("kinds"), F.max(F.struct("c", "label")).alias("top"))
    return rows.join(keys.where("kinds > 1").select("key", "many", F.col("top.label").alias("main")), "key")


def meeting(groups: DataFrame, hubs: int, similar: int, of: int, more: Column | None = None) -> DataFrame:
    """Pairs (x, y) of lines, with labels a and b, of a key whose labels differ and that can be similar, and their sizes' sum.

    Pairs have one of the key's hubs, about so many lines by a hash, all where the key has no more. Hubs of a key's
    commonest label meet the others, which meet each other too; pairs of equal labels are never made.
    """
    cols = [c for c in groups.columns if c not in ("key", "main", "many")]
    drawn = groups.withColumn("hub", F.pmod(F.xxhash64("lid", F.lit(hubs)), F.ceil(F.col("many") / F.lit(float(hubs)))) == 0)
    x = drawn.where("label <> main or not hub").select("key", F.col("hub").alias("hub_x"), *[F.col(c).alias(f"{c}_x") for c in cols])
    y = drawn.where("hub").select("key", "main", *[F.col(c).alias(f"{c}_y") for c in cols])
    once = ~F.col("hub_x") | (F.col("label_y") == F.col("main")) | (F.col("lid_x") > F.col("lid_y"))
    fits = (F.col("label_x") != F.col("label_y")) & once & can_be_similar("x", "y", similar, of)
    if more is not None:
        fits = more & fits
    found = x.alias("p").join(y.alias("q"), (F.col("p.key") == F.col("q.key")) & fits)
    return found.select(F.col("lid_x").alias("x"), F.col("lid_y").alias("y"), F.col("label_x").alias("a"), F.col("label_y").alias("b"), (F.col("n_x") + F.col("n_y")).alias("both"))


def prefixes(rest: DataFrame, texts: DataFrame, similar: int, of: int) -> DataFrame:
    """key, lid, label and left (shingles from there) of the rarest shingles of the whole sets of rest's lines.

    Sets are ordered by how many of rest's sets have a shingle. Similar sets share one among the first n - need + 1,
    and as many must be left behind the first that they share as they need in common.
    """
    sets = texts.join(rest, "lid").select("lid", "label", F.array_distinct(whole_set(F.col("line"))).alias("s"))
    of_line = staged(sets.select("lid", "label", F.explode_outer("s").alias("shingle")), "shingles")
    seen = of_line.groupBy("shingle").agg(F.count("*").alias("seen")).where("seen > 1")
    ordered = of_line.join(seen, "shingle", "left").groupBy("lid", "label").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(1)).alias("seen"), "shingle"))).alias("s"))
    made = ordered.withColumn("size", F.size("s")).select("lid", "label", "size", F.posexplode(F.slice("s", F.lit(1), F.col("size") - similar_enough("size", similar, of) + 1)).alias("at", "p"))
    out = staged(made.where("p.seen > 1").select(F.col("p.shingle").alias("key"), "lid", "label", (F.col("size") - F.col("at")).alias("left")), "prefixes")
    drop_staged(of_line)
    return out


def renamed(rows: DataFrame, to: DataFrame) -> DataFrame:
    """rows with the labels that to (label, to) gives."""
    return rows.join(to, "label", "left").select(*[F.coalesce("to", "label").alias(c) if c == "label" else c for c in rows.columns])


def all_met(rows: DataFrame, labels: DataFrame, texts: DataFrame, drawn: DataFrame, similar: int, of: int, more: Column | None = None) -> DataFrame:
    """labels (lid, label) after all similar lines of a key of rows (key, lid, label and what more asks for) were joined.

    In a round the lines of a key meet its hubs where labels differ. A key of no more lines than hubs is done, as all
    have met; of the others those that hold several labels after the round go on with MORE times as many hubs.
    """
    hubs, groups = HUBS, staged(mixed_groups(rows), "groups")
    while not groups.isEmpty():
        tried = staged(meeting(groups.join(drawn, "lid"), hubs, similar, of, more).distinct(), "candidates")
        to = components(linked(tried, texts, similar, of), "a", "b").select(F.col("node").alias("label"), F.col("label").alias("to"))
        after = staged(renamed(labels, to), "labels")
        left = staged(mixed_groups(renamed(groups.where(F.col("many") > hubs).drop("many", "main"), to)), "groups")
        for done in (tried, to, labels, groups):
            drop_staged(done)
        hubs, labels, groups = hubs * MORE, after, left
    drop_staged(groups)
    return labels


def met_exactly(rest: DataFrame, labels: DataFrame, texts: DataFrame, drawn: DataFrame, similar: int, of: int) -> DataFrame:
    """labels (lid, label) after all similar lines of rest (lid, label) were joined, whatever keys they have."""
    enough = (of + similar) * F.least("left_x", "left_y") >= similar * (F.col("n_x") + F.col("n_y"))
    return all_met(prefixes(rest, texts, similar, of), labels, texts, drawn, similar, of, enough)


def met(live: DataFrame, texts: DataFrame, similar: int, of: int) -> DataFrame:
    """(lid, label) of the lines of live (key, lid, least) after all lines of a key have met.

    First each meets its key's least line. Keys that hold lines of several components after that are left;
    their other lines are met by each other where components differ: in keys of up to MANY lines under the key, the
    lines of larger keys by the rarest shingles of their whole sets. No pair that shares a key is dropped but by bounds
    that no similar pair fails.
    """
    drawn = staged(sketches(texts), "sketches")
    ends = live.where("lid <> least").select(F.col("lid").alias("x"), F.col("least").alias("y")).distinct()
    pairs = staged(near(ends, drawn, similar, of), "pairs")
    known = components(linked(pairs, texts, similar, of), "x", "y").select(F.col("node").alias("lid"), "label")
    drop_staged(pairs)
    inner = live.where("lid <> least").select("key", "lid").distinct()
    told = inner.join(known, "lid", "left").select("key", "lid", F.coalesce("label", "lid").alias("label"))
    mixed = staged(mixed_groups(told), "mixed")
    labels = staged(known.unionByName(mixed.select("lid", "label").distinct().join(known, "lid", "left_anti")), "labels")
    drop_staged(known)
    labels = all_met(mixed.where(F.col("many") <= MANY).select("key", "lid", "label"), labels, texts, drawn, similar, of)
    large = mixed.where(F.col("many") > MANY).select("lid").distinct()
    if not large.isEmpty():
        labels = met_exactly(staged(large.join(labels, "lid"), "large"), labels, texts, drawn, similar, of)
    for done in (drawn, mixed):
        drop_staged(done)
    return labels


def keepers(lines: DataFrame, docs: DataFrame, similar: int = SIMILAR, of: int = OF, exact: bool = False) -> DataFrame:
    """lid, crc and at (doc_id, row, line_no of the kept line) of every line of lines that is not the only one of its component (and of those of repeated rows).

    lines: doc_id, row, line_no, lid, crc and signature of the lines of docs.
    """
    place = F.struct("doc_id", "row", "line_no")
    first = staged(lines.groupBy("lid", "crc").agg(F.min(place).alias("at"), F.count("*").alias("many")), "first")
    if exact:
        live = None
        wanted = first.select("lid").distinct()
    else:
        keyed = lines.select("lid", F.explode(bands(F.col("signature"))).alias("key")).where("key is not null")
        live = staged(keyed.select("key", "lid", F.expr("min(lid) over (partition by key)").alias("least"), F.expr("max(lid) over (partition by key)").alias("largest")).where("least <> largest").drop("largest"), "live")
        wanted = staged(live.select("lid").distinct(), "wanted")
        if wanted.count() <= MOST_SENT:
            wanted = F.broadcast(wanted)  # else the lines are shuffled by their ids
    read = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line")).withColumn("lid", F.xxhash64("line"))
    asked = read.join(wanted, "lid", "left_semi").groupBy("lid").agg(F.min(F.struct(F.crc32("line").alias("crc"), "line")).alias("t"))
    texts = staged(asked.select("lid", "t.crc", "t.line"), "texts")
    if exact:
        alone = staged(texts.select("lid", F.col("lid").alias("label")), "labels")
        labels = met_exactly(alone, alone, texts, staged(sketches(texts), "sketches"), similar, of)
    else:
        labels = met(live, texts, similar, of)
        drop_staged(live)
    members = staged(first.join(labels.join(texts.select("lid", "crc"), "lid"), ["lid", "crc"]).select("lid", "crc", "at", "label"), "members")
    of_label = staged(members.groupBy("label").agg(F.min("at").alias("kept")), "kept")  # so that the join can split a large component
    told = members.join(of_label, "label").select("lid", "crc", "kept")
    return staged(first.join(told, ["lid", "crc"], "left").where("kept <> at or many > 1").select("lid", "crc", F.coalesce("kept", "at").alias("at")), "keepers")


def removed_lines(docs: DataFrame, similar: int = SIMILAR, of: int = OF, exact: bool = False) -> DataFrame:
    """doc_id, row and removed (sorted numbers from 0 of the lines that go) of the rows that lose lines."""
    found = lines_of(docs)
    found = found.withColumn("signature", F.array().cast("array<long>")) if exact else signed(found)
    lines = staged(found.select("doc_id", "row", "line_no", "lid", "crc", "signature"), "lines")
    gone = lines.drop("signature").join(keepers(lines, docs, similar, of, exact), ["lid", "crc"]).where(F.struct("doc_id", "row", "line_no") != F.col("at"))
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def line_report(docs: DataFrame, similar: int = SIMILAR, of: int = OF, exact: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0) of every row.

    Lines without a word stay and count for nothing; a null text has no lines. Of equal or similar lines the first by
    (doc_id, line number) stays, rows without an id before all others. Rows that repeat id and text count as one and
    lose the same lines; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"), F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("n_lines"))
    lost = removed_lines(docs, similar, of, exact).withColumnRenamed("doc_id", "d").withColumnRenamed("row", "r")
    return rows.join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_lines(docs: DataFrame, similar: int = SIMILAR, of: int = OF, exact: bool = False) -> DataFrame:
    """docs without the lines that go, n_chars brought up to date; documents that lose all lines with words go."""
    lost = removed_lines(docs, similar, of, exact).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("removed").alias("__removed"))
    marked = docs.withColumn("__of", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    joined = marked.join(lost, marked["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__row")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("__removed", i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(rest)
    new = {"text": text} | ({"n_chars": F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length(rest)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.withColumns(new).where(F.col("__removed").isNull() | has_word(F.col("text"))).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))
