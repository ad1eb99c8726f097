"""Small tables with the odd cases that every operator must take."""

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n int, fp string, label string, key string, score double, size string, removed string, target string, n_words string"
PROSE = "the quick brown fox jumps over the lazy dog while seven other animals look on and wonder what comes next in this long story of hills and rivers and roads that wind through quiet towns until night falls on all of them and every lamp is lit "


def odd_rows() -> list[tuple]:
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [
        (1, PROSE + PROSE.upper(), "en", "a"), (2, PROSE + PROSE.upper(), "en", "a"), (2, PROSE + PROSE.upper(), "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t\r\n ", None, "b"), (6, "x", "de", None), (7, "é ñ 漢字 😀 \x00 \x1c ​", "fr", "c"),
        (8, long, "en", "a"), (9, long + " tail", "en", "a"), (10, "12 34 !? 56", "es", "c"), (11, "a b c", None, "d"), (12, "a b c", None, "d"), (13, "A B C", "en", "d"), (14, "z" * 5000, "en", "e"), (15, "line one of two\nline one of two\nline two", "en", "é"), (16, "<|endoftext|> <s> </s>", "en", "e"), (None, "no id at all", "en", "a"), (None, None, None, None),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, 7, "clash", "clash", "clash", 0.5, "clash", "clash", "clash", "clash") for r in rows]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), COLUMNS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)


def labels(spark: SparkSession, rows: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
