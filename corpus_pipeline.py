"""A corpus pipeline of five stages; each works on all that the stage before it kept.

Quality rules drop documents, line dedup drops lines, the n-gram join keeps one document of each group, mixing takes
documents as often as their source's target asks, and byte-level BPE encodes what is left and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.byte_bpe import digests
from quern.llm.common import read_table, staged
from quern.llm.jaccard_join import keep_one
from quern.llm.line_dedup import drop_lines
from quern.llm.mixing import apply_mix
from quern.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees' verdict; null and empty texts go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, alike or similar, in an earlier place; documents that lose all lines go."""
    return drop_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by five-word shingles at 0.8 or more."""
    return keep_one(docs, 5, 80, 100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return apply_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix."""
    import public_tokenizers as P

    return digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mixing", mixing), ("byte_bpe", byte_bpe)]
#: The trees, the random numbers of the mix and the merges of the vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
