"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and BPE, each stage on what the one before it kept.

Defined cases: a null or empty text has no words and goes in the first stage, as `short`; given to a later stage it stays (one of
all texts without words in near-dedup). A null doc_id stays null, and a row without one gives way to its copies that have one.
Equal rows are one document in near-dedup: one of them stays. Of texts alike the smallest doc_id stays, of rows with one doc_id
the one of least row hash. Very long texts are handled whole. Columns beyond those of documents are dropped by line dedup. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from tessera.llm.common import saved
from tessera.llm.entries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the new text."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) AS bigint) AS n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles alike to 0.8) stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.encoded_digests(docs, vocabulary())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", no_leaks), ("bpe", tokens)]

#: The last stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
