"""Corpus pipeline: quality rules, near duplicates, repeated strings, benchmark
passages, tokens. Each stage's result is written and read again as the next
one's documents.

Defined cases: null and empty texts fail the quality rules and go; equal rows
are near copies, of which one stays; rows without an id are documents like
others, last in order; texts of any length are read whole; columns beyond those
of `documents` stay up to the last stage; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.llm import byte_bpe, decontamination, jaccard_join, quality_rules, suffix_dedup
from windlass.llm.common import free_name, materialise, prepare, table


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    kept = F.col(free_name(docs, "kept"))
    return quality_rules.quality_rules(docs).filter(kept).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate class."""
    prepare(spark)
    first = F.col(free_name(docs, "is_first"))
    return jaccard_join.link_texts(docs).filter(first).select(*docs.columns)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that start earlier. Pieces of a
    character that is cut in two go as well; n_chars follows the text."""
    prepare(spark)
    text = free_name(docs, "kept")
    done = suffix_dedup.remove_repeats(docs).withColumn(
        "text", suffix_dedup.whole_characters(F.col(text)))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    prepare(spark)
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    prepare(spark)
    return byte_bpe.digests(docs)


STAGES = [
    ("quality_rules", pass_quality_rules),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("suffix_dedup", drop_repeated_strings),
    ("decontamination", drop_benchmark_passages),
    ("byte_bpe", encode_and_decode),
]

# Near-duplicate classes and repeated substrings are beyond SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
