"""A corpus pipeline of five stages: quality, line de-duplication, near-duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``, and returns the
rows that it keeps, whole, in the same columns; the last returns the encoded corpus. ``run`` writes
each stage's result to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.llm import bpe, gbdt, line_dedup, near_dups, registry, tiling
from provenia.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    return gbdt.keep(docs, gbdt.fit(docs, registry.table(spark, sf_dir, "labels")), registry.QUALITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; ``n_chars`` follows the text."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more."""
    return near_dups.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return tiling.clean(docs, registry.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the decoded text."""
    return bpe.encode(docs, registry.tokenizer_path(), columns=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", encoding),
]

#: No stage of the five but line de-duplication can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
