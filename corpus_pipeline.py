"""Corpus pipeline: documents -> clean, deduplicated, decontaminated, tokenised documents.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept; what it returns is written as Parquet in the shared folder and read again.  All
but the last return the columns of ``documents``, extra ones included.

Defined results: null and empty texts score as average ones, so they pass the quality stage
if the corpus is mostly good; line dedup leaves them as they are; near-dedup keeps rows
without words, of which only repeats of the same id and text leave; they hold no benchmark
window and have no tokens.  Of rows that repeat an id and text one stays; of ties the
smallest id, then the smallest text key.  Very long texts are worked on whole.  Without
labels every score is 0.5 and all documents pass; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm import bpe, decontaminate, line_dedup, near_dup, quality
from pursebook.llm.common import discard, read_table, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score reaches the cut of operator 6."""
    score = quality.score_column(spark, quality.train(docs, read_table(spark, sf_dir, "labels")))
    return docs.where(score("text") >= quality.CUT)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated three-line stretches out of the texts; every document stays."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group, that with the smallest id."""
    return near_dup.one_row_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without any window of the benchmark."""
    return decontaminate.without_benchmark(docs, read_table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and of the decoded documents."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_bpe),
]

#: SQL has no compression classifier and no tokenizer; tests/llm/test_pipeline.py checks
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name.replace(" ", "-").lower())
            if before is not None:  # nothing reads it any more
                discard(before)
            before = docs
    return docs
