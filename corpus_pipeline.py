"""Corpus pipeline: quality rules, toxicity, SimHash near-dedup, benchmark decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of `documents`. run() writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.llm import bpe, decontaminate, quality, similar, toxicity
from probitas.llm.common import id_mod, save, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits."""
    return quality.kept_rows(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; learned from labelled rows of the first two thirds by hash."""
    net = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_mod(F.col("doc_id"), 3) != 1)
    return toxicity.kept_rows(docs, net)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return similar.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, edited or not, of a benchmark item."""
    return decontaminate.kept_rows(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]
#: SQL can't express the learned and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
