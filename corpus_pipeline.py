"""A corpus pipeline over `documents`: quality rules, near copies, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landrank.llm import column_bwt, cube_mixing, prefix_join, quality_rules, vector_packing
from landrank.llm._shared import save, scratch

#: Limits of a packed sequence beside its 2048 tokens: pieces, and the sum of their squared lengths (that of one full piece).
MAX_DOCS = 32
MAX_ATTENTION = 2048.0**2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    return prefix_join.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte passages that a document with a smaller id has too."""
    return column_bwt.cut_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return cube_mixing.sample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it; a sequence holds at most MAX_DOCS pieces and MAX_ATTENTION of cost."""
    return vector_packing.pack_documents(docs, vector_packing.default_tokenizer(), max_docs=MAX_DOCS, max_attention=MAX_ATTENTION)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("best_fit_packing", packing),
]

#: Jaccard components, cube sampling and packing are not SQL; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage's kept documents are a table; what it wrote on the way is deleted behind it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = save(stage(spark, docs, sf_dir), name)
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
