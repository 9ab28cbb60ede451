"""The corpus pipeline: from raw documents to token ids, each stage a written table.

Stages in order: quality rules, exact deduplication, near duplicates by shingle sets, mixing to
target weights, byte-pair encoding. All but the last keep the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import bpe, exact_dedup, mixing, ngram_join, quality
from skyledger.llm.common import documents, stored
from skyledger.llm.queries import tokenizer

#: SQL cannot express byte-pair encoding; the stages are tested against brute force instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    judged = quality.with_quality(docs, "text", "llm_quality").filter("llm_quality.kept")
    changed = {"text": F.col("llm_quality.clean_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("llm_quality.clean_text").cast(docs.schema["n_chars"].dataType)
    return judged.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by similar shingle sets the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source comes near its share of the words; documents repeat or go."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    # Workers of the stages before may still hold memory.
    return bpe.encode(
        docs.select("doc_id", "text"), tokenizer(), decoded="decoded", keep=["doc_id"], memory=30_000)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("bpe_tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each to the written result of the one before."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
