"""A corpus pipeline of five stages over documents, each an operator of ``quillspan.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import decontaminate, line_dedup, packing, quality, queries, simhash
from quillspan.llm.cluster import shared_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it learns from all labelled rows among them, within its stated bound."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_accepted(docs, labels, threshold=queries.QUALITY_THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur in other documents."""
    return line_dedup.replace_lines(docs, least_chars=20, least_documents=3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_first(docs, n=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, remove="documents")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in training sequences."""
    return packing.pack_documents(docs, queries.vocabulary(), end_id=1, tokens=2048, segments=64)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: The stages learn a classifier, follow links and count tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
