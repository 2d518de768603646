"""Incremental builds: fingerprints, what can be reused, and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha256, n_bytes); a null text is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(key, F.sha2(whole, 256).alias("sha256"), F.octet_length(whole).cast("long").alias("n_bytes"))


def duplicates(prints: DataFrame, key: str) -> DataFrame:
    """(sha256, n, first) of contents that more than one row has."""
    return prints.groupBy("sha256").agg(F.count("*").alias("n"), F.min(key).alias("first")).where(F.col("n") > 1)


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, state): reused, changed, added or removed, from two tables of fingerprints."""
    a, b = old.select(key, F.col("sha256").alias("_o")), new.select(key, F.col("sha256").alias("_n"))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "reused").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def embedding_plan(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(content_hash, n_chunks, first_row): distinct texts with the first stored vector for each; null where it must be made, once, for all its chunks."""
    wanted = chunks.groupBy("content_hash").agg(F.count("*").alias("n_chunks"))
    known = stored.groupBy("content_hash").agg(F.min("vector_row").alias("first_row"))
    return wanted.join(known, "content_hash", "left")
