"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, html_text, line_dedup, lloyd, local_features, packing, quality, simhash, token_count, token_files, toxicity, url_filter


def vocabulary() -> str:
    """The public byte-level vocabulary, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A document is accepted from this score on.
QUALITY_THRESHOLD = 0.7


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, mod n; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no media column, so the vectors of ``embeddings``, 8 by 8, are drawn as images."""
    images = _table(spark, sf_dir, "embeddings").select("vec_id", local_features.thumbnails(F.col("embedding")).alias("image"))
    return local_features.copies(images, "vec_id", "image").withColumnRenamed("image_id", "vec_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), n=4, radius=2)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model, _ = toxicity.learn(docs, _table(spark, sf_dir, "labels").where(_remainder(5) != 0), "doc_id", "text", "toxic")
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary(), end_id=1, tokens=2048, segments=64)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), n=10)
    hits = decontaminate.n_hit(F.col("hit_spans"))
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, "text", vocabulary())
    return counted.select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=20, least_documents=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, _table(spark, sf_dir, "labels").where(_remainder(4) != 2), "doc_id", "text", "quality")
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.token_file_table(_table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = lloyd.cluster(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims=64, scale=256, k=40, rounds=5, seed="2")
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_middle.fill_middle(docs, fim_percent=90, spm_percent=20, seed="1")
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (op1_media_copies, op2_simhash, op3_url_filter, op4_toxicity, op5_packing, op6_decontaminate, op7_token_count, op8_line_dedup, op9_quality, op10_token_files, op11_lloyd, op12_fill_middle, op13_html_text)}
