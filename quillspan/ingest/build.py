"""The catalogue's tables as projections of parsed documents, and what spans documents: reference targets and row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.store import written

#: Candidates of a reference that its row lists; their number is exact, and all are in the declarations.
LISTED = 64
#: Vendors that come before others, in this order.
VENDORS = ("intel", "amd")


def documents(parsed: DataFrame) -> DataFrame:
    """title is the first section's heading, else the path; revision is what follows ``rev-`` in it."""
    revision = F.regexp_extract("entry_path", r"(?i)rev-(.*?)(?:\.md)?$", 1)
    title = F.coalesce(F.get("sections", F.lit(0))["heading"], F.col("entry_path"))
    return parsed.select("document_id", "vendor", "archive_id", "archive_sha256", "entry_path", title.alias("title"), F.when(revision != "", revision).alias("revision"), "content_sha256", "byte_len")


def _parts(parsed: DataFrame, name: str, *also: str) -> DataFrame:
    return parsed.select("document_id", *also, F.explode(name).alias("_p")).select("document_id", *also, "_p.*")


def sections(parsed: DataFrame) -> DataFrame:
    """With a section of level 0 over each document that has blocks before its first heading."""
    own = _parts(parsed, "sections")
    first = F.get("blocks", F.lit(0))
    n_lines = F.size(F.split("source", "\n")) - F.when(F.col("source").endswith("\n"), 1).otherwise(0)
    span = F.struct(F.lit(0).cast("long").alias("byte_start"), F.col("byte_len").alias("byte_end"), F.lit(1).alias("line_start"), n_lines.alias("line_end"), first["span"]["printed_page"].alias("printed_page"))
    front = parsed.where(F.size("blocks") > 0).where(first["section_id"].startswith("front:"))
    none = F.lit(None).cast("string")
    made = front.select("document_id", first["section_id"].alias("section_id"), none.alias("parent_section_id"), F.lit("Front matter").alias("heading"), F.array(F.lit("Front matter")).alias("heading_path"), F.lit(0).alias("level"), F.lit(1).alias("ordinal"), first["span"]["printed_page"].alias("printed_page"), span.alias("span"))
    return own.unionByName(made)


def blocks(parsed: DataFrame) -> DataFrame:
    return _parts(parsed, "blocks")


def tables(parsed: DataFrame) -> DataFrame:
    return _parts(parsed, "tables").select("document_id", "table_id", "block_id", "caption", "headers", F.size("rows").alias("row_count"))


def table_rows(parsed: DataFrame) -> DataFrame:
    """(document_id, table_id, block_id, row_index, cells), rows from 0."""
    each = _parts(parsed, "tables")
    return each.select("document_id", "table_id", "block_id", F.posexplode("rows").alias("row_index", "cells"))


def diagrams(parsed: DataFrame) -> DataFrame:
    return _parts(parsed, "diagrams")


def warnings(parsed: DataFrame) -> DataFrame:
    return _parts(parsed, "warnings")


def declarations(parsed: DataFrame) -> DataFrame:
    """(document_id, normalized_key, target_id), each once."""
    return _parts(parsed, "declarations").distinct()


def _targets(declared: DataFrame, *by: str) -> DataFrame:
    """Of each key the number of its targets, and the first ``LISTED`` of them by document and id. A task keeps so many of a key before the shuffle, so a key that all documents declare is never gathered."""
    order = Window.partitionBy(*by).orderBy("document_id", "target_id")
    first = declared.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= LISTED)
    listed = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("document_id", "target_id"))).alias("listed"))
    return declared.groupBy(*by).agg(F.count("*").alias("n")).join(listed, [*by])


def references(parsed: DataFrame, declared: DataFrame) -> DataFrame:
    """References with their targets: those in the reference's own document if there are any, else those of the corpus; resolved if there is exactly one.

    ``candidates`` lists at most ``LISTED`` of ``n_candidates``; all are the rows
    of ``declared`` with the reference's key. Targets are counted by key before
    the join, so a common key makes no product.
    """
    refs = _parts(parsed, "refs")
    local = _targets(declared, "document_id", "normalized_key").withColumnsRenamed({"n": "_ln", "listed": "_l"})
    world = _targets(declared, "normalized_key").withColumnsRenamed({"n": "_wn", "listed": "_w"})
    found = refs.join(local, ["document_id", "normalized_key"], "left").join(world, "normalized_key", "left")
    n, listed = F.coalesce("_ln", "_wn", F.lit(0).cast("long")), F.coalesce("_l", "_w")
    one: Column = F.when(n == 1, listed[0])
    return found.select("reference_id", "document_id", "source_block_id", "kind", "label", "normalized_key", one["document_id"].alias("target_document_id"), one["target_id"].alias("target_id"), F.coalesce(F.transform(listed, lambda t: t["target_id"]), F.array().cast("array<string>")).alias("candidates"), n.alias("n_candidates"), (n == 1).alias("resolved"))


def vendor_rank(vendor: Column) -> Column:
    """Known vendors in their order, then the others, which go by name."""
    out = F.lit(len(VENDORS))
    for i, name in enumerate(VENDORS):
        out = F.when(vendor == name, i).otherwise(out)
    return out


def numbered(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with vector_row: 0, 1, 2 and so on by vendor, archive, path and place in the document.

    Chunks are dealt by ranges of that order and written with the number of
    their range; rows are numbered within each, and only a count for each range
    goes through one task.
    """
    order = ["_v", "vendor", "archive_id", "entry_path", "chunk_ordinal"]
    placed = chunks.join(documents.select("document_id", "archive_id", "entry_path"), "document_id").withColumn("_v", vendor_rank(F.col("vendor")))
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(placed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered-chunks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rows = dealt.withColumn("_row", within).join(F.broadcast(first), "_part")
    return rows.select(*chunks.columns, (F.col("_first") + F.col("_row") - 1).alias("vector_row"))
