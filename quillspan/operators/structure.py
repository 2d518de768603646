"""Document structure: section trees, pages, captions and cross-references, as windows and joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.ingest import manual


@F.pandas_udf(T.ArrayType(T.LongType()))
def _line_starts(text: pd.Series) -> pd.Series:
    """Where the bytes of each line begin; a fold over an array of lines would copy it for each of them."""

    def starts(value: str) -> np.ndarray:
        raw = np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8)
        return np.concatenate([[0], np.flatnonzero(raw == 10) + 1])

    return text.map(starts)


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, byte_start, byte_end): lines from 1, and where their bytes lie; a carriage return before a line feed is not of the line. Within the row: no shuffle."""
    whole = F.coalesce(F.col(text), F.lit(""))
    zipped = F.arrays_zip(F.split(whole, "\n", -1).alias("line"), _line_starts(whole).alias("start"))
    rows = df.select(key, F.posexplode(zipped).alias("_p", "_z"))
    line = F.regexp_replace(F.col("_z.line"), "\r$", "")
    return rows.select(key, (F.col("_p") + 1).cast("long").alias("line_no"), line.alias("line"), F.col("_z.start").alias("byte_start"), (F.col("_z.start") + F.octet_length(line)).cast("long").alias("byte_end"))


def page_labels(df: DataFrame, document: str, order: str, label: str) -> DataFrame:
    """``df`` with printed_page: the last label at or before each row, else the document's first."""
    w = Window.partitionBy(document).orderBy(order)
    back = F.last(label, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("printed_page", F.coalesce(back, F.first(label, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def section_ends(df: DataFrame, document: str, start: str, level: str) -> DataFrame:
    """``df`` with section_end: the start of the next section of the same or a higher rank; null at the end.

    Levels are 0 to 6, so it is seven running minima over one sort from the end, not a join of sections with sections.
    """
    w = Window.partitionBy(document).orderBy(F.desc(start)).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.when(F.col(level) == n, F.min(F.when(F.col(level) <= n, F.col(start))).over(w)) for n in range(7)]
    return df.withColumn("section_end", F.coalesce(*ends))


def section_parents(df: DataFrame, document: str, start: str, level: str, key: str) -> DataFrame:
    """``df`` with parent_id: the nearest section before it of a higher rank."""
    w = Window.partitionBy(document).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.when(F.col(level) == n, F.max(F.when(F.col(level) < n, F.struct(F.col(start).alias("s"), F.col(key).alias("k")))).over(w)["k"]) for n in range(1, 7)]
    return df.withColumn("parent_id", F.coalesce(*latest))


def nearest_caption(blocks: DataFrame, section: str, ordinal: str, kind: str) -> DataFrame:
    """Tables and diagrams with caption_ordinal: that of the nearest caption of the section, the earlier one of two; null if there is none."""
    before = Window.partitionBy(section).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(section).orderBy(F.desc(ordinal)).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col(kind) == "caption", F.col(ordinal))
    found = blocks.withColumns({"_b": F.last(own, True).over(before), "_a": F.last(own, True).over(after)}).where(F.col(kind).isin("table", "diagram"))
    nearer = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a") - F.col(ordinal) < F.col(ordinal) - F.col("_b")))
    return found.withColumn("caption_ordinal", F.when(nearer, F.col("_a")).otherwise(F.col("_b"))).drop("_a", "_b")


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, kind, label, normalized_key) of each cross-reference in the texts; chapters and appendices are of the kind section."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(manual.REFERENCE), F.lit(1)).alias("w"), F.regexp_extract_all(text, F.lit(manual.REFERENCE), F.lit(2)).alias("l"))
    rows = df.select(key, F.posexplode(both).alias("_p", "_r"))
    word = F.lower(F.col("_r.w"))
    return rows.select(key, F.col("_p").cast("long").alias("ordinal"), F.when(word.isin("table", "figure"), word).otherwise(F.lit("section")).alias("kind"), F.col("_r.l").alias("label"), F.concat(word, F.lit(":"), F.lower(F.col("_r.l"))).alias("normalized_key"))


def runs(df: DataFrame, document: str, order: str, *same: str) -> DataFrame:
    """(document, first, last, n_rows) of the longest stretches of rows in order that agree in ``same``."""
    w = Window.partitionBy(document).orderBy(order)
    changed: Column = F.lag(order).over(w).isNull()
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = df.withColumn("_run", F.sum(changed.cast("int")).over(w))
    return marked.groupBy(document, "_run", *same).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_rows")).drop("_run")
