"""Reads over the catalogue: neighbours, pages of a section, outlines, table rows, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, section: str, order: str) -> DataFrame:
    """``df`` with previous and next: the order values around each row in its section."""
    w = Window.partitionBy(section).orderBy(order)
    return df.withColumns({"previous": F.lag(order).over(w), "next": F.lead(order).over(w)})


def surrounding(df: DataFrame, section: str, order: str, text: str) -> DataFrame:
    """``df`` with the texts just before and after, joined by a blank line."""
    w = Window.partitionBy(section).orderBy(order)
    return df.withColumn("surrounding", F.concat_ws("\n\n", F.lag(text).over(w), F.lead(text).over(w)))


def section_page(df: DataFrame, section: str, order: str, offset: int, limit: int) -> DataFrame:
    """Of each section, the rows offset + 1 to offset + limit, with has_more."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    w = Window.partitionBy(section)
    numbered = df.withColumns({"position": F.row_number().over(w.orderBy(order)).cast("long"), "total": F.count("*").over(w)})
    return numbered.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).withColumn("has_more", F.col("total") > offset + limit).drop("total")


def outline(edges: DataFrame, depth: int = 8) -> DataFrame:
    """(node, depth) of a tree (node, parent) from its roots, to ``depth`` levels at most: a recursive query, which a cycle cannot hold up."""
    if not 0 <= depth <= 8:
        raise ValueError("depth is 0 to 8")
    spark = edges.sparkSession
    edges.createOrReplaceTempView("_outline_edges")
    return spark.sql(f"WITH RECURSIVE walk(node, depth) AS (SELECT node, 0 FROM _outline_edges WHERE parent IS NULL UNION ALL SELECT e.node, w.depth + 1 FROM walk w JOIN _outline_edges e ON e.parent = w.node WHERE w.depth < {int(depth)}) SELECT node, CAST(depth AS INT) AS depth FROM walk")


def rows_with(df: DataFrame, needle: str, key: str, offset: int, limit: int) -> DataFrame:
    """Rows of which any cell has the needle, in any case, in order of key; with the total of such rows."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    cells = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
    hits = df.where(F.exists(cells, lambda c: c.contains(needle.lower())))
    total = hits.agg(F.count("*").alias("total"))
    first = hits.orderBy(key).limit(offset + limit).withColumn("position", F.row_number().over(Window.orderBy(key)))
    return first.where(F.col("position") > offset).crossJoin(F.broadcast(total))


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of tables."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, n): values of a foreign key that the parent table lacks, with their rows."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def dense(df: DataFrame, row: str) -> DataFrame:
    """Whether row numbers are 0, 1, 2 and so on without gaps: (n, n_distinct, least, greatest, contiguous)."""
    found = df.agg(F.count(row).alias("n"), F.count_distinct(row).alias("n_distinct"), F.min(row).alias("least"), F.max(row).alias("greatest"))
    return found.withColumn("contiguous", (F.col("n") == F.col("n_distinct")) & (F.coalesce("least", F.lit(0)) == 0) & (F.coalesce("greatest", F.lit(-1)) == F.col("n") - 1))
