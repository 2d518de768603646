"""Tables in the shared folder, and helpers over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillspan.store import shared_dir, shared_path, written

__all__ = ["dropped", "fresh", "local_path", "placed", "shared_dir", "shared_path", "slices", "without", "written"]

def placed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and where it lies, for ``dropped``."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_path``, on whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or a plain path; None for any other store."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    return None


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``, or of one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        at = total = 0
        for i, n in enumerate(sizes):
            if i > at and total + (n or 0) > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n or 0
        if at < len(sizes):
            yield batch.slice(at)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that no column has, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names, in any case."""
    gone = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in gone])
