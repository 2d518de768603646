"""The folder that driver and executors share, tables written there, and files read by ranges from tasks."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; on one machine, where that is unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quillspan-")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of rows that the driver has, handed over as Arrow: from a list Spark makes an RDD in Python, which starts a second pool of workers on each executor that stays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(made)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(made), strict=True)], names=made.names), made)


def numbered(df: DataFrame, number: str, first: int = 0) -> DataFrame:
    """``df`` with dense numbers from ``first`` on, in the order of its partitions: rows are written once, and counted by the partition they were in."""
    rows = written(df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row")), "numbered")
    starts = []
    for r in rows.groupBy("_part").count().orderBy("_part").collect():  # a row a partition
        starts.append((r["_part"], first))
        first += r["count"]
    begun = listed(df.sparkSession, starts, "_part int, _start bigint")
    return rows.join(F.broadcast(begun), "_part").withColumn(number, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def located(uri: str):
    """(pyarrow's file system, path in it) of a URI, as Spark or Hadoop writes them, or of a plain path."""
    from pyarrow import fs

    if not re.match("[A-Za-z][A-Za-z0-9+.-]+:", uri):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def file_digests(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(uri, sha256) of files: each is read by one task, a few MB at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column("uri").to_pylist():
                store, path = located(uri)
                made = hashlib.sha256()
                with store.open_input_stream(path) as stream:
                    while piece := stream.read(4 << 20):
                        made.update(piece)
                found.append(made.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array(found, pa.string())], names=["uri", "sha256"])

    rows = listed(spark, [(u,) for u in uris], "uri string")
    return rows.repartition(max(1, min(len(uris), spark.sparkContext.defaultParallelism * 4)), "uri").mapInArrow(run, "uri string, sha256 string")
