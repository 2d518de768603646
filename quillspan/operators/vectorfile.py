"""Vectors in files of fixed-width rows, read by offset and searched a block at a time.

A file has a header (mark, dimension, first row, count, SHA-256 of what follows)
and the rows as 32-bit floats, so a row's place follows from its number. A search
takes files of queries against files of rows: a task multiplies a block of one
with a block of the other and keeps the first k of each query, so what it holds
is bounded by the sizes of files and blocks, and all queries of a table go
through the rows together.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.store import located, numbered

MAGIC = b"QSVEC\x00\x00\x01"
HEADER = struct.Struct("<8sIQQ4x32s")
SHARD = "uri string, first_row bigint, n_rows bigint, dimension int"
ROWS = 1 << 16  # of a file
QUERY_ROWS = 1 << 12  # of a file of queries
BLOCK = 1 << 12  # rows that are multiplied at once
#: Products in blocks may differ from a row's own in the last bits: what is so near to the k-th is computed again by itself.
NEAR = 1e-9


def encoded(first: int, vectors: np.ndarray) -> bytes:
    """The bytes of a file."""
    payload = np.ascontiguousarray(vectors, "<f4").tobytes()
    return HEADER.pack(MAGIC, vectors.shape[1], first, len(vectors), hashlib.sha256(payload).digest()) + payload


@dataclass(frozen=True)
class Header:
    dimension: int
    first: int
    count: int
    sha256: bytes


def header(file, uri: str) -> Header:
    """The header of an open file; ValueError if it is none, or the file is not as long as it says."""
    raw = file.read_at(HEADER.size, 0)
    if len(raw) < HEADER.size or raw[:8] != MAGIC:
        raise ValueError(f"{uri} is not a file of vectors")
    _, dimension, first, count, sha = HEADER.unpack(raw)
    if not dimension or file.size() != HEADER.size + 4 * dimension * count:
        raise ValueError(f"{uri} is cut short, or its header was changed")
    return Header(dimension, first, count, sha)


def rows_at(file, head: Header, start: int, count: int) -> np.ndarray:
    """Rows of the file from ``start``, by their offset."""
    if start < 0 or start + count > head.count:
        raise ValueError(f"there are no vector rows {start} to {start + count}")
    raw = file.read_at(4 * head.dimension * count, HEADER.size + 4 * head.dimension * start)
    return np.frombuffer(raw, "<f4").reshape(count, head.dimension)


def opened(uri: str):
    store, path = located(uri)
    return store.open_input_file(path)


def units(vectors: np.ndarray) -> np.ndarray:
    """Of length 1, as doubles; ValueError for one that is zero or not finite."""
    wide = vectors.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    if not (np.isfinite(length) & (length > 0)).all():
        raise ValueError("a vector is zero or not finite")
    return wide / length[:, None]


def first_rows(queries: np.ndarray, rows: np.ndarray, numbers: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers, scores) of the first k rows of each query by its own product, ties by number."""
    product = queries @ rows.T
    out = []
    for q, scores in zip(queries, product, strict=True):
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
        near = np.flatnonzero(scores >= least - NEAR)
        exact = np.einsum("ij,j->i", rows[near], q)
        order = np.lexsort((numbers[near], -exact))[:k]
        out.append((numbers[near][order], exact[order]))
    return out


@dataclass(frozen=True)
class VectorFiles:
    """A table's vectors in files; ``shards`` says which rows are where."""

    spark: SparkSession
    shards: DataFrame
    dimension: int
    n_rows: int

    @staticmethod
    def write(vectors: DataFrame, folder: str, rows: int = ROWS) -> VectorFiles:
        """Files of ``vectors`` (vector_row, embedding), whose rows must be 0, 1, 2 and so on, under a folder that driver and executors share.

        A file is made by one task from the rows of its range; a task that is run
        again writes another file, and only the one that is returned counts.
        """
        spark = vectors.sparkSession
        dealt = vectors.select("vector_row", "embedding", F.expr(f"vector_row div {rows}").alias("shard")).repartition("shard").sortWithinPartitions("shard", "vector_row")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = located(folder)
            store.create_dir(base, recursive=True)
            held: list[np.ndarray] = []
            numbers: list[np.ndarray] = []
            current = None

            def closed() -> pa.RecordBatch:
                at, values = np.concatenate(numbers), np.concatenate(held)
                if (np.diff(at) != 1).any() or at[0] != current * rows or not np.isfinite(values).all():
                    raise ValueError(f"vector rows from {at[0]} have gaps or repeats, or a number is not finite")
                uri = f"{folder}/{uuid.uuid4().hex}.vec"
                with store.open_output_stream(f"{base}/{uri.rpartition('/')[2]}") as out:
                    out.write(encoded(int(at[0]), values))
                return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([int(at[0])]), pa.array([len(at)], pa.int64()), pa.array([values.shape[1]], pa.int32())], names=["uri", "first_row", "n_rows", "dimension"])

            for batch in batches:
                shard = batch.column("shard").to_numpy()
                size = np.unique(batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False))
                if len(size) > 1 or batch.column("embedding").null_count or held and held[0].shape[1] != size[0]:
                    raise ValueError("vectors are null or of several sizes")
                values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, int(size[0]))
                at = batch.column("vector_row").to_numpy()
                cuts = np.flatnonzero(np.diff(shard)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                    if current is not None and shard[a] != current:
                        yield closed()
                        held, numbers = [], []
                    current = int(shard[a])
                    held.append(values[a:b])
                    numbers.append(at[a:b])
            if held:
                yield closed()

        made = [r for r in dealt.mapInArrow(run, SHARD).collect()]  # a row a file
        spark.createDataFrame(made, SHARD).write.parquet(f"{folder}/shards")
        return VectorFiles.open(spark, folder)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> VectorFiles:
        """ValueError unless the files' headers and lengths are as listed, of one dimension, and their rows follow one another."""
        shards = spark.read.schema(SHARD).parquet(f"{folder}/shards")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for uri in batch.column("uri").to_pylist():
                    with opened(uri) as file:
                        head = header(file, uri)
                    found.append((head.first, head.count, head.dimension))
                yield pa.RecordBatch.from_arrays([batch.column("uri"), *[pa.array([f[i] for f in found], pa.int64()) for i in range(3)]], names=["uri", "a", "b", "c"])

        heads = shards.select("uri").mapInArrow(run, "uri string, a bigint, b bigint, c bigint")
        rows = shards.join(heads, "uri").orderBy("first_row").collect()  # a row a file
        at, dimensions = 0, {r["dimension"] for r in rows}
        for r in rows:
            if (r["a"], r["b"], r["c"]) != (r["first_row"], r["n_rows"], r["dimension"]) or r["first_row"] != at or len(dimensions) > 1:
                raise ValueError(f"{r['uri']} does not hold the rows that it is listed with")
            at += r["n_rows"]
        return VectorFiles(spark, shards, dimensions.pop() if dimensions else 0, at)

    def damaged(self) -> DataFrame:
        """(uri) of files whose rows do not have the header's hash; all are read."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = []
                for uri in batch.column("uri").to_pylist():
                    with opened(uri) as file:
                        head = header(file, uri)
                        made = hashlib.sha256()
                        for at in range(0, head.count, BLOCK):
                            made.update(rows_at(file, head, at, min(BLOCK, head.count - at)).tobytes())
                    if made.digest() != head.sha256:
                        bad.append(uri)
                yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["uri"])

        return self.shards.select("uri").repartition("uri").mapInArrow(run, "uri string")

    def row(self, number: int) -> list[float]:
        """One vector, by one read of its bytes; ValueError beyond the table."""
        found = self.shards.where((F.col("first_row") <= number) & (F.col("first_row") + F.col("n_rows") > number)).first()
        if found is None:
            raise ValueError(f"there is no vector row {number}")
        with opened(found["uri"]) as file:
            return rows_at(file, header(file, found["uri"]), number - found["first_row"], 1)[0].tolist()

    def top_k(self, queries: VectorFiles, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_row, vector_row, score, rank): the k nearest rows by cosine of each row of ``queries``, ties by row.

        ``allowed`` (vector_row) leaves other rows out; a row beyond the table is
        an error. Tasks are pairs of a file of queries and a file of rows; each
        gives at most k rows a query, and the first k of those are taken before
        and after the shuffle.
        """
        if k < 1:
            raise ValueError("k is 1 or more")
        if queries.dimension != self.dimension and queries.n_rows and self.n_rows:
            raise ValueError(f"queries have {queries.dimension} numbers, rows {self.dimension}")
        # lists of files, a row each: their pairs are the tasks
        pairs = self.shards.select("uri", "first_row", "n_rows").crossJoin(F.broadcast(queries.shards.select(F.col("uri").alias("query_uri"))))
        if allowed is not None:
            low, high = allowed.agg(F.min("vector_row"), F.max("vector_row")).first()
            if low is not None and (low < 0 or high >= self.n_rows):
                raise ValueError("an allowed row is beyond the table")
            width = self.shards.agg(F.max("n_rows")).first()[0] or 1
            # at most a file's rows a list
            lists = allowed.distinct().groupBy(F.expr(f"vector_row div {width}").alias("_s")).agg(F.sort_array(F.collect_list("vector_row")).alias("only"))
            pairs = pairs.withColumn("_s", F.expr(f"first_row div {width}")).join(lists, "_s").drop("_s")
        else:
            pairs = pairs.withColumn("only", F.lit(None).cast("array<bigint>"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pair in batch.to_pylist():
                    yield _searched(pair["query_uri"], pair["uri"], pair["only"], k)

        parts = self.spark.sparkContext.defaultParallelism * 4
        found = pairs.repartition(parts, "uri", "query_uri").mapInArrow(run, "query_row bigint, vector_row bigint, score double")
        w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vector_row")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searched(query_uri: str, uri: str, only: list[int] | None, k: int) -> pa.RecordBatch:
    """The first k rows of a file for each query of another, a block of rows at a time."""
    with opened(query_uri) as file:
        asked = header(file, query_uri)
        queries = units(rows_at(file, asked, 0, asked.count))
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * asked.count
    with opened(uri) as file:
        head = header(file, uri)
        for at in range(0, head.count, BLOCK):
            n = min(BLOCK, head.count - at)
            numbers = np.arange(head.first + at, head.first + at + n)
            keep = slice(None) if only is None else np.isin(numbers, only)
            if not len(numbers[keep]):
                continue
            found = first_rows(queries, units(rows_at(file, head, at, n)[keep]), numbers[keep], k)
            for i, (more, scores) in enumerate(found):
                rows, values = np.append(best[i][0], more), np.append(best[i][1], scores)
                order = np.lexsort((rows, -values))[:k]
                best[i] = rows[order], values[order]
    sizes = [len(b[0]) for b in best]
    columns = [np.repeat(np.arange(asked.first, asked.first + asked.count), sizes), np.concatenate([b[0] for b in best]) if best else np.zeros(0, np.int64), np.concatenate([b[1] for b in best]) if best else np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "vector_row", "score"])


def stored(df: DataFrame, key: str, vector: str, folder: str, rows: int = ROWS) -> tuple[VectorFiles, DataFrame]:
    """The vectors of a table in files, in the order of its keys, and (vector_row, key)."""
    in_order = df.select(F.col(key).alias("key"), F.col(vector).alias("embedding")).repartitionByRange("key").sortWithinPartitions("key")
    found = numbered(in_order, "vector_row")
    return VectorFiles.write(found, folder, rows), found.select("vector_row", "key")


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, folder: str) -> DataFrame:
    """(query, key, score, rank): the k nearest of ``df`` by cosine for each row of ``queries``, which has the same columns; ties by key."""
    files, names = stored(df, key, vector, f"{folder}/rows")
    asked, askers = stored(queries, key, vector, f"{folder}/queries", QUERY_ROWS)
    found = files.top_k(asked, k)
    return found.join(askers.select(F.col("vector_row").alias("query_row"), F.col("key").alias("query")), "query_row").join(names, "vector_row").select("query", "key", "score", "rank")
