"""Token-id files with Elias-Fano encoded document boundaries.

A shard holds the ids of documents in ascending order of doc_id, one after
another, as unsigned 16-bit numbers if the vocabulary allows it and 32-bit
otherwise. Where documents end, and their doc_ids, are two non-decreasing
sequences; each is Elias-Fano encoded: low bits packed, high bits in unary in a
bit vector, with every 256th one's position for select. That takes about
2 + log2(mean length) bits a document.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import local_path, shared_path, slices
from .encode import encoder_of

MAGIC = b"QSTF0001"
SAMPLE = 256
_HEAD = struct.Struct("<8sQQQQQ")  # magic, id bytes, documents, ids, bytes of the ends, bytes of the keys
_EF = struct.Struct("<qQQQ")  # least value, count, low bits, bytes of the high bits


class EliasFano:
    """A non-decreasing integer sequence with random access.

    encode() gives its bytes; at(i) selects one value from them, and blocks()
    goes through all, ``SAMPLE`` at a time, from one select sample to the next.
    """

    def __init__(self, data: bytes | np.ndarray):
        data = np.frombuffer(data, np.uint8)
        self.least, self.n, self.width, size = _EF.unpack(data[: _EF.size].tobytes())
        lows = (self.n * self.width + 7) // 8
        samples = (self.n + SAMPLE - 1) // SAMPLE
        at = _EF.size
        self.low = data[at : at + lows]
        self.high = data[at + lows : at + lows + size]
        self.samples = np.frombuffer(data[at + lows + size : at + lows + size + 4 * samples].tobytes(), "<u4")

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n = len(values)
        if (values[1:] < values[:-1]).any():
            raise ValueError("values must not decrease")
        least = int(values[0]) if n else 0
        # differences of signed numbers may need all 64 bits: they are taken modulo 2^64
        x = values.view(np.uint64) - np.uint64(least % (1 << 64))
        span = int(x[-1]) + 1 if n else 1
        width = max(0, (span // n).bit_length() - 1) if n else 0
        lows = np.zeros(0, np.uint8)
        if width:
            bits = (x[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
        mark = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        mark[ones] = 1
        high = np.packbits(mark, bitorder="little")
        return _EF.pack(least, n, width, len(high)) + lows.tobytes() + high.tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def at(self, i: int) -> int:
        """The i-th value: from the sample before it, bytes are skipped by their population counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        want = i % SAMPLE
        byte = start // 8
        current = int(self.high[byte]) & (0xFF << (start % 8)) & 0xFF
        while (ones := current.bit_count()) <= want:
            want -= ones
            byte += 1
            current = int(self.high[byte])
        for _ in range(want):
            current &= current - 1
        one = byte * 8 + (current & -current).bit_length() - 1
        low = 0
        if self.width:
            first = i * self.width
            raw = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8].tobytes(), "little")
            low = raw >> (first % 8) & ((1 << self.width) - 1)
        return self.least + ((one - i) << self.width | low)

    def blocks(self) -> Iterator[np.ndarray]:
        """The values in order, those of one select sample at a time."""
        for first in range(0, self.n, SAMPLE):
            count = min(SAMPLE, self.n - first)
            start = int(self.samples[first // SAMPLE])
            end = int(self.samples[first // SAMPLE + 1]) if first + count < self.n else 8 * len(self.high)
            bits = np.unpackbits(self.high[start // 8 : (end + 7) // 8], bitorder="little")
            ones = np.flatnonzero(bits[start % 8 :])[:count] + start
            out = (ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.width)
            if self.width:
                at = first * self.width
                lows = np.unpackbits(self.low[at // 8 : (at + count * self.width + 7) // 8], bitorder="little")[at % 8 :]
                lows = lows[: count * self.width].reshape(count, self.width).astype(np.uint64)
                out |= (lows << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            yield (out + np.uint64(self.least % (1 << 64))).view(np.int64)


def shard_bytes(keys: list[int], lengths: list[int], ids: list[bytes], id_bytes: int) -> bytes:
    """A shard file: header, ends and keys, ids."""
    ends = EliasFano.encode(np.cumsum(np.array(lengths, np.int64)) if lengths else np.zeros(0, np.int64))
    names = EliasFano.encode(np.array(keys, np.int64))
    data = b"".join(ids)
    if id_bytes == 2:
        data = np.frombuffer(data, "<u4").astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, id_bytes, len(keys), sum(lengths), len(ends), len(names)) + ends + names + data


class Shard:
    """A shard, read by ranges: the boundaries, in their encoded form, and then the ids of documents as they are asked for."""

    def __init__(self, file: RangeReader):
        magic, self.id_bytes, self.n, self.tokens, ends, keys = _HEAD.unpack(file.read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file of this format")
        coded = file.read(_HEAD.size, ends + keys)
        self.ends = EliasFano(coded[:ends])
        self.keys = EliasFano(coded[ends:])
        self.first = _HEAD.size + ends + keys
        self.file = file
        if file.size != self.first + self.tokens * self.id_bytes:
            raise ValueError("the token file is cut short")

    def span(self, i: int) -> tuple[int, int]:
        """Start and end of document i among the shard's ids, by select."""
        return (self.ends.at(i - 1) if i else 0), self.ends.at(i)

    def ids(self, start: int, end: int) -> bytes:
        raw = self.file.read(self.first + start * self.id_bytes, (end - start) * self.id_bytes)
        return np.frombuffer(raw, f"<u{self.id_bytes}").astype("<u4").tobytes()

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(key, start, end) of all documents, in blocks of those under one select sample."""
        before = 0
        for keys, ends in zip(self.keys.blocks(), self.ends.blocks(), strict=True):
            yield keys, np.concatenate([[before], ends[:-1]]), ends
            before = int(ends[-1])


def _store(uri: str, data: bytes) -> None:
    """Write whole or not at all: another attempt of the task never sees half a file."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as file:
            file.write(data)
        os.replace(f"{path}.part", path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as file:
        file.write(data)


class RangeReader:
    """Ranges of a file on any store; nothing beyond them is read."""

    def __init__(self, uri: str):
        if path := local_path(uri):
            self.file = open(path, "rb")
            self.size = os.path.getsize(path)
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            self.file = store.open_input_file(path)
            self.size = self.file.size()

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


SHARDS = T.StructType([T.StructField("part", T.LongType()), T.StructField("serial", T.LongType()), T.StructField("path", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("null_key", T.BooleanType())])
RECORDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def write_token_files(df: DataFrame, vocabulary: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text", shard_tokens: int = 8 << 20) -> DataFrame:
    """Encode whole texts, append ``end_id``, and write shards in ascending order of ``key``.

    Returns the table of shards (part, serial, path, tokens, null_key), itself
    written under ``folder``. Texts are dealt by ranges of the key, so that no
    task holds more than one shard's ids and the order is global. A shard is
    written under another name and then renamed; the table names only the files
    of tasks that ended well.

    Null or empty texts are the end id alone; rows with a null key come first,
    in shards of their own; repeated keys keep all their rows, in no set order
    among themselves; an empty table gives no shards.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        id_bytes = 2 if max(encoder.library.get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        keys, lengths, ids, held, serial, rows = [], [], [], 0, 0, []

        def close(null: bool) -> None:
            nonlocal held, serial
            if keys:
                path = f"{folder}/ids/part-{part:06d}-{serial:04d}-{uuid.uuid4().hex}.qstf"
                _store(path, shard_bytes(keys, lengths, ids, id_bytes))
                rows.append((part, serial, path, held, null))
                serial += 1
            for x in (keys, lengths, ids):
                x.clear()
            held = 0

        null = False
        for batch in slices(batches, "text", 1 << 20):
            for k, got in zip(batch.column("doc_id").to_pylist(), encoder.encode_all([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                if (k is None) != null or held >= shard_tokens:
                    close(null)
                    null = k is None
                keys.append(0 if k is None else k)
                ids.append(got + end)
                lengths.append(len(got) // 4 + 1)
                held += lengths[-1]
        close(null)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=SHARDS.names)

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    rows.mapInArrow(run, SHARDS).write.parquet(f"{folder}/shards")
    return spark.read.schema(SHARDS).parquet(f"{folder}/shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """One row per document of the shards, from the files: doc_id, start among all ids, n_tokens, ids.

    The first position of each shard is a running sum: within a writer's task
    over its shards, and over the tasks, a row each. Documents' positions come
    from the files' select structures, a sample's documents at a time, and only
    those documents' ids are held.
    """
    spark = shards.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = shards.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("first", F.coalesce(F.sum("all").over(before), F.lit(0))).select("part", "first")
    within = Window.partitionBy("part").orderBy("serial").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.join(tasks, "part").withColumn("base", F.col("first") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with RangeReader(row["path"]) as file:
                    shard = Shard(file)
                    for keys, starts, ends in shard.documents():
                        names = [None] * len(keys) if row["null_key"] else keys.tolist()
                        first = int(starts[0])
                        held = shard.ids(first, int(ends[-1]))
                        ids = [held[4 * (a - first) : 4 * (b - first)] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + row["base"]), pa.array(ends - starts), pa.array(ids, pa.binary())], names=RECORDS.names)

    return placed.select("path", "base", "null_key").repartition(parts, "path").mapInArrow(run, RECORDS)


def token_file_table(df: DataFrame, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents written to token files in the shared folder, and read back from them."""
    spark: SparkSession = df.sparkSession
    return read_token_files(write_token_files(df, vocabulary, shared_path(spark, "token-files"), end_id, key, text))
