"""ZIP archives as a Spark data source: a row an entry, read by ranges.

The driver reads the archives' directories, which lie at their ends, and deals
the entries to partitions of about ``split_bytes`` compressed bytes. A task reads
the ranges of its own entries only, so one archive is many tasks', and no task
holds more than one entry beside its Arrow batch. Filters on paths are applied to
the directories: entries that they leave out are never read.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from quillspan.store import located

NAME = "zip_entries"
SCHEMA = "archive string, entry_path string, byte_len bigint, crc bigint, content binary"
SPLIT_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
STORED, DEFLATED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED
_LOCAL = struct.Struct("<4s5H3L2H")


def opened(uri: str):
    """A file on any store, read by ranges."""
    store, path = located(uri)
    return store.open_input_file(path)


@dataclass(frozen=True)
class Entry:
    """Where an entry lies, by the directory."""

    path: str
    at: int
    packed: int
    size: int
    crc: int
    method: int


def directory(uri: str) -> list[Entry]:
    """The entries of an archive in its directory's order, without folders; only the directory is read."""
    with opened(uri) as file, zipfile.ZipFile(file) as zipped:
        return [Entry(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for i in zipped.infolist() if not i.is_dir()]


def content(file, archive: str, entry: Entry) -> bytes:
    """The bytes of an entry; ValueError if they are not those that the directory says."""
    file.seek(entry.at)
    head = _LOCAL.unpack(file.read(_LOCAL.size))
    if head[0] != b"PK\3\4" or entry.method not in (STORED, DEFLATED) or head[2] & 1:
        raise ValueError(f"{entry.path} in {archive} is damaged, encrypted or packed by another method")
    file.seek(entry.at + _LOCAL.size + head[-2] + head[-1])
    raw = file.read(entry.packed)
    if entry.method == DEFLATED:
        packer = zlib.decompressobj(-15)
        # one byte more than is declared shows an entry that is larger, without unpacking all of it
        raw = packer.decompress(raw, entry.size + 1)
    if len(raw) != entry.size or zlib.crc32(raw) != entry.crc:
        raise ValueError(f"{entry.path} in {archive} has other bytes than its directory says")
    return raw


@dataclass
class Part(InputPartition):
    """Entries of one archive for one task."""

    archive: str
    entries: list[Entry]


class Reader(DataSourceReader):
    """Plans and reads the entries that the pushed filters leave."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("archives", "").split("\n") if p]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.pattern = options.get("pattern", "*")
        self.equal: list[set] = []
        self.starts: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("entry_path",):
                self.equal.append({f.value} if isinstance(f, EqualTo) else set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("entry_path",):
                self.starts.append(f.value)
            else:
                yield f

    def wanted(self, path: str) -> bool:
        return fnmatch(path, self.pattern) and all(path in own for own in self.equal) and all(path.startswith(s) for s in self.starts)

    def partitions(self) -> list[Part]:
        parts = []
        for archive in self.paths:
            held, size = [], 0
            for e in sorted(directory(archive), key=lambda e: e.at):
                if self.wanted(e.path):
                    if held and size + e.packed > self.split:
                        parts.append(Part(archive, held))
                        held, size = [], 0
                    held.append(e)
                    size += e.packed
            if held:
                parts.append(Part(archive, held))
        return parts or [Part("", [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.entries:
            return
        with opened(part.archive) as file:
            rows, size = [], 0
            for e in part.entries:
                rows.append((e, content(file, part.archive, e)))
                size += e.size
                if size >= BATCH_BYTES:
                    yield _batch(part.archive, rows)
                    rows, size = [], 0
            if rows:
                yield _batch(part.archive, rows)


def _batch(archive: str, rows: list[tuple[Entry, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([archive] * len(rows)), pa.array([e.path for e, _ in rows]), pa.array([e.size for e, _ in rows], pa.int64()), pa.array([e.crc for e, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["archive", "entry_path", "byte_len", "crc", "content"])


class ZipEntries(DataSource):
    """Options: ``archives`` (URIs, a line each), ``pattern`` of paths, ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def zip_entries(spark: SparkSession, archives: list[str], pattern: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(archive, entry_path, byte_len, crc, content) of the entries of archives whose paths match a pattern.

    No archives, or none that match, give no rows; an entry that is damaged,
    encrypted or packed by another method than deflate is an error; a path that
    an archive has twice is two rows.
    """
    spark.dataSource.register(ZipEntries)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).options(archives="\n".join(archives), pattern=pattern, split_bytes=str(split_bytes)).load()


def write_archives(entries: DataFrame, folder: str, archive: str = "archive", path: str = "entry_path", text: str = "content") -> DataFrame:
    """(archive, uri, n_entries): ZIP files of the entries (archive, entry_path, content) under a folder that driver and executors share.

    The entries of an archive are one file, which one task writes as it reads
    them, in the order of their paths; a task that is run again writes another
    file, and only the one that is returned counts.
    """
    rows = entries.select(F.col(archive).cast("string").alias("archive"), F.col(path).alias("path"), F.col(text).cast("binary").alias("content")).repartition("archive").sortWithinPartitions("archive", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, made = None, []
        store, base = located(folder)
        store.create_dir(base, recursive=True)
        out = zipped = None
        for batch in batches:
            for name, at, data in zip(*(batch.column(c).to_pylist() for c in ("archive", "path", "content")), strict=True):
                if made == [] or name != current:
                    if zipped:
                        zipped.close()
                        out.close()
                    current, file = name, f"{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{base}/{file}")
                    zipped = zipfile.ZipFile(out, "w", DEFLATED)
                    made.append([name, f"{folder}/{file}", 0])
                zipped.writestr(at, data or b"")
                made[-1][2] += 1
        if zipped:
            zipped.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["archive", "uri", "n_entries"])

    return rows.mapInArrow(run, "archive string, uri string, n_entries bigint")
