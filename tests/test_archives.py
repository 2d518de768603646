"""ZIP archives as a data source: ranges, partitions, filters, damage."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.sources import archives


def made(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as zipped:
        for name, data in entries:
            zipped.writestr(name, data)
    return str(path)


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    r = random.Random(1)
    entries = [(f"{'en' if i % 3 else 'de'}/{i:03d}.md", r.randbytes(40_000 + i)) for i in range(60)]
    return made(tmp_path_factory.mktemp("zip") / "a b#é.zip", [*entries, ("empty.md", b""), ("folder/", b"")]), dict(entries) | {"empty.md": b""}


def test_one_archive_is_read_by_many_tasks(spark, large):
    path, entries = large
    found = archives.zip_entries(spark, [path], split_bytes=300_000)
    assert found.rdd.getNumPartitions() >= 8
    got = found.collect()
    assert {r.entry_path: bytes(r.content) for r in got} == entries and all(r.byte_len == len(entries[r.entry_path]) and r.archive == path for r in got)
    stored = made(path + ".stored", list(entries.items())[:5], zipfile.ZIP_STORED)
    assert archives.zip_entries(spark, [path, stored]).count() == len(entries) + 5
    assert archives.zip_entries(spark, []).count() == 0 and archives.zip_entries(spark, [path], "*.txt").count() == 0


def test_filters_reach_the_directory(spark, large, monkeypatch):
    path, entries = large
    found = archives.zip_entries(spark, [path], split_bytes=1)
    german = found.where(F.col("entry_path").startswith("de/"))
    assert german.rdd.getNumPartitions() == sum(p.startswith("de/") for p in entries)
    assert {r.entry_path for r in german.collect()} == {p for p in entries if p.startswith("de/")}
    one = found.where((F.col("entry_path") == "en/001.md") & (F.col("byte_len") > 5))
    assert one.rdd.getNumPartitions() == 1 and [r.byte_len for r in one.collect()] == [40_001]
    assert found.where(F.col("entry_path").isin("en/001.md", "de/003.md", "none")).count() == 2
    assert archives.zip_entries(spark, [path], "en/00*").count() == 6


def test_only_ranges_are_read(large):
    path, entries = large
    held = archives.directory(path)
    chosen = held[7]
    taken = []

    class Watched(io.FileIO):
        def read(self, n=-1):
            taken.append((self.tell(), n))
            return super().read(n)

    with Watched(path) as file:
        assert archives.content(file, path, chosen) == entries[chosen.path]
    assert all(chosen.at <= at and at + n <= chosen.at + chosen.packed + 200 for at, n in taken)


def test_damaged_entries_are_errors(tmp_path, large):
    path, entries = large
    whole = open(path, "rb").read()
    e = archives.directory(path)[3]
    for at in (e.at, e.at + 30 + len(e.path) + 20):
        with pytest.raises((ValueError, Exception)):
            archives.content(io.BytesIO(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]), path, e)
    bomb = archives.Entry(e.path, e.at, e.packed, 10, e.crc, e.method)
    with pytest.raises(ValueError, match="other bytes"):
        archives.content(io.BytesIO(whole), path, bomb)


def test_archives_that_are_written_are_read(spark, tmp_path):
    rows = [(i % 3, f"{i}.md", None if i == 4 else f"text {i} é" * i) for i in range(20)]
    frame = spark.createDataFrame(rows, "archive int, entry_path string, content string")
    written = archives.write_archives(frame, str(tmp_path / "z")).collect()
    assert sorted((r.archive, r.n_entries) for r in written) == [("0", 7), ("1", 7), ("2", 6)]
    got = archives.zip_entries(spark, [r.uri for r in written]).collect()
    assert {r.entry_path: r.content.decode() for r in got} == {p: t or "" for _, p, t in rows}
    assert archives.write_archives(frame.limit(0), str(tmp_path / "y")).count() == 0
