"""A corpus of ZIP archives under a manifest: checked, then read without extraction."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources import archives as archives_
from quillspan.store import file_digests


def entry_path(name: str) -> str:
    """A safe relative path of a Markdown entry; ValueError for any other."""
    parts = [p for p in name.replace("\\", "/").split("/") if p != "."]
    path = "/".join(parts)
    if not name or "\0" in name or path.startswith("/") or re.match("[A-Za-z]:", path) or any(p in ("", "..") for p in parts):
        raise ValueError(f"unsafe path {name!r}")
    if not path.lower().endswith(".md"):
        raise ValueError(f"not a Markdown entry: {name!r}")
    return path


def relative_path(name: str) -> str:
    """A path below a folder, with slashes; ValueError for an empty or absolute one, one with a drive or NUL, or with empty, ``.`` or ``..`` parts."""
    path = name.replace("\\", "/")
    if not path or "\0" in path or ":" in path or any(p in ("", ".", "..") for p in path.split("/")):
        raise ValueError(f"unsafe path {name!r}")
    return path


def load_manifest(path: str) -> list[dict]:
    """The archives of a manifest, sorted by vendor and id; ValueError if it is not valid."""
    data = tomllib.loads(Path(path).read_text())
    archives = data.get("archives") or []
    if data.get("schema_version") != 1 or not archives:
        raise ValueError("the manifest is of another version, or has no archives")
    ids = [a["id"] for a in archives]
    if len(set(ids)) < len(ids) or not all(i.strip() for i in ids):
        raise ValueError("archive ids are blank or repeated")
    for a in archives:
        if not re.fullmatch("[0-9a-f]{64}", a["sha256"]):
            raise ValueError(f"the checksum of {a['id']} is not one")
        relative_path(a["path"])
    return sorted(archives, key=lambda a: (a["vendor"], a["id"]))


def checked_entries(archive: dict, entries: list[archives_.Entry]) -> dict[str, str]:
    """The safe path of each entry's name; ValueError if the directory is not as declared."""
    paths, total = {}, 0
    for e in entries:
        path = entry_path(e.path)
        total += e.size
        if path in paths.values() or total > archive["uncompressed_bytes"]:
            raise ValueError(f"{path} is repeated, or the archive is larger than declared")
        paths[e.path] = path
    if len(paths) != archive["entry_count"] or total != archive["uncompressed_bytes"]:
        raise ValueError(f"{archive['id']} has other entries or sizes than declared")
    return paths


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers name it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _places(spark: SparkSession, folder: str, archives: list[dict]) -> dict[str, dict]:
    """Archives by the whole paths of their files, which tell them apart."""
    return {_qualified(spark, f"{folder}/{relative_path(a['path'])}"): a for a in archives}


def checksums(spark: SparkSession, folder: str, archives: list[dict]) -> dict[str, str]:
    """SHA-256 of the archives' files as they lie now, by id; a file that is missing has none. A file is read a few MB at a time."""
    there = _places(spark, folder, [a for a in archives if _exists(spark, f"{folder}/{relative_path(a['path'])}")])
    return {there[r["uri"]]["id"]: r["sha256"] for r in file_digests(spark, sorted(there)).collect()} if there else {}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_corpus(spark: SparkSession, folder: str, archives: list[dict], split_bytes: int = archives_.SPLIT_BYTES) -> DataFrame:
    """The documents of all archives, in order of vendor, archive and path where they are sorted by ``in_order``.

    Checksums, and the entries' paths, number and sizes, are compared with the
    manifest first; then each archive is read by as many tasks as it has
    ``split_bytes`` of packed entries.
    """
    places = _places(spark, folder, archives)
    found = checksums(spark, folder, archives)
    for a in archives:
        if found.get(a["id"]) != a["sha256"]:
            raise ValueError(f"the checksum of {a['id']} differs")
    named = [(uri, name, path) for uri, a in places.items() for name, path in checked_entries(a, archives_.directory(uri)).items() if path != name]
    about = spark.createDataFrame([(uri, a["id"], a["sha256"], a["vendor"]) for uri, a in places.items()], "archive string, archive_id string, archive_sha256 string, vendor string")
    other = spark.createDataFrame(named, "archive string, entry_path string, _safe string")
    # a row an archive
    rows = archives_.zip_entries(spark, sorted(places), split_bytes=split_bytes).join(F.broadcast(about), "archive").join(other, ["archive", "entry_path"], "left")
    path = F.coalesce("_safe", "entry_path")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), path)))
    identity = F.concat(F.lit("doc:"), F.sha2(F.concat("archive_id", F.lit("\0"), path), 256))
    return rows.select(identity.alias("document_id"), "archive_id", "archive_sha256", "vendor", path.alias("entry_path"), F.sha2("content", 256).alias("content_sha256"), "byte_len", text.alias("source"))


def in_order(documents: DataFrame) -> DataFrame:
    """Documents by vendor, archive and path."""
    from quillspan.ingest.build import vendor_rank

    return documents.orderBy(vendor_rank(F.col("vendor")), "vendor", "archive_id", "entry_path")
