"""Immutable snapshots of tables under a log of commits, on any store that Spark writes to.

A generation is a folder of its own that is written once. A commit is a numbered
entry in the log, made only if no other has its number, and it counts only when
it is whole; the highest one is the current snapshot. So a writer that stops
anywhere leaves the snapshot before it in place, of two writers both commit, one
after the other, and a reader always finds a whole snapshot once there is one.

A generation's files are listed with their sizes and digests, with a digest over
each table's list and one over those in its manifest. Opening compares names and
sizes; the bytes are read again only on demand, by many tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.store import file_digests, listed

VERSION = 3
#: States of a snapshot.
MISSING, INVALID, STALE, DEGRADED, READY = "missing", "invalid", "stale", "degraded_model", "ready"
LEASE = 3600  # seconds for which a reader holds a generation, unless it says otherwise
ABANDONED = 24 * 3600  # seconds after which a generation that was never committed goes
FILE = "path string, bytes bigint, sha256 string"


class Store:
    """Small files, listings and renames under a root, through the file systems that Spark itself uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def age(self, name: str) -> float:
        """Seconds since it was last changed."""
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def files(self, folder: str) -> list[tuple[str, int]]:
        """(path from the root, bytes) of the files in a folder and those below it, without marks and checksums."""
        if not self.exists(folder):
            return []
        out, found = [], self.fs.listFiles(self._path(folder), True)
        base = len(self.fs.makeQualified(self._path("")).toString()) + 1
        while found.hasNext():
            one = found.next()
            if not one.getPath().getName().startswith(("_", ".")):
                out.append((one.getPath().toString()[base:], one.getLen()))
        return out

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Under another name, then renamed. In between, where a file is replaced, there is none of that name."""
        part = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name):
            self.delete(name)
        if not self.fs.rename(self._path(part), self._path(name)):
            raise OSError(f"{name} could not be written")

    def create(self, name: str, text: str) -> bool:
        """Make a file unless there is one, which one caller alone can do; what is in it may be cut short by a crash."""
        path = self._path(name)
        self.fs.mkdirs(path.getParent())
        if self.fs.getUri().getScheme() == "file":
            try:
                out = os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(out, "wb") as file:
                file.write(text.encode())
            return True
        try:
            stream = self.fs.create(path, False)
        except Exception:
            if self.exists(name):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def flip(self, name: str, at: int) -> None:
        """Change one byte of a small file, as damage would, to see that it is found."""
        stream = self.fs.open(self._path(name))
        try:
            data = bytearray(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        data[at] ^= 1
        out = self.fs.create(self._path(name), True)
        out.write(data)
        out.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def snapshot_id(inputs: dict) -> str:
    """Of everything that decides the contents: versions, fingerprints, configuration."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest()


def digest(df: DataFrame, *columns: str) -> dict:
    """A fingerprint of rows that does not depend on their order and is never gathered: their number, and two sums of hashes. Of all columns if none are named."""
    cells = [F.col(f"`{c}`") for c in columns or df.columns]
    cells.append(F.array(*[F.isnull(c) for c in cells]))  # a hash passes over nulls: where they are counts too
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*cells)).alias("x"), F.sum(F.xxhash64(F.lit(1), *cells).cast("decimal(38,0)")).cast("string").alias("s")).first()
    return {"rows": row["n"], "xor": row["x"], "sum": row["s"]}


def hashed(store: Store, files: list[tuple[str, int]]) -> DataFrame:
    """(path, bytes, sha256) of files under the root."""
    base = f"{store.fs.makeQualified(store._path('')).toString()}/"
    found = file_digests(store.spark, [f"{base}{p}" for p, _ in files]).select(F.substring("uri", len(base) + 1, 1 << 30).alias("path"), "sha256")
    return listed(store.spark, files, "path string, bytes bigint").join(found, "path").select("path", "bytes", "sha256")


def tree(files: DataFrame, generation: str) -> dict:
    """A digest of each table's files (those outside the generation are one table), and the root over all."""
    own = F.regexp_extract("path", f"^generations/{generation}/([^/]+)/", 1)
    line = F.transform(F.sort_array(F.collect_list(F.struct("path", "bytes", "sha256"))), lambda x: F.concat_ws(" ", x["sha256"], x["bytes"].cast("string"), x["path"]))
    tables = {r["key"]: r["digest"] for r in files.groupBy(own.alias("key")).agg(F.sha2(F.array_join(line, "\n"), 256).alias("digest")).collect()}  # a row a table
    return {"root": hashlib.sha256(json.dumps(tables, sort_keys=True).encode()).hexdigest(), "tables": tables}


# the log


@dataclass(frozen=True)
class Entry:
    number: int
    generation: str
    id: str
    shared: tuple[str, ...] = ()  # folders outside the generation that it reads


def entries(store: Store) -> list[Entry]:
    """The commits that are whole, the last one first."""
    out = []
    for name in sorted((n for n in store.names("log") if n.endswith(".json")), reverse=True):
        line, _, check = store.read(f"log/{name}").partition("\n")
        if check == hashlib.sha256(line.encode()).hexdigest():
            found = json.loads(line)
            out.append(Entry(int(name.split(".")[0]), found["generation"], found["id"], tuple(found["shared"])))
    return out


def commit(store: Store, generation: str, name: str, shared: list[str]) -> int:
    """The number of the new entry: the next free one, whoever else commits."""
    line = json.dumps({"generation": generation, "id": name, "shared": sorted(shared)})
    while True:
        number = max((int(n.split(".")[0]) for n in store.names("log") if n.endswith(".json")), default=0) + 1
        if store.create(f"log/{number:020d}.json", f"{line}\n{hashlib.sha256(line.encode()).hexdigest()}"):
            return number


def leased(store: Store, generation: str) -> bool:
    """Whether a reader holds it; leases that have run out are taken away."""
    held = False
    for name in store.names(f"leases/{generation}"):
        if float(name.partition("-")[0]) > time.time():
            held = True
        else:
            store.delete(f"leases/{generation}/{name}")
    return held


def sweep(store: Store, keep: int) -> None:
    """Delete generations beyond the current one and ``keep`` before it that no reader holds, their entries first, and the folders that they alone read; and what was written and never committed, a day later."""
    known = entries(store)
    kept = list(dict.fromkeys(e.generation for e in known))[: 1 + max(0, keep)]
    kept += [e.generation for e in known if e.generation not in kept and leased(store, e.generation)]
    needed = {f for e in known if e.generation in kept for f in e.shared}
    for e in reversed(known):
        if e.generation not in kept:
            store.delete(f"log/{e.number:020d}.json")
            store.delete(f"generations/{e.generation}")
            for folder in set(e.shared) - needed:
                store.delete(folder)
    named = {f"generations/{e.generation}" for e in known} | {f for e in known for f in e.shared}
    for home in {f.rpartition("/")[0] for f in named}:
        for folder in (f"{home}/{n}" for n in store.names(home)):
            if folder not in named and store.age(folder) > ABANDONED:
                store.delete(folder)


def publish(spark: SparkSession, root: str, inputs: dict, tables: dict[str, DataFrame], force: bool = False, check: Callable[[Snapshot], None] = lambda s: None, keep: int = 1, shared: list[str] = (), more: dict | None = None, ids: dict[str, str] | None = None) -> tuple[str, bool]:
    """(id, whether it was built).

    Unless forced, a whole generation of the same inputs is taken if there is
    one. A new one is written in a folder that nothing else names, hashed, opened
    and checked as readers would, and then committed. A failure before that
    leaves the log as it was. Of older generations ``keep`` stay, and those that
    readers hold. ``shared`` are folders under the root that the generation reads
    and that never change: what an earlier one hashed is not read again. ``more``
    is kept in the manifest. Tables named in ``ids`` are dealt by ranges of that
    column, and the range of each file is listed, for ``Snapshot.with_ids``.
    """
    name, store = snapshot_id(inputs), Store(spark, root)
    if not force and recommitted(spark, store, name):
        return name, False
    known = entries(store)
    generation = uuid.uuid4().hex
    folder = f"generations/{generation}"
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for key, df in tables.items():
            own = (ids or {}).get(key)
            df = df.repartitionByRange(parts, own).sortWithinPartitions(own) if own else df
            df.write.option("compression", "zstd").parquet(f"{store.root}/{folder}/{key}")
        ranges = [_ranges(spark, f"{store.root}/{folder}", key, own) for key, own in (ids or {}).items() if key in tables]
        if ranges:
            reduce(DataFrame.unionByName, ranges).coalesce(1).write.parquet(f"{store.root}/{folder}/_ranges")
        # the numbers of rows are in the files' footers
        counts = {key: spark.read.parquet(f"{store.root}/{folder}/{key}").count() for key in tables}
        old = [x for f in shared for x in store.files(f)]
        digests = hashed(store, store.files(folder))
        if old:
            before = _opened_files(spark, store, known[0]) if known else listed(spark, [], FILE)
            taken = before.join(listed(spark, old, "path string, bytes bigint"), ["path", "bytes"], "left_semi").select("path", "bytes", "sha256")
            held = {r["path"] for r in taken.select("path").collect()}
            fresh = [x for x in old if x[0] not in held]
            digests = digests.unionByName(taken)
            if fresh:
                digests = digests.unionByName(hashed(store, fresh))
        digests.write.parquet(f"{store.root}/{folder}/_files")
        found = tree(spark.read.schema(FILE).parquet(f"{store.root}/{folder}/_files"), generation)
        store.write(f"{folder}/snapshot.json", json.dumps({"version": VERSION, "inputs": inputs, "counts": counts, "tree": found, "shared": sorted(shared), **(more or {})}, indent=2, sort_keys=True))
        check(Snapshot(spark, store, generation, name))
    except BaseException:
        store.delete(folder)
        raise
    commit(store, generation, name, list(shared))
    sweep(store, keep)
    return name, True


def _ranges(spark: SparkSession, folder: str, key: str, own: str) -> DataFrame:
    """(key, file, least, most) of a column of a table; nothing else of the table is read."""
    rows = spark.read.parquet(f"{folder}/{key}").select(own, F.col("_metadata.file_name").alias("file")).where(F.col(own).isNotNull())
    return rows.groupBy("file").agg(F.min(own).cast("string").alias("least"), F.max(own).cast("string").alias("most")).select(F.lit(key).alias("key"), "file", "least", "most")


def recommitted(spark: SparkSession, store: Store, name: str) -> bool:
    """Whether a generation of these inputs is there and opens; it is then the current one."""
    for place, e in enumerate(entries(store)):
        if e.id == name:
            try:
                Snapshot(spark, store, e.generation, e.id)
            except Exception:  # whatever keeps it from being read: it is built again
                continue
            if place:
                commit(store, e.generation, name, list(e.shared))
            return True
    return False


def _opened_files(spark: SparkSession, store: Store, entry: Entry) -> DataFrame:
    return spark.read.schema(FILE).parquet(f"{store.root}/generations/{entry.generation}/_files")


class Snapshot:
    """A snapshot's tables by name. Opening it compares the names and sizes of its files, and the list of their digests, with what was published."""

    def __init__(self, spark: SparkSession, store: Store, generation: str, name: str):
        self.spark, self.store, self.generation, self.id = spark, store, generation, name
        self.path = f"{store.root}/generations/{generation}"
        self.manifest = json.loads(store.read(f"generations/{generation}/snapshot.json"))
        if self.manifest["version"] != VERSION or snapshot_id(self.manifest["inputs"]) != name:
            raise ValueError("the snapshot is of another version, or its manifest was changed")
        self.counts = self.manifest["counts"]
        self.files = spark.read.schema(FILE).parquet(f"{self.path}/_files")
        if tree(self.files, generation) != self.manifest["tree"]:
            raise ValueError("the list of the snapshot's files was changed")
        there = [x for f in (f"generations/{generation}", *self.manifest["shared"]) for x in store.files(f) if not x[0].endswith("/snapshot.json") and "/_files/" not in x[0]]
        now = listed(spark, there, "path string, now bigint")
        wrong = self.files.join(now, "path", "full_outer").where(~F.col("bytes").eqNullSafe(F.col("now"))).select("path").orderBy("path").limit(5).collect()
        if wrong:
            raise ValueError(f"files are missing, added or of another size: {', '.join(r['path'] for r in wrong)}")

    @staticmethod
    def current(spark: SparkSession, root: str, lease: float = 0) -> Snapshot:
        """The last commit's snapshot. With a ``lease`` in seconds it is kept for so long whatever is built; ``hold`` renews that."""
        store = Store(spark, root)
        for e in entries(store)[:1]:
            if lease:
                hold(store, e.generation, lease)
            return Snapshot(spark, store, e.generation, e.id)
        raise FileNotFoundError("there is no snapshot")

    def hold(self, seconds: float = LEASE) -> None:
        hold(self.store, self.generation, seconds)

    def damaged(self) -> DataFrame:
        """(path) of the files whose bytes are not those that were published; all are read."""
        files = [(r["path"], r["bytes"]) for r in self.files.select("path", "bytes").collect()]  # a row a file
        now = hashed(self.store, files).select("path", F.col("sha256").alias("now"))
        return self.files.join(now, "path").where(F.col("sha256") != F.col("now")).select("path")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def _ranges(self) -> dict[str, list[tuple[str, str, str]]]:
        out: dict = {}
        if self.store.exists(f"generations/{self.generation}/_ranges"):
            for r in self.spark.read.parquet(f"{self.path}/_ranges").collect():  # a row a file
                out.setdefault(r["key"], []).append((r["least"], r["most"], r["file"]))
        return out

    def with_ids(self, name: str, column: str, values: list[str]) -> DataFrame:
        """The rows of a table whose ``column``, the one that it is dealt by, is one of some texts: only files whose range has one of these are opened."""
        listed = self._ranges.get(name, [])
        files = [f for least, most, f in listed if any(least <= v <= most for v in values)]
        if not listed:
            return self.table(name).where(F.col(column).isin(values))
        if not files:
            return self.table(name).limit(0)
        return self.spark.read.parquet(*[f"{self.path}/{name}/{f}" for f in files]).where(F.col(column).isin(values))


def hold(store: Store, generation: str, seconds: float) -> None:
    store.create(f"leases/{generation}/{time.time() + seconds:.3f}-{uuid.uuid4().hex}", "")


@dataclass(frozen=True)
class Status:
    """state, the reasons for it (stale ones first), and for each archive whether it is as it was."""

    state: str
    reasons: tuple[str, ...] = ()
    snapshot_id: str | None = None
    archives: tuple[dict, ...] = field(default=())

    @property
    def usable(self) -> bool:
        """Whether searches can be served."""
        return self.state in (READY, STALE, DEGRADED)

    @property
    def exit_code(self) -> int:
        return {READY: 0, DEGRADED: 0, MISSING: 2}.get(self.state, 1)


def freshness(built: list[dict], now: list[dict]) -> tuple[dict, ...]:
    """Of archives (id, sha256 and more) by id: whether all that was recorded is as it is now; one that is on one side only is not fresh."""
    then, today = ({a["id"]: a for a in side} for side in (built, now))
    return tuple({"id": k, "fresh": then.get(k) == today.get(k), "expected_sha256": then.get(k, {}).get("sha256"), "actual_sha256": today.get(k, {}).get("sha256")} for k in sorted({*then, *today}))


def status(spark: SparkSession, root: str, inputs: dict, model_reason: str | None = None, deep: bool = False) -> Status:
    """The state against what a build would now have as its inputs: missing, invalid, stale, degraded_model or ready.

    ``inputs`` may have archives, a list with ids and checksums, and artifacts of
    the model: if these alone differ, texts are searched as before and vectors
    are not. ``deep`` reads all files and compares their digests.
    """
    try:
        opened = Snapshot.current(spark, root)
        if deep and (lost := [r["path"] for r in opened.damaged().orderBy("path").limit(5).collect()]):
            raise ValueError(f"files are damaged: {', '.join(lost)}")
    except FileNotFoundError as error:
        return Status(MISSING, (str(error),))
    except Exception as error:  # whatever keeps it from being read makes it invalid
        return Status(INVALID, (str(error).splitlines()[0],))
    before = opened.manifest["inputs"]
    archives = freshness(before.get("archives", []), inputs.get("archives", []))
    reasons = [f"archive {a['id']} differs" for a in archives if not a["fresh"]]
    reasons += [f"{k} differs" for k in sorted({*before, *inputs}) if k not in ("archives", "artifacts") and before.get(k) != inputs.get(k)]
    if before.get("artifacts") != inputs.get("artifacts", before.get("artifacts")):
        model_reason = model_reason or "artifacts of the model differ"
    state = STALE if reasons else DEGRADED if model_reason else READY
    return Status(state, (*reasons, *([model_reason] if model_reason else [])), opened.id, archives)
