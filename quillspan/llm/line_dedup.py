"""Line dedup over levelled sorted runs of line hashes.

The store is a log-structured set of runs: each is a table of line hashes,
bucketed and sorted by them, with the number of documents that had the line and
the largest of their ids. A batch of documents is reduced to its own hashes; a
merge anti-join with each run in turn finds those not met before, which become a
new run, and the hits go to a tally. As all runs have the same buckets, sorted,
the merge reads them as they lie: no run is shuffled or sorted again. When a
level has ``fanout`` runs they are merged into one run of the next level. Lines
over the limit are those whose run and tally entries add up to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import dropped, fresh, shared_path, slices, without, written

#: Characters stripped from both ends of a line, and letters that are lower-cased.
STRIPPED = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space of ASCII at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def line_hashes(df: DataFrame, least_chars: int, *also: str) -> DataFrame:
    """Of (doc_id, text): a row (h1, h2, doc_id, at) for each line of at least ``least_chars`` code points; ``at`` is its number from 0."""
    lines = df.select("doc_id", *also, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line"))
    keyed = lines.where(F.length("line") >= least_chars).withColumn("line", line_key(F.col("line")))
    # two hashes that share no state: 128 bits
    return keyed.where(F.length("line") >= least_chars).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.concat(F.lit("\x01"), "line")).alias("h2"), "doc_id", *also, "at")


def document_counts(lines: DataFrame) -> DataFrame:
    """(h1, h2, n, last): in how many documents each line is, and the largest id. Counts are summed before the shuffle, so a line that a third of all documents share is a row a task."""
    once = lines.select("h1", "h2", "doc_id").distinct()
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


class LineRuns:
    """The runs on disk, under a folder that all executors share; ``close`` takes their tables out of the session again.

    ``buckets`` is fixed when the runs are made. A bucket is one sorted file a
    run, so that readers can rely on its order.
    """

    COLUMNS = "h1 bigint, h2 bigint, n bigint, last bigint"

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout is 2 or more")
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tally: list[str] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0
        self.kinds: dict[str, set[str]] = {"run": set(), "tally": set(), "batch": set()}

    def _put(self, rows: DataFrame, kind: str) -> str:
        """Write rows as a run: its name in the session's catalogue."""
        table = f"{self.name}_{self.made:05d}"
        dealt = rows.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{kind}-{self.made:05d}").format("parquet").saveAsTable(table)
        self.made += 1
        self.kinds[kind].add(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        dropped(self.spark, self._path(table))

    def _path(self, table: str) -> str:
        (kind,) = (k for k in ("run", "tally", "batch") if table in self.kinds[k])
        return f"{self.folder}/{kind}-{table[-5:]}"

    def _read(self, tables: list[str]) -> DataFrame:
        """Rows of several runs, by their files: a union of bucketed tables is not bucketed, and is not to pass for it."""
        if not tables:
            return self.spark.createDataFrame([], self.COLUMNS)
        return self.spark.read.schema(self.COLUMNS).parquet(*map(self._path, tables))

    def runs(self) -> DataFrame:
        """Every line hash met so far, once."""
        return self._read([t for level in self.levels for t in level])

    def merged(self, batch: DataFrame, how: str) -> DataFrame:
        """The rows of a table of this store that are in none of the runs ("left_anti"), by a merge join with each in turn."""
        for table in (t for level in self.levels for t in level):
            batch = batch.hint("merge").join(self.spark.table(table).select("h1", "h2"), ["h1", "h2"], how)
        return batch

    @contextmanager
    def sorted_buckets(self) -> Iterator[None]:
        """Scans of a run tell Spark that its buckets are sorted, which one file a bucket makes true."""
        settings = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
        before = {k: self.spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of (h1, h2, n, last), each hash once.

        A batch's documents must be others than those of the batches before.
        """
        if not self.levels:
            self.levels.append([self._put(batch, "run")])
            return
        waiting = self._put(batch, "batch")
        with self.sorted_buckets():
            rows = self.spark.table(waiting)
            fresh = self._put(self.merged(rows, "left_anti"), "run")
            # what is not fresh was met before
            again = rows.hint("merge").join(self.spark.table(fresh).select("h1", "h2"), ["h1", "h2"], "left_anti")
            self.tally.append(self._put(again, "tally"))
        self.levels[0].append(fresh)
        self._drop(waiting)
        self._compact()

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                merged = self._put(self._read(runs), "run")
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                self.levels[level] = []
                for table in runs:
                    self._drop(table)

    def frequent(self, least: int) -> DataFrame:
        """(h1, h2, last) of lines that at least so many documents have."""
        both = self.runs().unionByName(self._read(self.tally))
        total = both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        return total.where(F.col("n") >= least).select("h1", "h2", "last")

    def close(self) -> None:
        """Drop the tables from the session and their files."""
        for table in (t for level in self.levels for t in level):
            self._drop(table)
        for table in self.tally:
            self._drop(table)
        self.levels, self.tally = [], []


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_documents: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``df`` with kept_text, n_lines and n_dropped.

    Lines of at least ``least_chars`` code points, once stripped and with A-Z in
    lower case, that are in at least ``least_documents`` documents are dropped
    everywhere but in the document with the largest key that has them, which
    keeps all its copies. Other lines stay, joined by line feeds.

    The table goes into the runs in ``batches`` parts by a hash of the key. Only
    hashes are shuffled for that; texts are moved once, to meet their documents'
    numbers of dropped lines.

    A null or empty text is one empty line. Rows with the same key are one
    document when counting, and each gets its result; rows with a null key count
    as one document, which is never the largest, and keep their lines. An empty table gives no rows. Columns called kept_text, n_lines or
    n_dropped, in any case, are replaced.
    """
    spark = df.sparkSession
    identity = [F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row")]
    source = df.select(*identity, F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(batches)).alias("part"))
    lines = written(line_hashes(source, least_chars, "row", "part"), "lines")
    runs = LineRuns(spark, shared_path(spark, "line-runs"), fanout)
    for i in range(batches):
        runs.add(document_counts(lines.where(F.col("part") == i)))
    frequent = written(runs.frequent(least_documents), "frequent-lines")
    runs.close()
    hits = lines.join(frequent, ["h1", "h2"]).where(F.coalesce(F.col("doc_id") < F.col("last"), F.lit(False)))
    drops = hits.select("doc_id", "row", "at").distinct().groupBy("doc_id", "row").agg(F.collect_list("at").alias("_drops"))
    kept = without(df, "kept_text", "n_lines", "n_dropped")
    doc, row, gone = fresh(kept.columns, "doc", "row", "drops")
    drops = drops.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("_drops").alias(gone))
    joined = kept.join(drops, (kept[key].cast("long") == drops[doc]) & (F.xxhash64(kept[text]) == drops[row]), "left").drop(doc, row)
    schema = T.StructType([*kept.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, counts, missing = [], [], []
            for value, drop in zip(batch.column(text).to_pylist(), batch.column(gone).to_pylist(), strict=True):
                rows = (value or "").split("\n")
                out = set(drop or ())
                counts.append(len(rows))
                missing.append(len(out))
                texts.append("\n".join([x for i, x in enumerate(rows) if i not in out]) if out else value or "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(missing, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def replace_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_documents: int = 3, **options) -> DataFrame:
    """``df``, with its own columns, where each text is what ``dedup_lines`` keeps of it; a null text stays null."""
    kept = dedup_lines(df.withColumnsRenamed({c: f"~{c}" for c in df.columns}), f"~{key}", f"~{text}", least_chars, least_documents, **options)
    return kept.select([(F.when(F.col(f"`~{c}`").isNotNull(), F.col("kept_text")) if c == text else F.col(f"`~{c}`")).alias(c) for c in df.columns])
