"""The inverted index as segments of compressed blocks.

A segment is what one build added: its documents with their numbers, their
postings in blocks, and the numbers of its terms. It never changes. Documents
that go are listed in removals, with what they take from the numbers of terms,
so searches give the scores of an index that never had them. Segments of like
size are merged when there are ``fanout`` of them, so a posting is rewritten a
number of times that grows with the logarithm of the index.

A manifest of a few hundred bytes names the segments and removals that make one
state of the index. It is saved last; older states stay readable until what they
alone name is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.stemmer import stem
from quillspan.operators import blocks, lexical
from quillspan.operators.snapshot import Store
from quillspan.store import listed, numbered, written

MANIFEST = "index.json"
FANOUT = 8
EMPTY = {"next": 0, "segments": [], "removals": [], "n_docs": 0, "n_tokens": {}}
TERM = "field string, term string, n_with bigint, n_places bigint"
KINDS = {"blocks": "segment", "docs": "segment", "terms": "segment", "dead": "removal", "minus": "removal"}


@dataclass(frozen=True)
class Index:
    """One state of an index under ``root``."""

    spark: SparkSession
    root: str
    manifest: dict

    # reading

    @staticmethod
    def open(spark: SparkSession, root: str, manifest: str | None = None) -> Index:
        """The state that a manifest's text names, or the saved one."""
        return Index(spark, root.rstrip("/"), json.loads(manifest or Store(spark, root).read(MANIFEST)))

    @property
    def stemming(self) -> bool:
        return self.manifest["stemming"]

    @property
    def n_docs(self) -> int:
        return self.manifest["n_docs"]

    def mean_length(self, field: str) -> float:
        """Tokens of the field a document, of all documents."""
        return self.manifest["n_tokens"].get(field, 0) / self.n_docs if self.n_docs else 0.0

    def _names(self, kind: str) -> list[str]:
        return [x["name"] for x in self.manifest["segments" if KINDS[kind] == "segment" else "removals"]]

    def _read(self, kind: str, schema: str, names: list[str] | None = None) -> DataFrame:
        """The rows of a kind in all segments or removals, with the name of theirs."""
        names = self._names(kind) if names is None else names
        schema = f"{schema}, {KINDS[kind]} string"
        if not names:
            return listed(self.spark, [], schema)
        base = f"{self.root}/{kind}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{KINDS[kind]}={n}" for n in names])

    @property
    def blocks(self) -> DataFrame:
        return self._read("blocks", blocks.BLOCK)

    @property
    def dead(self) -> DataFrame:
        """(of_segment, doc_no) of documents that went and are still in a segment."""
        return self._read("dead", "of_segment string, doc_no bigint").where(F.col("of_segment").isin(self._names("blocks")))

    def alive(self, rows: DataFrame) -> DataFrame:
        """The rows whose document is still there."""
        return rows.join(self.dead.select("doc_no"), "doc_no", "left_anti") if self.manifest["removals"] else rows

    @property
    def docs(self) -> DataFrame:
        """(doc_no, chunk_id, segment) of the documents that are there."""
        return self.alive(self._read("docs", f"doc_no bigint, chunk_id {self.manifest['id_type']}"))

    @property
    def terms(self) -> DataFrame:
        """(field, term, n_with, n_places) over the documents that are there."""
        rows = self._read("terms", TERM).drop("segment")
        if len(self.manifest["segments"]) == 1 and not self.manifest["removals"]:
            return rows
        minus = self._read("minus", f"of_segment string, {TERM}").where(F.col("of_segment").isin(self._names("blocks")))
        rows = rows.unionByName(minus.select("field", "term", (-F.col("n_with")).alias("n_with"), (-F.col("n_places")).alias("n_places")))
        return rows.groupBy("field", "term").agg(F.sum("n_with").alias("n_with"), F.sum("n_places").alias("n_places")).where("n_with > 0")

    def of_terms(self, terms: list[str], fields: list[str] | None = None, positions: bool = False) -> DataFrame:
        """Postings of these terms with idf and the field's mean length; the terms reach the scan of the blocks."""
        wanted = F.col("term").isin(terms)
        if fields:
            wanted &= F.col("field").isin(fields)
        means = F.create_map(*[x for f in lexical.FIELDS for x in (F.lit(f), F.lit(self.mean_length(f)))])
        # a row a term and field asked for: bounded by the request
        known = F.broadcast(self.terms.where(wanted).select("field", "term", lexical.idf(F.lit(float(self.n_docs)), F.col("n_with")).alias("idf"), means[F.col("field")].alias("mean")))
        # blocks of a common term lie side by side in few files: they are opened by all tasks
        held = self.blocks.where(wanted).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "field", "term", "first")
        return self.alive(blocks.decoded(held, positions)).join(known, ["field", "term"])

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows with chunk_id in place of doc_no."""
        return self.docs.select("doc_no", "chunk_id").join(rows, "doc_no").select("chunk_id", *[c for c in rows.columns if c != "doc_no"])

    def query_words(self, text: str) -> list[str]:
        """A query's terms in order, each once. Where texts have stems a query is analysed twice: its stems are stemmed again."""
        found = list(lexical.plain_tokens(text))
        for _ in range(2 if self.stemming else 0):
            found = [stem(t) for w in found for t in lexical.plain_tokens(w)]
        return list(dict.fromkeys(found))

    # writing

    @staticmethod
    def write(fields: DataFrame, root: str, stemming: bool = True) -> Index:
        """A new index of the documents (chunk_id and fields) under an empty folder. A chunk id that occurs twice is an error."""
        return Index.empty(fields, root, stemming).updated(fields).saved()

    @staticmethod
    def empty(fields: DataFrame, root: str, stemming: bool) -> Index:
        return Index(fields.sparkSession, root.rstrip("/"), EMPTY | {"stemming": stemming, "id_type": fields.schema["chunk_id"].dataType.simpleString()})

    def saved(self) -> Index:
        Store(self.spark, self.root).write(MANIFEST, self.text())
        return self

    def text(self) -> str:
        return json.dumps(self.manifest, sort_keys=True)

    def updated(self, added: DataFrame, removed: DataFrame | None = None, fanout: int = FANOUT) -> Index:
        """The next state: without the documents of ``removed`` (their fields as they were indexed, which tell their terms), with those of ``added`` as a new segment, and merged where there are ``fanout`` segments of like size or half of one is gone.

        What is written is in proportion to what changes, but for the merges.
        """
        out = self if removed is None else self._without(removed)
        rows = numbered(added, "doc_no", self.manifest["next"])
        ids = rows.select("chunk_id")
        if ids.groupBy("chunk_id").count().where("count > 1").take(1) or out.docs.join(ids, "chunk_id", "left_semi").take(1):
            raise ValueError("a chunk id occurs twice")
        n = rows.count()
        if n:
            # what is dealt by ranges is read twice, so it is made once
            made = written(lexical.postings(rows) if self.stemming else lexical.runs(rows), "postings")
            out = out._with_segment(made, rows.select("doc_no", "chunk_id"), n)
            out = Index(self.spark, self.root, out.manifest | {"next": self.manifest["next"] + n, "n_docs": out.n_docs + n})
        while names := out._due(fanout):
            out = out._merged(names)
        return out._one_removal() if len(out.manifest["removals"]) >= 2 * fanout else out

    def _with_segment(self, postings: DataFrame, docs: DataFrame, n: int) -> Index:
        """Blocks are dealt by ranges of (field, term, number), so a term that a third of all texts have is many tasks' and many files', and a search prunes the others by their statistics."""
        name, parts = f"s-{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        key = ("field", "term", "first" if "first" in postings.columns else "doc_no")
        path = lambda kind: f"{self.root}/{kind}/segment={name}"
        blocks.encoded(postings.repartitionByRange(parts, *key).sortWithinPartitions(*key)).write.option("compression", "zstd").parquet(path("blocks"))
        docs.select("doc_no", "chunk_id").sortWithinPartitions("doc_no").write.parquet(path("docs"))
        counted = self._read("blocks", blocks.BLOCK, [name]).groupBy("field", "term").agg(F.sum("n").alias("n_with"), F.sum("n_places").alias("n_places"))
        counted.repartitionByRange(parts, "term").sortWithinPartitions("term").write.parquet(path("terms"))
        tokens = {r["field"]: r["n"] for r in self._read("terms", TERM, [name]).groupBy("field").agg(F.sum("n_places").alias("n")).collect()}  # a row a field
        m = self.manifest
        return Index(self.spark, self.root, m | {"segments": [*m["segments"], {"name": name, "docs": n, "dead": 0}], "n_tokens": dict(Counter(m["n_tokens"]) + Counter(tokens))})

    def _without(self, removed: DataFrame) -> Index:
        gone = written(self.docs.join(removed, "chunk_id"), "removed")
        counts = {r["segment"]: r["n"] for r in gone.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row a segment
        if sum(counts.values()) != removed.count():
            raise ValueError("a document that is to go is not in the index, or is named twice")
        if not counts:
            return self
        name = f"r-{uuid.uuid4().hex}"
        gone.select(F.col("segment").alias("of_segment"), "doc_no").write.parquet(f"{self.root}/dead/removal={name}")
        # segments are few, and a join would take the postings of all that goes to the other side or broadcast them
        of_segment = [lexical.term_counts(gone.where(F.col("segment") == s).drop("segment"), self.stemming).select(F.lit(s).alias("of_segment"), "field", "term", "n_with", "n_places") for s in sorted(counts)]
        reduce(DataFrame.unionByName, of_segment).write.parquet(f"{self.root}/minus/removal={name}")
        tokens = {r["field"]: r["n"] for r in self._read("minus", f"of_segment string, {TERM}", [name]).groupBy("field").agg(F.sum("n_places").alias("n")).collect()}
        m = self.manifest
        segments = [s | {"dead": s["dead"] + counts.get(s["name"], 0)} for s in m["segments"]]
        left = {f: n - tokens.get(f, 0) for f, n in m["n_tokens"].items()}
        return Index(self.spark, self.root, m | {"segments": segments, "removals": [*m["removals"], {"name": name, "segments": sorted(counts)}], "n_docs": self.n_docs - sum(counts.values()), "n_tokens": left})

    def _due(self, fanout: int) -> list[str]:
        """Segments to merge now: those of one tier of size if there are enough, else one of which half is gone."""
        tiers: dict[int, list[str]] = defaultdict(list)
        for s in self.manifest["segments"]:
            size, tier = s["docs"], 0
            while size >= fanout:
                size, tier = size // fanout, tier + 1
            tiers[tier].append(s["name"])
        full = [names for _, names in sorted(tiers.items()) if len(names) >= fanout]
        return full[0] if full else [s["name"] for s in self.manifest["segments"] if 2 * s["dead"] > s["docs"]][:1]

    def _merged(self, names: list[str]) -> Index:
        """One segment in place of some: their live documents keep their numbers."""
        m = self.manifest
        live = sum(s["docs"] - s["dead"] for s in m["segments"] if s["name"] in names)
        rows = self.alive(blocks.decoded(self._read("blocks", blocks.BLOCK, names), positions=True))
        docs = self.docs.where(F.col("segment").isin(names))
        kept = [s for s in m["segments"] if s["name"] not in names]
        removals = [r for r in m["removals"] if any(s["name"] in r["segments"] for s in kept)]
        out = Index(self.spark, self.root, m | {"segments": kept})
        if live:
            # its tokens are counted already
            made = out._with_segment(rows, docs, live).manifest["segments"][-1]
            kept = [*kept, made]
        return Index(self.spark, self.root, m | {"segments": kept, "removals": removals})

    def _one_removal(self) -> Index:
        """All removals as one, for what is still in a segment."""
        name, alive = f"r-{uuid.uuid4().hex}", self._names("blocks")
        self.dead.select("of_segment", "doc_no").write.parquet(f"{self.root}/dead/removal={name}")
        minus = self._read("minus", f"of_segment string, {TERM}").where(F.col("of_segment").isin(alive))
        minus.groupBy("of_segment", "field", "term").agg(F.sum("n_with").alias("n_with"), F.sum("n_places").alias("n_places")).write.parquet(f"{self.root}/minus/removal={name}")
        touched = sorted({s for r in self.manifest["removals"] for s in r["segments"]} & set(alive))
        return Index(self.spark, self.root, self.manifest | {"removals": [{"name": name, "segments": touched}]})

    def folders(self) -> list[str]:
        """The folders under the root that this state is made of."""
        return [f"{kind}/{key}={n}" for kind, key in KINDS.items() for n in self._names(kind)]
