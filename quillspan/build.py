"""A corpus to a snapshot: parsed, chunked, indexed and embedded, taking from the last snapshot what has not changed."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.ingest import build as tables
from quillspan.ingest import chunker, manual
from quillspan.operators import embed, lexical, navigate, snapshot
from quillspan.operators.index import Index
from quillspan.store import written

CATALOG_VERSION, LEXICAL_VERSION = 1, 2
#: Folder of the index's segments under a root, which generations share.
LEXICAL = "lexical"


@dataclass(frozen=True)
class Report:
    """What a build did: chunks are counted as reused or embedded, not distinct texts."""

    snapshot_id: str
    built: bool
    documents: int
    chunks: int
    parsed_reused: int
    vectors_reused: int
    vectors_embedded: int
    warnings: int


def inputs_of(documents: DataFrame, archives: list[dict], embedder: embed.Embedder, budget: chunker.Budget, stemming: bool) -> dict:
    """Everything that decides a snapshot's contents."""
    versions = {"catalog": CATALOG_VERSION, "ingest": manual.INGEST_VERSION, "lexical": LEXICAL_VERSION, "vector": embed.VECTOR_VERSION, "snapshot": snapshot.VERSION}
    kept = sorted(({k: a[k] for k in ("id", "vendor", "path", "sha256", "entry_count", "uncompressed_bytes") if k in a} for a in archives), key=lambda a: a["id"])
    return {"versions": versions, "archives": kept, "entries": snapshot.digest(documents, "document_id", "content_sha256"), "model": embedder.spec(), "artifacts": embedder.artifacts(), "chunks": asdict(budget), "stemming": stemming}


def _previous(spark: SparkSession, root: str) -> snapshot.Snapshot | None:
    """The last snapshot if it can be read; a damaged one is not reused."""
    try:
        return snapshot.Snapshot.current(spark, root)
    except Exception:  # missing, damaged or of another version: nothing to take
        return None


def parse(documents: DataFrame, before: DataFrame | None) -> tuple[DataFrame, int]:
    """(parsed documents, how many were taken): a document that was parsed by this version with the same content keeps that form under its present archive."""
    if before is None:
        return written(manual.parsed(documents), "parsed"), 0
    same = before.where(F.col("ingest_version") == manual.INGEST_VERSION)
    keys = ["document_id", "content_sha256"]
    now = [c for c in manual.DOCUMENT if c not in keys]
    taken = same.drop(*now).join(documents, keys).select(*manual.PARSED.names)
    fresh = documents.join(same.select(*keys), keys, "left_anti")
    taken = written(taken, "parsed-before")
    return written(taken.unionByName(manual.parsed(fresh)), "parsed"), taken.count()


def indexed(spark: SparkSession, root: str, now: DataFrame, then: DataFrame | None, before: snapshot.Snapshot | None, stemming: bool) -> Index:
    """The index of the fields of all chunks: what the last snapshot has of it, without chunks that are gone or differ, with a segment of those that are new."""
    folder = f"{root.rstrip('/')}/{LEXICAL}"
    if before is None or before.manifest["inputs"]["versions"]["lexical"] != LEXICAL_VERSION or before.manifest["index"]["stemming"] != stemming:
        return Index.empty(now, folder, stemming).updated(now)
    last = Index(spark, folder, before.manifest["index"])
    marked = lambda fields: fields.withColumn("_mark", F.sha2(F.to_json(F.struct(*fields.columns)), 256))
    now, then = marked(now), marked(then)
    key = ["chunk_id", "_mark"]
    return last.updated(now.join(then.select(*key), key, "left_anti").drop("_mark"), then.join(now.select(*key), key, "left_anti").drop("_mark"))


def build(spark: SparkSession, root: str, documents: DataFrame, archives: list[dict], embedder: embed.Embedder, budget: chunker.Budget = chunker.Budget(), stemming: bool = True, force: bool = False) -> Report:
    """Build the snapshot of a corpus, unless it is the current one already, and make it current.

    ``documents`` has the columns of ``manual.DOCUMENT``. Intermediates lie in
    the shared folder; the candidate is opened and its parts are counted against
    one another before it is published.
    """
    inputs = inputs_of(documents, archives, embedder, budget, stemming)
    before = _previous(spark, root)
    if not force and snapshot.recommitted(spark, snapshot.Store(spark, root), snapshot.snapshot_id(inputs)):
        before = snapshot.Snapshot.current(spark, root)
        n = before.counts
        return Report(before.id, False, n["documents"], n["chunks"], n["documents"], n["chunks"], 0, n["warnings"])
    parsed, taken = parse(documents, before.table("parsed") if before else None)
    rows = tables.documents(parsed)
    # what is dealt by ranges is read twice, so chunks are made once
    made = written(chunker.chunks(parsed, budget, embedder.count_tokens), "chunks-made")
    chunks = written(tables.numbered(made, rows), "chunks")
    same_model = before is not None and before.manifest["inputs"]["model"] == embedder.spec()
    vectors = written(embed.vectors(chunks, embedder, before.table("vectors") if same_model else None), "vectors")
    declared = written(tables.declarations(parsed), "declarations")
    index = indexed(spark, root, lexical.chunk_fields(chunks), lexical.chunk_fields(before.table("chunks")) if before else None, before, stemming)
    parts = {
        "parsed": parsed,
        "documents": rows,
        "sections": tables.sections(parsed),
        "blocks": tables.blocks(parsed),
        "chunks": chunks,
        "tables": tables.tables(parsed),
        "table_rows": tables.table_rows(parsed),
        "diagrams": tables.diagrams(parsed),
        "declarations": declared,
        "refs": tables.references(parsed, declared),
        "warnings": tables.warnings(parsed),
        "vectors": vectors.drop("reused").sort("vector_row"),
    }
    name, built = snapshot.publish(spark, root, inputs, parts, force, lambda s: verify(s, embedder.spec()["dimension"]), shared=[f"{LEXICAL}/{f}" for f in index.folders()], more={"index": index.manifest}, ids=IDS)
    reused = {r["reused"]: r["count"] for r in vectors.groupBy("reused").count().collect()}
    opened = snapshot.Snapshot.current(spark, root)
    return Report(name, built, opened.counts["documents"], opened.counts["chunks"], taken, reused.get(True, 0), reused.get(False, 0), opened.counts["warnings"])


#: Columns by whose ranges tables are dealt to files, which reads by id then choose from.
IDS = {"documents": "document_id", "sections": "section_id", "blocks": "block_id", "chunks": "chunk_id", "tables": "table_id", "diagrams": "diagram_id"}

#: Foreign keys: (table, column, table that has it).
KEYS = (
    ("sections", "document_id", "documents"),
    ("sections", "parent_section_id", "sections"),
    ("blocks", "document_id", "documents"),
    ("blocks", "section_id", "sections"),
    ("chunks", "document_id", "documents"),
    ("chunks", "section_id", "sections"),
    ("tables", "block_id", "blocks"),
    ("table_rows", "table_id", "tables"),
    ("diagrams", "block_id", "blocks"),
    ("refs", "source_block_id", "blocks"),
    ("vectors", "chunk_id", "chunks"),
)
#: Column of a table that a foreign key of another name stands for.
NAMED = {"parent_section_id": "section_id", "source_block_id": "block_id"}


def integrity(opened: snapshot.Snapshot) -> list[str]:
    """What is wrong between the tables: keys that lead nowhere, rows that are not 0, 1, 2 and so on, and counts that differ."""
    wrong = []
    for child, column, parent in KEYS:
        lost = navigate.orphans(opened.table(child), column, opened.table(parent), NAMED.get(column, column))
        if lost.take(1):
            wrong.append(f"{child}.{column} has values that {parent} lacks")
    if not navigate.dense(opened.table("chunks"), "vector_row").first()["contiguous"]:
        wrong.append("chunks.vector_row has gaps or repeats")
    if opened.counts["chunks"] != opened.counts["vectors"]:
        wrong.append("chunks and vectors differ in number")
    if opened.manifest["index"]["n_docs"] != opened.counts["chunks"]:
        wrong.append("chunks and indexed texts differ in number")
    if opened.counts["documents"] != opened.manifest["inputs"]["entries"]["rows"]:
        wrong.append("documents and entries differ in number")
    return wrong


def verify(opened: snapshot.Snapshot, dimension: int) -> None:
    """ValueError unless the tables fit together and the vectors are sound."""
    if wrong := integrity(opened):
        raise ValueError("; ".join(wrong))
    embed.verified(opened.table("vectors"), dimension)
