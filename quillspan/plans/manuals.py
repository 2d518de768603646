"""A corpus of manuals made from the given tables, and the queries that take it through the whole engine.

Each manual has notices, a chapter with a page mark and references, a section
with a pipe table of suppliers and its caption, one with a diagram and its
caption, and one with a list of customers. What the parser must find in it is
known from the tables, so SQL over those gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import build
from quillspan.engine import Engine, Facets, Search
from quillspan.functions import text as tx
from quillspan.ingest import build as tables
from quillspan.ingest import chunker, manual
from quillspan.operators import embed, navigate
from quillspan.operators.catalogue import Catalogue
from quillspan.operators.index import Index
from quillspan.store import listed, shared_path, written

QUERIES: dict = {}
ORACLES: dict = {}
#: Rows of a source table in a manual of a nation: keys are dealt by so many.
SLICE = 5000
#: The manual that typed reads ask for, by its number.
ASKED = 4

_made: dict[tuple[str, str, str], object] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """What is built once a session and folder of tables, as an index is."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, vendor, archive_id, archive_sha256, entry_path, content_sha256, byte_len, source), a manual for each nation and slice of keys."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    part = lambda key: F.floor(F.col(key) / SLICE).cast("int").alias("j")
    suppliers = read("supplier").select(F.col("s_nationkey").alias("k"), part("s_suppkey"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("what"), F.floor("s_acctbal").cast("bigint").alias("balance"))
    customers = read("customer").select(F.col("c_nationkey").alias("k"), part("c_custkey"), F.col("c_custkey").alias("key"), F.format_string("- %s of %s\n", "c_name", "c_mktsegment").alias("line"))
    joined = lambda df, *lines: df.groupBy("k", "j").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", F.col(c).alias("x")))), lambda s: s["x"]), "").alias(c) for c in lines])
    rows = suppliers.withColumns({"row": F.format_string("| %d | %s | %d |\n", "key", "what", "balance"), "edge": F.format_string('  n%d -->|supplies| s%d["%s"]\n', "k", "key", "what")})
    held = joined(rows, "row", "edge").join(joined(customers, "line"), ["k", "j"], "full_outer").join(nation, "k")
    number = (F.col("j") * 25 + F.col("k") + 1).cast("string")
    following = (F.col("j") * 25 + (F.col("k") + 1) % 25 + 1).cast("string")
    text = F.concat(
        F.lit("Intel Logo\n\n# Notices\nAll rights reserved by "), "name", F.lit(".\n\n# CHAPTER "), number, F.lit(" "), "name", F.lit("\n<page_number>"), number, F.lit("-1</page_number>\nThe suppliers of "),
        "name", F.lit(" are in Table "), number, F.lit("-1, and Figure "), number, F.lit("-1 shows them; see Section "), number, F.lit(".1 and Chapter "), following, F.lit(".\n\n## "),
        number, F.lit(".1 Suppliers\n| key | name | balance |\n|---|---|---|\n"), F.coalesce("row", F.lit("")), F.lit("\nTable "), number, F.lit("-1. Suppliers of "), "name", F.lit("\n\n## "),
        number, F.lit(".2 Flow\n```mermaid\ngraph TD\n"), F.coalesce("edge", F.lit("")), F.lit("```\n\nFigure "), number, F.lit("-1. Flow of "), "name", F.lit("\n\n### "),
        number, F.lit(".2.1 Customers\n"), F.coalesce("line", F.lit("")),
    )
    out = held.select(F.when(F.col("k") % 2 == 0, "intel").otherwise("amd").alias("vendor"), F.concat(F.lit("archive-"), (F.col("k") % 2).cast("string")).alias("archive_id"), F.format_string("manual-%d.md", F.col("j") * 25 + F.col("k") + 1).alias("entry_path"), text.alias("source"))
    # parsing takes long for its bytes, by which alone what is grouped would come in few tasks
    out = out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "entry_path")
    return out.select(F.concat(F.lit("doc:"), F.sha2(F.concat("archive_id", F.lit("\0"), "entry_path"), 256)).alias("document_id"), "vendor", "archive_id", F.sha2("archive_id", 256).alias("archive_sha256"), "entry_path", F.sha2("source", 256).alias("content_sha256"), F.octet_length("source").cast("long").alias("byte_len"), "source")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "parsed", lambda: written(manual.parsed(sources(spark, sf_dir)), "manuals"))


def _archives() -> list[dict]:
    return [{"id": f"archive-{i}", "vendor": v, "path": f"archive-{i}.zip", "sha256": str(i) * 64} for i, v in enumerate(("intel", "amd"))]


def snapshot_root(spark: SparkSession, sf_dir: str) -> str:
    """A snapshot of the manuals, built once."""

    def make() -> str:
        root = shared_path(spark, "manual-index")
        build.build(spark, root, sources(spark, sf_dir), _archives(), embed.HashingEmbedder())
        return root

    return once(spark, sf_dir, "snapshot", make)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return once(spark, sf_dir, "engine", lambda: Engine.open(spark, snapshot_root(spark, sf_dir), embed.HashingEmbedder))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("document_id", "entry_path")


# manuals and their parts in SQL, from the tables
_DOCS = f"""s AS (SELECT s_nationkey AS k, CAST(s_suppkey // {SLICE} AS INT) AS j, s_suppkey AS key, s_name AS name, CAST(floor(s_acctbal) AS BIGINT) AS balance FROM supplier),
c AS (SELECT c_nationkey AS k, CAST(c_custkey // {SLICE} AS INT) AS j, c_custkey AS key FROM customer),
docs AS (SELECT k, j, j * 25 + k + 1 AS number, n_name AS nation, 'manual-' || (j * 25 + k + 1) || '.md' AS entry_path FROM (SELECT DISTINCT k, j FROM (SELECT k, j FROM s UNION ALL SELECT k, j FROM c)) JOIN nation ON n_nationkey = k)"""
_SECTIONS = """secs AS (SELECT entry_path, heading, level, parent, place FROM docs, LATERAL (VALUES ('Front matter', 0, NULL, 0), ('CHAPTER ' || number || ' ' || nation, 1, NULL, 1), (number || '.1 Suppliers', 2, 'CHAPTER ' || number || ' ' || nation, 2),
(number || '.2 Flow', 2, 'CHAPTER ' || number || ' ' || nation, 3), (number || '.2.1 Customers', 3, number || '.2 Flow', 4)) AS v(heading, level, parent, place))"""


@query(f"WITH {_DOCS}, {_SECTIONS} SELECT entry_path, heading, CAST(level AS INT) AS level, parent FROM secs")
def manual_sections(spark, sf_dir):
    rows = tables.sections(parsed(spark, sf_dir))
    parents = rows.select("document_id", F.col("section_id").alias("parent_section_id"), F.col("heading").alias("parent"))
    return rows.join(parents, ["document_id", "parent_section_id"], "left").join(_paths(spark, sf_dir), "document_id").select("entry_path", "heading", "level", "parent")


@query(f"""WITH {_DOCS}, n AS (SELECT count(*) AS d FROM docs)
SELECT kind, content_class, CAST(f * d AS BIGINT) AS n FROM n, (VALUES ('prose', 'page_furniture', 2), ('prose', 'legal', 2), ('prose', 'substantive', 5), ('table', 'substantive', 1), ('caption', 'substantive', 2), ('diagram', 'substantive', 1)) AS v(kind, content_class, f)
UNION ALL SELECT 'list', 'substantive', count(*) FROM c""")
def manual_blocks(spark, sf_dir):
    return tables.blocks(parsed(spark, sf_dir)).groupBy("kind", "content_class").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT entry_path, number || '-1' AS printed_page, count(*) AS n FROM docs, (VALUES (0), (1), (2), (3), (4)) GROUP BY ALL")
def manual_pages(spark, sf_dir):
    rows = tables.sections(parsed(spark, sf_dir)).join(_paths(spark, sf_dir), "document_id")
    return rows.groupBy("entry_path", "printed_page").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT entry_path, 'Table ' || number || '-1. Suppliers of ' || nation AS caption, 'key|name|balance' AS headers, CAST((SELECT count(*) FROM s WHERE s.k = docs.k AND s.j = docs.j) AS INT) AS row_count FROM docs")
def manual_tables(spark, sf_dir):
    return tables.tables(parsed(spark, sf_dir)).join(_paths(spark, sf_dir), "document_id").select("entry_path", "caption", F.array_join("headers", "|").alias("headers"), "row_count")


@query(f"WITH {_DOCS} SELECT entry_path, CAST(row_number() OVER (PARTITION BY k, j ORDER BY key) - 1 AS INT) AS row_index, key || '|' || name || '|' || balance AS cells FROM s JOIN docs USING (k, j)")
def manual_table_rows(spark, sf_dir):
    return tables.table_rows(parsed(spark, sf_dir)).join(_paths(spark, sf_dir), "document_id").select("entry_path", "row_index", F.array_join("cells", "|").alias("cells"))


@query(f"WITH {_DOCS} SELECT entry_path, 'n' || k AS source, 's' || key AS target, 'supplies' AS label, '-->' AS style, name AS target_label, 'TD' AS direction FROM s JOIN docs USING (k, j)")
def manual_diagram_edges(spark, sf_dir):
    rows = tables.diagrams(parsed(spark, sf_dir)).select("document_id", "direction", "nodes", F.explode("edges").alias("e"))
    label = F.filter("nodes", lambda n: n["id"] == F.col("e.to"))[0]["label"]
    return rows.join(_paths(spark, sf_dir), "document_id").select("entry_path", F.col("e.from").alias("source"), F.col("e.to").alias("target"), "e.label", "e.style", label.alias("target_label"), "direction")


_REFS = f"""{_DOCS}, refs AS (SELECT docs.*, v.* FROM docs, LATERAL (VALUES ('table', 'Table ' || number || '-1', 'table:' || number || '-1', number), ('figure', 'Figure ' || number || '-1', 'figure:' || number || '-1', number),
('section', 'Section ' || number || '.1', 'section:' || number || '.1', number), ('section', 'Chapter ' || (j * 25 + (k + 1) % 25 + 1), 'chapter:' || (j * 25 + (k + 1) % 25 + 1), j * 25 + (k + 1) % 25 + 1)) AS v(kind, label, normalized_key, target))"""


@query(f"WITH {_REFS} SELECT entry_path, kind, label, normalized_key FROM refs")
def manual_reference_extract(spark, sf_dir):
    rows = parsed(spark, sf_dir).select("entry_path", F.explode("refs").alias("r"))
    return rows.select("entry_path", "r.kind", "r.label", "r.normalized_key")


@query(f"""WITH {_REFS} SELECT refs.entry_path, refs.label, CAST(t.number IS NOT NULL AS BIGINT) AS n_candidates, t.number IS NOT NULL AS resolved, t.entry_path AS target_path FROM refs LEFT JOIN docs t ON t.number = refs.target""")
def manual_reference_resolve(spark, sf_dir):
    found = tables.references(parsed(spark, sf_dir), tables.declarations(parsed(spark, sf_dir)))
    paths = _paths(spark, sf_dir)
    targets = paths.select(F.col("document_id").alias("target_document_id"), F.col("entry_path").alias("target_path"))
    return found.join(paths, "document_id").join(targets, "target_document_id", "left").select("entry_path", "label", "n_candidates", "resolved", "target_path")


@query(f"WITH {_DOCS} SELECT entry_path, kind, CAST(CASE kind WHEN 'table' THEN greatest(1, ceil((SELECT count(*) FROM s WHERE s.k = docs.k AND s.j = docs.j) / 24)) ELSE 1 END AS BIGINT) AS n FROM docs, (VALUES ('table'), ('diagram')) AS v(kind)")
def manual_chunks(spark, sf_dir):
    """Chunks of tables and diagrams; those of prose and lists are tested against their budget."""
    rows = chunker.chunks(parsed(spark, sf_dir)).where(F.col("kind").isin("table", "diagram")).join(_paths(spark, sf_dir), "document_id")
    return rows.groupBy("entry_path", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT entry_path, CAST(0 AS BIGINT) AS n FROM docs")
def manual_warnings(spark, sf_dir):
    """Manuals are well formed: none has a warning."""
    return parsed(spark, sf_dir).select("entry_path", F.size("warnings").cast("long").alias("n"))


# the engine over a built snapshot


def _id(spark, sf_dir, table: str, key: str) -> str:
    """An id of the asked manual's only table, diagram or document."""
    path = F.col("entry_path") == f"manual-{ASKED}.md"
    docs = engine(spark, sf_dir).table("documents").where(path).select("document_id")
    rows = docs if table == "documents" else engine(spark, sf_dir).table(table).join(docs, "document_id", "left_semi")
    return rows.select(key).orderBy(key).first()[0]


@query(f"WITH {_DOCS} SELECT 'documents' AS name, count(*) AS n FROM docs UNION ALL SELECT 'sections', 5 * count(*) FROM docs UNION ALL SELECT 'tables', count(*) FROM docs UNION ALL SELECT 'diagrams', count(*) FROM docs UNION ALL SELECT 'refs', 4 * count(*) FROM docs UNION ALL SELECT 'table_rows', count(*) FROM s UNION ALL SELECT 'blocks', 13 * (SELECT count(*) FROM docs) + count(*) FROM c UNION ALL SELECT 'warnings', 0")
def engine_status(spark, sf_dir):
    counts = engine(spark, sf_dir).index_status()["counts"]
    return listed(spark, [(k, v) for k, v in counts.items() if k not in ("chunks", "vectors")], "name string, n bigint")


@query(f"WITH {_DOCS}, {_SECTIONS} SELECT heading, CAST(CASE level WHEN 0 THEN 0 ELSE level - 1 END AS INT) AS relative_depth, CAST(row_number() OVER (ORDER BY place) AS INT) AS position FROM secs WHERE entry_path = 'manual-{ASKED}.md'")
def engine_outline(spark, sf_dir):
    got = engine(spark, sf_dir).get_outline(_id(spark, sf_dir, "documents", "document_id"), depth=8)
    return listed(spark, [(s["heading"], s["relative_depth"], i) for i, s in enumerate(got["sections"], 1)], "heading string, relative_depth int, position int")


@query(f"""WITH {_DOCS}, r AS (SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS INT) AS row_index, key || '|' || name || '|' || balance AS cells FROM s JOIN docs USING (k, j) WHERE number = {ASKED})
SELECT row_index, cells, (SELECT count(*) FROM r WHERE contains(cells, '1')) AS total FROM r WHERE contains(cells, '1') ORDER BY row_index LIMIT 100""")
def engine_table(spark, sf_dir):
    got = engine(spark, sf_dir).get_table(_id(spark, sf_dir, "tables", "table_id"), row_filter="1", limit=100)
    return listed(spark, [(r["row_index"], "|".join(r["cells"]), got["total_rows"]) for r in got["rows"]], "row_index int, cells string, total bigint")


@query(f"WITH {_DOCS} SELECT 's' || key AS node, name AS label FROM s JOIN docs USING (k, j) WHERE number = {ASKED} UNION ALL SELECT 'n' || k, 'n' || k FROM docs WHERE number = {ASKED} AND EXISTS (SELECT 1 FROM s WHERE s.k = docs.k AND s.j = docs.j)")
def engine_diagram(spark, sf_dir):
    got = engine(spark, sf_dir).get_diagram(_id(spark, sf_dir, "diagrams", "diagram_id"), surrounding=True)
    return listed(spark, [(n["id"], n["label"]) for n in got["diagram"]["nodes"]], "node string, label string")


@query(f"WITH {_REFS} SELECT 'outgoing' AS direction, label FROM refs WHERE number = {ASKED} UNION ALL SELECT 'incoming', label FROM refs WHERE target = {ASKED}")
def engine_references(spark, sf_dir):
    name, e = _id(spark, sf_dir, "documents", "document_id"), engine(spark, sf_dir)
    return listed(spark, [(d, r["label"]) for d in ("outgoing", "incoming") for r in e.get_references(name, d)["references"]], "direction string, label string")


@query(f"WITH {_DOCS} SELECT CAST(1 AS INT) AS position, 'table' AS kind, number || '.1 Suppliers' AS heading FROM docs WHERE number = {ASKED} UNION ALL SELECT 2, 'caption', number || '.1 Suppliers' FROM docs WHERE number = {ASKED}")
def engine_section(spark, sf_dir):
    """The blocks after the heading of the suppliers' section, by the block's section."""
    e = engine(spark, sf_dir)
    block = e.table("blocks").where(F.col("block_id") == _id(spark, sf_dir, "tables", "block_id")).first()
    got = e.get_section(block["section_id"], neighbours=True)
    return listed(spark, [(i, b["kind"], got["section"]["heading"]) for i, b in enumerate(got["blocks"][1:], 1)], "position int, kind string, heading string")


@query(f"WITH {_DOCS} SELECT DISTINCT entry_path, CASE k % 2 WHEN 0 THEN 'intel' ELSE 'amd' END AS vendor FROM docs WHERE nation = (SELECT nation FROM docs WHERE number = {ASKED}) AND j = 0")
def engine_search(spark, sf_dir):
    """A nation's name is in the headings of its own manuals only; of the first slice's manuals, which are asked for by their documents, that is one."""
    e = engine(spark, sf_dir)
    name = spark.read.parquet(f"{sf_dir}/nation.parquet").where(F.col("n_nationkey") == ASKED - 1).first()["n_name"]
    # a nation has a manual a slice, so without the filter its first page need not have this one
    slice_paths = [f"manual-{i}.md" for i in range(1, 26)]
    ids = sorted(r[0] for r in e.table("documents").where(F.col("entry_path").isin(slice_paths)).select("document_id").collect())
    asked = [Facets(document_ids=tuple(ids[at : at + 16])) for at in range(0, len(ids), 16)]
    cited = {(h["citation"]["entry_path"], h["citation"]["vendor"]) for f in asked for h in e.search(Search(name, "lexical", f, limit=50))["hits"]}
    return listed(spark, sorted(cited), "entry_path string, vendor string")


@query("SELECT 'amd' AS vendor, 'amd' AS found UNION ALL SELECT 'intel', 'intel'")
def engine_compare(spark, sf_dir):
    """Each side has hits of its own vendor only."""
    sides = engine(spark, sf_dir).compare("suppliers table", mode="hybrid", limit=5)["sides"]
    return listed(spark, sorted({(v, h["citation"]["vendor"]) for v, s in sides.items() for h in s["hits"]}), "vendor string, found string")


@query(f"SELECT 'found' AS entity_state, 'manual-{ASKED}.md' AS entry_path")
def engine_lookup(spark, sf_dir):
    """A symbol that one manual's heading has: CHAPTER and its number are in all chunks of that chapter; of the first hit the manual."""
    number = spark.read.parquet(f"{sf_dir}/nation.parquet").where(F.col("n_nationkey") == ASKED - 1).first()["n_name"]
    got = engine(spark, sf_dir).lookup(f"CHAPTER_{ASKED} {number}", kind="register")
    first = (got["exact"] or got["related"])[0]
    return listed(spark, [(got["entity_state"], first["citation"]["entry_path"])], "entity_state string, entry_path string")


@query("SELECT true AS within_budget, true AS each_once, true AS has_groups")
def engine_context(spark, sf_dir):
    got = engine(spark, sf_dir).build_context("suppliers balance", budget=1024)
    ids = [i for g in got["groups"] for i in g["chunk_ids"]]
    return listed(spark, [(got["tokens"] <= 1024, len(ids) == len(set(ids)), bool(got["groups"]))], "within_budget boolean, each_once boolean, has_groups boolean")


@query(f"WITH {_DOCS} SELECT CASE k % 2 WHEN 0 THEN 'intel' ELSE 'amd' END AS vendor, entry_path, 'CHAPTER ' || number || ' ' || nation AS title, CAST(row_number() OVER (ORDER BY k % 2, entry_path) AS INT) AS position FROM docs")
def catalogue_documents(spark, sf_dir):
    """Documents by the order of their vectors' rows: vendor, archive, path."""
    read = Catalogue(engine(spark, sf_dir).opened)
    return read.documents().join(read.first_rows(), "document_id").select("vendor", "entry_path", "title", "position")


@query(f"WITH {_DOCS} SELECT 'blocks' AS part, 13 + (SELECT count(*) FROM c WHERE c.k = docs.k AND c.j = docs.j) AS n FROM docs WHERE number = {ASKED} UNION ALL SELECT 'sections', 4 UNION ALL SELECT 'tables', 1 UNION ALL SELECT 'diagrams', 1 UNION ALL SELECT 'refs', 4 UNION ALL SELECT 'warnings', 0")
def catalogue_parsed_document(spark, sf_dir):
    found = Catalogue(engine(spark, sf_dir).opened).parsed_document(_id(spark, sf_dir, "documents", "document_id"))
    return listed(spark, [(k, len(found[k])) for k in ("blocks", "sections", "tables", "diagrams", "refs", "warnings")], "part string, n bigint")


@query("SELECT 0 AS n_wrong, true AS contiguous, true AS in_order, true AS same_row")
def catalogue_integrity(spark, sf_dir):
    """Foreign keys, vocabularies and rows, and chunks read by their ids in the order asked for."""
    e = engine(spark, sf_dir)
    read = Catalogue(e.opened)
    wrong = build.integrity(e.opened) + read.invalid_values()
    last = [r["chunk_id"] for r in read.vector_metadata().orderBy(F.desc("vector_row")).limit(5).collect()]
    got = read.chunks_by_ids([*last, "chk:none"])
    contiguous = bool(navigate.dense(e.table("vectors"), "vector_row").first()["contiguous"])
    return listed(spark, [(len(wrong), contiguous, [c["chunk_id"] for c in got] == last, read.vector_row(last[0]) == got[0]["vector_row"])], "n_wrong int, contiguous boolean, in_order boolean, same_row boolean")


# the stored index of the documents


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    """Postings of ``documents``, without stems, written once: the source is the heading, the text the body, with its symbols."""

    def make() -> Index:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        fields = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("heading"), F.col("text").alias("body"), tx.symbols(F.col("text")).alias("symbols"))
        return Index.write(fields, shared_path(spark, "document-index"), stemming=False)

    return once(spark, sf_dir, "documents", make)

