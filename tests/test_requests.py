"""Requests over a built snapshot, builds that reuse, and the command line."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan import build, cli, engine
from quillspan.engine import Engine, Facets, InvalidInput, Search, call
from quillspan.ingest import manual
from quillspan.operators import embed, snapshot
from quillspan.operators.catalogue import Catalogue
from quillspan.sources import corpus

FIRST = """# First Manual
## 1.1 Registers
The register IA32_EFER enables virtualization; see Table 1-1 and Figure 1-1.
## 1.2 Operation
Virtual machine entries use the register.

| bit | meaning |
|---|---|
| 13 | enable |
| 0 | lock |

Table 1-1. Bits

```mermaid
graph TD
A[Off] --> B[On]
B --> C[Entered]
```

Figure 1-1. States
"""
SECOND = "# Second Manual\n## 2.1 Nested paging\nNested paging maps guest memory.\n## 2.2 Faults\nThe fault #PF is raised by paging.\n"


def rows(*texts):
    out = []
    for vendor, path, text in texts:
        raw = text.encode()
        out.append((f"doc:{path}", vendor, f"archive-{vendor}", vendor, path, hashlib.sha256(raw).hexdigest(), len(raw), text))
    return out


DDL = "document_id string, vendor string, archive_id string, archive_sha256 string, entry_path string, content_sha256 string, byte_len bigint, source string"
ARCHIVES = [{"id": f"archive-{v}", "vendor": v, "path": f"{v}.zip", "sha256": v} for v in ("amd", "intel")]
MADE = []


def model():
    MADE.append(1)
    return embed.HashingEmbedder()


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    documents = spark.createDataFrame(rows(("intel", "first.md", FIRST), ("amd", "second.md", SECOND)), DDL)
    report = build.build(spark, root, documents, ARCHIVES, embed.HashingEmbedder())
    assert (report.built, report.documents, report.parsed_reused, report.vectors_reused, report.vectors_embedded) == (True, 2, 0, 0, report.chunks)
    return Engine.open(spark, root, model)


def test_search_cites_its_hits(opened):
    got = opened.search(Search("IA32_EFER"))
    first = got["hits"][0]
    assert "IA32_EFER" in first["snippet"] and first["citation"]["entry_path"] == "first.md" and first["scores"]["exact_rank"] == 1
    assert first["citation"]["heading_path"] == ["First Manual", "1.1 Registers"] and first["citation"]["line_start"] == 2
    assert FIRST.encode()[first["citation"]["byte_start"] : first["citation"]["byte_end"]].decode().startswith("## 1.1")
    assert got["state"]["semantic_degraded_reason"] is None and not got["candidate_window_truncated"]
    amd = opened.search(Search("paging", facets=Facets(vendors=("amd",))))["hits"]
    assert amd and {h["citation"]["vendor"] for h in amd} == {"amd"}
    assert opened.search(Search("enable", "lexical", Facets(kinds=("table",))))["hits"][0]["citation"]["heading_path"][-1] == "1.2 Operation"


def test_pages_cover_each_hit_once(opened):
    whole = [h["chunk_id"] for h in opened.search(Search("the register paging", limit=50))["hits"]]
    seen, cursor = [], None
    for _ in range(20):
        got = opened.search(Search("the register paging", limit=1, cursor=cursor))
        seen += [h["chunk_id"] for h in got["hits"]]
        cursor = got["next_cursor"]
        if cursor is None:
            break
    assert seen == whole and len(set(seen)) == len(seen) >= 2


def test_cursors_are_bound(opened):
    cursor = opened.search(Search("register paging", limit=1))["next_cursor"]
    for wrong in (Search("register paging", limit=2, cursor=cursor), Search("register", limit=1, cursor=cursor), Search("register paging", limit=1, cursor="%%")):
        with pytest.raises(InvalidInput):
            opened.search(wrong)


def test_sections_give_two_hits_at_most(opened):
    hits = opened.search(Search("register paging virtual fault bit", limit=50))["hits"]
    sections = [h["citation"]["section_id"] for h in hits]
    assert max(map(sections.count, sections)) <= 2


@pytest.mark.parametrize("bad", [Search(" "), Search("x", limit=0), Search("x", limit=51), Search("x", mode="fuzzy"), Search("x", facets=Facets(vendors=("a", "b", "c"))), Search("x", facets=Facets(kinds=("code", "code"))), Search("x", facets=Facets(document_ids=(" ",))), Search("...")])
def test_bad_searches(opened, bad):
    with pytest.raises(InvalidInput):
        opened.search(bad)


def test_the_model_is_made_when_needed_and_may_fail(opened, spark):
    MADE.clear()
    fresh = Engine(opened.opened, model)
    fresh.search(Search("register", "lexical"))
    assert not MADE
    fresh.search(Search("register"))
    fresh.search(Search("paging", "semantic"))
    assert len(MADE) == 1
    without = Engine(opened.opened).search(Search("register"))
    assert without["hits"] and "model" in without["state"]["semantic_degraded_reason"]
    other = Engine(opened.opened, lambda: embed.HashingEmbedder(8)).search(Search("register"))
    assert other["hits"] and other["state"]["semantic_degraded_reason"]


def test_lookup_and_comparison(opened):
    found = opened.lookup("ia32_efer", kind="msr")
    assert found["entity_state"] == "found" and found["exact"] and not {h["chunk_id"] for h in found["exact"]} & {h["chunk_id"] for h in found["related"]}
    assert opened.lookup("paging")["exact"] == [] and opened.lookup("paging")["related"]
    assert opened.lookup("zzzz", kind="msr")["entity_state"] == "not_found"
    sides = opened.compare("register paging manual", limit=5)["sides"]
    assert all({h["citation"]["vendor"] for h in s["hits"]} == {v} for v, s in sides.items())


def test_typed_reads(opened):
    docs = opened.get_outline()["documents"]
    assert [d["vendor"] for d in docs] == ["amd", "intel"] and docs[1]["title"] == "First Manual"
    outline = opened.get_outline(docs[1]["document_id"])["sections"]
    assert [(s["heading"], s["relative_depth"]) for s in outline] == [("First Manual", 0), ("1.1 Registers", 1), ("1.2 Operation", 1)]
    below = opened.get_outline(docs[1]["document_id"], outline[0]["section_id"], depth=1)["sections"]
    assert [s["relative_depth"] for s in below] == [0, 1, 1]
    page = opened.get_outline(docs[1]["document_id"], limit=2)
    assert [s["heading"] for s in opened.get_outline(docs[1]["document_id"], limit=2, cursor=page["next_cursor"])["sections"]] == ["1.2 Operation"]
    section = opened.get_section(outline[2]["section_id"], block_limit=3, neighbours=True)
    assert section["previous"]["section_id"] == outline[1]["section_id"] and section["next"] is None and len(section["blocks"]) == 3
    rest = opened.get_section(outline[2]["section_id"], block_limit=3, cursor=section["next_cursor"])
    assert [b["ordinal"] for b in section["blocks"] + rest["blocks"]] == [3, 4, 5, 6, 7, 8]
    assert len(opened.get_section(outline[0]["section_id"])["children"]) == 2
    block = section["blocks"][0]
    assert opened.get_section(block["block_id"])["blocks"][0]["block_id"] == block["block_id"]
    table = opened.get_table(section["blocks"][2]["block_id"], row_filter="ENABLE")
    assert [r["cells"] for r in table["rows"]] == [["13", "enable"]] and table["total_rows"] == 1 and table["table"]["caption"] == "Table 1-1. Bits" and table["raw_source"] is None
    diagram = opened.get_diagram(rest["blocks"][1]["block_id"], surrounding=True)
    assert [(e["from"], e["to"]) for e in diagram["diagram"]["edges"]] == [("A", "B"), ("B", "C")] and [b["ordinal"] for b in diagram["surrounding"]] == [6, 8]
    out = opened.get_references(docs[1]["document_id"])
    assert sorted((r["label"], r["resolved"]) for r in out["references"]) == [("Figure 1-1", True), ("Table 1-1", True)]
    into = opened.get_references(table["table"]["table_id"], "incoming")["references"]
    assert [r["label"] for r in into] == ["Table 1-1"]
    assert opened.get_references(outline[0]["section_id"], "incoming")["references"] == []
    for missing in (opened.get_table("tbl:x"), opened.get_diagram("fig:x"), opened.get_section("sec:x"), opened.get_references("blk:x"), opened.get_outline("doc:x")):
        assert missing["entity_state"] == "not_found" and missing["state"]["snapshot_id"] == opened.opened.id


def test_context(opened):
    ids = [h["chunk_id"] for h in opened.search(Search("register"))["hits"]]
    got = opened.build_context("register", (ids[0], "chk:none"), budget=256)
    listed = [i for g in got["groups"] for i in g["chunk_ids"]]
    assert len(listed) == len(set(listed)) and got["tokens"] <= 256 and all(g["citations"] for g in got["groups"])
    assert {"chunk_ids": ["chk:none"], "reason": "chunk is not in the snapshot"} in got["omitted"]
    for bad in (dict(query=None), dict(query="x", budget=255), dict(chunk_ids=tuple(map(str, range(257))))):
        with pytest.raises(InvalidInput):
            opened.build_context(**bad)


def test_tools_answer_with_errors(opened):
    assert len(engine.TOOLS) == 10
    assert call(opened, "search", {"query": "register", "vendors": ["intel"], "limit": 3})["result"]["hits"]
    for tool, arguments in (("search", {"query": "x", "limit": 0}), ("none", {}), ("get_table", {"id": 3})):
        assert call(opened, tool, arguments)["error"]["code"] == "invalid_params"
    counts = call(opened, "index_status", {})["result"]["counts"]
    assert (counts["documents"], counts["tables"], counts["diagrams"], counts["refs"]) == (2, 1, 1, 2)


def test_catalogue_reads(opened):
    read = Catalogue(opened.opened)
    docs = read.documents().collect()
    assert [d.vendor for d in docs] == ["amd", "intel"] and read.document(docs[0].document_id)["title"] == "Second Manual" and read.document("x") is None
    whole = read.parsed_document(docs[1].document_id)
    assert [s["heading"] for s in whole["sections"]] == ["First Manual", "1.1 Registers", "1.2 Operation"] and whole["source"] == FIRST
    section, blocks = read.section(whole["sections"][2]["section_id"])
    assert [b["kind"] for b in blocks] == ["prose", "prose", "table", "caption", "diagram", "caption"] and read.section("x") is None
    assert read.document_id_for_section(section["section_id"]) == docs[1].document_id
    assert read.block(blocks[2]["block_id"])["kind"] == "table"
    rows = read.chunks_with_vector_rows().collect()
    assert [r.vector_row for r in rows] == list(range(len(rows))) and rows[0].vendor == "intel"
    ids = [rows[2].chunk_id, "none", rows[0].chunk_id]
    assert [c["chunk_id"] for c in read.chunks_by_ids(ids)] == [ids[0], ids[2]] and read.chunk(ids[0])["vector_row"] == read.vector_row(ids[0]) == 2
    with pytest.raises(ValueError):
        read.chunks_by_ids(["x"] * 257)
    assert read.vector_reuse_records().count() <= len(rows) and read.counts()["archives"] == 2
    assert read.invalid_values() == [] and opened.opened.damaged().count() == 0


def test_builds_reuse_what_is_unchanged(spark, tmp_path):
    root, model_ = str(tmp_path), embed.HashingEmbedder()
    documents = lambda *texts: spark.createDataFrame(rows(*texts), DDL)
    a = build.build(spark, root, documents(("intel", "first.md", FIRST), ("amd", "second.md", SECOND)), ARCHIVES, model_)
    again = build.build(spark, root, documents(("intel", "first.md", FIRST), ("amd", "second.md", SECOND)), ARCHIVES, model_)
    assert a.built and not again.built and (again.vectors_embedded, again.parsed_reused) == (0, 2)
    old = Engine.open(spark, root)
    changed = documents(("intel", "first.md", FIRST), ("amd", "second.md", SECOND + "One more sentence.\n"))
    b = build.build(spark, root, changed, ARCHIVES, model_)
    assert len(old.index.manifest["segments"]) == 1 and len(Engine.open(spark, root).index.manifest["segments"]) == 2
    assert b.built and b.snapshot_id != a.snapshot_id and b.parsed_reused == 1 and b.vectors_reused > 0 and b.vectors_embedded > 0
    assert old.get_outline()["documents"], "who reads the old snapshot still can"
    inputs = build.inputs_of(changed, [ARCHIVES[0], ARCHIVES[1] | {"sha256": "other"}], model_, build.chunker.Budget(), True)
    found = snapshot.status(spark, root, inputs)
    assert found.state == "stale" and [(x["id"], x["fresh"]) for x in found.archives] == [("archive-amd", True), ("archive-intel", False)]


def test_answers_say_whether_the_index_is_stale(spark, opened):
    state = lambda kind: snapshot.Status(kind, ("why",), opened.opened.id)
    assert opened.search(Search("paging", "lexical"))["state"]["stale"] is False
    stale = Engine(opened.opened, model, lambda: state(snapshot.STALE))
    assert stale.search(Search("paging", "lexical"))["state"]["stale"] and stale.get_outline()["state"]["stale"] and stale.index_status()["state"] == "stale"
    with pytest.raises(InvalidInput):
        Engine.open(spark, opened.opened.store.root, model, lambda: snapshot.Status(snapshot.READY, (), "0" * 64))


def test_a_semantic_leg_that_fails_leaves_the_others(spark, opened, monkeypatch):
    hits = [h["chunk_id"] for h in opened.search(Search("paging", "lexical"))["hits"]]
    degraded = Engine(opened.opened, model, lambda: snapshot.Status(snapshot.DEGRADED, ("artifacts of the model differ",), opened.opened.id))
    got = degraded.search(Search("paging"))
    assert [h["chunk_id"] for h in got["hits"]] == hits and "artifacts" in got["state"]["semantic_degraded_reason"]
    made = []

    def fails():
        made.append(1)
        raise RuntimeError("no weights")

    broken = Engine(opened.opened, fails)
    for _ in range(2):
        assert "no weights" in broken.search(Search("paging"))["state"]["semantic_degraded_reason"]
    assert made == [1], "a model that failed is not loaded again"
    # found out only when the rows are read
    lost = spark.range(1).select(F.raise_error(F.lit("a file is lost")).cast("string").alias("chunk_id"), F.lit(1.0).alias("score"))
    monkeypatch.setattr(Engine, "_semantic_leg", lambda *_: lost)
    got = Engine(opened.opened, model).search(Search("paging"))
    assert [h["chunk_id"] for h in got["hits"]] == hits and got["state"]["semantic_degraded_reason"]


def test_contexts_of_a_mode_and_a_vendor(opened):
    both = opened.build_context("register paging", budget=4096, mode="lexical")
    one = opened.build_context("register paging", budget=4096, mode="lexical", vendors=("amd",))
    of = lambda got: {c["vendor"] for g in got["groups"] for c in g["citations"]}
    assert of(both) == {"amd", "intel"} and of(one) == {"amd"}
    assert call(opened, "build_context", {"query": "paging", "mode": "lexical", "vendors": ["amd"]})["result"]["groups"]
    assert call(opened, "build_context", {"query": "paging", "mode": "none"})["error"]["code"] == "invalid_params"


def test_a_blank_row_filter_leaves_all_rows(opened):
    table = opened.table("tables").first()["table_id"]
    assert opened.get_table(table, row_filter="  ")["total_rows"] == opened.get_table(table)["total_rows"] == 2


def test_another_parser_version_is_not_reused(spark, tmp_path, monkeypatch):
    root, model_ = str(tmp_path), embed.HashingEmbedder()
    documents = spark.createDataFrame(rows(("intel", "first.md", FIRST)), DDL)
    build.build(spark, root, documents, ARCHIVES, model_)
    monkeypatch.setattr(manual, "INGEST_VERSION", 99)
    got = build.build(spark, root, documents, ARCHIVES, model_)
    assert got.built and got.parsed_reused == 0 and got.vectors_reused == got.chunks


def test_a_damaged_snapshot_is_invalid_and_not_published(spark, tmp_path, opened):
    parts = {k: opened.table(k) for k in opened.opened.counts}
    broken = parts | {"blocks": parts["blocks"].limit(1)}
    with pytest.raises(ValueError, match="chunks|tables|diagrams|refs|blocks"):
        snapshot.publish(spark, str(tmp_path), opened.opened.manifest["inputs"], broken, check=lambda s: build.verify(s, 64), more={"index": opened.opened.manifest["index"]})
    assert snapshot.status(spark, str(tmp_path), {}).state == "missing"


def test_empty_corpus(spark, tmp_path):
    report = build.build(spark, str(tmp_path), spark.createDataFrame([], DDL), [], embed.HashingEmbedder())
    assert (report.documents, report.chunks) == (0, 0)


def test_reference_candidates(spark):
    from quillspan.ingest import build as tables

    source = lambda n: f"# {n} A\nSee Section 1 and Section 9.\n"
    parsed = manual.parsed(spark.createDataFrame(rows(*[("v", f"{i}.md", source(1 if i < 80 else 2)) for i in range(81)]), DDL))
    found = tables.references(parsed, tables.declarations(parsed))
    last = found.where(F.col("document_id") == "doc:80.md").orderBy("label").collect()
    assert [(r.label, r.n_candidates, len(r.candidates), r.resolved) for r in last] == [("Section 1", 80, tables.LISTED, False), ("Section 9", 0, 0, False)]
    local = found.where((F.col("document_id") == "doc:3.md") & (F.col("label") == "Section 1")).first()
    assert local.resolved and local.target_document_id == "doc:3.md" and local.n_candidates == 1


def test_command_line(spark, tmp_path, capsys):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as zipped:
        zipped.writestr("first.md", FIRST)
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.zip").write_bytes(held.getvalue())
    digest = hashlib.sha256(held.getvalue()).hexdigest()
    (tmp_path / "corpus" / "manifest.toml").write_text(f'schema_version = 1\n[[archives]]\nid = "a"\nvendor = "intel"\npath = "a.zip"\nsha256 = "{digest}"\nentry_count = 1\nuncompressed_bytes = {len(FIRST)}\n')
    config, model_ = cli.Config(str(tmp_path)), embed.HashingEmbedder()
    assert cli.status(spark, config, model_).exit_code == 2
    assert cli.index(spark, config, model_).built
    assert cli.status(spark, config, model_).state == "ready"
    out = io.StringIO()
    cli.serve(spark, config, embed.HashingEmbedder, ['{"id": 1, "tool": "list"}', "", '{"id": 2, "tool": "search", "arguments": {"query": "IA32_EFER"}}', "nonsense"], out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(answers[0]["tools"]) == 10 and answers[1]["result"]["hits"] and answers[2]["error"]["code"] == "invalid_request"
    (tmp_path / "corpus" / "a.zip").write_bytes(held.getvalue() + b"x")
    stale = cli.status(spark, config, model_)
    assert stale.state == "stale" and stale.archives[0]["actual_sha256"] != digest
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
    assert corpus.load_manifest(config.manifest)
