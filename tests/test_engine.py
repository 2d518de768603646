"""The engine's queries against SQL, and its plain parts against small cases."""

import hashlib
import io
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspan.functions.stemmer import stem
from quillspan.operators import context, lexical, rank, snapshot, structure, vector
from quillspan.operators.index import Index
from quillspan.plans import catalog
from quillspan.sources import corpus

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("~" if not isinstance(x, str) and pd.isna(x) else f"{x:.5f}" if isinstance(x, float) and x % 1 else str(int(x)) if isinstance(x, (int, float)) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query_equals_its_sql(spark, sf, duck, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).fetch_df())


@pytest.mark.parametrize("name", ["bm25_topk", "cosine_topk"])
def test_first_rows_are_cut_before_the_shuffle(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan


def test_stems():
    assert {w: stem(w) for w in ("caresses", "ponies", "running", "relational", "generously", "hopefully", "skies", "dying", "sky", "by", "exceed", "controlling")} == {"caresses": "caress", "ponies": "poni", "running": "run", "relational": "relat", "generously": "generous", "hopefully": "hope", "skies": "sky", "dying": "die", "sky": "sky", "by": "by", "exceed": "exceed", "controlling": "control"}


def test_cursors_belong_to_their_request():
    request = {"query": "x", "limit": 5}
    cursor = rank.encode_cursor("s", request, 10, "k")
    assert rank.decode_cursor(cursor, "s", request | {"cursor": cursor}) == (10, "k")
    for snap, other in (("t", request), ("s", request | {"limit": 6})):
        with pytest.raises(ValueError):
            rank.decode_cursor(cursor, snap, other)
    with pytest.raises(ValueError):
        rank.decode_cursor("%%%", "s", request)


def test_limits_are_checked(spark, sf):
    df = catalog.table(spark, sf, "embeddings")
    for bad in ([], [0.0] * 64, [float("nan")] * 64):
        with pytest.raises(ValueError):
            vector.top_k(df, "vec_id", "embedding", bad, 3)
    for call in (lambda: vector.top_k(df, "vec_id", "embedding", [1.0] * 64, 0), lambda: rank.page(df, "label", "vec_id", 300, 5), lambda: rank.page(df, "label", "vec_id", 0, 51), lambda: context.packed(df, "label", "vec_id", "label", 255)):
        with pytest.raises(ValueError):
            call()


def test_context_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, "x" * 700), (1, 2, "y" * 400), (1, 3, "z" * 140), (1, 4, None)], "q int, pos int, text string")
    got = [(r.pos, r.tokens, r.included, r.used) for r in context.packed(df, "q", "pos", "text", 256).orderBy("pos").collect()]
    assert got == [(1, 200, True, 200), (2, 115, False, 200), (3, 40, True, 240), (4, 0, True, 240)]
    assert context.joined_texts(["a\nb", "b\nc", "d"]) == "a\nb\nc\n\nd"


def test_sections(spark):
    df = spark.createDataFrame([("d", 0, 1, "a"), ("d", 5, 2, "b"), ("d", 9, 3, "c"), ("d", 12, 2, "e")], "doc string, start int, level int, id string")
    ends = {r.id: (r.section_end, r.parent_id) for r in structure.section_parents(structure.section_ends(df, "doc", "start", "level"), "doc", "start", "level", "id").collect()}
    assert ends == {"a": (None, None), "b": (12, "a"), "c": (12, "b"), "e": (None, "a")}


def archive(tmp_path, entries, name="a.zip"):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as zipped:
        for path, text in entries:
            zipped.writestr(path, text)
    (tmp_path / name).write_bytes(held.getvalue())
    return {"id": name[0], "vendor": "v", "path": name, "sha256": hashlib.sha256(held.getvalue()).hexdigest(), "entry_count": len(entries), "uncompressed_bytes": sum(len(t.encode()) for _, t in entries)}


def test_corpus_is_checked_and_read(spark, tmp_path):
    good = archive(tmp_path, [("./m.md", "# É\n"), ("d/n.MD", "x")])
    read = corpus.read_corpus(spark, str(tmp_path), [good]).collect()
    assert {(r.entry_path, r.source) for r in read} == {("m.md", "# É\n"), ("d/n.MD", "x")}
    for wrong in ({"sha256": "0" * 64}, {"entry_count": 3}, {"uncompressed_bytes": 2}, {"uncompressed_bytes": 999}):
        with pytest.raises(ValueError):
            corpus.read_corpus(spark, str(tmp_path), [good | wrong])
    for bad in ("../m.md", "/m.md", "c:/m.md", "m.txt", "", "a//m.md"):
        with pytest.raises(ValueError):
            corpus.entry_path(bad)
    manifest = tmp_path / "m.toml"
    manifest.write_text('schema_version = 1\n[[archives]]\nid = "a"\nvendor = "v"\npath = "a.zip"\nsha256 = "%s"\nentry_count = 2\nuncompressed_bytes = 6\n' % good["sha256"])
    assert corpus.load_manifest(str(manifest))[0]["id"] == "a"
    manifest.write_text("schema_version = 2")
    with pytest.raises(ValueError):
        corpus.load_manifest(str(manifest))


def test_archives_are_told_apart_by_their_paths(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
    one = archive(tmp_path / "a", [("m.md", "# One\n")], "x.zip") | {"id": "one", "path": "a/x.zip"}
    two = archive(tmp_path / "b", [("m.md", "# Two\n")], "x.zip") | {"id": "two", "path": "b/x.zip"}
    read = corpus.in_order(corpus.read_corpus(spark, str(tmp_path), [two, one])).collect()
    assert [(r.archive_id, r.source, r.archive_sha256) for r in read] == [("one", "# One\n", one["sha256"]), ("two", "# Two\n", two["sha256"])]
    assert corpus.checksums(spark, str(tmp_path), [one, two, one | {"id": "gone", "path": "c.zip"}]) == {"one": one["sha256"], "two": two["sha256"]}
    for bad in ("", "/a.zip", "c:/a.zip", "a/../b.zip", "a//b.zip", "./a.zip", "a\0.zip"):
        with pytest.raises(ValueError):
            corpus.relative_path(bad)


def test_snapshots_are_published_whole(spark, tmp_path):
    root, a, b = str(tmp_path), {"v": "a"}, {"v": "b"}
    assert snapshot.status(spark, root, a).state == "missing"
    first, built = snapshot.publish(spark, root, a, {"chunks": spark.range(3).toDF("id")})
    assert built and snapshot.publish(spark, root, a, {"chunks": spark.range(3).toDF("id")}) == (first, False)
    opened = snapshot.Snapshot.current(spark, root)
    second, _ = snapshot.publish(spark, root, b, {"chunks": spark.range(5).toDF("id")})
    assert opened.table("chunks").count() == 3 and snapshot.Snapshot.current(spark, root).counts == {"chunks": 5}
    stale = snapshot.status(spark, root, a)
    assert first != second and stale.state == "stale" and stale.reasons == ("v differs",) and stale.usable and stale.exit_code == 1
    assert snapshot.status(spark, root, b).exit_code == 0 and snapshot.status(spark, root, b, "no weights").state == "degraded_model"

    def refuse(_):
        raise ValueError("not sound")

    with pytest.raises(ValueError):
        snapshot.publish(spark, root, {"v": "c"}, {"chunks": spark.range(1).toDF("id")}, check=refuse)
    assert snapshot.Snapshot.current(spark, root).id == second and len(list((tmp_path / "generations").iterdir())) == 2
    for v in "de":
        snapshot.publish(spark, root, {"v": v}, {"chunks": spark.range(1).toDF("id")})
    assert len(list((tmp_path / "generations").iterdir())) == 2, "the current one and the one before"
    (tmp_path / "log" / f"{99:020d}.json").write_text('{"generation": "cut sho')
    assert snapshot.Snapshot.current(spark, root).id == snapshot.snapshot_id({"v": "e"})


def test_symbols_and_references_by_worked_values(spark):
    """Values worked out by hand, not from the patterns."""
    from quillspan.functions import text as tx
    from quillspan.ingest.chunker import symbols_of

    cases = {
        "CR10 and CR4.VMXE": ["CR1", "CR4.VMXE"],
        "CPUIDX CPUID.07H_EBX,ECX:1": ["CPUID", "CPUID.07H_EBX,ECX:1"],
        "#UD #PFX IA32_EFER.LME": ["#UD", "#PF", "IA32_EFER", "LME"],
        "RFLAGS.AC rax AB": ["RFLAGS.AC"],
    }
    got = {r.t: list(r.s) for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.symbols(F.col("t")).alias("s")).collect()}
    assert got == cases and {t: symbols_of(t) for t in cases} == cases
    texts = {"see Section 4.2-1 and Table 2-1a": [("section", "4.2-1"), ("table", "2-1")], "Section 3-B, section that": [("section", "3"), ("section", "t")], "APPENDIX B; Figure x": [("section", "B"), ("figure", "x")]}
    rows = structure.references(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "t").orderBy("ordinal").collect()
    assert {t: [(r.kind, r.label) for r in rows if r.t == t] for t in texts} == texts


def test_body_classes_by_worked_values(spark):
    from quillspan.functions import text as tx

    cases = [
        ("Intel Logo", "substantive", [], "page_furniture"),
        ("Vol. 3C", "substantive", [], "page_furniture"),
        ("VMX OPERATION", "substantive", ["23.1 INTRODUCTION TO VMX OPERATION"], "page_furniture"),
        ("VMX OPERATION", "substantive", ["Other"], "substantive"),
        ("CHAPTER 23 X", "contents", ["X"], "page_furniture"),
        ("All rights reserved.", "front_matter", [], "legal"),
        ("All rights reserved.", "substantive", [], "substantive"),
        ("No product or component", "front_matter", [], "legal"),
        ("trademark", "front_matter", [], "front_matter"),
        ("", "contents", [], "contents"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, inherited string, headings array<string>, want string")
    wrong = df.where(tx.content_class(F.col("t"), F.col("inherited"), F.col("headings")) != F.col("want")).collect()
    assert not wrong


FIELDS = "chunk_id string, heading string, body string, code string, symbols array<string>"


@pytest.fixture(scope="module")
def small_index(spark, tmp_path_factory):
    rows = [
        ("a", "Registers", "The extended feature enable register", None, ["IA32_EFER"]),
        ("b", "Flags", "A register of flags", None, ["EFER"]),
        ("c", "Entry", None, "enter the virtual machine entry point", ["CR4.VMXE", "CPUID.07H.00H:EBX"]),
        ("d", "Faults", "page fault faults", None, ["#PF"]),
    ]
    return Index.write(spark.createDataFrame(rows, FIELDS), str(tmp_path_factory.mktemp("index") / "i"))


def ids(df):
    return [r.chunk_id for r in df.orderBy(F.desc("score"), "chunk_id").collect()]


def test_a_symbol_ranks_before_its_parts(small_index):
    found = ids(lexical.scored(small_index, small_index.query_words("IA32_EFER"), lexical.exact_symbols("IA32_EFER")))
    assert found[0] == "a" and "b" in found
    assert ids(lexical.scored(small_index, small_index.query_words("virtual machine entry points"), []))[0] == "c"
    assert ids(lexical.scored(small_index, small_index.query_words("vendor:intel"), [])) == []
    with pytest.raises(ValueError):
        lexical.scored(small_index, [], [])


def test_words_are_stemmed_and_phrases_are_in_a_row(small_index):
    assert small_index.query_words("Faulting faults") == ["fault"]
    assert ids(small_index.named(lexical.word_clauses(small_index, ["fault"]).groupBy("doc_no").agg(F.sum("score").alias("score")))) == ["d"]
    assert ids(small_index.named(lexical.phrase_clauses(small_index, small_index.query_words("feature enable")))) == ["a"]
    assert ids(small_index.named(lexical.phrase_clauses(small_index, small_index.query_words("enable feature")))) == []


def test_symbols_of_queries():
    assert [lexical.normalized_symbol(w) for w in ("(ia32_efer),", "#pf", "RFLAGS[11:8].")] == ["IA32_EFER", "#PF", "RFLAGS[11:8]"]
    assert lexical.symbol_terms("CR4.VMXE") == ["CR4.VMXE", "CR4", "VMXE"] and lexical.symbol_terms("#PF") == ["#PF", "PF"]
    assert lexical.exact_symbols("what is cr4.vmxe or R8 in the é3 #pf #pf") == ["CR4.VMXE", "R8", "#PF"]


def test_a_search_reads_only_its_terms(small_index):
    plan = lexical.word_clauses(small_index, ["fault"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,fault)" in plan


def test_repeated_chunk_ids_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        Index.write(spark.createDataFrame([("a", None, "x", None, []), ("a", None, "y", None, [])], FIELDS), str(tmp_path / "i"))


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.7071, 0.7071, 0.0])], "vector_row bigint, embedding array<float>")
    order = lambda q, k, allowed=None: [r.vector_row for r in vector.top_k(rows, "vector_row", "embedding", q, k, allowed).collect()]
    assert order([1, 0.2, 0], 3) == [0, 2, 1]
    assert order([1, 0.2, 0], 2, F.col("vector_row").isin(1, 2)) == [2, 1]
    assert order([0, 0, 1], 3) == [0, 1, 2]
    from quillspan.operators import embed

    assert embed.row(embed.verified(rows, 3), 1) == [0.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        embed.row(rows, 3)
    for bad in ([(0, [1.0, 0.0])], [(0, [2.0, 0.0, 0.0])], [(0, [float("nan"), 0.0, 0.0])], [(1, [1.0, 0.0, 0.0])]):
        with pytest.raises(ValueError):
            embed.verified(spark.createDataFrame(bad, "vector_row bigint, embedding array<float>"), 3)
