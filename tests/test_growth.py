"""What must hold however large the tables are: results at many slices, and steps whose rows do not multiply."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspan import build, store
from quillspan.ingest import chunker, manual
from quillspan.operators import blocks, embed, lexical, topk
from quillspan.operators.index import Index
from quillspan.plans import manuals

FIELDS = "chunk_id string, heading string, caption string, body string, code string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_engine_search_finds_its_manual_among_many_of_the_nation(spark, tmp_path):
    number = F.col("id").cast("int")
    spark.range(25).select(number.alias("n_nationkey"), F.format_string("LAND%c", F.lit(65) + number).alias("n_name")).write.parquet(str(tmp_path / "nation.parquet"))
    key = (number * manuals.SLICE + 1).alias("c_custkey")
    spark.range(300).select(key, F.lit(manuals.ASKED - 1).alias("c_nationkey"), F.lit("Customer").alias("c_name"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(2).select((number + 1).alias("s_suppkey"), (number * (manuals.ASKED - 1)).alias("s_nationkey"), F.lit("Supplier").alias("s_name"), F.lit(5.0).alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    got = manuals.QUERIES["engine_search"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(f"manual-{manuals.ASKED}.md", "amd")]


def test_postings_are_counted_without_a_shuffle(spark):
    rows = [(7, None, None, "a b a ab", "b"), (8, "B", None, "b", None), (9, None, None, None, None), (12, None, None, "b a b", None)]
    fields = spark.createDataFrame(rows, FIELDS.replace("chunk_id string", "doc_no bigint")).coalesce(1)
    found = lexical.postings(fields, stemming=False)
    assert "Exchange" not in plan_of(found)
    got = {(r.field, r.term, r.doc_no): (r.tf, r.length, r.positions) for r in found.collect()}
    assert got == {("body", "a", 7): (2, 4, [0, 2]), ("body", "b", 7): (1, 4, [1]), ("body", "ab", 7): (1, 4, [3]), ("code", "b", 7): (1, 1, [0]), ("heading", "b", 8): (1, 1, [0]), ("body", "b", 8): (1, 1, [0]), ("body", "b", 12): (2, 3, [0, 2]), ("body", "a", 12): (1, 3, [1])}
    # numbers 10 and 11 may be another task's: a run does not pass over them
    runs = sorted((r.term, r.first, r.doc_nos) for r in lexical.runs(fields).where("field = 'body'").collect())
    assert runs == [("a", 7, [7]), ("a", 12, [12]), ("ab", 7, [7]), ("b", 7, [7, 8]), ("b", 12, [12])]


def test_a_build_starts_one_pool_of_few_python_workers(spark, tmp_path):
    fields = spark.createDataFrame([(7, None, None, "a b a ab", "b"), (8, "B", None, "b", None)], FIELDS.replace("chunk_id string", "doc_no bigint")).coalesce(1)
    # two steps in a row would be two processes for each task
    assert plan_of(lexical.postings(fields, stemming=False)).count("MapInArrow") == 1
    rows = store.listed(spark, [("a", 1), (None, 2)], "x string, y bigint")
    assert "ExistingRDD" not in plan_of(rows) and plan_of(rows).startswith("LocalTableScan")
    assert rows.schema == spark.createDataFrame([], "x string, y bigint").schema and [tuple(r) for r in rows.collect()] == [("a", 1), (None, 2)]
    assert store.listed(spark, [], blocks.BLOCK).count() == 0
    index = Index.write(fields.withColumn("chunk_id", F.col("doc_no").cast("string")).drop("doc_no"), str(tmp_path / "i"))
    assert "ExistingRDD" not in plan_of(store.numbered(index.docs, "n")) and "ExistingRDD" not in plan_of(index.dead)


def test_what_a_task_counts_at_once_is_bounded(monkeypatch):
    own = lambda first, n: pa.RecordBatch.from_pydict({"doc_no": list(range(first, first + n)), "field": ["body"] * n, "tokens": [["a", f"t{i % 3}"] for i in range(n)]})
    batches = [own(0, 40), own(40, 0), own(40, 3), own(43, 30)]
    seen, counted = [], lexical._counted
    monkeypatch.setattr(lexical, "_counted", lambda held, apart: (seen.append(sum(b.num_rows for b in held)), counted(held, apart))[1])
    postings = lambda together: sorted(tuple(r.values()) for b in blocks.of_runs(lexical.run_batches(iter(batches), False, together)) for r in b.to_pylist())
    few = postings(20)
    assert sum(seen) == 73 and max(seen) <= 10
    assert few == postings(1000) and len(few) == 146
    assert lexical.OPENED_TOGETHER <= 1 << 18


def test_blocks_are_unpacked_in_bounded_portions():
    sizes = np.array([5, blocks.AT_ONCE, 1, blocks.AT_ONCE - 1, 2, blocks.AT_ONCE + 9])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6))], names=["x"])
    assert [p.column("x").to_pylist() for p in blocks.portions(batch, sizes)] == [[0], [1], [2, 3], [4], [5]]
    assert list(blocks.portions(batch.slice(0, 0), sizes[:0])) == []


def firsts(scores, k):
    by = {}
    for r in scores.collect():
        by.setdefault(r.query_id, []).append((-round(r.score, 6), r.chunk_id))
    return {q: sorted(rows)[:k] for q, rows in by.items()}


def test_scores_are_cut_before_they_are_shuffled(spark, tmp_path):
    words = lambda i: " ".join(["common"] + [f"w{i % n}" for n in (3, 7, 11, 50)] + ["rare"] * (i % 900 == 5) + ["often"] * (i % 4))
    rows = [(f"c{i:05d}", None, None, words(i), None) for i in range(6000)]
    index = Index.write(spark.createDataFrame(rows, FIELDS), str(tmp_path / "i"), stemming=False)
    index = index.updated(spark.createDataFrame([("n1", None, None, "rare common rare", None)], FIELDS), spark.createDataFrame([r for i, r in enumerate(rows) if i % 900 == 5 and i > 2000], FIELDS))
    queries = spark.createDataFrame([(i, f"common w{i % 11} often rare w{i % 50}") for i in range(300)] + [(300, "nowhere")], "query_id int, query string")
    asked = lexical.asked_terms(index, queries)
    allowed = index.docs.where("doc_no % 3 = 0").select("doc_no")
    for binary in (True, False):
        everything = lexical.bm25(index, queries, binary=binary)
        found = topk.best(index, asked, 5, binary).persist()
        assert firsts(index.named(found), 5) == firsts(everything, 5)
        # six ranges of numbers give five each, and ties; all scores are a row a text and query
        assert found.count() < 0.2 * everything.count()
        found.unpersist()
        within = everything.join(index.docs.join(allowed, "doc_no", "left_semi").select("chunk_id"), "chunk_id", "left_semi")
        assert firsts(index.named(topk.best(index, asked, 5, binary, allowed)), 5) == firsts(within, 5)


def test_terms_of_removed_documents_are_counted_together_and_without_a_join(spark, tmp_path):
    texts = {7: "a b a ab", 8: "b", 9: None, 12: "b a b"}
    fields = spark.createDataFrame([(n, None, None, t, None) for n, t in texts.items()], FIELDS.replace("chunk_id string", "doc_no bigint")).coalesce(1)
    assert [(r.term, r.doc_nos) for r in lexical.runs(fields, apart=False).orderBy("term").collect()] == [("a", [7, 12]), ("ab", [7]), ("b", [7, 8, 12])]
    for stemming in (False, True):
        found = lexical.term_counts(fields, stemming)
        assert stemming or "Join" not in plan_of(found)
        assert sorted(map(tuple, found.collect())) == [("body", "a", 2, 3), ("body", "ab", 1, 1), ("body", "b", 3, 4)]
    ids = lambda *own: spark.createDataFrame([(str(n), None, None, texts[n], None) for n in own], FIELDS)
    index = Index.write(ids(7, 9), str(tmp_path / "i"), stemming=False).updated(ids(8, 12))
    left = index.updated(ids(9).limit(0), ids(7, 12, 9))
    assert sorted(map(tuple, left.terms.collect())) == [("body", "b", 1, 1)] and left.n_docs == 1


def test_slow_work_on_few_bytes_is_many_tasks(spark, sf):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts > 1 and manuals.sources(spark, sf).rdd.getNumPartitions() == parts
    texts = spark.createDataFrame([(str(i % 9), f"text {i % 9}") for i in range(20)], "content_hash string, text string").groupBy("content_hash").agg(F.min("text").alias("text"))
    made = embed.embedded(texts, embed.HashingEmbedder())
    assert made.rdd.getNumPartitions() == parts and made.count() == 9


def test_chunks_of_a_build_are_made_once(spark, tmp_path):
    class Noting(embed.HashingEmbedder):
        """Leaves a file for each text that is counted."""

        def __init__(self, folder):
            super().__init__()
            object.__setattr__(self, "folder", folder)

        def count_tokens(self, text):
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w"):
                return super().count_tokens(text)

    seen = tmp_path / "seen"
    seen.mkdir()
    source = "# A\n\none two three"
    docs = spark.createDataFrame([("d", "v", "a", "0", "m.md", "1", len(source), source)], ", ".join(f"{c} {'bigint' if c == 'byte_len' else 'string'}" for c in manual.DOCUMENT))
    build.build(spark, str(tmp_path / "root"), docs, [], Noting(str(seen)))
    alone = tmp_path / "alone"
    alone.mkdir()
    chunker.Chunker(manual.parsed(docs).first().asDict(True), count=Noting(str(alone)).count_tokens).run()
    assert len(list(seen.iterdir())) == len(list(alone.iterdir())) > 0
