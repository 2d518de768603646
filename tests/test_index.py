"""Compressed blocks, first-k searches by their bounds, and segments with removals and merges."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import blocks, lexical, topk
from quillspan.operators.index import Index

FIELDS = "chunk_id string, heading string, body string, code string, symbols array<string>"


def test_packing_is_exact():
    r = np.random.default_rng(4)
    counts = r.integers(1, 129, 300)
    values = r.integers(0, 1 << 40, counts.sum()) >> r.integers(0, 41, counts.sum())
    values[: counts[0]] = 0
    width, packed = blocks.pack(values, counts)
    assert width[0] == 0 and (blocks.unpack(width, packed, counts) == values).all()
    assert (blocks.unpack(width[7:], packed[7:], counts[7:]) == values[counts[:7].sum() :]).all()
    assert len(packed[5].as_py()) == -(-int(counts[5]) * int(width[5]) // 8)


def test_blocks_give_their_postings_back(spark):
    r = random.Random(2)
    rows, seen = [], set()
    for field, term, most in (("body", "a", 400), ("body", "b", 1), ("code", "a", 129), ("body", "ü漢", 128)):
        for _ in range(most):
            doc = r.randrange(1 << 33)
            if (field, term, doc) not in seen:
                seen.add((field, term, doc))
                places = sorted(r.sample(range(5000), r.choice([1, 1, 2, 40])))
                rows.append((field, term, doc, len(places), r.randrange(len(places), 10**6), places))
    frame = spark.createDataFrame(rows, "field string, term string, doc_no bigint, tf bigint, length bigint, positions array<int>")
    key = ("field", "term", "doc_no")
    stored = blocks.encoded(frame.repartitionByRange(3, *key).sortWithinPartitions(*key)).persist()
    assert sorted(map(tuple, blocks.decoded(stored, positions=True).collect())) == sorted(rows)
    assert sorted(map(tuple, blocks.decoded(stored).collect())) == sorted(x[:5] for x in rows)
    for b in stored.collect():
        own = [x for x in rows if x[:2] == (b.field, b.term) and b.first <= x[2] <= b.last]
        assert (b.n, b.n_places, b.shortest, b.most) == (len(own), sum(x[3] for x in own), min(x[4] for x in own), max(x[3] for x in own)) and b.n <= 128
    stored.unpersist()
    assert blocks.decoded(blocks.encoded(frame.limit(0)), positions=True).count() == 0


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["common"] * 40 + [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        own = ["common", *r.choices(words, k=r.randrange(3, 25))]
        own += ["half"] * (i % 2) + ["rare"] * (i % 700 == 3) + ["seldom seldom"] * (i % 450 == 7)
        r.shuffle(own)
        out.append((f"c{i:06d}", None, " ".join(own), None, None))
    return out


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    frame = spark.createDataFrame(texts(20_000), FIELDS).repartition(4)
    return Index.write(frame, str(tmp_path_factory.mktemp("many") / "i"), stemming=False)


def firsts(scores, k):
    by = {}
    for r in scores.collect():
        by.setdefault(r.query_id, []).append((-round(r.score, 6), r.chunk_id))
    return {q: sorted(rows)[:k] for q, rows in by.items()}


@pytest.mark.parametrize("binary", [True, False])
def test_first_k_reads_few_blocks(spark, many, binary):
    queries = spark.createDataFrame([(0, "rare common"), (1, "half seldom common"), (2, "common"), (3, "rare seldom"), (4, "w3 w4 common"), (5, "nowhere"), (6, "rare nowhere half")], "query_id int, query string")
    clauses = lexical.asked_terms(many, queries)
    found = topk.first(many, clauses, 5, binary)
    assert firsts(many.named(found.scores), 5) == firsts(lexical.bm25(many, queries, binary=binary), 5)
    asked = many.blocks.join(clauses.select("field", "term").distinct(), ["field", "term"], "left_semi").count()
    read = found.heavy.unionByName(found.seeds).unionByName(found.light).distinct().count()
    assert asked > 250 and read < asked
    one = topk.first(many, lexical.asked_terms(many, queries.where("query_id = 0")), 5, binary)
    common = many.blocks.where("term = 'common'").count()
    assert one.heavy.count() == many.blocks.where("term = 'rare'").count()
    # a block of the common term for each text with the rare one at most, of more than 150
    assert one.light.count() <= 29 and common > 150


def test_first_k_under_a_filter_and_with_few_texts(spark, many):
    queries = spark.createDataFrame([(0, "rare common"), (1, "seldom half")], "query_id int, query string")
    allowed = many.docs.where("doc_no % 3 = 0").select("doc_no")
    got = many.named(topk.first(many, lexical.asked_terms(many, queries), 4, allowed=allowed).scores)
    want = lexical.bm25(many, queries).join(many.docs.join(allowed, "doc_no", "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    assert firsts(got, 4) == firsts(want, 4)
    everything = many.named(topk.first(many, lexical.asked_terms(many, queries.where("query_id = 0")), 50_000).scores)
    assert everything.count() == 20_000
    with pytest.raises(ValueError):
        topk.first(many, lexical.asked_terms(many, queries), 0)


def scores_of(index):
    words = index.query_words("common rare seldom half w3")
    parts = lexical.word_clauses(index, words).unionByName(lexical.phrase_clauses(index, index.query_words("common half")))
    return sorted((r.chunk_id, round(r.score, 9)) for r in index.named(parts.groupBy("doc_no").agg(F.sum("score").alias("score"))).collect())


def written_bytes(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet")}


def test_an_update_writes_what_changed(spark, tmp_path):
    rows = texts(3000)
    frame = lambda r: spark.createDataFrame(r, FIELDS)
    first = Index.write(frame(rows), str(tmp_path / "i"), stemming=False)
    before = written_bytes(first.root)
    old, new = rows[100:130], [(f"n{i}", None, x[2] + " rare", None, None) for i, x in enumerate(rows[100:130])]
    second = first.updated(frame(new), frame(old))
    after = written_bytes(first.root)
    assert all(after[p] == n for p, n in before.items())
    postings = [r["sum(n)"] for r in second.blocks.groupBy("segment").sum("n").collect()]
    assert len(postings) == 2 and min(postings) < 0.02 * max(postings)
    whole = Index.write(frame(rows[:100] + rows[130:] + new), str(tmp_path / "w"), stemming=False)
    assert scores_of(second) == scores_of(whole) and second.n_docs == whole.n_docs == 3000
    assert sorted(map(tuple, second.terms.collect())) == sorted(map(tuple, whole.terms.select(*second.terms.columns).collect()))
    # the state before is as it was
    assert first.docs.where("chunk_id = 'c000100'").count() == 1 and second.docs.where("chunk_id = 'c000100'").count() == 0
    queries = spark.createDataFrame([(0, "rare common")], "query_id int, query string")
    pruned = lambda i: firsts(i.named(topk.first(i, lexical.asked_terms(i, queries), 5).scores), 5)
    assert pruned(second) == pruned(whole)


def test_segments_are_merged_by_size(spark, tmp_path):
    rows = texts(240, seed=5)
    frame = lambda r: spark.createDataFrame(r, FIELDS)
    index = Index.write(frame(rows[:90]), str(tmp_path / "i"), stemming=False)
    held = rows[:90]
    for i in range(90, 240, 25):
        gone, more = held[: 12 + i // 10], rows[i : i + 25]
        index = index.updated(frame(more), frame(gone), fanout=3)
        held = held[len(gone) :] + more
        assert len(index.manifest["segments"]) <= 6 and len(index.manifest["removals"]) < 6
        assert index.n_docs == len(held) == index.docs.count()
    whole = Index.write(frame(held), str(tmp_path / "w"), stemming=False)
    assert scores_of(index) == scores_of(whole)
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, whole.terms.select(*index.terms.columns).collect()))
    assert {k: v for k, v in index.manifest["n_tokens"].items() if v} == whole.manifest["n_tokens"]
    again = Index.open(spark, index.root, index.saved().text())
    assert scores_of(again) == scores_of(whole)
    none = index.updated(frame([]), frame(held))
    assert none.n_docs == 0 and none.docs.count() == 0 and none.terms.count() == 0 and scores_of(none) == []


def test_wrong_updates_are_refused(spark, tmp_path):
    frame = lambda r: spark.createDataFrame(r, FIELDS)
    rows = texts(20)
    index = Index.write(frame(rows), str(tmp_path / "i"), stemming=False)
    with pytest.raises(ValueError):
        index.updated(frame(rows[:1]))
    with pytest.raises(ValueError):
        index.updated(frame([]), frame([("unknown", None, "x", None, None)]))
    assert index.updated(frame(rows[:1]), frame(rows[:1])).n_docs == 20


def test_distinct_terms_are_stemmed_once(spark):
    from quillspan.functions.stemmer import stem

    rows = [("a", "Runs running", "running runs the runner IA32 faults", None, ["RUNNING"]), ("b", None, "fault the faults running", "running", None)]
    fields = spark.createDataFrame(rows, FIELDS).withColumn("doc_no", F.monotonically_increasing_id())
    got = {(r.field, r.term, r.doc_no): (r.tf, r.length, r.positions) for r in lexical.postings(fields).collect()}
    want = {}
    for r in fields.collect():
        for field in ("heading", "body", "code"):
            words = list(lexical.plain_tokens(r[field] or ""))
            for at, word in enumerate(words):
                tf, _, places = want.get((field, stem(word), r.doc_no), (0, 0, []))
                want[field, stem(word), r.doc_no] = tf + 1, len(words), [*places, at]
        for at, symbol in enumerate(r.symbols or []):
            want["symbol", symbol, r.doc_no] = 1, len(r.symbols), [at]
    assert got == want and ("symbol", "RUNNING", rows and fields.first().doc_no) in got
    raw = lexical.postings(fields, stemming=False)
    found = lexical.stems(raw).collect()
    assert len(found) == len({r.term for r in found}) == raw.select("term").distinct().count()
    plan = lexical.stems(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate [term"), "Python is above the distinct terms"
