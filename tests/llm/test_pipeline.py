"""The pipeline stage by stage, each against plain Python on the rows that it gets."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_hits, key_of_line
from test_tokens import library_ids

import corpus_pipeline
from quillspan.llm import packing, quality, queries, simhash


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    """What each stage gets and gives: (input, output) by name."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, sf).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(staged):
    before = staged["quality"][0]
    for name, (_, after) in list(staged.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.dtypes == before.dtypes, name


def test_quality_stage(spark, sf, staged):
    before, after = staged["quality"]
    model = quality.learn(before, spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "text", "quality")
    want = {d for d, r in rows(before).items() if model.predict(np.array([quality.statistics(r.text)]))[0] >= queries.QUALITY_THRESHOLD}
    assert set(rows(after)) == want


def test_line_stage(staged):
    before, after = (rows(x) for x in staged["lines"])
    where = defaultdict(set)
    for d, r in before.items():
        for line in (r.text or "").split("\n"):
            where[key_of_line(line)].add(d)
    assert set(before) == set(after)
    for d, r in before.items():
        kept = [x for x in (r.text or "").split("\n") if not (len(k := key_of_line(x)) >= 20 and len(where[k]) >= 3 and max(where[k]) != d)]
        assert after[d].text == (None if r.text is None else "\n".join(kept))


def test_near_duplicate_stage(staged):
    before, after = (rows(x) for x in staged["near_duplicates"])
    sets = {d: set(simhash.shingle_hashes(r.text, 5).tolist()) for d, r in before.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert set(after) == {find(d) for d in sets}


def test_benchmark_stage(spark, sf, staged):
    before, after = (rows(x) for x in staged["benchmark"])
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0]: r[5] for r in brute_hits([(d, r.text) for d, r in before.items()], items)}
    assert set(after) == {d for d in before if not hit[d]}


def test_packing_stage(staged):
    docs, pieces = staged["packing"][0].collect(), staged["packing"][1]
    assert set(pieces.columns) == set(packing.PIECES.names)
    got, used = defaultdict(list), defaultdict(list)
    for p in pieces.collect():
        got[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        used[p.sequence_id].append((p.offset, p.length))
    for doc, ids in zip(docs, library_ids([r.text for r in docs]), strict=True):
        assert [i for _, part in sorted(got[doc.doc_id]) for i in part] == [*ids, 1]
    for placed in used.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_gives_the_last_stage(spark, sf, staged):
    got = corpus_pipeline.run(spark, sf).agg(F.countDistinct("doc_id"), F.sum("length")).first()
    want = staged["packing"][1].agg(F.countDistinct("doc_id"), F.sum("length")).first()
    assert tuple(got) == tuple(want)
