"""SimHash, line dedup and decontamination against brute force."""

import functools
import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from quillspan.llm import components, decontaminate, line_dedup, queries, simhash


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(docs):
    prints = [brute_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    return Counter((docs[i][0], f"{prints[i]:016x}", min((k for k in groups[find(i)] if k is not None), default=None)) for i in range(len(docs)))


def test_simhash_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op2_simhash(spark, sf).collect())) == brute_components(docs)


def test_simhash_of_awkward_texts(awkward, empty):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert Counter(map(tuple, simhash.near_duplicates(awkward).collect())) == brute_components(docs)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("lead", [4, 7])
def test_every_near_pair_meets(spark, lead):
    r = np.random.default_rng(lead)
    base = r.integers(0, 1 << 63, 30, np.uint64)
    found = [base]
    for _ in range(6):
        flip = np.zeros(len(base), np.uint64)
        for _ in range(4):
            flip |= np.uint64(1) << r.integers(0, 64, len(base)).astype(np.uint64)
        found.append(found[-1] ^ flip)
    found = np.unique(np.concatenate(found))
    links = set()
    for value in range(1 << lead):
        a, b = simhash.link_bucket(found, 64 - lead, value, 2)
        assert (np.bitwise_count(a ^ b) <= 64).all()
        links |= set(zip(a.tolist(), b.tolist(), strict=True))
    parent = {int(x): int(x) for x in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    for x, y in combinations(found.tolist(), 2):
        if (x ^ y).bit_count() <= 4:
            assert find(x) == find(y)


def test_a_crowded_bucket_is_split():
    r = np.random.default_rng(0)
    found = np.unique(np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 30, 40).astype(np.uint64)))

    def roots(most):
        out = np.arange(len(found))
        for a, b, _ in simhash.meetings(found, 60, 0, 2, most):
            out = simhash.forest(len(found), out[a], out[b])[out]
        return out.tolist()

    assert roots(1 << 21) == roots(500) == [0] * len(found)


def test_a_hot_bucket_is_met_in_blocks(spark):
    """A third of all fingerprints are one ball's: cut into parts, they are linked as they are whole, and no task has more than two parts."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    ball = np.full(400, r.integers(0, 1 << 63), np.uint64)
    for _ in range(3):
        ball ^= np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)
    prints = np.unique(np.concatenate([ball, r.integers(0, 1 << 63, 800, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    roots = lambda links: {(x.node, x.root) for x in components.components(links).collect()}
    whole, cut = simhash.near_links(df), simhash.near_links(df, most=90)
    assert roots(cut) == roots(whole) and len(roots(whole)) > 300
    dealt = df.select("fp", F.lit(0).alias("lead"))
    sizes = simhash.in_blocks(dealt, ["lead"], F.lit(1), F.col("fp"), 100).groupBy("p", "q").count().collect()
    assert max(x["count"] for x in sizes) < 2 * 150 and len(sizes) > 50


def test_similar_groups_in_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    r = np.random.default_rng(1)
    texts = []
    for i in range(60):
        own = list(words)
        for at in r.integers(0, 120, int(r.integers(0, 6))):
            own[at] = f"x{i}{at}"
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = sorted(map(tuple, simhash.similar_groups(df).collect()))
    for f in (simhash.similar_links, simhash.crossing_links):
        monkeypatch.setattr(simhash, f.__name__, functools.partial(f, most=20))
    assert sorted(map(tuple, simhash.similar_groups(df.repartition(9)).collect())) == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (-5, -9)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, -5: -9}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text, n=5):
    words = lowered(text).split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_groups_hold_every_similar_pair(spark):
    r = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        base = [f"w{i}" for i in r.integers(0, 5000, 400)]
        texts.append(" ".join(base))
        for changes in r.choice([1, 3, 5, 30, 80], 3):
            copy = list(base)
            for at in r.choice(400, changes, replace=False):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(df).collect()}
    sets = [shingle_set(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        same = jaccard(sets[i], sets[j])
        if same >= 0.82:
            assert got[i] == got[j], (i, j, same)
        if same < 0.05:
            assert got[i] != got[j], (i, j, same)
    for i, root in got.items():
        others = [jaccard(sets[i], sets[j]) for j, x in got.items() if x == root and j != i]
        assert not others or max(others) >= 0.8


def test_similar_pairs_within_a_template_are_found(spark):
    r = np.random.default_rng(9)
    template = [f"t{i}" for i in range(330)]
    texts = []
    for i in range(700):
        own = [*template, *[f"own{i}x{j}" for j in range(70)]]
        texts.append(" ".join(own))
        if i % 10 == 0:
            for at in (r.permutation(39)[:4] * 10 + 5).tolist():
                own[at] = f"changed{i}x{at}"
            texts.append(" ".join(own))
    sets = [shingle_set(t) for t in texts]
    assert 0.68 < jaccard(sets[0], sets[2]) < 0.72
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(df).collect()}
    copies = [i for i in range(1, len(texts)) if jaccard(sets[i], sets[i - 1]) > 0.85]
    assert len(copies) == 70
    assert {i: root for i, root in got.items() if i != root} == {i: i - 1 for i in copies}


@pytest.mark.parametrize("lead", [0, 4])
def test_every_crossing_pair_is_compared_once(lead):
    r = np.random.default_rng(lead)
    centre = r.integers(0, 1 << 40, 3, np.uint64)
    flip = np.uint64(1) << r.integers(0, 40, (3, 60, 3)).astype(np.uint64)
    prints = np.bitwise_xor.reduce(flip, axis=2) ^ centre[:, None]
    prints = np.concatenate([prints.ravel(), prints[:, :5].ravel()])
    labels = np.arange(len(prints)) // 2
    sketches = np.zeros((len(prints), simhash.SKETCH_WORDS), np.uint64)
    got = []
    for value in range(1 << lead):
        a, b, sure = simhash.crossing_pairs(prints, labels, sketches, 40 - lead, value, 2, (-1, 0))
        assert not sure.any()
        got += [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)]
    want = [(i, j) for i, j in combinations(range(len(prints)), 2) if labels[i] != labels[j] and (prints[i] ^ prints[j]).bit_count() <= 4]
    assert sorted(got) == want


def near_prints(seed, n=60):
    """Fingerprints of a table: three balls, and as many of no ball."""
    r = np.random.default_rng(seed)
    flip = np.uint64(1) << r.integers(0, 40, (3, n, 3)).astype(np.uint64)
    balls = (r.integers(0, 1 << 40, 3, np.uint64)[:, None] ^ np.bitwise_xor.reduce(flip, axis=2)).ravel()
    return np.unique(np.concatenate([balls, r.integers(0, 1 << 40, 3 * n, np.uint64)]))


def test_a_set_goes_to_few_places_however_many_there_are(spark):
    """The disk of the dealing: five places a table, where leading bits and their variants were 37 at 8 bits and more at each further one."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, r.bytes(64)) for i in range(500)], "doc bigint, sketch binary")
    for bits, places in ((0, 1), (3, 5), (8, 5)):
        dealt = simhash.dealt_tables(df, bits, 2).groupBy("t").agg(F.sum(F.octet_length("docs") / 8).alias("n"), F.sum(F.octet_length("prints") / 8).alias("m")).collect()
        assert [(x.n, x.m) for x in dealt] == [(500 * places, 500 * places)] * simhash.TABLES, bits
    assert simhash.part_bits(10**9, 2, 20_000) == 8


def test_sets_that_meet_by_chance_are_no_crowd(spark):
    """All have one fingerprint in a table or one a bit off, and are else unlike: neither pairs nor a crowd, as many at many millions of sets would be."""
    r = np.random.default_rng(4)
    own = r.bytes(5)
    sketches = [bytes([own[0] ^ (1 << i if i < 8 else 0)]) + own[1:] + r.bytes(59) for i in range(8)]
    pairs, crowd = simhash.similar_links(spark.createDataFrame(list(enumerate(sketches)), "doc bigint, sketch binary"))
    assert pairs.count() == 0 and crowd.count() == 0


def test_neighbours_equal_brute_force():
    found = near_prints(1)
    colour = np.arange(len(found)) % 3
    differ = lambda x, y: colour[x] != colour[y]
    want = np.array([any((int(a) ^ int(b)).bit_count() <= 4 and colour[i] != colour[j] for j, b in enumerate(found)) for i, a in enumerate(found)])
    assert 100 < want.sum() < 250
    assert (simhash.with_neighbours(found, 40, 4, differ) == want).all()
    assert simhash.with_neighbours(found, 40, 4, differ, most=5)[want].all()


@pytest.mark.parametrize("bits", [0, 1, 4, 8])
def test_every_crossing_pair_is_taken_in_one_part(bits):
    prints = near_prints(bits)
    labels = np.arange(len(prints)) % 7
    sketches = np.zeros((len(prints), simhash.SKETCH_WORDS), np.uint64)
    got = Counter()
    for part in range(5 if bits else 1):
        found = simhash.turned(prints, part, 2)
        for value in np.unique(found >> np.uint64(40 - bits)).tolist():
            here = np.flatnonzero(found >> np.uint64(40 - bits) == value)
            a, b, _ = simhash.crossing_pairs(found[here], labels[here], sketches[here], 40 - bits, value, 2, (-1, 0), part=part)
            got.update(map(frozenset, zip(here[a].tolist(), here[b].tolist(), strict=True)))
    want = {frozenset((i, j)) for i, j in combinations(range(len(prints)), 2) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 4 and labels[i] != labels[j]}
    assert len(want) > 1000 and got == Counter(want)


def test_every_pair_that_meets_is_met_in_some_part():
    prints = near_prints(6)
    total = np.arange(len(prints))
    met = set()
    for part in range(5):
        found = simhash.turned(prints, part, 2)
        for value in np.unique(found >> np.uint64(36)).tolist():
            here = np.flatnonzero(found >> np.uint64(36) == value)
            order = here[np.argsort(found[here])]
            a, b, roots = simhash.neighbour_edges(found[order], 36, value, 2, lambda x, y: np.ones(len(x), bool))
            met |= {(order[i], order[j]) for i, g in enumerate(roots) for j, h in enumerate(roots) if g == h and i != j}
            total = simhash.forest(len(prints), total[order[a]], total[order[b]])[total]
    for i, j in combinations(range(len(prints)), 2):
        if (int(prints[i]) ^ int(prints[j])).bit_count() <= 4:
            assert (i, j) in met and total[i] == total[j]


def test_similar_groups_in_small_buckets(spark, monkeypatch):
    r = np.random.default_rng(2)
    texts = []
    for i in range(90):
        own = [f"w{i % 3}x{j}" for j in range(120)]
        for at in r.integers(0, 120, int(r.integers(0, 9))):
            own[at] = f"x{i}{at}"
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = sorted(map(tuple, simhash.similar_groups(df).collect()))
    assert 3 < len({root for _, root in want}) < 80
    for f in (simhash.similar_links, simhash.crossing_links):
        monkeypatch.setattr(simhash, f.__name__, functools.partial(f, bucket_rows=10))
    assert sorted(map(tuple, simhash.similar_groups(df.repartition(5)).collect())) == want


def test_keep_first(spark, awkward, empty):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(5, text, 1), (3, text.upper(), 2), (9, "other words entirely here now", 3), (None, text, 4)], "doc_id bigint, text string, _gone int")
    assert sorted(x["_gone"] for x in simhash.keep_first(df).collect()) == [2, 3, 4]
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert 0 < kept.count() < awkward.count()
    assert simhash.keep_first(empty).count() == 0


def key_of_line(line):
    return lowered(line.strip(" \t\n\x0b\f\r"))


def brute_lines(docs):
    key = key_of_line
    where = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            where[key(line)].add(doc)
    out = []
    for doc, text in docs:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            own = where[k := key(line)]
            ids = [d for d in own if d is not None]
            if not (len(k) >= 20 and len(ids) >= 3 and doc is not None and doc != max(ids)):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_lines_equal_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op8_line_dedup(spark, sf).collect())) == brute_lines(docs)


def test_lines_of_awkward_texts(awkward, empty):
    from pyspark.sql import functions as F

    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    got = line_dedup.dedup_lines(awkward)
    assert got.columns == [*[c for c in awkward.columns if c != "Kept_Text"], "kept_text", "n_lines", "n_dropped"]
    rows = got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert Counter(map(tuple, rows)) == brute_lines(docs)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_are_compacted(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1, i), (10 + i, 0, 1, i)], "h1 bigint, h2 bigint, n bigint, last bigint"))
    assert max(map(len, runs.levels)) < 2
    met = runs.runs().select("h1").collect()
    assert sorted(r.h1 for r in met) == [1, 10, 11, 12, 13, 14]
    assert [tuple(r) for r in runs.frequent(5).collect()] == [(1, 1, 4)]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("Sort "), plan.count("SortMergeJoin")


def test_a_batch_merges_with_the_runs_as_they_lie(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), F.lit(1).cast("long").alias("n"), F.col("id").alias("last"))
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), fanout=3, buckets=4)
    runs.add(rows.where("last < 1500"))
    runs.add(rows.where("last >= 1000 and last < 2500"))
    batch = runs._put(rows.where("last >= 2000"), "batch")
    with runs.sorted_buckets():
        merged = runs.merged(spark.table(batch), "left_anti")
        assert exchanges(merged) == (0, 0, 2)
        assert sorted(r["last"] for r in merged.collect()) == list(range(2500, 3000))
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
    assert runs.runs().count() == 2500 and runs.frequent(2).count() == 500
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name) and not t.name.endswith(batch[-5:])]


def test_replaced_lines(spark, awkward, empty):
    got = line_dedup.replace_lines(awkward)
    assert got.columns == awkward.columns
    want = {(r.doc_id, r.n_lines, r.n_dropped): r.kept_text for r in line_dedup.dedup_lines(awkward).collect()}
    texts = Counter((r.doc_id, r.text) for r in got.collect())
    nulls = {r.doc_id for r in awkward.collect() if r.text is None}
    assert {t for _, t in texts if t is not None} <= set(want.values())
    assert {d for d, t in texts if t is None} == nulls
    assert sum(texts.values()) == awkward.count()
    assert line_dedup.replace_lines(empty).count() == 0


def brute_hits(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for item, text in items:
        own = words(text)
        if own:
            for i in range(max(1, len(own) - n + 1)):
                windows[tuple(own[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if (w := tuple(own[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[w]
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_hits_equal_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(map(tuple, queries.op6_decontaminate(spark, sf).collect())) == brute_hits(docs, items)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_hits_of_awkward_texts(spark, awkward, empty, block):
    from pyspark.sql import functions as F

    items = [(1, " ".join(f"leak{i}" for i in range(14))), (2, "Short ITEM"), (3, None), (4, ""), (None, "one"), (5, "..."), (2, "Short ITEM"), (30, "one two three four")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_contamination(awkward, bench, block_bytes=block)
    hits = decontaminate.n_hit(F.col("hit_spans"))
    got = found.select("doc_id", F.col("n_words"), hits, F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256), hits > 0).collect()
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert Counter(map(tuple, got)) == brute_hits(docs, [x for x in items if x[0] is not None])
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(awkward, bench.limit(0)).where(F.size("item_ids") > 0).count() == 0


def test_spans_and_documents_go(spark):
    leak = " ".join(f"leak{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"Before, {leak.upper()}! after."), (2, "clean text"), (3, None), (4, leak)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == [2, 3]
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench, remove="spans").collect()}
    assert spans == {1: "Before, ! after.", 2: "clean text", 3: None, 4: ""}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(df, bench, remove="x")


def test_the_index_keeps_to_its_bound():
    """The bound is on the index as it lies in memory; a benchmark over it makes several blocks."""
    import pickle
    import tracemalloc

    r = np.random.default_rng(0)
    items = [(str(i), " ".join(f"w{x}" for x in r.integers(0, 50_000, 400))) for i in range(2000)]
    tracemalloc.start()
    windows = decontaminate.Windows([(i, decontaminate.words(t)) for i, t in items], 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    text = sum(len(t) for _, t in items)
    bound = 2000 * 400 * decontaminate.WINDOW_BYTES + text
    assert len(pickle.dumps(windows)) < 1.1 * bound and peak < 8 * bound
    assert held < 2 * bound


def test_blocks_of_the_benchmark(spark):
    items = spark.createDataFrame([(str(i), " ".join(f"w{(i * 7 + k) % 60}" for k in range(30))) for i in range(20)] + [("x", None), (None, "a b")], "item_id string, text string")
    blocks = list(decontaminate._blocks(items, "item_id", "text", 2 * (30 * decontaminate.WINDOW_BYTES + 90)))
    assert sum(map(len, blocks)) == 20 and len(blocks) == 10
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 11 + k) % 60}" for k in range(40))) for i in range(9)], "doc_id bigint, text string")
    one = sorted(map(tuple, decontaminate.find_contamination(docs, items).select("doc_id", "n_words", "hit_spans", "item_ids").collect()))
    many = sorted(map(tuple, decontaminate.find_contamination(docs, items, block_bytes=3000).select("doc_id", "n_words", "hit_spans", "item_ids").collect()))
    assert one == many and any(r[3] for r in one)


def test_the_shared_folder_must_be_named_on_a_cluster(spark):
    from quillspan.llm import cluster

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        cluster.shared_dir(Session())
    assert cluster.shared_dir(spark)
