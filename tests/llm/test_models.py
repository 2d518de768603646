"""Learned operators: held-out accuracy, plain-Python likeness, and planted copies."""

import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import local_features, quality, queries, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def held_out(spark, rows, label, n, r):
    labels = {x.doc_id: x[label] for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = rows.collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % n == r) for x in got)
    assert all(0 <= x.score <= 1 for x in got)
    return [(x.predicted, labels[x.doc_id]) for x in got if x.held_out and x.doc_id in labels]


def test_quality_on_held_out_rows(spark):
    pairs = held_out(spark, queries.op9_quality(spark, SF), "quality", 4, 2)
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)


def test_toxicity_on_held_out_rows(spark):
    pairs = held_out(spark, queries.op4_toxicity(spark, SF), "toxic", 5, 0)
    assert sum(a == b for a, b in pairs) >= 0.93 * len(pairs)
    assert all(not a or b for a, b in pairs)


def test_rules_as_columns_equal_the_model(spark):
    r = np.random.default_rng(1)
    x = r.random((400, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] < 0.7)).astype(int)
    model = quality.fit_rules(x, y, trees=10)
    assert ((model.predict(x) > 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([(i, tuple(map(float, row))) for i, row in enumerate(x[:50])], "i int, s struct<" + ",".join(f"{s}:double" for s in quality.STATISTICS) + ">")
    got = [v.p for v in df.select("i", model.column("s").alias("p")).orderBy("i").collect()]
    assert np.allclose(got, model.predict(x[:50]))
    assert quality.fit_rules(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]
    assert quality.fit_rules(x[:5], np.ones(5, int)).predict(x[:1])[0] > 0.5


def test_scores_of_awkward_texts(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None), (1, 1)], "doc_id bigint, label int")
    model = quality.learn(awkward, labels, "doc_id", "text", "label")
    linear, _ = toxicity.learn(awkward, labels, "doc_id", "text", "label")
    for scored in (quality.score_quality(awkward, model), toxicity.score_toxicity(awkward, linear)):
        assert scored.columns == [*awkward.columns, "score"]
        assert scored.where("score between 0 and 1").count() == awkward.count()
    assert quality.score_quality(empty, model).count() == toxicity.score_toxicity(empty, linear).count() == 0
    nothing = quality.learn(empty, labels.limit(0), "doc_id", "text", "label")
    assert nothing.rules == ()
    assert toxicity.learn(empty, labels.limit(0), "doc_id", "text", "label")[0].terms == ()
    assert quality.keep_accepted(awkward, labels, 0.0, label="label").columns == awkward.columns


def test_label_model_finds_accuracies_and_correlation():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.3
    votes = np.stack([np.where(r.random(len(truth)) < a, truth, ~truth) for a in (0.9, 0.8, 0.7, 0.85)], axis=1).astype(int)
    votes = np.column_stack([votes, votes[:, 1]])  # a voter twice
    patterns, counts = np.unique([toxicity.pattern_of(v) for v in votes.tolist()], return_counts=True)
    model = toxicity.fit_label_model(toxicity.votes_of(patterns, 5), counts.astype(float), 0.3)
    assert np.allclose(model.accuracy[:4], (0.9, 0.8, 0.7, 0.85), atol=0.06)
    assert model.correlation[1, 4] > 0.8 and model.weight[1] < 0.6 < model.weight[0]


def test_posteriors_equal_bayes_by_hand():
    """With voters that are tied to none, the posterior is the product of their chances and the prior."""
    r = np.random.default_rng(3)
    truth = r.random(4000) < 0.2
    votes = np.stack([np.where(r.random(4000) < 0.4, -1, np.where(r.random(4000) < a, truth, ~truth)) for a in (0.9, 0.75, 0.8)], axis=1).astype(int)
    patterns, counts = np.unique([toxicity.pattern_of(v) for v in votes.tolist()], return_counts=True)
    seen = toxicity.votes_of(patterns, 3)
    assert [toxicity.pattern_of(v) for v in seen.tolist()] == patterns.tolist()
    model = toxicity.fit_label_model(seen, counts.astype(float), 0.2)
    assert model.weight.tolist() == [1.0] * 3
    for vote, got in zip(seen.tolist(), model.posterior(seen).tolist(), strict=True):
        by_label = [1 - model.prior, model.prior]
        for v, said in enumerate(vote):
            by_label = [by_label[y] * model.chance[v, y, said + 1] for y in (0, 1)]
        assert abs(got - by_label[1] / sum(by_label)) < 1e-9


def test_pattern_voters_look_at_the_text():
    voters = toxicity.Voters((("scum", "moron"), ("clown",), (), (), (), (), ()))
    table = toxicity.TermTable(["scum", "moron", "clown"])

    def votes(text):
        found = {["scum", "moron", "clown"][i]: n for i, n in table(text).items()}
        return voters.votes(text, found)[len(voters.lexicons) :]

    assert votes("a plain short text") == [-1, -1, -1, -1, -1, 0, 0, -1]
    assert votes("you scum you moron") == [-1, -1, 1, 1, -1, -1, 0, -1]
    assert votes("scum " + "x " * 30 + "scum") == [-1, 1, -1, 1, -1, -1, 0, -1]
    assert votes("scum " + "x " * 30 + "clown moron")[0] == 1
    for hidden in ("you m0r0n there", "such cl*own", "what a scuuuum", "s-c-u-m"):
        assert votes(hidden)[4] == 1 and votes(hidden)[5] == 0
    assert votes("word " * 250)[7] == 0
    assert toxicity.undisguised("don't stop well.known") == {"wellknown"}


def test_toxicity_learns_from_texts_without_labels(spark):
    """Terms that no labelled text has get no weight; of the others, the weight is set by posteriors of all texts."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        toxic = i % 5 == 0
        words = [f"w{x}" for x in r.integers(0, 300, 40)]
        if toxic:
            words[3:3] = list(r.choice(["scum", "moron", "clown", "idiot", "trash"], 2, replace=False))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400], "doc_id bigint, toxic int")
    model, votes = toxicity.learn(docs, labels, "doc_id", "text", "toxic")
    assert {"scum", "moron", "clown", "idiot", "trash"} <= set(model.terms)
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows[400:]]) > 0.98
    few, _ = toxicity.learn(docs.where("doc_id < 400"), labels, "doc_id", "text", "toxic")
    assert few.weights != model.weights, "texts without labels take part"


def test_scores_are_the_same_for_rows_in_another_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    mixed = docs.repartition(7, "text"), labels.orderBy(F.xxhash64("doc_id", F.lit(3)))
    assert quality.learn(docs, labels, "doc_id", "text", "quality") == quality.learn(*mixed, "doc_id", "text", "quality")
    assert toxicity.learn(docs, labels, "doc_id", "text", "toxic")[0] == toxicity.learn(*mixed, "doc_id", "text", "toxic")[0]


def test_rule_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "text", "quality")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score_quality(docs, model).collect():
        own = dict(zip(quality.STATISTICS, quality.statistics(texts[r.doc_id]), strict=True))
        total = model.intercept
        for rule, weight in zip(model.rules, model.weights, strict=True):
            total += weight * all((own[quality.STATISTICS[j]] > cut) == above for j, above, cut in rule)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def test_toxicity_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model, _ = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "text", "toxic")
    weights = dict(zip(model.terms, model.weights, strict=True))
    for r in toxicity.score_toxicity(docs, model).collect():
        total, words = model.intercept, {w for w in re.findall(r"[^\W\d_]+", (r.text or "").lower())}
        for term, weight in weights.items():
            n = sum(w == term if not term.endswith("-") else len(w) >= len(term) and w.startswith(term[:-1]) for w in words)
            total += weight * min(n, toxicity.MOST_WORDS)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def test_one_of_copies():
    rows = [(3, 1, [1] * 16), (1, 1, [1] * 10 + [2] * 6), (2, 0, [1] * 16), (4, 1, [9] * 7 + [1] * 9)]
    assert toxicity.one_of_copies(rows) == {1, 2, 4}


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_urls(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "x://org", "x://org/", "x://a.com/de/?q=://b.org/", "http://e.net?x=/fr/", "http://example.org/en/12", "http://badorg/", "http://é.com/fr/漢"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-1 - i, u) for i, u in enumerate([*odd, odd[4]])], "page_id bigint, url string")).withColumn("Score", F.lit("x"))
    rows = url_filter.filter_urls(pages, url_filter.RULES).collect()
    assert len(rows) == 250 + len(odd) + 1
    for x in rows:
        host, path, rule, verdict = brute_rule(x.url)
        assert (x.host, x.path, x.rule) == (host, path, rule)
        assert x.verdict in ("allow", "block") and verdict in (None, x.verdict)
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_url_scores_and_verdicts_equal_brute_force(spark, sf):
    """URLs without a rule: the two models by plain counts of every context, and the ratio against the threshold."""
    import math
    from collections import Counter

    import xxhash

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    rows = url_filter.filter_urls(pages, url_filter.RULES).collect()
    bare = lambda url: re.sub(r"^[^:/?#]*://", "", url or "")
    counts = {v: [Counter() for _ in range(url_filter.ORDER + 2)] for v in ("allow", "block")}

    def grams(url):
        raw = b"\x01" * url_filter.ORDER + url.encode() + b"\x02"
        return [raw[i - url_filter.ORDER : i + 1] for i in range(url_filter.ORDER, len(raw))]

    for r in rows:
        digest = xxhash.xxh64(bare(r.url).encode(), seed=42).intdigest()
        held_out = (digest - (digest >> 63 << 64)) % 5 == 0
        if r.rule is not None and not held_out:
            for gram in grams(bare(r.url)):
                for n in range(url_filter.ORDER + 1):
                    counts[r.verdict][n][gram[-n - 1 :]] += 1

    def probability(gram, v):
        p = 1 / 256
        for n in range(url_filter.ORDER + 1):
            table = counts[v][n]
            of = sum(c for k, c in table.items() if k[:-1] == gram[-n - 1 : -1])
            p = (table[gram[-n - 1 :]] + 2.0 * p) / (of + 2.0)
        return p

    cache: dict = {}
    for r in rows:
        if r.rule is None:
            own = grams(bare(r.url))
            for gram in own:
                if gram not in cache:
                    cache[gram] = math.log(probability(gram, "allow")) - math.log(probability(gram, "block"))
            assert abs(r.score - sum(cache[g] for g in own) / len(own)) < 1e-9
    free = [r for r in rows if r.rule is None]
    if free:
        accepted, rejected = ([r.score for r in free if r.verdict == v] for v in ("allow", "block"))
        assert not accepted or not rejected or min(accepted) > max(rejected)


def test_long_and_many_urls(spark):
    rows = [(i, f"https://host{i % 97}.{('org', 'com', 'net')[i % 3]}/{('en', 'de', 'fr')[i % 5 % 3]}/{i}") for i in range(5000)]
    rows += [(9000, "https://a.net/" + "x/" * 60_000), (9001, "://"), (9002, None), (9003, "http://ORG"), (9003, "http://ORG")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string").repartition(7), url_filter.RULES).collect()
    assert len(got) == len(rows) and {x.verdict for x in got} <= {"allow", "block"}
    for x in got:
        host, path, rule, verdict = brute_rule(x.url)
        assert (x.host, x.path, x.rule) == (host, path, rule) and (verdict is None or x.verdict == verdict)


def test_url_models_tell_languages_apart(spark):
    r = np.random.default_rng(2)
    good = [f"site{i}.example/read/{'abc'[i % 3]}{r.integers(999)}" for i in range(400)]
    bad = [f"buy-pills{i}.example/sale/{r.integers(999)}?cheap" for i in range(400)]
    df = spark.createDataFrame([(u, "allow") for u in good] + [(u, "block") for u in bad], "url string, verdict string")
    model = url_filter.learn(df)
    assert (model.scores(["site999.example/read/a1"]) >= model.threshold).all()
    assert (model.scores(["buy-pills999.example/sale/7?cheap"]) < model.threshold).all()


def test_url_counts_are_exact_for_many_contexts(spark):
    r = np.random.default_rng(4)
    urls = ["".join(map(chr, row)) for row in r.integers(33, 127, (6000, 60))]
    df = spark.createDataFrame([(u, "allow" if i % 2 else "block") for i, u in enumerate(urls)], "url string, verdict string")
    model = url_filter.learn(df)
    assert model.counts.count() > 250_000
    # contexts that no URL has leave both models at their lower orders
    trained = {v: [r.url for r in df.where(F.pmod(F.xxhash64("url"), F.lit(5)) != 0).where(F.col("verdict") == v).collect()] for v in ("allow", "block")}
    want = []
    tested = ["é" * 8, "~}|{zyx!", urls[0][:20], ""]
    counts = {v: ({}, {}) for v in trained}
    for v, own in trained.items():
        context, joint = counts[v]
        for u in own:
            data = b"\x01" * 5 + u.encode() + b"\x02"
            for i in range(5, len(data)):
                for k in range(6):
                    c, j = data[i - k : i], data[i - k : i + 1]
                    context[c] = context.get(c, 0) + 1
                    joint[j] = joint.get(j, 0) + 1
    for u in tested:
        data, total = b"\x01" * 5 + u.encode() + b"\x02", 0.0
        for i in range(5, len(data)):
            p = {}
            for v, (context, joint) in counts.items():
                p[v] = 1 / 256
                for k in range(6):
                    p[v] = (joint.get(data[i - k : i + 1], 0) + 2 * p[v]) / (context.get(data[i - k : i], 0) + 2)
            total += np.log(p["allow"]) - np.log(p["block"])
        want.append(total / (len(data) - 5))
    assert np.allclose(model.scores(tested), want, atol=1e-9)


def picture(seed, side=96):
    r = np.random.default_rng(seed)
    image = local_features.resized(r.random((12, 12)).astype(np.float32) * 255, side, side)
    for _ in range(12):
        y, x, h, w = r.integers(0, side - 20, 2).tolist() + r.integers(8, 20, 2).tolist()
        image[y : y + h, x : x + w] = r.random() * 255
    return image


def pgm(image):
    image = np.rint(image).clip(0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % image.shape[::-1] + image.tobytes()


def test_cropped_and_edited_copies_are_found(spark):
    rows, origin = [], {}
    for s in range(12):
        image = picture(s)
        noise = np.random.default_rng(s).normal(0, 3, image.shape)
        for j, copy in enumerate((image, image[10:86, 14:90], image * 0.8 + 20, image + noise, np.rot90(image))):
            rows.append((10 * s + j, pgm(copy), "x"))
            origin[10 * s + j] = s
    rows += [(900, None, "x"), (904, None, "x"), (901, b"broken", "x"), (905, b"broken", "x"), (902, pgm(np.full((40, 40), 9.0)), "x"), (903, rows[0][1], "x"), (903, rows[0][1], "x"), (None, rows[0][1], "x")]
    got = local_features.copies(spark.createDataFrame(rows, "image_id bigint, image binary, n_links string"), "image_id", "image").collect()
    assert len(got) == len(rows)
    root = {x.image_id: x.component_id for x in got}
    same = [(a, b) for a, b in combinations(origin, 2) if origin[a] == origin[b]]
    assert sum(root[a] == root[b] for a, b in same) >= 0.9 * len(same)
    assert all(root[a] != root[b] for a, b in combinations(origin, 2) if origin[a] != origin[b])
    assert root[903] == root[None] == root[0] and [root[i] for i in (900, 904, 901, 905, 902)] == [900, 904, 901, 901, 902]
    assert local_features.copies(spark.createDataFrame([], "image_id bigint, image binary"), "image_id", "image").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_rows_of_a_key_are_compared_across_labels(seed):
    r = np.random.default_rng(seed)
    rows = sorted(zip(r.integers(0, 6, 60).tolist(), r.integers(0, 4, 60).tolist(), strict=True))
    key, label = (np.array(x) for x in zip(*rows, strict=True))
    got = [p for x, y in local_features.crossing(key, label, most=50) for p in zip(x.tolist(), y.tolist(), strict=True)]
    want = [(i, j) for i, j in combinations(range(60), 2) if key[i] == key[j] and label[i] != label[j]]
    assert sorted(got) == want
    assert not list(local_features.crossing(key[:0], label[:0]))


def linked(a, b, least=120.0):
    corners, evidence = local_features.consensus(*a, *b)
    return corners >= max(4, 0.15 * min(len(a[1]), len(b[1]))) and evidence >= least


def class_rows(spark, images):
    rows = [(i, p.astype("<f4").tobytes(), b.tobytes(), i) for i, (p, b) in enumerate(images)]
    return spark.createDataFrame(rows, "image bigint, places binary, bits binary, label bigint")


@pytest.mark.parametrize("edit", ["noise 8", "noise 16", "rescaled", "cropped"])
def test_pairs_that_verification_accepts_meet(spark, edit):
    images = []
    for s in range(40):
        image = picture(s)
        if edit == "rescaled":
            copy = local_features.resized(local_features.resized(image, 77, 77), 96, 96)
        elif edit == "cropped":
            copy = image[20:90, 10:70]
        else:
            copy = image + np.random.default_rng(s).normal(0, int(edit.split()[1]), image.shape)
        images += [local_features.describe(local_features.decode(pgm(i))) for i in (image, copy)]
    met = {(x.a, x.b) for x in local_features.crossing_pairs(class_rows(spark, images)).collect()}
    accepted = [(i + 1, i) for i in range(0, 80, 2) if linked(images[i + 1], images[i])]
    assert len(accepted) >= 30 and sum(p in met for p in accepted) >= 0.98 * len(accepted)


def test_unrelated_vectors_are_not_linked(spark):
    """Of all pairs of 500 unrelated drawn vectors the rules accept none; four corners within 40 bits, without weights, accept 14."""
    drawn = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(500).select("vec_id", local_features.thumbnails(F.col("embedding")).alias("image"))
    images = [local_features.describe(local_features.decode(x.image)) for x in drawn.orderBy("vec_id").collect()]
    assert not any(linked(images[i], images[j]) for j, i in combinations(range(len(images)), 2))
    got = local_features.copies(drawn, "vec_id", "image").collect()
    assert all(x.image_id == x.component_id for x in got)


def test_components_equal_those_of_all_pairs(spark):
    """Small pictures with edited copies of many strengths and a large group, against every pair verified."""
    r = np.random.default_rng(11)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(60).select(local_features.thumbnails(F.col("embedding")).alias("image")).collect()
    images = []
    for n, x in enumerate(table):
        image = local_features.decode(x.image)
        images.append(image)
        for k in range(120 if n == 0 else 3):
            edits = (image + r.normal(0, r.uniform(2, 16), image.shape), image[3:, :28], local_features.resized(image, 40, 40), np.rot90(image))
            images.append(edits[0 if n == 0 else (n + k) % 4])
    rows = [(i, pgm(image)) for i, image in enumerate(images)]
    described = [local_features.describe(local_features.decode(data)) for _, data in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if linked(described[i], described[j]) or linked(described[j], described[i])]
    for i, j in pairs:
        low, high = sorted((find(i), find(j)))
        root[high] = low
    got = {x.image_id: x.component_id for x in local_features.copies(spark.createDataFrame(rows, "image_id bigint, image binary").repartition(5), "image_id", "image").collect()}
    assert all(find(i) == find(got[i]) for i in got), "nothing is joined that all pairs do not join"
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
    assert sum(got[i] == got[0] for i in range(121)) >= 119


def test_a_group_of_copies_makes_few_pairs(spark):
    image = picture(5)
    noisy = [local_features.describe(local_features.decode(pgm(image + np.random.default_rng(i).normal(0, 3, image.shape)))) for i in range(300)]
    classes = class_rows(spark, noisy)
    first = local_features.first_pairs(classes).collect()
    assert len(first) <= local_features.SKETCH * len(noisy)
    joined = np.arange(300)
    for _ in range(300):
        for x in first:
            joined[[x.a, x.b]] = min(joined[x.a], joined[x.b])
    assert (joined == 0).mean() > 0.97
    one = classes.withColumn("label", F.lit(7).cast("long"))
    assert local_features.crossing_pairs(one).count() == 0


def test_a_large_image(spark):
    r = np.random.default_rng(0)
    image = local_features.resized(r.uniform(0, 255, (90, 120)).astype(np.float32), 900, 1200)
    rows = [(1, pgm(image)), (2, pgm(image[100:700, 200:1000])), (3, pgm(image[:, ::-1] * 0.5))]
    got = {x.image_id: x.component_id for x in local_features.copies(spark.createDataFrame(rows, "image_id bigint, image binary"), "image_id", "image").collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_png_and_pgm_give_one_image():
    import zlib as z

    image = np.rint(picture(3)[:20, :20]).astype(np.uint8)
    raw = b"".join(b"\x02" + (row.astype(int) - (image[i - 1] if i else 0)).astype(np.uint8).tobytes() for i, row in enumerate(image))
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + z.crc32(kind + data).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (20).to_bytes(4, "big") * 2 + b"\x08\x00\x00\x00\x00") + chunk(b"IDAT", z.compress(raw)) + chunk(b"IEND", b"")
    assert (local_features.decode(png) == local_features.decode(pgm(image))).all()
    assert local_features.decode(b"P5\n9 9\n255\n") is None


@pytest.mark.parametrize("name", ["op1_media_copies"])
def test_copies_of_vectors_share_a_component(spark, name):
    rows = {x.vec_id: x for x in queries.QUERIES[name](spark, SF).collect()}
    table = {x.vec_id: np.array(x.embedding) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert rows.keys() == table.keys()
    near = [(a, b) for a, b in combinations(sorted(table), 2) if table[a] @ table[b] > 0.97]
    assert sum(rows[a].component_id == rows[b].component_id for a, b in near) >= 0.9 * len(near)


#: Edits of drawn vectors, and the least share of edited copies that meet and are accepted.
DRAWN_EDITS = {
    "noise of sigma 8": 0.95,
    "noise of sigma 16": 0.9,
    "cropped by 2 pixels on each side": 0.9,
    "cropped to a corner of 24 by 24": 0.9,
    "enlarged by a quarter": 0.95,
    "enlarged by an eighth": 0.95,
    "a ninth covered in white": 0.9,
    "reduced by a fifth, with noise": 0.9,
    "reduced by a tenth, with noise": 0.9,
    "reduced by a third": 0.9,
    "darker": 0.95,
}


def drawn_edit(name, image, r):
    size = lambda n: np.rint(local_features.resized(image.astype(np.float32), n, n))
    noisy = lambda x, sigma: x + r.normal(0, sigma, x.shape)
    covered = image.copy()
    covered[10:21, 10:21] = 255
    return np.rint(
        {
            "noise of sigma 8": lambda: noisy(image, 8),
            "noise of sigma 16": lambda: noisy(image, 16),
            "cropped by 2 pixels on each side": lambda: image[2:-2, 2:-2],
            "cropped to a corner of 24 by 24": lambda: image[:24, 8:],
            "enlarged by a quarter": lambda: size(40),
            "enlarged by an eighth": lambda: size(36),
            "a ninth covered in white": lambda: covered,
            "reduced by a fifth, with noise": lambda: noisy(size(26), 4),
            "reduced by a tenth, with noise": lambda: noisy(size(29), 4),
            "reduced by a third": lambda: size(22),
            "darker": lambda: image * 0.8 + 20,
        }[name]()
    ).clip(0, 255)


def test_edited_copies_of_drawn_vectors_meet_and_are_accepted(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id % 14 = 3").orderBy("vec_id").limit(120)
    images = [local_features.decode(x.image) for x in table.select(local_features.thumbnails(F.col("embedding")).alias("image")).collect()]
    r = np.random.default_rng(8)
    described = [local_features.describe(i) for i in images]
    rows, pairs = list(described), {}
    for name in DRAWN_EDITS:
        for n, image in enumerate(images):
            pairs[len(rows), n] = name
            rows.append(local_features.describe(drawn_edit(name, image, r).astype(np.float32)))
    met = {(x.a, x.b) for x in local_features.crossing_pairs(class_rows(spark, rows)).collect()}
    found = dict.fromkeys(DRAWN_EDITS, 0)
    for (a, b), name in pairs.items():
        if (a, b) in met:
            corners, evidence = local_features.consensus(*rows[a], *rows[b])
            found[name] += corners >= max(4, 0.15 * min(len(rows[a][1]), len(rows[b][1]))) and evidence >= 120
    shares = {name: n / len(images) for name, n in found.items()}
    assert all(shares[name] >= least for name, least in DRAWN_EDITS.items()), shares
    # of unrelated pictures hardly any meet
    chance = sum(a != b and max(a, b) < len(images) for a, b in met)
    assert chance <= 0.0005 * len(images) ** 2 / 2 + 3


def test_large_pictures_are_compared_in_bounded_memory():
    import time
    import tracemalloc

    r = np.random.default_rng(0)
    a, b = (local_features.describe(r.uniform(0, 255, (1024, 1024)).astype(np.float32)) for _ in range(2))
    assert len(a[1]) > 10_000
    tracemalloc.start()
    began = time.perf_counter()
    nearest = local_features.nearest_descriptors(a[1], b[1])
    keys, _, _ = local_features.doublets(*a)
    assert len(keys) > 30_000 and tracemalloc.get_traced_memory()[1] < 500_000_000
    tracemalloc.stop()
    assert time.perf_counter() - began < 120
    some = slice(0, 40)
    bits = np.bitwise_count(a[1][some, None, :] ^ b[1][None]).sum(axis=2)
    assert (nearest[0][some] == bits.argmin(axis=1)).all() and (nearest[1][some] == bits.min(axis=1)).all()


def test_near_corners_equal_a_full_search():
    r = np.random.default_rng(1)
    at = np.unique(r.integers(0, 400, (900, 2)), axis=0).astype(float)
    places = np.column_stack([at, np.ones(len(at)), np.zeros(len(at))])
    places = places[(places[:, 0] < 50) | (places[:, 0] > 350)]  # with a gap
    among = np.arange(len(places))
    for part in np.array_split(among, 7):
        got = np.concatenate([np.column_stack(x) for x in local_features.near_corners(places, part, among, 3.0)])
        apart = np.hypot(*(places[part, None, :2] - places[None, :, :2]).transpose(2, 0, 1))
        apart[apart < 3] = np.inf
        want = {(p, q) for p, row in zip(part, np.argsort(apart, axis=1, kind="stable")[:, : local_features.NEIGHBOURS], strict=True) for q in row}
        assert set(map(tuple, got.tolist())) == want


def test_odd_pictures_are_not_read():
    assert local_features.decode(b"P5\n99999999999 99999999999\n255\n" + b"x" * 100) is None
    assert local_features.decode(b"P6\n3000000000 3000000000\n255\n\0") is None


def drawn_vectors(spark, n):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(n)
    return [local_features.decode(x.image) for x in table.select(local_features.thumbnails(F.col("embedding")).alias("image")).collect()]


def test_images_taken_together_are_described_as_one_by_one(spark):
    r = np.random.default_rng(3)
    images = [*drawn_vectors(spark, 40), None, np.zeros((9, 9), np.float32), r.uniform(0, 255, (7, 30)).astype(np.float32), picture(r), r.uniform(0, 255, (150, 160)).astype(np.float32)]
    images += images[:3]
    together = local_features.describe_all(images, most=4096)
    for image, (places, bits) in zip(images, together, strict=True):
        own_places, own_bits = local_features.describe(image)
        assert places.shape == own_places.shape and (places == own_places).all() and (bits == own_bits).all()
    sizes = [len(b) for _, b in together]
    owner, *found = local_features.doublets_of_all(np.concatenate([p for p, _ in together]), np.concatenate([b for _, b in together]), np.repeat(np.arange(len(images)), sizes))
    for row, one in enumerate(together):
        for got, want in zip(found, local_features.doublets(*one), strict=True):
            assert (got[owner == row] == want).all() and (owner == row).sum() == len(want)


def test_bounds_keep_all_that_agree_and_little_else(spark):
    r = np.random.default_rng(4)
    images = drawn_vectors(spark, 60)
    images += [i + r.normal(0, 12, i.shape).astype(np.float32) for i in images[:30]] + [np.ascontiguousarray(np.rot90(i)) for i in images[:15]] + [None, picture(r)]
    rows = [(p.astype(np.float32), b) for p, b in local_features.describe_all(images)]
    sizes = np.array([len(b) for _, b in rows])
    corners = np.concatenate([p for p, _ in rows]), np.concatenate([b for _, b in rows]), np.cumsum(sizes) - sizes, sizes
    a, b = np.triu_indices(len(rows), 1)
    agree = []
    for x, y in zip(a, b, strict=True):
        n, evidence = local_features.consensus(*rows[x], *rows[y])
        agree.append(n >= max(4, 0.15 * min(sizes[x], sizes[y])) and evidence >= 120)
    agree = np.array(agree)
    for most in (1 << 12, 1 << 17):
        kept = local_features.bounds(*corners, a, b, 4, 0.15, 120.0, most)
        assert not (agree & ~kept).any() and agree.sum() >= 40
    assert kept.sum() <= 2 * agree.sum() and len(a) > 5000


def test_chance_pairs_end_before_corners_are_joined_to_them(spark):
    images = local_features.describe_all(drawn_vectors(spark, 200))
    classes = class_rows(spark, images)
    pairs = [(x, y) for x in range(200) for y in range(x) if (x * y) % 7 == 0]
    rules = (4, 0.15, 120.0)
    met = spark.createDataFrame(pairs, "a bigint, b bigint")
    want = {(x.a, x.b) for x in local_features.verified(met, classes, *rules).collect()}
    likely = local_features.may_agree(met, classes, *rules, block_bytes=1 << 15)
    assert likely.count() <= len(want) + len(pairs) // 200
    assert {(x.a, x.b) for x in local_features.verified(likely, classes, *rules).collect()} == want
    assert local_features.may_agree(met.limit(0), classes, *rules).count() == 0


def test_doublets_that_meet_are_those_of_all_that_lie_alike():
    """Directions and turns over the whole circle, compared by cells, against each with each."""
    r = np.random.default_rng(5)
    n = 1500
    layout = np.column_stack([r.integers(0, 256, n), r.integers(0, 256, n) // 4 * 4, r.integers(0, 12, n)]).astype(np.uint8)
    check = (r.integers(0, 2, (n, 2)) << r.integers(0, 4, (n, 2))).astype(np.uint32)
    x, y = np.triu_indices(n, 1)
    off = np.abs(layout[x].astype(int) - layout[y])
    turned = np.minimum(off[:, :2], 256 - off[:, :2])
    want = (turned <= local_features.TURN_APART).all(axis=1) & (off[:, 2] <= local_features.LENGTH_APART) & (np.bitwise_count(check[x] ^ check[y]).sum(axis=1) <= local_features.CHECK_DIFFERING)
    got = local_features.alike(check, layout, x, y)
    assert set(zip(*(i.tolist() for i in got), strict=True)) == set(zip(x[want].tolist(), y[want].tolist(), strict=True)) and want.any()
    pairs, looked_at = local_features.meetings(np.zeros(n, np.uint64), np.arange(n), np.arange(n), check, layout)
    assert set(zip(*pairs.tolist(), strict=True)) == set(zip(y[want].tolist(), x[want].tolist(), strict=True))
    assert looked_at < len(x) / 40  # 4 of 256 cells
