"""Lloyd clustering, fill-in-the-middle and main texts of pages against plain Python."""

import hashlib
import html
import math
import random
import re

import numpy as np
import pytest

from quillspan.llm import fill_middle, html_text, lloyd, queries


def plain_lloyd(rows, k=40, rounds=5, dims=64, seed="2"):
    """(vec_id, cluster, distance) and centroids by whole numbers in plain Python."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in drawn[:k]]

    def assigned():
        return [(i, v, *min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))) for i, v in kept]

    for _ in range(rounds):
        groups = {}
        for _, v, _, j in assigned():
            groups.setdefault(j, []).append(v)
        for j, own in groups.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, j, d) for i, _, d, j in assigned()], centroids


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, Cluster string, inertia int").repartition(3)


def wide(values):
    return [float(np.float32(x)) for x in values]


def test_lloyd_equals_whole_numbers(spark):
    r = random.Random(3)
    rows = [(i, wide(r.gauss(i % 7, 0.4) for _ in range(64)), "x", 1) for i in range(150)]
    rows += [(2**60 + 1, rows[0][1], None, None), (2**60 + 2, rows[0][1], None, None), rows[5], (None, rows[9][1], None, 3)]
    awkward = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [math.inf] + [0.0] * 63), (906, [3e38] * 64)]
    rows += [(i, v, None, None) for i, v in awkward]
    want, centroids = plain_lloyd([r[:2] for r in rows if r[0] != 906])
    found = lloyd.cluster(vectors(spark, rows)).collect()
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(((x.vec_id, x.cluster, x.distance) for x in found), key=key) == sorted(want, key=key)
    inertia = {}
    for _, j, d in want:
        inertia[j] = inertia.get(j, 0) + d
    for x in found:
        assert (x.cluster_inertia, x.inertia, x.centroid) == (inertia[x.cluster], sum(inertia.values()), centroids[x.cluster])
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[x.cluster])).encode()).hexdigest()


def test_lloyd_ties_and_few_rows(spark):
    equal = [(i, [0.5] * 64, None, None) for i in range(60)]
    found = lloyd.cluster(vectors(spark, equal)).collect()
    assert {(x.cluster, x.distance, x.inertia) for x in found} == {(0, 0, 0)} and len(found) == 60
    two = lloyd.cluster(vectors(spark, [(1, [0.0] * 64, None, None), (2, [1.0] * 64, None, None)])).collect()
    assert sorted((x.vec_id, x.distance) for x in two) == [(1, 0), (2, 0)]
    none = lloyd.cluster(vectors(spark, []))
    assert none.columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"] and none.count() == 0


def test_large_components_stay_exact(spark):
    edge = lloyd.largest_integer(64)
    assert edge == 1 << 27
    far = [-(float(edge) / 256 - 1 / 16)] * 64
    rows = [(1, far, None, None), (2, [-x for x in far], None, None), (3, [float(edge) / 256] * 64, None, None)]
    found = lloyd.assign(vectors(spark, rows), np.array([[edge - 1] * 64], np.int64)).collect()
    whole = lambda v: 64 * (math.floor(256 * v) - (edge - 1)) ** 2
    assert {x.vec_id: x.distance for x in found} == {1: whole(far[0]), 2: whole(-far[0])}


def test_sums_are_added_in_tasks(spark):
    rows = [(i, [0.25] * 64, None, None) for i in range(3000)]
    points = lloyd._points(vectors(spark, rows), "vec_id", "embedding", 64, 256)
    assert lloyd._moved(points, np.array([[0] * 64, [64] * 64], np.int64), 256).tolist() == [[0] * 64, [64] * 64]
    assert [r.n for r in lloyd.cluster(vectors(spark, rows)).groupBy("cluster").agg({"*": "count"}).toDF("cluster", "n").collect()] == [3000]


def plain_fim(doc_id, text):
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_middle_of_awkward_texts(spark, awkward, empty):
    extra = [(i, t) for i, t in enumerate(["a<P>b", "<S", "<", "<P", "M>", "<M>", "\U0001f600é <p>", ">", "S>x<"] * 12, 5000)]
    table = awkward.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True)
    table = table.withColumnsRenamed({"fp": "N", "n_words": "Output"})
    made = fill_middle.fill_middle(table)
    assert made.columns == [c for c in table.columns if c not in ("N", "Output")] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.select("*", fill_middle.restored(made.form, made.output).alias("back")).collect()
    assert len(rows) == table.count() and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert fill_middle.fill_middle(empty).count() == 0


def test_fill_middle_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op12_fill_middle(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, a, b, output = plain_fim(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, a, b, sha(output), sha(texts[r.doc_id] or ""))


def test_units_are_cut_by_the_pattern(spark):
    text = "one  two, three\nfour five six "
    frame = spark.createDataFrame([(i, text) for i in range(200)] + [(200, "   ")], "doc_id int, text string")
    rows = fill_middle.fill_middle(frame, unit=r"\w+", fim_percent=100).collect()
    ends = {0, *(m.end() for m in re.finditer(r"\w+", text))}
    assert {r.n for r in rows if r.doc_id < 200} == {6}
    assert all({r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends for r in rows if r.doc_id < 200)
    assert len({(r.prefix_chars, r.middle_chars) for r in rows}) > 15
    assert [(r.n, r.prefix_chars, r.middle_chars) for r in rows if r.doc_id == 200] == [(0, 0, 0)]


def test_no_match_is_kept():
    seen = []

    class Counting:
        """Hands out matches one at a time and notes the most that were alive together."""

        def __init__(self, unit):
            self.unit = re.compile(unit)

        def finditer(self, text):
            import sys

            before = None
            for m in self.unit.finditer(text):
                if before is not None:
                    seen.append(sys.getrefcount(before))
                before = m
                yield m

    unit = Counting(fill_middle.CODE_POINT)
    assert fill_middle.count_units(unit, "x" * 5000) == 5000
    assert fill_middle.ends_at(unit, "x" * 5000, 1234, 4321) == (1234, 4321)
    assert max(seen) <= 3  # this frame's name, the loop's and the call's own


def test_ambiguous_sentinels_are_refused(spark, empty):
    for wrong in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<P>", "<", "x"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fill_middle.fill_middle(empty, sentinels=wrong)


PROSE = "This is the first part of a story that was told to us by the people who live in the town, and it is as long as it should be."
OTHER = "The second part of it is about what they did with all of that, and how they came to be in the place where we found them."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>{PROSE}</title>{head}</head><body>{body}</body></html>"


PAGES = [
    (page(f"<nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav><article><h1>Title</h1><p>{PROSE}</p><p>So.</p></article><footer>{OTHER}</footer>"), ["Title", PROSE, "So."]),
    (page(f"<div class='cookie-notice'>{OTHER}</div><div><h2>Short &amp; plain</h2><p>{PROSE}<p>Yes &eacute; \n  x&#x21;<br>z<p>{OTHER}</div><p>{PROSE} <a href=x>{OTHER}{PROSE}</a>"), ["Short & plain", PROSE, "Yes é x! z", OTHER]),
    (page(f"<main><header><h1>Name</h1></header><p>{PROSE}</p><aside><p>{OTHER}</p></aside><p>End</p><section id=comments><article class='comment'><p>{OTHER}</p></article></section><form><label>{OTHER}</label></form></main><div>{OTHER}</div>"), ["Name", PROSE, "End"]),
    (page(f"<form action=x><input name=v><article><p>{PROSE}</p></article><select><option>{OTHER}</select></form>"), [PROSE]),
    (page("<article><p>alpha | beta | gamma | delta | epsilon | zeta | eta | theta | iota | kappa | lambda | mu</p><p>nu</p></article>"), ["alpha | beta | gamma | delta | epsilon | zeta | eta | theta | iota | kappa | lambda | mu", "nu"]),
    (page(f"<article><p>{PROSE}</p><ul><li><a href=1>One more</a></li><li><a href=2>And one</a></li></ul><ul><li>Point <b>b</b>old</li></ul><p>{OTHER}"), [PROSE, "Point bold", OTHER]),
    (page(f"<div>Menu of <a>links</a></div><div class=ad>{OTHER}</div><div class='post no-ads'><p>{PROSE}</p><p>tail</p></div><div hidden>{OTHER}</div><p style='display: none'>{OTHER}"), ["Menu of links", PROSE, "tail"]),
    (f"<p>{PROSE}<script>var s = '</p><p>{OTHER}</p>';</script><style>p{{}}</style><!-- <p>{OTHER}</p> --><p>1 < 2 <b title='a>b'>x</b></p><![CDATA[ y ]]><p>cut <a href=\"", [PROSE, "1 < 2 x", "cut"]),
    (page(""), []),
    ("", []),
    (None, []),
    ("no markup, but a text that is as long as it has to be for the words of it to be what tells that it is prose &am", ["no markup, but a text that is as long as it has to be for the words of it to be what tells that it is prose &am"]),
    ("<div><a href=1>one</a> <a href=2>two</a></div><div><a href=3>three</a></div>", []),
    (page(f"<article><div><p>{PROSE}</div></div></p></section><p>{OTHER}</p></article></div>"), [PROSE, OTHER]),
    (page(f"<header>{OTHER}</header><div id=main-content><p>{PROSE}</p></div><div class='site-header x'>{OTHER}</div><div role=navigation>{OTHER}</div>"), [PROSE]),
    ("<p>" + "漢字かな交じり文" * 40, ["漢字かな交じり文" * 40]),
]


def test_main_texts(spark):
    rows = [(i, h, "u", 3) for i, (h, _) in enumerate(PAGES)] + [(0, PAGES[0][0], None, None)]
    frame = spark.createDataFrame(rows, "page_id int, html string, TEXT string, `N_Chars` int").repartition(3)
    found = html_text.extract_text(frame)
    assert found.columns == ["page_id", "html", "text", "n_chars"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == "\n\n".join(PAGES[r.page_id][1]), r.page_id
        assert r.n_chars == len(r.text)
    assert html_text.extract_text(frame.limit(0)).count() == 0


def plain_passes(found):
    """The two passes over one page's blocks, one block at a time."""
    stops = lambda t: sum(w.strip(html_text._EDGES) in html_text.STOP_WORDS for w in t.lower().split()) / len(t.split())
    article = any(main == 2 and not aside for _, _, aside, main, _ in found)
    labels = []
    for text, linked, aside, main, listed in found:
        links = linked / len(text.replace(" ", ""))
        if aside or (article and main != 2) or (listed and links >= 0.9) or (main != 2 and links > 1 / 2):
            labels.append("bad")
        else:
            labels.append("good" if len(text) >= 70 and stops(text) >= 0.15 and links <= 1 / 3 else None)
    if "good" in labels:
        labels = ["bad" if x is None and b[3] != 2 and len(b[0]) >= 70 and stops(b[0]) < 0.05 else x for x, b in zip(labels, found, strict=True)]
    out = list(labels)
    for inside in (True, False):
        known = list(out)
        for i, (x, b) in enumerate(zip(known, found, strict=True)):
            if x is None and (b[3] == 2) == inside:
                near = [(abs(i - j), j, y) for j, (y, c) in enumerate(zip(known, found, strict=True)) if y and not c[2] and (not inside or c[3] == 2)]
                before, after = min(((d, y) for d, j, y in near if j < i), default=None), min(((d, y) for d, j, y in near if j > i), default=None)
                if before is None and after is None:
                    out[i] = "good"
                elif before and after and before[0] == after[0]:
                    out[i] = "good" if b[3] and "good" in (before[1], after[1]) else after[1]
                else:
                    out[i] = min(x for x in (before, after) if x)[1]
    return "\n\n".join(b[0] for b, x in zip(found, out, strict=True) if x == "good")


def test_passes_over_batches_equal_passes_over_pages():
    r = random.Random(5)
    pieces = [PROSE, OTHER, "x", "So it is.", f"<a>{PROSE}</a>", "<a>y</a>", "zz " * 40, f"<b>{OTHER}</b> <a>{PROSE}</a>", "&lt;p&gt;"]
    around = ["<p>{}</p>", "<li>{}</li>", "<div class=ad>{}</div>", "<div class=content>{}</div>", "<h2>{}", "<article>{}</article>", "<nav>{}</nav>", "<td>{}", "{}<hr>"]
    pages = ["".join(r.choice(around).format("".join(r.choices(pieces, k=r.randrange(1, 3)))) for _ in range(r.randrange(12))) for _ in range(400)]
    got = html_text.texts(pages)
    assert got == [plain_passes(html_text.blocks(p)) for p in pages]
    assert sum(map(bool, got)) > 200


def test_page_query(spark, sf):
    rows = queries.op13_html_text(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html, re.S)[1]
        own = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in own if b)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_hostile_pages_take_time_in_proportion():
    import time

    for part in ("<div>", "<p a='", '<p a="', "<!--", "<script>", "<a", "<li>x", "</section>", "&", "<", "<div><section>x</div>", "<div a=\"'>"):
        began = time.perf_counter()
        html_text.texts([part * 60_000])
        assert time.perf_counter() - began < 20, part
    nested = "<div>" * 60_000 + PROSE + "</p></span></nav>" * 60_000
    assert html_text.texts([nested]) == [PROSE]
