"""Parsing, tables, diagrams, references and chunks, by cases worked out by hand."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.ingest import chunker, manual, plain
from quillspan.ingest.chunker import Budget, Chunker, white_space_tokens
from quillspan.ingest.diagrams import read_diagram
from quillspan.ingest.manual import Lines, read_manual
from quillspan.ingest.tables import read_table

OBSERVED = "Intel Logo\n\n# Programmer's Manual\n\n# Notices\nAll rights reserved.\n\n# CHAPTER 26 VM ENTRIES\n## 26.1 BASIC\nSome prose\nof two lines.\n```c\nx = 1;\n```\n<page_number>\nVol. 3C 26-1\n</page_number>\nVM ENTRIES\n"


def blocks_of(source):
    return read_manual("doc:x", source)["blocks"]


def test_observed_shapes():
    found = read_manual("doc:x", OBSERVED)
    assert [(s["heading"], s["level"]) for s in found["sections"]] == [("Programmer's Manual", 1), ("CHAPTER 26 VM ENTRIES", 1), ("26.1 BASIC", 2)]
    assert found["sections"][1]["printed_page"] == "26-1", "the only label, though it comes later"
    assert found["sections"][2]["parent_section_id"] == found["sections"][1]["section_id"]
    assert [(b["kind"], b["content_class"]) for b in found["blocks"]] == [
        ("prose", "page_furniture"),
        ("prose", "substantive"),
        ("prose", "legal"),
        ("prose", "legal"),
        ("prose", "substantive"),
        ("prose", "substantive"),
        ("prose", "substantive"),
        ("code", "substantive"),
        ("prose", "page_furniture"),
        ("prose", "page_furniture"),
    ]
    assert not found["warnings"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["", "# A\r", "## 2.1 B", "prose é", "漢字 | x", "|---|", "| a | b |", "- item", "3) n", "> q", "Table 1-1. T", "```mermaid", "~~~", "```", "<page_number>1-2", "</page_number>", "<table>", "<tr><th>h</table>", "A-->B", "7-1 vol. 2", "\t"]), max_size=14).map("\n".join))
def test_blocks_are_their_bytes_and_cover_all(source):
    raw, covered = source.encode(), 0
    found = read_manual("d", source)
    for b in found["blocks"]:
        span = b["span"]
        assert raw[span["byte_start"] : span["byte_end"]].decode() == b["raw_source"]
        assert not raw[covered : span["byte_start"]].strip(), "only blank lines lie between blocks"
        covered = span["byte_end"]
    assert not raw[covered:].strip()
    known = {s["section_id"] for s in found["sections"]}
    for b in found["blocks"]:
        assert b["section_id"] in known or b["section_id"].startswith("front:")
    for s in found["sections"]:
        later = [t for t in found["sections"] if t["span"]["byte_start"] > s["span"]["byte_start"] and t["level"] <= s["level"]]
        assert s["span"]["byte_end"] == (later[0]["span"]["byte_start"] if later else len(raw))
        assert s["parent_section_id"] is None or s["parent_section_id"] in known
    assert len({b["block_id"] for b in found["blocks"]}) == len(found["blocks"])


def test_repeated_headings_have_their_own_ids():
    found = read_manual("d", "# CHAPTER 1 A\n## Same\nx\n## same\ny\n")["sections"]
    assert [s["ordinal"] for s in found] == [1, 1, 2] and len({s["section_id"] for s in found}) == 3


def test_bytes_and_lines_of_carriage_returns():
    found = blocks_of("\r\n# É\r\n\r\n\r\nline é\r\n")
    assert found[-1]["span"]["line_start"] == 5 and found[-1]["raw_source"] == "line é\r\n"
    assert Lines.of("a\r\nb").texts == ["a", "b"] and Lines.of("").texts == []


@pytest.mark.parametrize(("source", "code"), [("```c\nx", "unclosed_fence"), ("<page_number>1-1", "unclosed_page_number"), ("<table><tr><th>a", "unclosed_html_table"), ("<table></table>", "table_extraction"), ("| a |\n|---|\n| 1 | 2 |", "table_width_mismatch")])
def test_warnings(source, code):
    assert [w["code"] for w in read_manual("d", source)["warnings"]] == [code]


@pytest.mark.parametrize(("heading", "level"), [("CHAPTER 2", 1), ("Appendix B X", 1), ("2.1.3 Deep", 3), ("1.2.3.4.5.6.7.8 x", 6), ("2. Two", 4), ("Plain", 4)])
def test_levels(heading, level):
    assert read_manual("d", f"#### {heading}")["sections"][0]["level"] == level


def test_heading_classes():
    assert plain.heading_class("Legal Information", True) == "legal"
    assert [plain.heading_class(h, False) for h in ("Contents", "Tables", "My contents", "Revision History")] == ["contents", "contents", "contents", "revision_history"]
    assert plain.heading_class("Volume 3", True) == "front_matter" and plain.heading_class("Volume 3", False) is None


def test_plain_text():
    assert plain.plain("# A *bold* `x_y` [link](http://a.b) <br> &amp; \\*") == "A bold x_y link & *"
    assert plain.plain("- [x] done\n- [ ] open") == "checked done unchecked open"
    assert plain.plain("```c\nint a_b;\n```") == "int a_b;"
    assert plain.plain("| a | b |\n|---|---|\n| 1 | 2 |") == "a b 1 2"
    assert plain.plain("snake_case_name a*b*c") == "snake_case_name a b c"
    assert plain.printed_page("Vol. 3C 26-1") == "26-1" and plain.printed_page("415") is None


def test_pipe_table():
    found = read_table("| a | b |\n|:---|---:|\n| 1 | x\\|y |\n| 2 | c\\d |\n| 3 |\n")
    assert found.headers == ["a", "b"] and found.rows[:1] == [["1", "x|y"]] and found.rows[2] == ["3", ""] and found.mismatched == [3]


def test_html_table():
    found = read_table("<table><thead><tr><th colspan=2>top</th></tr><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td rowspan=2>x<br>y</td><td>1</td></tr><tr><td>2</td></tr></tbody></table>")
    assert found.headers == ["a", "b"] and found.rows == [["x y", "1"], ["x y", "2"]] and not found.mismatched
    assert read_table("<table><tr><th>a</th></tr><tr><td>1</td></tr></table>").headers == ["a"]
    assert read_table("<table><tr><td>1</td></tr></table>") is None
    wide = read_table("<table><thead><tr><th colspan='2'>t</th><th>u</th></tr></thead><tr><td colspan=2>v</td><td rowspan=2>w</td></tr><tr><td>p</td><td>q</td></tr></table>")
    assert wide.headers == ["t", "", "u"] and wide.rows == [["v", "", "w"], ["p", "q", "w"]]


def test_diagrams():
    found = read_diagram('```mermaid\ngraph TD\nsubgraph one ["The Group"]\nA["Start"] -- "goes to" --> B\nB -.-> C{Choice}\nend\n```', "Figure 1-1. X")
    assert found.direction == "TD" and found.subgraphs == ["The Group"]
    assert found.nodes == {"A": "Start", "B": "B", "C": "Choice"}
    assert [(a, b, label) for a, b, label, _ in found.edges] == [("A", "B", "goes to"), ("B", "C", None)]
    assert list(found.labels)[-1] == "Figure 1-1. X" and not found.warnings
    arrows = read_diagram("A <--> B\nA ==> B\nA <--- B\nA ---> B\nA --x B")
    assert [(a, b, s) for a, b, _, s in arrows.edges] == [("A", "B", "<-->"), ("A", "B", "==>"), ("B", "A", "<---"), ("A", "B", "--->"), ("A", "B", "--x")]
    assert [e[2] for e in read_diagram("A -->|yes| B\nA -.->| no | C").edges] == ["yes", "no"]
    assert list(read_diagram("N1[Only]\nstyle N1 fill:#fff").nodes.items()) == [("N1", "Only")]
    assert read_diagram("stateDiagram-v2\n[*] --> Idle").edges == [("[*]", "Idle", None, "-->")]
    bad = read_diagram("A[Open --> B\n?? [left over]")
    assert {c for c, _ in bad.warnings} == {"malformed_mermaid_node", "unknown_mermaid_syntax"} and "left over" in bad.labels


def test_captions_and_references_of_a_document():
    found = read_manual("d", "# 1.1 A\nSee Figure 1-1 and Section 1.1.\n```mermaid\ngraph TD\nA-->B\n```\nFigure 1-1. The figure\n")
    assert found["diagrams"][0]["caption"] == "Figure 1-1. The figure"
    assert [(r["kind"], r["normalized_key"]) for r in found["refs"]] == [("figure", "figure:1-1"), ("section", "section:1.1")]
    assert {(d["normalized_key"], d["target_id"]) for d in found["declarations"]} == {("figure:1-1", found["diagrams"][0]["diagram_id"]), ("section:1.1", found["sections"][0]["section_id"])}


def chunked(source, **budget):
    read = read_manual("d", source)
    return Chunker({"document_id": "d", "vendor": "v", "entry_path": "x.md"} | read, Budget(**budget)).run()


def test_prose_overlaps_by_whole_blocks():
    found = chunked("aa bb\n\ncc dd\n\nee ff\n\ngg hh\n", target=5, overlap=2)
    assert all(c["token_count"] <= 5 for c in found) and all(c["token_count"] == white_space_tokens(c["text"]) for c in found)
    shared = [len(set(a["source_block_ids"]) & set(b["source_block_ids"])) for a, b in zip(found, found[1:], strict=False)]
    assert max(shared) == 1
    assert found[0]["text"] == "x\n\naa bb\n\ncc dd"


def test_small_blocks_stay_whole():
    found = chunked("```c\nx = 1;\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```mermaid\ngraph TD\nA-->B\n```\n", target=64)
    assert [c["kind"] for c in found] == ["code", "table", "diagram"] and all(len(c["source_block_ids"]) == 1 for c in found)
    assert found[1]["text"] == "x\n\na | b\n1 | 2" and found[2]["text"] == "x\n\nA | B"


def test_tables_repeat_their_headers():
    rows = "".join(f"| r{i} | v |\n" for i in range(5))
    found = chunked(f"| a | b |\n|---|---|\n{rows}", target=7, table_rows=2)
    assert len(found) == 5 and all("a | b" in c["text"] and c["token_count"] <= 7 for c in found)
    many = chunked(f"| a | b |\n|---|---|\n{rows}", target=99, table_rows=2)
    assert [c["text"].count("r") for c in many] == [2, 2, 1]
    assert len(chunked("| a | b |\n|---|---|\n", target=1)) == 1


def test_code_is_cut_at_blank_lines():
    found = chunked("```c\na b c d\n\n e f g h\n```\n", target=6)
    assert [c["text"].split("\n\n")[1] for c in found] == ["a b c d", "e f g h"]


def test_chunks_are_the_same_twice():
    a, b, c = (chunked(t)[0]["chunk_id"] for t in ("aa", "aa", "ab"))
    assert a == b != c
    assert [x["kind"] for x in chunked("- a\n- b\n")] == ["list"]
    with pytest.raises(ValueError):
        Budget(target=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=12), st.integers(3, 20), st.integers(0, 6))
def test_no_word_is_lost(sizes, target, overlap):
    words = iter(range(10**6))
    blocks = [" ".join(f"w{next(words)}" for _ in range(n)) for n in sizes]
    found = chunked("\n\n".join(blocks), target=target, overlap=overlap)
    shown = {w for c in found for w in c["text"].split()} - {"x"}
    assert shown == {w for b in blocks for w in b.split()}
    assert all(c["token_count"] <= max(target, 2) for c in found)


def test_chains_and_brackets_of_diagrams():
    found = read_diagram('A(("x (y)")) --> B{{z}} --x C([w])\nE -- "a --> b" --> F\nA -. q .-> F\nA --xy--> F')
    assert [e[:3] for e in found.edges] == [("A", "B", None), ("B", "C", None), ("E", "F", "a --> b"), ("A", "F", "q"), ("A", "F", "xy")]
    assert found.nodes["A"] == "x (y)" and found.nodes["B"] == "z"
    chain = read_diagram("a.b-c --> d_1 ==> [*]")
    assert [(a, b, s) for a, b, _, s in chain.edges] == [("a.b-c", "d_1", "-->"), ("d_1", "[*]", "==>")] and not chain.warnings
    open_label = read_diagram("A[Open --> B")
    assert open_label.edges == [("A", "B", None, "-->")] and open_label.nodes["A"] == "Open"
    assert [c for c, _ in open_label.warnings] == ["malformed_mermaid_node"]
    lost = read_diagram("--> H[lost one]\nword and [another one] here")
    assert not lost.edges and not lost.nodes and {"lost one", "another one"} <= set(lost.labels)


def test_long_and_odd_inputs_stay_cheap():
    import time
    import tracemalloc

    from quillspan.ingest.plain import Furniture, plain
    from quillspan.ingest.tables import read_table

    began = time.perf_counter()
    tracemalloc.start()
    furniture = Furniture()
    furniture.learn("1.1 " + "LONG HEADING " * 8000)
    assert furniture("HEADING") and furniture("LONG HEADING") and not furniture("OTHER")
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
    for marks in ("`" * 40_000, "`a " * 20_000, " ".join("`" * i for i in range(300))):
        plain(f"x {marks} y")
    assert plain("a `b ``c`` d` e ``f`g`` h") == "a b ``c`` d e f`g h"
    cell = "<table><tr><th>a</th></tr><tr><td colspan='{0}' rowspan='{0}'>x</td></tr><tr><td>y</td></tr></table>"
    assert all(["x"] in read_table(cell.format(n)).rows for n in ("²", "200000", "20000000", "9" * 5000, "0", "-1", "٣"))
    assert time.perf_counter() - began < 10


def test_a_long_block_is_counted_few_times_a_part():
    counted = []

    def count(text):
        counted.append(len(text))
        return white_space_tokens(text)

    words = [f"w{i % 97}" for i in range(20_000)]
    for budget in (Budget(), Budget(target=7), Budget(target=1)):
        counted.clear()
        document = {"document_id": "d", "vendor": "v", "entry_path": "m.md", "source": " ".join(words)} | read_manual("d", " ".join(words))
        units = [t for _, t, _ in Chunker(document, budget, count).units(document["blocks"][0])]
        # the prefix is a word of each part; a word over the target stays whole
        size = max(1, budget.target - 1)
        assert units == [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
        assert len(counted) <= 20 * len(units) and sum(counted) <= 100 * len(" ".join(words))


def test_documents_are_chunked_as_they_are_parsed(spark):
    texts = ["# A\n\nb c\n\n- d\n- e", None, "", "x " * 900, "| a |\n|---|\n| b |"]
    made = spark.createDataFrame([(str(i), "v", "a", "", f"{i}.md", "", 0, t) for i, t in enumerate(texts)], ", ".join(f"{c} {'bigint' if c == 'byte_len' else 'string'}" for c in manual.DOCUMENT))
    key = ["document_id", "chunk_ordinal"]
    two = [r.asDict(True) for r in chunker.chunks(manual.parsed(made)).orderBy(*key).collect()]
    assert [r.asDict(True) for r in chunker.chunked(made).orderBy(*key).collect()] == two and {r["document_id"] for r in two} == {"0", "3", "4"}
    some = manual.parsed(made, ["document_id", "blocks"])
    assert some.columns == ["document_id", "blocks"] and some.count() == 5


def test_batches_of_documents_are_bounded():
    schema = pa.schema([("n", pa.int64())])
    rows = lambda sizes: ((s, [{"n": i}]) for i, s in enumerate(sizes))
    sizes = [b.num_rows for b in manual.in_batches(rows([0] * 10_000 + [5, 5, 99, 1]), schema, together=10)]
    assert sum(sizes) == 10_004 and max(sizes) <= manual.MOST_ROWS and len(sizes) == 5
    wide = pa.RecordBatch.from_pydict({"source": ["y" * manual.TOGETHER] * 3 + [""]})
    assert [len(r["source"]) for r in manual.each_row([wide])] == [manual.TOGETHER] * 3 + [0]


def test_inline_marks_are_tried_only_where_they_may_begin():
    parts = ["a_b", "*x*", "`c *d*`", r"\*", "[l *m*](u)", "![i](u)", "[^n]", "<http://a.b>", "<br>", "<!-- _ -->", "~~s~~", "$y$", "wörd", "_z_", "!", "[", "``", " ", "\n"]
    rng = random.Random(5)

    def shown(m):
        return f"<{plain._INLINE.sub(shown, m['link']) if m['link'] is not None else m[0].upper()}>"

    for _ in range(2_000):
        text = "".join(rng.choices(parts, k=rng.randrange(9)))
        assert plain._inline(text, shown) == plain._INLINE.sub(shown, text)


def test_a_long_text_is_no_furniture_without_looking_at_its_letters():
    long = "WORD " * 4_000_000
    furniture = plain.Furniture()
    furniture.learn("WORD")
    began = time.process_time()
    assert not furniture(long) and furniture("WORD")
    assert time.process_time() - began < 0.5


def test_objects_of_a_batch_are_made_some_at_a_time():
    document = dict.fromkeys(manual.DOCUMENT, "") | {"document_id": "d", "byte_len": 0, "ingest_version": 1} | read_manual("d", "\n\n".join(f"- line {i}" for i in range(300)))
    batch = pa.RecordBatch.from_pylist([document] * 100, schema=manual.PARSED)

    def peak(rows):
        tracemalloc.start()
        n = sum(len(chunker.Chunker(r).run()) for r in rows())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most

    (n, most), (same, whole) = peak(lambda: manual.each_row([batch])), peak(batch.to_pylist)
    assert n == same > 100 and most < whole / 4
