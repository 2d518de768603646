"""A Markdown manual, read in one pass over its lines: blocks, sections, tables, diagrams and references, with byte spans.

``read_manual`` works on one document and keeps only that in memory;
``parsed`` runs it over a table, a row a document, without a shuffle. The
entities' own tables are projections of that (``quillspan.ingest.build``).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import plain as pl
from .diagrams import read_diagram
from .tables import read_table, separates

#: The parser's version: parsed forms of another one are not reused.
INGEST_VERSION = 1
#: Kinds of blocks that pack together, and beginnings of captions.
PROSE_KINDS = ("prose", "list", "quote", "caption")
CAPTIONS = ("Figure ", "Table ", "Рисунок ", "Таблица ")
#: Fixed value: a cross-reference. A label of one letter may be the first of a word.
REFERENCE = r"(?i)\b(Section|Chapter|Appendix|Table|Figure)\s+([A-Z]|\d+(?:\.\d+)*(?:-\d+)?)"
#: What a heading and a caption declare.
DECLARING_HEADING = r"(?i)^\s*(?:(CHAPTER|APPENDIX)\s+)?([A-Z]|\d+(?:\.\d+)*)\b"
DECLARING_CAPTION = r"(?i)^\s*(Table|Figure)\s+(\d+(?:\.\d+)*(?:-\d+)?)\b"

_HEADING = re.compile(r"\s*(#{1,6})[ \t\n\x0c\r](.*)", re.S)
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_LIST = re.compile(r"\s*(?:[-*+] |[0-9]+[.)] )")
_REFERENCE, _SECTION_KEY, _CAPTION_KEY = map(re.compile, (REFERENCE, DECLARING_HEADING, DECLARING_CAPTION))


def name_of(kind: str, *parts: str) -> str:
    """An id: the kind, and a hash of what it stands for."""
    return f"{kind}:{hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).hexdigest()}"


@dataclass
class Lines:
    """Lines of a text with the bytes they span; a text has no line after its last line feed."""

    texts: list[str]
    starts: list[int]
    raws: list[str]

    @staticmethod
    def of(source: str) -> Lines:
        raws = [x for x in source.split("\n")]
        raws = [f"{x}\n" for x in raws[:-1]] + ([raws[-1]] if raws[-1] else [])
        starts = [0]
        for raw in raws:
            starts.append(starts[-1] + len(raw.encode("utf-8", "surrogatepass")))
        return Lines([x.removesuffix("\n").removesuffix("\r") if x.endswith("\n") else x for x in raws], starts, raws)

    def raw(self, first: int, end: int) -> str:
        return "".join(self.raws[first:end])

    def span(self, first: int, end: int) -> dict:
        return {"byte_start": self.starts[first], "byte_end": self.starts[end], "line_start": first + 1, "line_end": end, "printed_page": None}

    def number_at(self, offset: int) -> int:
        return max(1, min(bisect_right(self.starts, offset), len(self.texts)))


def heading_of(line: str) -> tuple[int, str] | None:
    """(marks, heading) of a heading line."""
    found = _HEADING.match(line)
    text = found[2].strip().rstrip("#").strip() if found else ""
    return (len(found[1]), text) if text else None


def level_of(marks: int, heading: str) -> int:
    """Chapters and appendices are 1; a dotted number is its depth, 6 at most; anything else has its marks."""
    if heading.strip().upper().startswith(("CHAPTER ", "APPENDIX ")):
        return 1
    number = (heading.split() or [""])[0].rstrip(".")
    if re.fullmatch(r"[0-9.]*\.[0-9.]*", number):
        return min(6, number.count(".") + 1)
    return marks


class Scanner:
    """Where the block that begins at a line ends, and what it is."""

    def __init__(self, lines: Lines):
        self.lines, self.texts = lines, lines.texts

    def kind_at(self, i: int) -> str:
        """What a line that is not blank begins; plain prose is what nothing else claims."""
        text = self.texts[i]
        low, bare = text.lower(), text.lstrip()
        claims: tuple[tuple[str, Callable[[], bool]], ...] = (
            ("heading", lambda: heading_of(text) is not None),
            ("fence", lambda: bool(_FENCE.match(text))),
            ("page_element", lambda: "<page_number>" in low),
            ("page_mark", lambda: pl.marks_page(text)),
            ("html_table", lambda: bare.lower().startswith("<table")),
            ("pipe_table", lambda: "|" in text and i + 1 < len(self.texts) and separates(self.texts[i + 1])),
            ("list", lambda: bool(_LIST.match(text))),
            ("quote", lambda: bare.startswith(">")),
            ("caption", lambda: bare.startswith(CAPTIONS)),
        )
        return next((kind for kind, holds in claims if holds()), "prose")

    def closed(self, first: int, closes: Callable[[str], bool]) -> tuple[int, bool]:
        """(end, whether it closes) of a block up to the first line that closes it, or to the end of the document."""
        for i in range(first, len(self.texts)):
            if closes(self.texts[i]):
                return i + 1, True
        return len(self.texts), False

    def end_of(self, i: int, kind: str) -> tuple[int, str | None]:
        """(end, warning) of the block of this kind at a line."""
        if kind in ("heading", "page_mark"):
            return i + 1, None
        if kind == "fence":
            mark = _FENCE.match(self.texts[i])[1]
            end, closed = self.closed(i + 1, lambda x: bool(re.fullmatch(rf"{re.escape(mark[0])}{{{len(mark)},}}", x.strip())))
            return end, None if closed else "unclosed_fence"
        if kind in ("page_element", "html_table"):
            tag = "</page_number>" if kind == "page_element" else "</table>"
            end, closed = self.closed(i, lambda x: tag in x.lower())
            return end, None if closed else ("unclosed_page_number" if kind == "page_element" else "unclosed_html_table")
        end = i + 2 if kind == "pipe_table" else i + 1
        while end < len(self.texts) and self.texts[end].strip() and ("|" in self.texts[end] if kind == "pipe_table" else self.kind_at(end) == "prose"):
            end += 1
        return end, None

    def blocks(self) -> Iterator[tuple[str, int, int, str | None]]:
        """(kind, first line, end, warning) in order."""
        i = 0
        while i < len(self.texts):
            if not self.texts[i].strip():
                i += 1
                continue
            kind = self.kind_at(i)
            end, warning = self.end_of(i, kind)
            yield kind, i, end, warning
            i = end


MESSAGES = {
    "unclosed_fence": "a fence is open to the end",
    "unclosed_page_number": "a page number is open to the end",
    "unclosed_html_table": "a table is open to the end",
    "table_extraction": "the table has no headers",
}


def read_manual(document_id: str, source: str) -> dict:
    """Sections, blocks, tables, diagrams, references, declarations and warnings of a document, as lists of rows."""
    lines = Lines.of(source)
    front = name_of("front", document_id)
    furniture, inherited = pl.Furniture(), pl.FRONT_MATTER
    sections: list[dict] = []
    open_: list[dict] = []  # the sections that the current line is in, outermost first
    repeats: dict[str, int] = {}
    blocks: list[dict] = []
    warnings: list[dict] = []
    pages: list[tuple[int, str]] = []

    def warn(code: str, span: dict, block_id: str | None = None, message: str | None = None) -> None:
        warnings.append({"block_id": block_id, "code": code, "message": message or MESSAGES[code]} | {k: span[k] for k in ("byte_start", "byte_end", "line_start", "line_end")})

    def section(marks: int, heading: str, span: dict) -> None:
        level = level_of(marks, heading)
        while open_ and open_[-1]["level"] >= level:
            open_.pop()["span"]["byte_end"] = span["byte_start"]
        path = [*[s["heading"] for s in open_], heading]
        lowered = chr(0).join(p.lower() for p in path)
        repeats[lowered] = repeats.get(lowered, 0) + 1
        made = {"section_id": name_of("sec", document_id, lowered, str(repeats[lowered])), "parent_section_id": open_[-1]["section_id"] if open_ else None, "heading": heading, "heading_path": path, "level": level, "ordinal": repeats[lowered], "printed_page": None, "span": dict(span, byte_end=lines.starts[-1])}
        sections.append(made)
        open_.append(made)
        furniture.learn(heading)

    for kind, first, end, warning in Scanner(lines).blocks():
        span, raw = lines.span(first, end), lines.raw(first, end)
        if warning:
            warn(warning, span)
        text = pl.plain(raw)
        shown, content = kind, None
        if kind == "heading":
            marks, heading = heading_of(lines.texts[first])
            content = pl.heading_class(heading, not sections)
            inherited = content or pl.SUBSTANTIVE
            if content is None:
                section(marks, heading, span)
            shown, content = "prose", inherited
        elif kind == "fence":
            # a language is read only after a fence that begins its line
            info = lines.texts[first].lstrip("`" if "`" in lines.texts[first] else "~").strip() if not lines.texts[first][:1].isspace() else ""
            shown, content = "diagram" if info.split()[:1] and info.split()[0].lower() == "mermaid" else "code", inherited
        elif kind in ("page_element", "page_mark"):
            if label := pl.printed_page(raw):
                pages.append((span["byte_start"], label))
            shown, content = "prose", pl.FURNITURE
        elif kind in ("html_table", "pipe_table"):
            shown = "table"
        blocks.append(
            {
                "block_id": name_of("blk", document_id, str(span["byte_start"]), str(span["byte_end"]), shown),
                "section_id": open_[-1]["section_id"] if open_ else front,
                "kind": shown,
                "content_class": content or pl.body_class(text, inherited, furniture),
                "heading_path": [s["heading"] for s in open_],
                "ordinal": len(blocks),
                "caption": None,
                "raw_source": raw,
                "normalized_text": text,
                "content_hash": hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest(),
                "span": span,
            }
        )
    marks_at = [p for p, _ in pages]
    label_at = lambda offset: pages[max(0, bisect_right(marks_at, offset) - 1)][1] if pages else None
    for s in sections:
        s["printed_page"] = s["span"]["printed_page"] = label_at(s["span"]["byte_start"])
        s["span"]["line_end"] = lines.number_at(max(0, s["span"]["byte_end"] - 1))
    for b in blocks:
        b["span"]["printed_page"] = label_at(b["span"]["byte_start"])
    captions = _captions(blocks)
    tables, diagrams = [], []
    for b in blocks:
        if b["kind"] == "table":
            found = read_table(b["raw_source"])
            if not found:
                warn("table_extraction", b["span"], b["block_id"])
                continue
            b["caption"] = captions(b, "Table ")
            tables.append({"table_id": name_of("tbl", document_id, b["block_id"]), "block_id": b["block_id"], "caption": b["caption"], "headers": found.headers, "rows": found.rows})
            for row in found.mismatched:
                warn("table_width_mismatch", b["span"], b["block_id"], f"row {row} differs in width from its {len(found.headers)} headers")
        elif b["kind"] == "diagram":
            b["caption"] = captions(b, "Figure ")
            got = read_diagram(b["raw_source"], b["caption"])
            listed = {"nodes": [{"id": k, "label": v} for k, v in got.nodes.items()], "edges": [dict(zip(("from", "to", "label", "style"), e, strict=True)) for e in got.edges], "warnings": [{"code": c, "message": m} for c, m in got.warnings]}
            diagrams.append({"diagram_id": name_of("fig", document_id, b["block_id"]), "block_id": b["block_id"], "caption": b["caption"], "direction": got.direction, "raw_source": b["raw_source"], "subgraphs": got.subgraphs, "search_labels": list(got.labels)} | listed)
            for code, message in got.warnings:
                warn(code, b["span"], b["block_id"], message)
    return {
        "sections": sections,
        "blocks": blocks,
        "tables": tables,
        "diagrams": diagrams,
        "refs": [r for b in blocks for r in references(document_id, b)],
        "declarations": [*declared_sections(sections), *declared_captions(tables, "table", "table_id"), *declared_captions(diagrams, "figure", "diagram_id")],
        "warnings": warnings,
    }


def _captions(blocks: list[dict]) -> Callable[[dict, str], str | None]:
    """The nearest caption of a block's section that begins with a word; of two as near the earlier."""
    places: dict[tuple[str, str], list[int]] = {}
    for b in blocks:
        if b["kind"] == "caption":
            for word in ("Table ", "Figure "):
                if b["normalized_text"].startswith(word):
                    places.setdefault((b["section_id"], word), []).append(b["ordinal"])

    def nearest(block: dict, word: str) -> str | None:
        known = places.get((block["section_id"], word), [])
        at = bisect_right(known, block["ordinal"])
        best = min(known[max(0, at - 1) : at + 1], key=lambda o: (abs(o - block["ordinal"]), o), default=None)
        return None if best is None else blocks[best]["normalized_text"]

    return nearest


def references(document_id: str, block: dict) -> list[dict]:
    """Cross-references of a block that is neither a caption nor its section's heading; chapters and appendices are of the kind section."""
    if block["kind"] == "caption" or block["heading_path"][-1:] == [block["normalized_text"]]:
        return []
    out = []
    for found in _REFERENCE.finditer(block["raw_source"]):
        word, key = found[1].lower(), f"{found[1].lower()}:{found[2].lower()}"
        at = len(block["raw_source"][: found.start()].encode("utf-8", "surrogatepass"))
        out.append({"reference_id": name_of("ref", document_id, block["block_id"], str(at), key), "source_block_id": block["block_id"], "kind": word if word in ("table", "figure") else "section", "label": found[0], "normalized_key": key})
    return out


def declared_sections(sections: list[dict]) -> list[dict]:
    found = [(s, _SECTION_KEY.match(s["heading"])) for s in sections]
    return [{"normalized_key": f"{(m[1] or 'section').lower()}:{m[2].lower()}", "target_id": s["section_id"]} for s, m in found if m]


def declared_captions(entities: list[dict], kind: str, key: str) -> list[dict]:
    found = [(e, _CAPTION_KEY.match(e["caption"] or "")) for e in entities]
    return [{"normalized_key": f"{kind}:{m[2].lower()}", "target_id": e[key]} for e, m in found if m and m[1].lower() == kind]


_SPAN = pa.struct([("byte_start", pa.int64()), ("byte_end", pa.int64()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("printed_page", pa.string())])
_TEXTS = pa.list_(pa.string())
_fields = lambda names, kind=None: [(n, kind or pa.string()) for n in names.split()]
PARTS = {
    "sections": pa.struct([*_fields("section_id parent_section_id heading"), ("heading_path", _TEXTS), ("level", pa.int32()), ("ordinal", pa.int32()), ("printed_page", pa.string()), ("span", _SPAN)]),
    "blocks": pa.struct([*_fields("block_id section_id kind content_class"), ("heading_path", _TEXTS), ("ordinal", pa.int32()), *_fields("caption raw_source normalized_text content_hash"), ("span", _SPAN)]),
    "tables": pa.struct([*_fields("table_id block_id caption"), ("headers", _TEXTS), ("rows", pa.list_(_TEXTS))]),
    "diagrams": pa.struct([*_fields("diagram_id block_id caption direction raw_source"), ("nodes", pa.list_(pa.struct(_fields("id label")))), ("edges", pa.list_(pa.struct(_fields("from to label style")))), ("subgraphs", _TEXTS), ("search_labels", _TEXTS), ("warnings", pa.list_(pa.struct(_fields("code message"))))]),
    "refs": pa.struct(_fields("reference_id source_block_id kind label normalized_key")),
    "declarations": pa.struct(_fields("normalized_key target_id")),
    "warnings": pa.struct([*_fields("block_id code message"), *_fields("byte_start byte_end", pa.int64()), *_fields("line_start line_end", pa.int32())]),
}
#: Columns of a document that go through the parser unchanged.
DOCUMENT = ("document_id", "vendor", "archive_id", "archive_sha256", "entry_path", "content_sha256", "byte_len", "source")
PARSED = pa.schema([*[(c, pa.int64() if c == "byte_len" else pa.string()) for c in DOCUMENT], ("ingest_version", pa.int32()), *[(k, pa.list_(v)) for k, v in PARTS.items()]])


#: Texts of a batch of parsed documents, in characters; a longer document is a batch of its own.
TOGETHER = 1 << 19
MOST_ROWS = 4096  # of such a batch, as documents may be empty


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, some at a time: a batch may hold thousands of documents, whose parts as objects take ten times its bytes."""
    for batch in batches:
        step = max(1, min(64, batch.num_rows * TOGETHER // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield from batch.slice(at, step).to_pylist()


def in_batches(rows: Iterator[tuple[int, list[dict]]], schema: pa.Schema, together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come in groups with their size, of about ``together`` in all, and of few more than ``MOST_ROWS``."""
    held, size = [], 0
    for own, found in rows:
        held += found
        size += own
        if size >= together or len(held) >= MOST_ROWS:
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def parsed(documents: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each document of ``DOCUMENT`` columns, with its parts as arrays. A null source is empty; an empty one has no parts. No shuffle. Only ``columns`` are given back if they are named."""
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = PARSED if columns is None else pa.schema([PARSED.field(c) for c in columns])
    read = [c for c in DOCUMENT if c in schema.names or c in ("document_id", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((len(row["source"] or ""), [row | {"ingest_version": INGEST_VERSION} | read_manual(row["document_id"], row["source"] or "")]) for row in each_row(batches))
        yield from in_batches(rows, schema)

    return documents.select(*read).mapInArrow(run, from_arrow_schema(schema))
