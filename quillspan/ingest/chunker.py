"""Search chunks of a parsed document, under a budget of tokens.

Prose-like blocks in a row, of one section and one class, are packed together
with whole blocks repeated as overlap; tables are cut between rows and repeat
their headers; diagrams stay whole; code is cut at blank lines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.functions import text as tx

from .manual import _SPAN, _TEXTS, PROSE_KINDS, each_row, in_batches, name_of, read_manual

_SYMBOL = re.compile(tx.SYMBOL)
Counter = Callable[[str], int]


@dataclass(frozen=True)
class Budget:
    """Tokens of a chunk and of its overlap, and rows of a table in a chunk."""

    target: int = 384
    overlap: int = 48
    table_rows: int = 24

    def __post_init__(self):
        if self.target < 1 or self.table_rows < 1 or self.overlap < 0:
            raise ValueError("target and table_rows are positive, overlap is not negative")


def white_space_tokens(text: str) -> int:
    return len(text.split())


def composed(prefix: str, parts: list[str]) -> str:
    return "\n\n".join([x for x in (prefix, *[p.strip() for p in parts if p]) if x])


def symbols_of(text: str) -> list[str]:
    return list(dict.fromkeys(m[0] for m in _SYMBOL.finditer(text)))


class Chunker:
    """The chunks of one document in order."""

    def __init__(self, document: dict, budget: Budget = Budget(), count: Counter = white_space_tokens):
        self.document, self.budget, self.count = document, budget, count
        self.tables = {t["block_id"]: t for t in document["tables"] or []}
        self.diagrams = {d["block_id"]: d for d in document["diagrams"] or []}
        self.out: list[dict] = []

    def run(self) -> list[dict]:
        alike = lambda b: (b["section_id"], b["content_class"]) if b["kind"] in PROSE_KINDS else b["ordinal"]
        for _, group in groupby(self.document["blocks"] or [], alike):
            blocks = list(group)
            pieces = {"table": self.table, "diagram": self.diagram, "code": self.code}.get(blocks[0]["kind"])
            for text in pieces(blocks[0]) if pieces else ():
                self.emit(blocks[0]["kind"], blocks[:1], text)
            if not pieces:
                self.prose(blocks)
        return self.out

    def prefix(self, block: dict, caption: str | None = None) -> str:
        stem = re.sub(r"(?<=.)\.[^.]*$", "", self.document["entry_path"].rsplit("/", 1)[-1])
        return "\n".join(x for x in (stem, " > ".join(block["heading_path"]), caption) if x)

    def fits(self, text: str) -> bool:
        return self.count(text) <= self.budget.target

    def emit(self, kind: str, blocks: list[dict], text: str) -> None:
        ids = [k for k, _ in groupby(b["block_id"] for b in blocks)]
        first, last = blocks[0]["span"], blocks[-1]["span"]
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        self.out.append(
            {
                "chunk_id": name_of("chk", self.document["document_id"], kind, str(len(self.out)), *ids, digest),
                "document_id": self.document["document_id"],
                "section_id": blocks[0]["section_id"],
                "vendor": self.document["vendor"],
                "heading_path": blocks[0]["heading_path"],
                "source_block_ids": ids,
                "kind": kind,
                "content_class": blocks[0]["content_class"],
                "text": text,
                "token_count": self.count(text),
                "symbols": symbols_of(text),
                "content_hash": digest,
                "chunk_ordinal": len(self.out),
                "span": first | {"byte_end": last["byte_end"], "line_end": last["line_end"]},
            }
        )

    def prose(self, blocks: list[dict]) -> None:
        """Greedy: when the next unit does not fit, the chunk ends and the next begins with whole blocks from its end, as far as they leave room."""
        units = [u for b in blocks for u in self.units(b)]
        text_of = lambda own: composed(self.prefix(own[0][0]), [t for _, t, _ in own])
        pending: list[tuple] = []
        for unit in units:
            if pending and not self.fits(text_of([*pending, unit])):
                self._close(pending, text_of)
                pending = self.tail(pending)
                while pending and not self.fits(text_of([*pending, unit])):
                    pending.pop(0)
            pending.append(unit)
        if pending:
            self._close(pending, text_of)

    def _close(self, units: list[tuple], text_of: Callable[[list], str]) -> None:
        blocks = [b for b, _, _ in units]
        self.emit("list" if all(b["kind"] == "list" for b in blocks) else "prose", blocks, text_of(units))

    def units(self, block: dict) -> list[tuple[dict, str, bool]]:
        """(block, text, whether it is all of it): a block over the target is parted at words; a word over it stays whole."""
        prefix, text = self.prefix(block), block["normalized_text"]
        if self.fits(composed(prefix, [text])):
            return [(block, text, True)]
        words, parts, at = text.split(), [], 0
        while at < len(words):
            n = self.most_words(prefix, words, at)
            parts.append(" ".join(words[at : at + n]))
            at += n
        return [(block, p, False) for p in parts or [text]]

    def most_words(self, prefix: str, words: list[str], at: int) -> int:
        """How many words from a place on fit, one at least. Text counts no less for a word more, so the number is doubled and then halved in on: a part is counted some 16 times, however many words it has."""
        fits = lambda n: self.fits(composed(prefix, [" ".join(words[at : at + n])]))
        left = len(words) - at
        fit, over = 1, 2
        while over <= left and fits(over):
            fit, over = over, 2 * over
        over = min(over, left + 1)
        while over - fit > 1:
            middle = (fit + over) // 2
            fit, over = (middle, over) if fits(middle) else (fit, middle)
        return fit

    def tail(self, units: list[tuple]) -> list[tuple]:
        """Whole blocks from the end, together within the overlap."""
        kept: list[tuple] = []
        for unit in reversed(units):
            if not unit[2] or self.count("\n\n".join(t for _, t, _ in [unit, *kept])) > self.budget.overlap:
                break
            kept.insert(0, unit)
        return kept

    def table(self, block: dict) -> Iterator[str]:
        """Groups of rows under the headers; a row over the target stands alone, and a table without rows has its headers."""
        found = self.tables.get(block["block_id"])
        if not found:
            yield composed(self.prefix(block), [block["normalized_text"]])
            return
        prefix, rows = self.prefix(block, found["caption"]), [" | ".join(r) for r in found["rows"]]
        render = lambda own: composed(prefix, ["\n".join([" | ".join(found["headers"]), *own])])
        held: list[str] = []
        for row in rows:
            if held and (len(held) == self.budget.table_rows or not self.fits(render([*held, row]))):
                yield render(held)
                held = []
            held.append(row)
        if held or not rows:
            yield render(held)

    def diagram(self, block: dict) -> Iterator[str]:
        found = self.diagrams.get(block["block_id"])
        labels = " | ".join(found["search_labels"]) if found else ""
        yield composed(self.prefix(block, found["caption"] if found else None), [labels or block["normalized_text"]])

    def code(self, block: dict) -> Iterator[str]:
        """Whole, or groups between blank lines; a group over the target is not cut."""
        prefix, source = self.prefix(block), block["raw_source"].strip()
        if source.startswith(("```", "~~~")):
            source = re.sub(r"\n?(```|~~~)$", "", source.partition("\n")[2]).strip()
        if self.fits(composed(prefix, [source])):
            yield composed(prefix, [source])
            return
        held: list[str] = []
        for part in re.split(r"\r?\n[ \t]*\r?\n+", source):
            part = part.strip()
            if held and part and not self.fits(composed(prefix, [*held, part])):
                yield composed(prefix, held)
                held = []
            held += [part] * bool(part)
        if held:
            yield composed(prefix, held)


CHUNK = pa.schema(
    [
        *[(c, pa.string()) for c in ("chunk_id", "document_id", "section_id", "vendor")],
        ("heading_path", _TEXTS),
        ("source_block_ids", _TEXTS),
        *[(c, pa.string()) for c in ("kind", "content_class", "text")],
        ("token_count", pa.int32()),
        ("symbols", _TEXTS),
        ("content_hash", pa.string()),
        ("chunk_ordinal", pa.int32()),
        ("span", _SPAN),
    ]
)


def chunks(parsed: DataFrame, budget: Budget = Budget(), count: Counter = white_space_tokens) -> DataFrame:
    """The chunks of parsed documents, a document in its own row: no shuffle."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Chunker(row, budget, count).run() for row in each_row(batches))
        yield from in_batches(((sum(len(c["text"]) for c in own), own) for own in found), CHUNK)

    return parsed.select("document_id", "vendor", "entry_path", "blocks", "tables", "diagrams").mapInArrow(run, from_arrow_schema(CHUNK))


def chunked(documents: DataFrame, budget: Budget = Budget(), count: Counter = white_space_tokens) -> DataFrame:
    """The chunks of documents of ``manual.DOCUMENT`` columns whose parsed form is not kept: each is parsed and chunked at once."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Chunker(row | read_manual(row["document_id"], row["source"] or ""), budget, count).run() for row in each_row(batches))
        yield from in_batches(((sum(len(c["text"]) for c in own), own) for own in found), CHUNK)

    return documents.select("document_id", "vendor", "entry_path", "source").mapInArrow(run, from_arrow_schema(CHUNK))
