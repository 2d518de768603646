"""Pipe and HTML tables to headers and rows of equal width."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from .plain import plain


@dataclass
class Table:
    headers: list[str]
    rows: list[list[str]]
    mismatched: list[int] = field(default_factory=list)  # rows, from 1, of another width


def pipe_cells(line: str) -> list[str]:
    """Plain cells of a row; a backslash before a pipe makes it one of the text, before anything else it stays."""
    inner = line.strip()
    inner = inner[1:] if inner.startswith("|") else inner
    parts = [""]
    for token in re.findall(r"\\.|[^\\|]+|\||\\$", inner, re.S):
        if token == "|":
            parts.append("")
        else:
            parts[-1] += "|" if token == r"\|" else token
    if len(parts) > 1 and not parts[-1].strip() and inner.endswith("|"):
        parts.pop()
    return [plain(p.strip()) if p.strip() else "" for p in parts]


def separates(line: str) -> bool:
    """Whether a line is the rule under a pipe table's headers."""
    cells = line.strip().strip("|").split("|")
    return all(re.fullmatch(r":*-{3,}:*", c.strip()) for c in cells)


#: How many columns and rows a cell may span, as HTML has it.
MOST_SPANNED = {"colspan": 1000, "rowspan": 65534}


def spanned(text: str, most: int) -> int:
    """The number of columns or rows that an attribute asks for; 1 where it is none."""
    digits = text if text.isascii() and text.isdigit() else "1"
    return min(max(1, int(digits[:9])), most)


class _Rows(HTMLParser):
    """Rows of a table: (part, [(tag, colspan, rowspan, text)]). A row outside thead and tfoot is of the body, whether that is written or not."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, list[list]]] = []
        self.part, self.cell = "", None

    def handle_starttag(self, tag, attrs):
        if tag in ("thead", "tbody", "tfoot"):
            self.part, self.cell = tag, None
        elif tag == "tr":
            self.rows.append((self.part or "tbody", []))
            self.cell = None
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append((self.part or "tbody", []))
            given = dict(attrs)
            self.cell = [tag, *[spanned(given.get(k) or "", most) for k, most in MOST_SPANNED.items()], []]
            self.rows[-1][1].append(self.cell)
        elif tag == "br" and self.cell:
            self.cell[3].append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag in ("thead", "tbody", "tfoot"):
            self.part, self.cell = "", None

    def handle_data(self, data):
        if self.cell:
            self.cell[3].append(data)


def _spread(cells: list[list]) -> list[str]:
    """A header row: a cell over several columns is followed by empty ones."""
    return [x for _, columns, _, text in cells for x in [plain(" ".join(text)), *[""] * (columns - 1)]]


def html_table(source: str) -> Table:
    """Headers are the last row of thead, else the first row with a th; rows are those of the body, with cells over several rows repeated."""
    reader = _Rows()
    reader.feed(source)
    reader.close()
    head = [cells for part, cells in reader.rows if part == "thead"]
    body = [cells for part, cells in reader.rows if part == "tbody"] or [cells for _, cells in reader.rows]
    titled = head[-1] if head and head[-1] else next((c for _, c in reader.rows if any(x[0] == "th" for x in c)), [])
    below: dict[int, tuple[str, int]] = {}  # column: what goes on, for so many rows
    rows = []
    for cells in body:
        row: list[str] = []
        waiting = [(text if i == 0 else "", down) for _, columns, down, parts in cells for text in [plain(" ".join(parts))] for i in range(columns)]
        taken = 0
        while taken < len(waiting) or len(row) in below:
            at = len(row)
            if at in below:
                text, left = below.pop(at)
                if left > 1:
                    below[at] = (text, left - 1)
            else:
                text, down = waiting[taken]
                taken += 1
                if down > 1:
                    below[at] = (text, down - 1)
            row.append(text)
        rows.append(row)
    return Table(_spread(titled), rows)


def pipe_table(source: str) -> Table:
    lines = source.splitlines()
    if len(lines) < 2 or not separates(lines[1]):
        return Table([], [])
    return Table(pipe_cells(lines[0]), [pipe_cells(x) for x in lines[2:] if x.strip()])


def read_table(source: str) -> Table | None:
    """The table of a block, its rows padded or cut to the headers; None without headers."""
    found = html_table(source) if source.lstrip().lower().startswith("<table") else pipe_table(source)
    width = len(found.headers)
    if not width:
        return None
    found.mismatched = [i for i, r in enumerate(found.rows, 1) if len(r) != width]
    found.rows = [(r + [""] * width)[:width] for r in found.rows]
    return found
