"""Plain text of Markdown, and what headings and texts say about the class of their content."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

#: Content classes.
SUBSTANTIVE, FRONT_MATTER, CONTENTS, LEGAL, REVISIONS, FURNITURE = "substantive", "front_matter", "contents", "legal", "revision_history", "page_furniture"
#: Phrases of headings that make no section, by the class they announce.
LEGAL_HEADINGS = ("notices", "disclaimer", "legal information")
CONTENTS_HEADINGS = ("contents", "figures", "tables")
REVISION_HEADINGS = ("revision history", "revision guide")
FRONT_HEADINGS = ("architectures software developer", "amd64 architecture programmer", "publication no.")
#: Phrases of legal texts in front matter, and texts that are page furniture.
LEGAL_PHRASES = ("all rights reserved", "no product or component", "warranties", "copyright")
LOGOS = ("intel logo", "amd logo")
#: Fixed value: a printed page label.
PRINTED_PAGE = r"(?i)\b(?:[A-Z]{1,4}-)?\d{1,4}-\d{1,4}\b"

_PAGE = re.compile(PRINTED_PAGE)
_FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,}).*$", re.M)
_BLOCK_MARKS = re.compile(r"^[ \t]*(?:#{1,6}[ \t]+|(?:[-*+]|\d{1,9}[.)])[ \t]+|>[ \t]?)+", re.M)
_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$", re.M)
_INLINE = re.compile(
    r"""(?P<code>(?<!`)(?P<ticks>`++)(?P<inside>.+?)(?<!`)(?P=ticks)(?!`))
    |\\(?P<escaped>[!-/:-@\[-`{-~])
    |!?\[(?P<link>(?:[^\[\]\\]|\\.)*)\](?:\([^()\s]*(?:\s+"[^"]*")?\)|\[[^\[\]]*\])
    |\[\^(?P<note>[^\]\s]+)\]
    |<(?P<address>[A-Za-z][A-Za-z0-9+.\-]*:[^<>\s]*)>
    |(?P<tag></?[A-Za-z][^<>]*>|<!--.*?-->)
    |(?P<mark>\*{1,3}|~~|(?<![^\W_])_{1,3}(?=\S)|(?<=\S)_{1,3}(?![^\W_])|\$\$?(?=\S))""",
    re.X | re.S,
)
#: What every match of ``_INLINE`` begins with; elsewhere it need not be tried.
_INLINE_BEGINS = re.compile(r"[`\\!\[<*~_$]")
_TASK = re.compile(r"^[ \t]*[-*+][ \t]+\[([ xX])\][ \t]+", re.M)


def collapsed(text: str) -> str:
    return " ".join(text.split())


def _inline(text: str, shown: Callable[[re.Match], str]) -> str:
    """As ``_INLINE.sub(shown, text)``, tried only where a match may begin."""
    out, done, at = [], 0, 0
    while begins := _INLINE_BEGINS.search(text, at):
        at = begins.end()
        if found := _INLINE.match(text, begins.start()):
            out += text[done : found.start()], shown(found)
            done = at = found.end()
    return "".join([*out, text[done:]]) if out else text


def plain(markdown: str) -> str:
    """The words that a Markdown text shows, with single spaces.

    Marks, tags and the addresses of links go; where one stood between two words
    a space parts them. Code and formulas stay as text, a task's box as checked
    or unchecked. A block that begins with an HTML tag shows nothing.
    """
    if re.match(r"[ ]{0,3}<(?:/?[A-Za-z]|!--)", markdown) and not markdown.lstrip().lower().startswith("<http"):
        return ""
    if _FENCE.match(markdown):
        return collapsed(_FENCE.sub("", markdown))
    text = _TASK.sub(lambda m: f" {'unchecked' if m[1] == ' ' else 'checked'} ", markdown)
    text = _RULE.sub("", text) if "|" in text else text
    table = "|" in text and bool(_RULE.search(markdown))
    text = _BLOCK_MARKS.sub("", text)
    if table:
        text = re.sub(r"(?<!\\)\|", " ", text)

    def shown(m: re.Match) -> str:
        if m["code"]:
            return f" {m['inside'].strip()} "
        if m["escaped"]:
            return m["escaped"]
        if m["link"] is not None:
            return f" {_inline(m['link'], shown)} "
        return f" {m['note'] or m['address'] or ''} "

    return collapsed(html.unescape(_inline(text, shown)))


def heading_class(heading: str, before_sections: bool) -> str | None:
    """The class that a heading announces for what follows, without making a section; None for a heading that makes one."""
    low = heading.lower()
    if any(p in low for p in LEGAL_HEADINGS):
        return LEGAL
    if low in CONTENTS_HEADINGS or low.endswith(" contents") or "table of contents" in low:
        return CONTENTS
    if any(p in low for p in REVISION_HEADINGS):
        return REVISIONS
    if before_sections and (low.startswith("volume ") or any(p in low for p in FRONT_HEADINGS)):
        return FRONT_MATTER
    return None


def printed_page(text: str) -> str | None:
    """The first page label; a number without a dash is none."""
    found = _PAGE.search(text)
    return found[0] if found else None


def marks_page(line: str) -> bool:
    """Whether a line is a running head or foot with a page label and a volume."""
    low = line.lower()
    return ("vol." in low or "volume" in low) and printed_page(line) is not None


def bare_heading(text: str) -> str:
    """A heading without its number and the word CHAPTER."""
    return re.sub(r"^CHAPTER ", "", text.strip().lstrip("0123456789.").lstrip())


#: A longer line is no page furniture, in bytes.
LONGEST_FURNITURE = 120


class Furniture:
    """Tells lines that repeat on pages: logos, volume marks, and capitals that repeat a heading met before."""

    def __init__(self):
        self.known: set[str] = set()
        self.ends: set[str] = set()

    def learn(self, heading: str) -> None:
        bare = bare_heading(heading)
        self.known.add(bare)
        # only ends as short as a line that is asked for
        self.ends.update(bare[i:] for i in range(max(0, len(bare) - LONGEST_FURNITURE), len(bare) + 1))

    def __call__(self, text: str) -> bool:
        text = text.strip()
        low = text.lower()
        if low in LOGOS or (len(text.encode()) < 48 and low.startswith(("vol. ", "volume "))):
            return bool(text)
        if len(text.encode()) > LONGEST_FURNITURE:
            return False
        letters = [c for c in text if c.isalpha()]
        if not letters or not all(c.isupper() for c in letters):
            return False
        bare = bare_heading(text)
        return bare in self.ends or any(bare[i:] in self.known for i in range(len(bare) + 1))


def body_class(text: str, inherited: str, furniture: Furniture) -> str:
    """The class of a block's plain text under the class that the last heading announced."""
    if furniture(text):
        return FURNITURE
    if inherited == FRONT_MATTER and any(p in text.lower() for p in LEGAL_PHRASES):
        return LEGAL
    return inherited
