"""Main text of HTML pages by two passes over their blocks.

A page is cut into blocks at its block elements. The first pass calls a block
good, bad or undecided: by where it stands (menus, notices, forms and the like
are bad), by its length, its share of stop words and its share of link text.
In the second pass an undecided block takes the label of the nearest decided
blocks before and after it. Both passes run over all blocks of an Arrow batch at
once, as arrays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .cluster import slices, without

# Frequent function words of four languages.
ENGLISH = "a an and are as at be been but by can for from had has have he her his if in is it its not of on or she so that the their there they this to was we were which who will with would you"
GERMAN = "als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wir wird zu zum zur"
FRENCH = "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une"
SPANISH = "al como con de del el ella en es esta este ha la las lo los más no o para pero por que se si sin sobre su sus un una y"
STOP_WORDS = frozenset(f"{ENGLISH} {GERMAN} {FRENCH} {SPANISH}".split())

# Elements of HTML by how they bear on blocks.
RAW = "script style title textarea iframe noembed noframes xmp"
BREAKING = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split())
ASIDE = frozenset("aside button dialog footer form menu nav noscript object option search select svg template".split())
ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Words of classes, ids and roles.
ASIDE_NAMES = frozenset("ad ads adslot advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog discussion disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
HEADER_NAMES = frozenset("header page-header site-header top-header".split())
MAIN_NAMES = frozenset("article content entry main post story".split())
DENYING = frozenset("free has no non with without".split())

SHORT = 70  # characters; a shorter block is not decided by its words
PROSE, NO_PROSE = 0.15, 0.05  # stop words a word
FEW_LINKS, MANY_LINKS, ONLY_LINKS = 1 / 3, 1 / 2, 0.9  # link text a text

BAD, UNDECIDED, GOOD = -1, 0, 1
OUTSIDE, MAYBE, INSIDE = 0, 1, 2  # of the article

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>]).*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:=\s*"[^"]*+"|=\s*'[^']*+'|[^>])*+)(?:>|\Z)|<[!?/][^>]*>?""",
    re.IGNORECASE | re.DOTALL,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
_EDGES = ".,;:!?\"'()[]«»„“”‘’…|"


def _standing(name: str, rest: str, aside: str, main: int) -> tuple[str, int]:
    """Where a new element stands: what puts it beside the article, if anything does, and whether it is of the article."""
    if aside == "form" and name in ("article", "main"):
        aside = ""  # some sites wrap whole pages in a form
    named = [c for m in _NAMES.finditer(rest) for c in (m[1] or m[2] or m[3] or "").lower().split()] if rest else []
    parts = [p for c in named if (p := _PARTS.findall(c)) and DENYING.isdisjoint(p)]
    if not aside and name not in ("html", "body", "main"):
        if name in ASIDE or (name == "header" or not HEADER_NAMES.isdisjoint(named)) and main != INSIDE:
            aside = name
        elif any(p[0] in ASIDE_NAMES or p[-1] in ASIDE_NAMES for p in parts) or rest and _HIDDEN.search(rest):
            aside = "named"
    if name in ("article", "main") or "main" in named and "role" in rest.lower():
        main = INSIDE
    elif main == OUTSIDE and name in ("div", "section", "td") and any(p[0] in MAIN_NAMES for p in parts):
        main = MAYBE
    return aside, main


def blocks(html: str) -> list[tuple[str, int, bool, int, bool]]:
    """(text, characters of it in links, beside the article, of the article, in a list) of each block that has text, in order."""
    out: list = []
    held: list[str] = []
    stack: list[tuple[str, str, int]] = []  # open elements, with where they stand
    count: Counter = Counter()
    aside, main, in_link, linked, at = "", OUTSIDE, False, 0, 0

    def flush() -> None:
        nonlocal linked
        if text := " ".join("".join(held).split()):
            out.append((text, linked, bool(aside), main, bool(count["li"])))
        held.clear()
        linked = 0

    def closed() -> None:
        nonlocal aside, main
        count[stack.pop()[0]] -= 1
        _, aside, main = stack[-1] if stack else ("", "", OUTSIDE)

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            held.append(piece)
            linked += len("".join(piece.split())) if in_link else 0

    for token in _TOKEN.finditer(html):
        take(html[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if name == "a":
            in_link = not token["end"]
        elif name == "br":
            held.append(" ")
        elif name in BREAKING:
            flush()
            if token["end"]:
                while count[name]:  # an end tag ends what was left open inside
                    innermost = stack[-1][0] == name
                    closed()
                    if innermost:
                        break
            else:
                in_link = False
                while stack and (stack[-1][0] == "p" or stack[-1][0] in ENDS_BEFORE.get(name, ())):
                    closed()
                rest = token["rest"]
                if name != "hr" and not (name == "svg" and rest.endswith("/")):
                    aside, main = _standing(name, rest, aside, main)
                    stack.append((name, aside, main))
                    count[name] += 1
    take(html[at:])
    flush()
    return out


def first_pass(page: np.ndarray, length: np.ndarray, stops: np.ndarray, links: np.ndarray, aside: np.ndarray, main: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """The label of each block by its own statistics and place; ``page`` numbers the blocks' pages, in order."""

    def somewhere(what: np.ndarray) -> np.ndarray:
        return np.bincount(page, what, minlength=page[-1] + 1)[page] > 0 if len(page) else what

    of_article = ~aside & (main == INSIDE)
    outside = somewhere(of_article) & ~of_article
    good = ~aside & ~outside & (length >= SHORT) & (stops >= PROSE) & (links <= FEW_LINKS)
    beside = (main != INSIDE) & ((links > MANY_LINKS) | somewhere(good) & (length >= SHORT) & (stops < NO_PROSE))
    bad = aside | outside | beside | listed & (links >= ONLY_LINKS)
    return np.where(bad, BAD, np.where(good, GOOD, UNDECIDED))


def second_pass(page: np.ndarray, label: np.ndarray, aside: np.ndarray, main: np.ndarray) -> np.ndarray:
    """Labels with the undecided ones by their nearest decided neighbours in the page: the nearer of two that differ.

    Blocks beside the article are no neighbours, and inside the article only its
    own blocks are. Of two that differ at one distance, a block that may be of
    the article goes with the good one, any other with the one after it, as
    headings do. An undecided block without neighbours is good.
    """
    n = len(label)
    at = np.arange(n)
    for inside in (True, False):
        here = (main == INSIDE) == inside
        decided = (label != UNDECIDED) & ~aside & (here if inside else True)
        before = np.maximum.accumulate(np.where(decided, at, -1))
        after = np.minimum.accumulate(np.where(decided, at, n)[::-1])[::-1]
        down = np.where((before >= 0) & (page[before] == page), at - before, n)
        up = np.where((after < n) & (page[np.minimum(after, n - 1)] == page), after - at, n)
        earlier, later = label[before], label[np.minimum(after, n - 1)]
        nearer = np.where(down < up, earlier, later)
        tied = (down == up) & (main != OUTSIDE)
        found = np.where((down == n) & (up == n), GOOD, np.where(tied, np.maximum(earlier, later), nearer))
        label = np.where(here & (label == UNDECIDED), found, label)
    return label


def texts(pages: list[str | None], stop_words: frozenset = STOP_WORDS) -> list[str]:
    """The main text of each page."""
    cut = [blocks(html) if html else [] for html in pages]
    flat = [b for own in cut for b in own]
    if not flat:
        return ["" for _ in pages]
    page = np.repeat(np.arange(len(pages)), [len(own) for own in cut])
    length = np.array([len(b[0]) for b in flat])
    share = []
    for text, *_ in flat:
        words = text.lower().split()
        share.append(sum(w.strip(_EDGES) in stop_words for w in words) / len(words))
    dense = np.array([len(b[0].replace(" ", "")) for b in flat])
    links = np.array([b[1] for b in flat]) / dense
    aside, main, listed = (np.array([b[i] for b in flat]) for i in (2, 3, 4))
    label = second_pass(page, first_pass(page, length, np.array(share), links, aside, main, listed), aside, main)
    kept: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(label == GOOD):
        kept[page[i]].append(flat[i][0])
    return ["\n\n".join(own) for own in kept]


def extract_text(df: DataFrame, html: str = "html", stop_words: frozenset = STOP_WORDS, name: str = "text", chars: str = "n_chars") -> DataFrame:
    """``df`` with the main text of each page, and its number of code points.

    Blocks are in page order, joined by an empty line; character references are
    decoded, white space is one space, and nothing that is kept is shortened. If
    a page has an ``article`` or ``main`` element with text, all else is beside
    the article; in it, menus, page footers, side notes, forms, reader comments
    and what classes, ids and roles name so are.

    A null or empty page, or one without text, has an empty text; markup that is
    cut off or nested wrongly is read as far as it goes; very long pages are read
    whole, in time that grows with their length; equal pages and repeated rows
    each get their own; an empty table stays empty; other columns are kept, and
    those with the new names, in any case, are replaced. There is no shuffle.
    """
    kept = without(df, name, chars)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType()), T.StructField(chars, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html, 4 << 20):
            found = texts(batch.column(html).to_pylist(), stop_words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)
