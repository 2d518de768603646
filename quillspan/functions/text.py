"""Text expressions: tokens, symbols, estimates. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token and symbol patterns of the data model.
TOKEN = r"[\p{L}\p{N}#][\p{L}\p{N}#._:/\[\]]*"
SYMBOL = r"\#(?:UD|GP|PF|SS|AC|NM|DB|BP)|IA32_[A-Z0-9_]+|CPUID(?:\.[A-Z0-9_:,.-]+)?|(?:CR|DR)\d(?:\.[A-Z0-9_]+)?|[A-Z][A-Z0-9_]{2,}(?:\.[A-Z0-9_]+)*"
#: Phrases of legal texts.
LEGAL_PHRASES = ("all rights reserved", "no product or component", "warranties", "copyright")
SNIPPET_CHARS = 700


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def symbols(text: Column) -> Column:
    """Technical symbols in the order of their first occurrence, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0)))


def normalized_symbol(symbol: Column) -> Column:
    """Trimmed to symbol characters, then of separators at the ends, in upper case."""
    inner = F.regexp_replace(symbol, r"^[^A-Za-z0-9#._:/\-\[\]]+|[^A-Za-z0-9#._:/\-\[\]]+$", "")
    return F.translate(F.btrim(inner, F.lit("._:/-")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def symbol_terms(symbol: Column) -> Column:
    """A normalised symbol and its components, each once; no empty ones."""
    whole = normalized_symbol(symbol)
    parts = F.transform(F.split(whole, r"[._:/\-\[\]]+"), lambda p: F.ltrim(p, F.lit("#")))
    return F.filter(F.array_distinct(F.concat(F.array(whole), parts)), lambda p: p != "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " "))


def token_estimate(text: Column) -> Column:
    """(2 * characters + 6) div 7."""
    return F.floor((2 * F.char_length(F.coalesce(text, F.lit(""))) + 6) / 7).cast("long")


def snippet(text: Column, most: int = SNIPPET_CHARS) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def bare_heading(text: Column) -> Column:
    """A heading without its number and the word CHAPTER."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^[0-9.]*[ \t]*", ""), "^CHAPTER ", "")


def content_class(text: Column, inherited: Column, headings: Column) -> Column:
    """The class of a body text under an inherited one; ``headings`` is an array of the headings before it.

    A logo, a short volume mark, or capitals that agree with an earlier heading
    from either one's end are page furniture; legal wording counts in front
    matter only; anything else has the inherited class.
    """
    shown = F.trim(text)
    low = F.lower(shown)
    logo = low.isin("intel logo", "amd logo") | ((F.octet_length(shown) < 48) & (low.startswith("vol. ") | low.startswith("volume ")))
    bare = bare_heading(shown)
    agrees = F.exists(F.transform(headings, bare_heading), lambda h: h.endswith(bare) | bare.endswith(h))
    capitals = (F.octet_length(shown) <= 120) & shown.rlike(r"\p{L}") & ~shown.rlike(r"[\p{L}&&[^\p{Lu}]]") & agrees
    legal = F.lit(False)
    for phrase in LEGAL_PHRASES:
        legal = legal | low.contains(phrase)
    return F.when((shown != "") & (logo | capitals), F.lit("page_furniture")).when((inherited == "front_matter") & legal, F.lit("legal")).otherwise(inherited)
