"""The English (Porter 2) stemmer, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed values of the published algorithm: words with stems of their own, and words that stay.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes of the second, third and fourth steps.
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_V = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    found = re.match(r"gener|commun|arsen", word)
    first = found.end() if found else (m.end() if (m := re.search(rf"[{_V}][^{_V}]", word)) else len(word))
    second = m.end() if (m := re.compile(rf"[{_V}][^{_V}]").search(word, first)) else len(word)
    return first, second


def _short_end(word: str) -> bool:
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]$", word) or re.fullmatch(rf"[{_V}][^{_V}]", word))


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with anything but a-z and apostrophes stay."""
    if len(word) < 3 or not re.fullmatch(r"[a-z']+", word):
        return word
    word = word.lstrip("'")
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(rf"(^|[{_V}])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[: -2 if len(word) > 4 else -1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_V}]", word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    if end := _longest(word, ("eed", "eedly")):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif (end := _longest(word, ("ed", "edly", "ing", "ingly"))) and re.search(f"[{_V}]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    word = re.sub(rf"(?<=.[^{_V}])[yY]$", "i", word)
    if (end := _longest(word, [*STEP2, "ogi", "li"])) and len(word) - len(end) >= r1:
        base = word[: -len(end)]
        if end in STEP2:
            word = base + STEP2[end]
        elif end == "ogi" and base.endswith("l"):
            word = base + "og"
        elif end == "li" and base[-1:] in tuple("cdeghkmnrt"):
            word = base
    if (end := _longest(word, [*STEP3, "ative"])) and len(word) - len(end) >= r1:
        if end in STEP3:
            word = word[: -len(end)] + STEP3[end]
        elif len(word) - len(end) >= r2:
            word = word[: -len(end)]
    if (end := _longest(word, [*STEP4, "ion"])) and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)][-1:] in tuple("st")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1]))) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
