"""Text cut into cached units that a byte-level BPE vocabulary treats independently.

The pre-tokenizer of byte-level BPE never joins text across a white-space run,
except that one space goes to the word after it. So a text is a sequence of
units: words with at most one leading space, and white-space runs. Words recur,
so what is computed for a unit is kept, within a bound, for the next one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: The characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"

# a word of letters and digits ends before ASCII punctuation in any case, so it is a unit without it
_UNIT = re.compile(rf" ?[^\W_]++(?=[!-/:-@\[-`{{-~])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")


def units(text: str) -> list[str]:
    """The units of ``text``; joined, they give it back."""
    return _UNIT.findall(text)


class UnitCache:
    """Values of units in two generations of at most ``most`` entries each.

    Units longer than ``longest`` are kept for one call only.
    When the young generation is full it becomes the old one; an entry that is
    used again moves back. Memory is bounded whatever the texts are, and a
    dropped value is only computed again.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int = 500_000, longest: int = 64):
        self.compute, self.most, self.longest = compute, most, longest
        self.young: dict = {}
        self.old: dict = {}
        self.passing: list[str] = []

    def values(self, parts: list[list[str]]) -> list[list]:
        """The value of each unit of each part."""
        for unit in self.passing:
            self.young.pop(unit, None)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        get = self.young.get
        found = [list(map(get, p)) for p in parts]
        lacking = [(p, f, [j for j, v in enumerate(f) if v is None]) for p, f in zip(parts, found, strict=True) if None in f]
        wanted = list({p[j] for p, _, at in lacking for j in at})
        missing = []
        for unit in wanted:
            if unit in self.old:
                self.young[unit] = self.old[unit]
            else:
                missing.append(unit)
        self.young.update(zip(missing, self.compute(missing), strict=True))
        self.passing = [u for u in missing if len(u) > self.longest]
        for p, f, at in lacking:
            for j in at:
                f[j] = self.young[p[j]]
        return found
