"""Token ids of whole texts by the tokenizers library, with recurring units kept."""

from __future__ import annotations

import json
import os
import re
import struct
from functools import cache

import numpy as np

from .text_units import UnitCache, units

_BLANK = re.compile(r"\s")

#: Latin letters, with at most a space before them: one unit of the pre-tokenizer, by every version of Unicode.
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def _byte_symbols() -> dict[int, str]:
    """The symbol that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class UnitEncoder:
    """Little-endian unsigned 32-bit ids of texts, equal to the library's for the whole text.

    Units that were not met lately are encoded by the library: Latin words by
    its model, the others many in one call, joined by line feeds, whose id then
    marks their ends. Vocabularies that are not plain byte-level BPE are encoded
    text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # units come to the library once; keeping them there costs more than it saves
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        self.by_unit = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer") and len(self.newline) == 1
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens", [])}
        self.by_unit &= not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbols = _byte_symbols()
        self.cache = UnitCache(self._encode)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode(self, wanted: list[str]) -> list[bytes]:
        out: list = [None] * len(wanted)
        tokenize, symbols, latin = self.library.model.tokenize, self.symbols, _LETTERS.fullmatch
        others = []
        for i, unit in enumerate(wanted):
            if latin(unit):
                ids = [t.id for t in tokenize(unit.encode().decode("latin-1").translate(symbols))]
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(i)
        words = [i for i in others if not _BLANK.search(wanted[i], 1) and not (len(wanted[i]) == 1 and wanted[i].isspace())]
        alone = sorted(set(others).difference(words))
        if words:
            joined = self.library.encode_batch_fast(["\n".join([wanted[i] for i in words])], add_special_tokens=False)[0].ids
            ids = np.array(joined, "<u4")
            raw = ids.tobytes()
            ends = [*(4 * np.flatnonzero(ids == self.newline[0])).tolist(), len(raw)]
            if len(ends) == len(words):
                at = 0
                for i, end in zip(words, ends, strict=True):
                    out[i] = raw[at:end]
                    at = end + 4
            else:
                alone = others
        for i, ids in zip(alone, self._whole([wanted[i] for i in alone]) if alone else [], strict=True):
            out[i] = ids
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return self._whole(texts)
        segments = [self.cut.split(text) if self.cut is not None else [text] for text in texts]
        found = iter(self.cache.values([units(x) for s in segments for x in s[::2]]))
        return [b"".join(b"".join(next(found)) + (self.special[s[i + 1]] if i + 1 < len(s) else b"") for i in range(0, len(s), 2)) for s in segments]


@cache
def encoder_of(path: str) -> UnitEncoder:
    """One encoder for all tasks of a worker process."""
    return UnitEncoder(path)
