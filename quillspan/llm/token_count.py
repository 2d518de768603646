"""Token counts by heap-and-linked-list byte-pair merging.

The pieces of a text are merged without emitting identifiers: the adjacent pair
of lowest rank is popped from a heap, its two nodes of a linked list become
one, and the two new neighbours are pushed. A piece's count is its initial
symbols less its merges.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .cluster import slices, without
from .text_units import WHITE, UnitCache, units

#: Fixed value: the byte-level pre-tokenizer's pattern, as published with the vocabulary.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Merge ranks of a byte-level vocabulary, between symbols numbered in order of rank.

    Symbol numbers exist only inside a merge; they are not vocabulary ids.
    """

    def __init__(self, pairs: list[tuple[bytes, bytes]], specials: list[str], splitter=None):
        number = {bytes([b]): b for b in range(256)}
        self.joined: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(pairs):
            whole = left + right
            new = number.setdefault(whole, len(number))
            self.joined.setdefault(number[left] << 32 | number[right], (rank, new))
        self.specials = specials
        self.splitter = splitter
        self.split = regex.compile(PATTERN).findall
        self.alphabet = byte_alphabet()
        self.cut = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    @classmethod
    def load(cls, path: str) -> MergeTable:
        """From a tokenizers ``.json`` (byte-level BPE) or a ``.tiktoken`` rank file; others raise ValueError."""
        if path.endswith(".tiktoken"):
            return cls(_pairs_of_ranks(path), [])
        if not path.endswith(".json"):
            raise ValueError(f"not a byte-level BPE vocabulary: {path}")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"not a byte-level BPE vocabulary: {path}")
        byte = byte_alphabet()
        decode = lambda s: bytes(byte[c] for c in s)
        pairs = [tuple(map(decode, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        from tokenizers import pre_tokenizers

        return cls(pairs, [t["content"] for t in spec.get("added_tokens", [])], pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str)

    def pieces(self, unit: str) -> list[bytes]:
        """The pre-tokens of a unit. Letters beyond Latin are split by the library's own tables, whose Unicode version may differ from ours."""
        if self.splitter is None or unit.isascii() or max(unit) < "ɐ":
            return [p.encode("utf-8", "surrogatepass") for p in self.split(unit)]
        return [bytes(self.alphabet[c] for c in p) for p, _ in self.splitter(unit)]

    def merged(self, piece: bytes) -> int:
        """Symbols that remain of ``piece`` when no adjacent pair has a rank."""
        n = len(piece)
        if n < 2:
            return n
        symbol = list(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        joined = self.joined
        heap = []
        for i in range(n - 1):
            if pair := joined.get(symbol[i] << 32 | symbol[i + 1]):
                heap.append((pair[0], i, pair[1]))
        heapify(heap)
        count = n
        while heap:
            rank, i, new = heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            pair = joined.get(symbol[i] << 32 | symbol[j])
            if pair is None or pair[0] != rank:
                continue
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if pair := joined.get(new << 32 | symbol[k]):
                    heappush(heap, (pair[0], i, pair[1]))
            h = before[i]
            if h >= 0 and (pair := joined.get(symbol[h] << 32 | new)):
                heappush(heap, (pair[0], h, pair[1]))
        return count

    def counts(self, wanted: list[str]) -> list[int]:
        merged, pieces = self.merged, self.pieces
        return [sum(map(merged, pieces(unit))) for unit in wanted]


def _pairs_of_ranks(path: str) -> list[tuple[bytes, bytes]]:
    """The pair whose merge makes each entry of a rank file: the last one left when the entry's bytes are merged by the ranks below its own."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    pairs = []
    for whole, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(whole) < 2:
            continue
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pairs.append((parts[0], parts[1]))
    return pairs


class TokenCounter:
    """Counts tokens of whole texts, with the counts of recurring units kept."""

    def __init__(self, path: str):
        self.merges = MergeTable.load(path)
        self.cache = UnitCache(self.merges.counts)

    def count_all(self, texts: list[str]) -> list[int]:
        cut = self.merges.cut
        parts, extra = [], []
        for text in texts:
            segments = cut.split(text) if cut is not None else [text]
            extra.append(len(segments) - 1)
            parts.append([u for s in segments for u in units(s)] if len(segments) > 1 else units(text))
        return [sum(found) + e for found, e in zip(self.cache.values(parts), extra, strict=True)]


@cache
def counter_of(path: str) -> TokenCounter:
    """One counter for all tasks of a worker process."""
    return TokenCounter(path)


def count_tokens(df: DataFrame, text: str, vocabulary: str, name: str = "n_tokens") -> DataFrame:
    """``df`` with a long column ``name``: the tokens of each whole text under the vocabulary file.

    Special strings inside a text count one each, as the library does by default.
    A null or empty text has 0 tokens; very long texts are counted whole; equal
    texts and repeated rows each get their own row; an empty table stays empty;
    other columns are kept, and one called ``name`` (in any case) is replaced.
    Each task keeps at most a bounded number of units, so memory does not grow
    with the input, and a lost executor costs only its own tasks: there is no shuffle.
    """
    kept = without(df, name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in slices(batches, text, 1 << 20):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts = pa.array(counter.count_all(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)
