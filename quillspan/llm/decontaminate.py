"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Test items are normalised to words and cut into windows. The windows' rolling
hashes are broadcast, as sorted arrays of a checked size; training words are
scanned with the same rolling hash, hits are verified word by word, and the hit
words are returned as spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import fresh, slices, without, written

#: Fixed value: bytes below 0x80 that are not 0-9, A-Z, a-z part words; A-Z are lower-cased.
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Words of a text: letters and digits of ASCII in lower case, and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of ``n`` ids."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for i in range(n if len(out) else 0):
        out *= _STEP
        out += ids[i : i + len(out)]
    return out ^ (out >> np.uint64(29))


def _hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


class Windows:
    """The windows of a block of test items: a sorted array of their hashes, with item and place of each.

    The items' words lie in one string, to verify by. That is ``WINDOW_BYTES``
    and the word itself for each word, in flat arrays that pickle as they are.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.items = [item for item, _ in items]
        self.text = b" ".join(w for _, found in items for w in found)
        lengths = np.fromiter((len(w) for _, found in items for w in found), np.int64, sum(len(f) for _, f in items))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        hashes: dict[int, list[np.ndarray]] = {}
        places: dict[int, list[np.ndarray]] = {}
        at = 0
        for _, found in items:
            size = min(n, len(found))
            hashes.setdefault(size, []).append(_rolled(_hashes(found), size))
            places.setdefault(size, []).append(np.arange(at, at + len(found) - size + 1, dtype=np.uint32))
            at += len(found)
        firsts = np.cumsum([0, *[len(f) for _, f in items]])[:-1]
        #: of each window length: distinct hashes, where each one's places start, places, and the item of each place
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in hashes:
            every, place = np.concatenate(hashes[size]), np.concatenate(places[size])
            order = np.lexsort((place, every))
            distinct, starts = np.unique(every[order], return_index=True)
            place = place[order]
            owner = np.searchsorted(firsts, place, side="right").astype(np.uint32) - np.uint32(1)
            self.of[size] = (distinct, np.append(starts, len(place)).astype(np.uint32), place, owner)

    def words_at(self, place: int, size: int) -> bytes:
        return self.text[self.starts[place] : self.starts[place + size] - 1]

    def hits(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """A flag for each word, and the items of which windows occur."""
        flags, items = np.zeros(len(found), bool), set()
        ids = _hashes(found)
        for size, (hashes, starts, places, owners) in self.of.items():
            rolled = _rolled(ids, size)
            if not len(rolled):
                continue
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            seen: dict[bytes, bool] = {}
            for i in np.flatnonzero(hashes[at] == rolled).tolist():
                own = b" ".join(found[i : i + size])
                if own not in seen:
                    here = slice(int(starts[at[i]]), int(starts[at[i] + 1]))
                    true = np.fromiter((self.words_at(p, size) == own for p in places[here].tolist()), bool)
                    seen[own] = bool(true.any())
                    items.update(self.items[o] for o in np.unique(owners[here][true]).tolist())
                if seen[own]:
                    flags[i : i + size] = True
        return flags, items


#: Of an index, for each word of the items, beside the word: hash, start, place, item, and the start of the hash's places.
WINDOW_BYTES = 8 + 8 + 4 + 4 + 4


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with their words, a partition at a time, in blocks whose index has about ``most`` bytes."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).toLocalIterator():
        found = words(row["text"]) if row["item"] is not None else []
        if not found:
            continue
        own = WINDOW_BYTES * len(found) + sum(map(len, found))
        if block and size + own > most:
            yield block
            block, size = [], 0
        block.append((row["item"], found))
        size += own
    if block:
        yield block


def _marked(df: DataFrame, text: str, windows: Windows | None) -> DataFrame:
    """``df``, whose last three columns are word counts, spans and items, with those brought up to date for one block."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(windows) if windows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value if held else None
        for batch in slices(batches, text):
            counts, spans, items = [], [], []
            _, before, known_items = (c.to_pylist() for c in batch.columns[-3:])
            for value, old, known in zip(batch.column(text).to_pylist(), before, known_items, strict=True):
                found = words(value)
                flags, got = block.hits(found) if block else (np.zeros(len(found), bool), set())
                for a, b in zip(old[::2], old[1::2], strict=True):
                    flags[a:b] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                counts.append(len(found))
                spans.append(edge.tolist())
                items.append(sorted(got.union(known)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _scanned(df: DataFrame, benchmark: DataFrame, n: int, text: str, item: str, item_text: str, block_bytes: int, names: list[str]) -> DataFrame:
    """``df`` with the three columns of ``names``, which it doesn't have."""
    empty = (F.lit(0).cast("long"), F.array().cast("array<bigint>"), F.array().cast("array<string>"))
    marked = df.select("*", *[c.alias(name) for c, name in zip(empty, names, strict=True)])
    seen = 0
    for block in _blocks(benchmark, item, item_text, block_bytes):
        marked = _marked(written(marked, "contamination") if seen else marked, text, Windows(block, n))
        seen += 1
    return marked if seen else _marked(marked, text, None)


def find_contamination(df: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 128 << 20) -> DataFrame:
    """``df`` with n_words, hit_spans and item_ids of its whole texts.

    hit_spans are pairs (first word, word after the last), flat and in order, of
    words inside any occurrence of a window; item_ids are the items with
    occurring windows, sorted. A window is ``n`` consecutive words of an item; an
    item of fewer words, but not none, is one window.

    The benchmark is broadcast in blocks of which the index, as it lies in memory
    and as it is sent, has at most ``block_bytes`` (or one item); where there are
    several, the table is scanned once for each and the marks so far are written
    between scans. There is no shuffle of texts.

    A null or empty text has no words and no hits; null items are passed over;
    repeated items and rows are each counted once and on their own; an empty
    table or benchmark gives no hits. Columns of ``df`` that have the names of
    the new ones, in any case, are replaced.
    """
    names = ["n_words", "hit_spans", "item_ids"]
    return _scanned(without(df, *names), benchmark, n, text, item, item_text, block_bytes, names)


def decontaminate(df: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", remove: str = "documents", least_hits: int = 1, item: str = "item_id", item_text: str = "text", block_bytes: int = 128 << 20) -> DataFrame:
    """``df``, with its own columns only, without contamination: whole documents go, or only the hit spans.

    remove="documents" drops rows with at least ``least_hits`` hit words.
    remove="spans" cuts the hit words, and what lies between the words of a
    span, out of the text; the rest is left as it was. Edge cases are those of
    ``find_contamination``, but no column is replaced; a text that is hit
    throughout becomes empty.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    columns = df.columns
    names = fresh(columns, "n_words", "hit_spans", "item_ids")
    found = _scanned(df, benchmark, n, text, item, item_text, block_bytes, names)
    if remove == "documents":
        return found.where(n_hit(F.col(names[1])) < least_hits).drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            spans = batch.column(names[1]).to_pylist()
            texts = [cut_words(t, s) if s else t for t, s in zip(batch.column(text).to_pylist(), spans, strict=True)]
            out = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return found.mapInArrow(run, df.schema)


def n_hit(spans):
    """The number of words in flat pairs of span bounds."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def cut_words(text: str, spans: list[int]) -> str:
    """``text`` without the words of the spans and what lies between them."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_WORDS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    firsts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[at : firsts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
