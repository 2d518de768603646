"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r
bits of both. Every fingerprint gives all its variants within r bits; those
that collide are verified and linked.

Variants are shuffled by their leading bits. A fingerprint goes, once, to each
value of the leading bits that any of its variants has, and the variants with
that value are made where they meet: the same incidences as a row per variant,
for a small part of the rows. Exact copies share a fingerprint and are counted
once; a group of colliding variants is linked in a chain, not in pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import slices, written
from .components import components

BITS = 64


def shingle_hashes(text: str | None, n: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each ``n``-word shingle of a text, A-Z in lower case, words parted by white space of ASCII.

    Fewer words are one shingle; no words, none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    hashed = xxhash.xxh64_intdigest
    if len(found) <= n:
        return np.array([hashed(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([hashed(joined[a:b], 42) for a, b in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, n: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words: 0."""
    hashes = shingle_hashes(text, n)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4) -> DataFrame:
    """(doc_id, fp): fingerprints of whole texts as longs with the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, n) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def flips(width: int, most: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``most`` bits set."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)]


def collisions(found: np.ndarray, width: int, lead: int, radius: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, position in ``found``) of fingerprints that share a variant with others, in order of the variants; all of a variant in one part.

    The variants are those whose bits from ``width`` up equal ``lead``, within
    ``radius`` flips of all bits. Where there are over ``most``, they are made
    in parts by four further bits, so memory stays bounded and none is left out.
    """

    def walk(at: np.ndarray, low: np.ndarray, left: np.ndarray, width: int, above: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = [1 + (r >= 1) * width + (r >= 2) * (width * (width - 1) // 2) for r in range(radius + 1)]
        if len(at) < 2:
            return
        if sum(int((left == r).sum()) * sizes[r] for r in range(radius + 1)) > most and width > 8:
            top, rest = low >> np.uint64(width - 4), low & np.uint64((1 << (width - 4)) - 1)
            for value in range(16):
                after = left - np.bitwise_count(top ^ np.uint64(value)).astype(np.int64)
                near = after >= 0
                yield from walk(at[near], rest[near], after[near], width - 4, above << 4 | value)
            return
        variants, owners = [], []
        for r in range(radius + 1):
            here = left == r
            masks = np.array(flips(width, r), np.uint64)
            variants.append((low[here][:, None] ^ masks).ravel())
            owners.append(np.repeat(at[here], len(masks)))
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variant, kind="stable")
        variant, owner = variant[order], owner[order]
        same = np.concatenate([[False], variant[1:] == variant[:-1], [False]])
        met = same[1:] | same[:-1]
        yield variant[met] | np.uint64(above << width), owner[met]

    left = radius - np.bitwise_count((found >> np.uint64(width)) ^ np.uint64(lead)).astype(np.int64)
    near = np.flatnonzero(left >= 0)
    yield from walk(near, found[near] & np.uint64((1 << width) - 1), left[near], width, lead)


def meetings(found: np.ndarray, width: int, lead: int, radius: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in ``found`` of fingerprints of which variants collide: (member, first of its group, the one before it)."""
    for variant, owner in collisions(found, width, lead, radius, most):
        same = np.concatenate([[False], variant[1:] == variant[:-1]])[: len(variant)]
        first = owner[np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))]
        member = np.flatnonzero(same)
        met = np.stack([owner[member], first[member], owner[member - 1]])
        yield tuple(np.unique(met, axis=1) if len(member) < 4096 else met)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position linked to each of ``n``, by hooking roots and halving paths until nothing moves."""
    parent = np.arange(n)
    while True:
        up_a, up_b = parent[a], parent[b]
        open_ = up_a != up_b
        if not open_.any():
            return parent
        a, b, up_a, up_b = a[open_], b[open_], up_a[open_], up_b[open_]
        np.minimum.at(parent, np.maximum(up_a, up_b), np.minimum(up_a, up_b))
        while (parent != (up := parent[parent])).any():
            parent = up


def link_bucket(found: np.ndarray, width: int, lead: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of distinct fingerprints that meet here, as a forest: (fingerprint, the root it leads to)."""
    total = np.arange(len(found))
    for member, first, _ in meetings(found, width, lead, radius):
        true = np.bitwise_count(found[member] ^ found[first]) <= 2 * radius
        a, b = total[member[true]], total[first[true]]
        total = forest(len(found), a, b)[total]
    moved = np.flatnonzero(total != np.arange(len(found)))
    return found[moved], found[total[moved]]


def lead_bits(n: int, radius: int, bucket_rows: int) -> int:
    """Leading bits to deal by, so that about ``bucket_rows`` of ``n`` fingerprints, or less, go to one value of them."""
    lead = 4
    while lead < 24 and n * len(flips(lead, radius)) > bucket_rows << lead:
        lead += 1
    return lead


def in_blocks(dealt: DataFrame, keys: list[str], size: Column, row: Column, most: int) -> DataFrame:
    """``dealt`` with p and q: a bucket of over ``most`` rows is cut into parts by a hash of ``row``, and each part goes to a task with each other, so every two rows still meet somewhere.

    ``size`` says for how many a row stands. A task then holds about twice
    ``most``, whatever a bucket has; others stay whole, in block (0, 0). The cut
    buckets are at most one for each ``most`` rows: that table is broadcast.
    """
    sizes = dealt.groupBy(*keys).agg(F.ceil(F.sum(size) / most).cast("int").alias("_parts")).where(F.col("_parts") > 1)
    if not sizes.take(1):
        return dealt.select("*", F.lit(0).alias("p"), F.lit(0).alias("q"))
    placed = dealt.join(F.broadcast(sizes), keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64(row), F.col("_parts")).cast("int"))
    each = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return each.select(*dealt.columns, F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q"))


def near_links(distinct: DataFrame, radius: int = 2, bucket_rows: int = 20_000, most: int = 500_000) -> DataFrame:
    """(a, b): links that connect all pairs of distinct fingerprints ``fp`` at most 2 * ``radius`` bits apart. Leading bits make buckets of about ``bucket_rows``; one of over ``most``, as a large group of like texts makes, is met in blocks."""
    if radius not in (0, 1, 2):
        raise ValueError("radius is 0, 1 or 2")
    lead = lead_bits(distinct.count(), radius, bucket_rows)
    width = BITS - lead
    masks = F.array(*[F.lit(m).cast("long") for m in flips(lead, radius)])
    dealt = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.shiftrightunsigned("fp", width).bitwiseXOR(F.col("mask")).alias("lead"))

    def link(group: pd.DataFrame) -> pd.DataFrame:
        found = np.unique(group["fp"].to_numpy(np.int64).view(np.uint64))
        a, b = link_bucket(found, width, int(group["lead"].iloc[0]), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return in_blocks(dealt, ["lead"], F.lit(1), F.col("fp"), most).groupBy("lead", "p", "q").applyInPandas(link, "a bigint, b bigint")


def hex_of(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints of ``n``-word shingles link at 2 * ``radius`` or fewer differing
    bits; component_id is the smallest doc_id reachable, the row's own included.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows stay; rows with a null key get a component of the others they link to,
    or null if they link to no key. An empty table gives no rows; other columns
    are not read.
    """
    docs = written(fingerprints(df, key, text, n), "fingerprints")
    firsts = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(near_links(firsts.select("fp"), radius))
    placed = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "fingerprint-roots")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(placed.join(named, "root").select(F.col("fp").alias("print"), "component_id"), "fingerprint-components")
    return docs.join(named, F.col("fp") == F.col("print")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


SKETCH_WORDS, TABLES, TABLE_BITS = 8, 12, 40
PART_VARIANTS = 1 << 18  # made at a time, about 15 MB
WIDE_WORDS = 32  # of the sketches of sets that meet others of another group
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * j + 1) & 0xFFFFFFFFFFFFFFFF for j in range(WIDE_WORDS)], np.uint64)


def sketch(text: str | None, n: int = 5, words: int = SKETCH_WORDS) -> tuple[bytes, bytes]:
    """(identity, sketch) of a text's set of ``n``-word shingles: a 128-bit hash of the set, and a SimHash of 64 * ``words`` bits, of which the first are those of a shorter one."""
    hashes = np.unique(shingle_hashes(text, n))
    total = np.zeros((words, BITS), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        mixed = hashes[at : at + (1 << 14)][None, :] * _MIX[:words, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(words, -1, 8), axis=2, bitorder="little")
        total += bits.sum(axis=1, dtype=np.int32)
    return xxhash.xxh128_digest(hashes.tobytes()), np.packbits(2 * total.ravel() > len(hashes), bitorder="little").tobytes()


def table_fingerprints(sketches: np.ndarray) -> np.ndarray:
    """The fingerprints of ``TABLE_BITS`` bits in a sketch, a row for each table."""
    size = TABLE_BITS // 8
    out = np.zeros((len(sketches), TABLES, 8), np.uint8)
    out[:, :, :size] = sketches[:, : TABLES * size].reshape(len(sketches), TABLES, size)
    return out.view("<u8")[:, :, 0].T


def most_differing(similarity: float, words: int = SKETCH_WORDS) -> int:
    """Bits of a sketch in which sets of this Jaccard similarity are expected to differ."""
    cosine = 2 * similarity / (1 + similarity)
    return int(words * BITS * np.arccos(min(1.0, cosine)) / np.pi)


def with_neighbours(found: np.ndarray, width: int, differ: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 1000) -> np.ndarray:
    """Whether a distinct fingerprint has another at most ``differ`` bits off that is ``wanted`` with it; only those that have need variants.

    Two such agree in one of ``differ + 1`` parts of their lower ``width`` bits,
    so those that agree in a part are compared, each with each. Where over
    ``most`` do, all of them pass for having one.
    """
    out = np.zeros(len(found), bool)
    for i in range(differ + 1):
        start, end = width * i // (differ + 1), width * (i + 1) // (differ + 1)
        part = (found >> np.uint64(start)) & np.uint64((1 << (end - start)) - 1)
        order = np.argsort(part.astype(np.uint16) if end - start <= 16 else part, kind="stable")
        part, prints = part[order], found[order]
        _, place, sizes = np.unique(part, return_inverse=True, return_counts=True)
        crowded = sizes[place] > most
        out[order[crowded]] = True
        at, step = np.flatnonzero(~crowded), 1
        while len(at := at[: np.searchsorted(at, len(found) - step)]) and len(at := at[part[at + step] == part[at]]):
            near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= differ]
            x, y = order[near], order[near + step]
            true = wanted(x, y)
            out[x[true]] = out[y[true]] = True
            step += 1
    return out


def neighbour_edges(found: np.ndarray, width: int, lead: int, radius: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint that meets ``wanted`` others here, at most two of them, its smallest and its largest in order; and for each the smallest that meetings lead to.

    Up to ``most`` that share a variant are looked at each with each; more are
    linked in a chain, wanted or not.
    """
    n = len(found)
    low, high, total = np.arange(n), np.arange(n), np.arange(n)
    some = np.flatnonzero(with_neighbours(found, width, 2 * radius, wanted))
    for variant, owner in collisions(found[some], width, lead, radius, PART_VARIANTS):
        if not len(variant):
            continue
        owner = some[owner]
        new = np.concatenate([[True], variant[1:] != variant[:-1]])
        starts = np.flatnonzero(new)
        first = starts[np.cumsum(new) - 1]
        many = np.diff(np.append(starts, len(variant)))[np.cumsum(new) - 1] > most
        chained = np.flatnonzero(many & ~new)
        met = [np.stack([owner[chained], owner[first[chained]]]), np.stack([owner[chained], owner[chained - 1]])]
        at, step = np.flatnonzero(~many), 1
        while len(at := at[: np.searchsorted(at, len(variant) - step)]) and len(at := at[variant[at + step] == variant[at]]):
            x, y = owner[at], owner[at + step]
            true = wanted(x, y)
            met.append(np.stack([x[true], y[true]]))
            step += 1
        a, b = np.concatenate(met, axis=1)
        for x, y in ((a, b), (b, a)):
            np.minimum.at(low, x, y)
            np.maximum.at(high, x, y)
        total = forest(n, total[a], total[b])[total]
    at = np.arange(n)
    return np.concatenate([at[low != at], at[high != at]]), np.concatenate([low[low != at], high[high != at]]), total


def common_variant(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One variant of all that two fingerprints share: the smaller one with half of the differing bits, the lowest, turned."""
    rest = a ^ b
    half, out = np.bitwise_count(rest) // 2, np.minimum(a, b)
    for k in range(int(half.max(initial=0))):
        bit = rest & (~rest + np.uint64(1))
        out ^= np.where(k < half, bit, np.uint64(0))
        rest ^= bit
    return out


def nearest_pairs(a: np.ndarray, b: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
    """Whether a pair is, for one of its two at least, among the ``most`` that differ in the fewest bits; of equal ones the first."""
    kept = np.zeros(len(a), bool)
    for own in (a, b):
        order = np.lexsort((bits, own))
        new = np.concatenate([[True], own[order][1:] != own[order][:-1]])[: len(order)]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        kept[order[place < most]] = True
    return kept


def crossing_pairs(prints: np.ndarray, labels: np.ndarray, sketches: np.ndarray, width: int, lead: int, radius: int, bounds: tuple[int, int], nearest: int | None = None, part: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure): positions of all fingerprints that meet here and, turned for a ``part``, for none before it, have unequal labels and sketches that differ in ``bounds[1]`` bits or less.

    Sure ones differ in ``bounds[0]`` bits or less, and join their labels from
    then on. A pair is compared at one of its common variants only, and each
    variant's members in turn with those one place on, two places on, and so on,
    so memory is that of the variants. With ``nearest``, of those that are not
    sure only so many for each fingerprint, the ones that differ least.
    """
    names, total = np.unique(labels, return_inverse=True)
    found: list[np.ndarray] = [np.zeros((4, 0), np.int64)]
    distinct, place = np.unique(prints, return_inverse=True)
    low, high = np.full(len(distinct), len(names)), np.full(len(distinct), -1)
    np.minimum.at(low, place, total)
    np.maximum.at(high, place, total)
    some = (low != high) | with_neighbours(distinct, width, 2 * radius, lambda x, y: (low[x] != low[y]) | (high[x] != high[y]))
    some = np.flatnonzero(some[place])
    for variant, owner in collisions(prints[some], width, lead, radius, PART_VARIANTS):
        if not len(variant):
            continue
        owner = some[owner]
        new = np.concatenate([[True], variant[1:] != variant[:-1]])
        starts = np.flatnonzero(new)
        mixed = (np.minimum.reduceat(total[owner], starts) != np.maximum.reduceat(total[owner], starts))[np.cumsum(new) - 1]
        variant, owner = variant[mixed], owner[mixed]
        at, step = np.arange(len(variant)), 1
        while len(at := at[: np.searchsorted(at, len(variant) - step)]) and len(at := at[variant[at + step] == variant[at]]):
            for some_at in np.array_split(at, len(at) * sketches.shape[1] // (1 << 20) + 1):
                x, y = owner[some_at], owner[some_at + step]
                here = total[x] != total[y]
                x, y, own = x[here], y[here], variant[some_at[here]]
                here = (common_variant(prints[x], prints[y]) == own) & apart_before(prints[x] ^ prints[y], part, TABLE_BITS - width, radius)
                x, y = x[here], y[here]
                bits = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64)
                near, sure = bits <= bounds[1], bits <= bounds[0]
                found.append(np.stack([x[near], y[near], sure[near].astype(np.int64), bits[near]]))
                if sure.any():
                    total = forest(len(names), total[x[sure]], total[y[sure]])[total]
            if nearest and len(found) > 64:
                found = [_open_pairs(np.concatenate(found, axis=1), total, nearest)]
            step += 1
    a, b, sure, _ = _open_pairs(np.concatenate(found, axis=1), total, nearest)
    return a, b, sure == 1


def _open_pairs(found: np.ndarray, total: np.ndarray, nearest: int | None) -> np.ndarray:
    """Of (a, b, sure, bits) the sure ones, and those that sure ones do not connect; of these, with ``nearest``, so many for each."""
    a, b, sure, bits = found
    open_ = (sure == 0) & (total[a] != total[b])
    if nearest:
        open_[open_] = nearest_pairs(a[open_], b[open_], bits[open_], nearest)
    return found[:, open_ | (sure == 1)]


def sketch_bounds(similarity: float, words: int = SKETCH_WORDS, errors: float = 3.3) -> tuple[int, int]:
    """Differing bits of sketches up to which sets are surely so similar, and up to which they can be: so many standard errors off the limit."""
    limit = most_differing(similarity, words)
    spread = int(errors * (limit * (1 - limit / (words * BITS))) ** 0.5) + 1
    return limit - spread, limit + spread


def part_bits(n: int, radius: int, bucket_rows: int) -> int:
    """Bits of a part to deal by, so that about ``bucket_rows`` of ``n`` fingerprints, or less, agree in them; at most what a part has."""
    bits = 0
    while bits < min(16, TABLE_BITS // (2 * radius + 1)) and n > bucket_rows << bits:
        bits += 1
    return bits


def turned(found: np.ndarray, part: int, radius: int) -> np.ndarray:
    """Fingerprints of a table, turned so that this one of their 2 * ``radius`` + 1 parts has the leading bits."""
    by = part * (TABLE_BITS // (2 * radius + 1))
    return (found << np.uint64(by) | found >> np.uint64(TABLE_BITS - by)) & np.uint64((1 << TABLE_BITS) - 1)


def apart_before(differing: np.ndarray, part: int, bits: int, radius: int) -> np.ndarray:
    """Whether two that differ in these bits, turned for ``part``, are dealt apart for each part before it; so a pair is taken in one place of those where it meets."""
    out = np.ones(len(differing), bool)
    for before in range(part):
        off = (before - part) * (TABLE_BITS // (2 * radius + 1)) % TABLE_BITS
        out &= (differing >> np.uint64(TABLE_BITS - off - bits)) & np.uint64((1 << bits) - 1) != 0
    return out


def dealt_tables(distinct: DataFrame, bits: int, radius: int, *others: str, rows: int = 1000) -> DataFrame:
    """(t, part, lead, prints, docs, like and ``others``): for each table and part, the fingerprints turned for it with these leading bits, as bytes; ``others`` are columns of longs or of bytes of one length.

    Two that differ in 2 * ``radius`` bits or less agree in one of 2 * ``radius``
    + 1 parts, so each goes to so many places of a table, however many rows and
    leading bits there are; without leading bits, to one. ``like`` is a word of
    the sketch that the table has no bits from. ``rows`` are dealt at a time.
    """
    width, parts = TABLE_BITS - bits, 2 * radius + 1 if bits else 1
    names = ["t", "part", "lead", "prints", "docs", "like", *others]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
                docs = batch.column("doc").to_numpy()
                held = [np.array(batch.column(c).to_pylist(), np.int64) if pa.types.is_integer(batch.column(c).type) else np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(docs), -1) for c in others]
                sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(docs), -1)
                dealt: list[tuple] = []
                for t, prints in enumerate(table_fingerprints(sketches)):
                    like = sketches.view(np.uint64)[:, (t * TABLE_BITS // BITS + SKETCH_WORDS // 2) % SKETCH_WORDS]
                    for part in range(parts):
                        found = turned(prints, part, radius)
                        to = found >> np.uint64(width)
                        order = np.argsort(to.astype(np.uint16), kind="stable")
                        values, starts = np.unique(to[order], return_index=True)
                        for value, own in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                            dealt.append((t, part, value, *[h[own].tobytes() for h in (found, docs, like, *held)]))
                kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * (3 + len(others))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in dealt], kind) for i, kind in enumerate(kinds)], names=names)

    return distinct.mapInArrow(deal, ", ".join(["t int", "part int", "lead bigint", *[f"{n} binary" for n in names[3:]]]))


def similar_links(distinct: DataFrame, similarity: float = 0.8, radius: int = 2, bucket_rows: int = 50_000, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(a, b, sure), some pairs of rows (doc, sketch) of distinct shingle sets that are about so similar; and (doc), those that meet in groups of three or more.

    Twelve fingerprints of 40 bits, each from other bits of the sketch, go
    through ball hashing of their own: two sets of Jaccard similarity 0.8 are
    within 4 bits in one of them with a probability of 0.97, of 0.9 or more with
    over 0.999. A colliding pair is verified by all 512 bits of the sketch; it
    is ``sure`` if they differ by 3.3 standard errors less than at the limit, and
    goes if by as many more.

    Fingerprints meet by chance as the square of their number, so only those are
    taken to meet that differ, in 64 bits of the sketch from outside the table,
    by no more than 5.5 standard errors over the limit, as one in 20 by chance.

    Each fingerprint is verified with two of those that it meets, which joins
    most of a large group by few pairs. Two that meet no third are verified by
    that; for the others ``crossing_links`` has the pairs that are left. Buckets
    of over ``most`` sets are met in blocks.
    """
    bits = part_bits(distinct.count(), radius, bucket_rows)
    width, (surely, at_most), (_, unlike) = TABLE_BITS - bits, sketch_bounds(similarity), sketch_bounds(similarity, 1, 5.5)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        prints, docs, like = (np.frombuffer(b"".join(group[c]), k) for c, k in (("prints", np.uint64), ("docs", np.int64), ("like", np.uint64)))
        order = np.lexsort((docs, prints))
        prints, docs, like = prints[order], docs[order], like[order]
        found, starts = np.unique(prints, return_index=True)
        # of sets with one fingerprint: bits that all have, and that some have
        every, some = np.bitwise_and.reduceat(like, starts), np.bitwise_or.reduceat(like, starts)
        part = int(group["part"].iloc[0])
        wanted = lambda x, y: (np.bitwise_count(every[x] & ~some[y] | every[y] & ~some[x]) <= unlike) & apart_before(found[x] ^ found[y], part, bits, radius)
        a, b, total = neighbour_edges(found, width, int(group["lead"].iloc[0]), radius, wanted)
        meet = total[np.searchsorted(found, prints)]
        crowd = np.bincount(meet, minlength=len(found)) > 2
        same = np.flatnonzero(prints[1:] == prints[:-1])
        top = docs[starts[np.searchsorted(found, prints[same + 1])]]
        left = np.concatenate([docs[starts[a]], docs[same + 1], docs[same + 1]])
        right = np.concatenate([docs[starts[b]], docs[same], top])
        crowded = crowd[np.concatenate([total[a], meet[same], meet[same]])]
        pairs = pd.DataFrame({"a": np.maximum(left, right), "b": np.minimum(left, right), "crowd": crowded}).drop_duplicates()
        return pairs[pairs["a"] != pairs["b"]]

    dealt = dealt_tables(distinct, bits, radius, rows=2000)
    blocks = in_blocks(dealt, ["t", "part", "lead"], F.octet_length("docs") / 8, F.col("docs"), most)
    both = written(blocks.groupBy("t", "part", "lead", "p", "q").applyInPandas(link, "a bigint, b bigint, crowd boolean"), "colliding-pairs")
    pairs = both.select("a", "b").distinct()
    crowd = both.where("crowd").select(F.col("a").alias("doc")).union(both.where("crowd").select("b")).distinct()
    left = distinct.select(F.col("doc").alias("a"), F.col("sketch").alias("sketch_a"))
    right = distinct.select(F.col("doc").alias("b"), F.col("sketch").alias("sketch_b"))

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, SKETCH_WORDS * 8) for c in ("sketch_a", "sketch_b"))
            bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            near = pa.array(bits <= at_most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(bits <= surely)], names=["a", "b", "sure"]).filter(near)

    verified = written(pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(differing, "a bigint, b bigint, sure boolean"), "near-pairs")
    return verified, written(crowd, "crowded-documents")


def wide_sketches(docs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(doc, wide): the sketch of ``WIDE_WORDS`` words of each of ``docs`` (doc), whose texts are in (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [sketch(t, n, WIDE_WORDS)[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc", "wide"])

    wanted = docs.select(F.col("doc").alias("doc_id")).distinct()
    return texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(run, "doc bigint, wide binary")


def crossing_links(labelled: DataFrame, similarity: float = 0.8, radius: int = 2, bucket_rows: int = 20_000, nearest: int | None = None, most: int = 500_000) -> DataFrame:
    """(a, b, sure): all pairs of rows (doc, sketch, wide, label) that meet in the tables of ``similar_links``, have unequal labels and are about so similar.

    Wide sketches are dealt with the fingerprints and compared where they meet,
    so however many others a set meets, each is compared, and only those within
    the limit make rows. Pairs that sure ones before them connect are left out.
    With ``nearest``, those that are not sure are only so many for each set and
    place; a call without it, once these are decided, has all that are left.
    """
    bits = part_bits(labelled.count(), radius, bucket_rows)
    width, bounds = TABLE_BITS - bits, sketch_bounds(similarity, WIDE_WORDS)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        prints, docs, labels, held = (np.frombuffer(b"".join(group[c]), k) for c, k in (("prints", np.uint64), ("docs", np.int64), ("label", np.int64), ("wide", np.uint64)))
        a, b, sure = crossing_pairs(prints, labels, held.reshape(-1, WIDE_WORDS), width, int(group["lead"].iloc[0]), radius, bounds, nearest, int(group["part"].iloc[0]))
        return pd.DataFrame({"a": np.maximum(docs[a], docs[b]), "b": np.minimum(docs[a], docs[b]), "sure": sure})

    dealt = dealt_tables(labelled, bits, radius, "label", "wide").drop("like")
    blocks = in_blocks(dealt, ["t", "part", "lead"], F.octet_length("docs") / 8, F.col("docs"), most)
    return written(blocks.groupBy("t", "part", "lead", "p", "q").applyInPandas(link, "a bigint, b bigint, sure boolean").distinct(), "crossing-pairs")


def exactly_similar(pairs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least this Jaccard similarity. ``texts`` has (doc_id, text), a row for each id at least."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [np.unique(shingle_hashes(t, n)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "found"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "found_a"):
            keep = []
            for x, y in zip(batch.column("found_a").to_pylist(), batch.column("found_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    found = written(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(sets, "doc_id bigint, found binary"), "shingle-sets")
    left = found.select(F.col("doc_id").alias("a"), F.col("found").alias("found_a"))
    right = found.select(F.col("doc_id").alias("b"), F.col("found").alias("found_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "found_a", "found_b").mapInArrow(compare, "a bigint, b bigint")


def sketches(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(doc_id, same, sketch): ``same`` is equal for equal sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [sketch(t, n) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)]], names=["doc_id", "same", "sketch"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, same binary, sketch binary")


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents by similarity of their sets of ``n``-word shingles.

    Documents of equal sets are one class; classes link where their Jaccard
    similarity is at least ``similarity``: SimHash decides it where it is 3.3
    standard errors or more off the limit, and the sets themselves where it is
    nearer. component_id is the smallest doc_id reachable.

    Each set is compared first with two of those that it meets, by 512 bits.
    Where three or more meet and are not yet of one group, 2,048 bits of each
    are compared with each: first the three nearest that the bits do not decide
    go to the sets, which joins most of a group, and then all that are left
    between different groups.

    Null and empty texts have equal, empty sets. Rows with a null key are left
    out; repeated rows stay; an empty table gives no rows.
    """
    docs = written(sketches(df.where(F.col(key).isNotNull()), key, text, n), "sketches")
    distinct = written(docs.groupBy("same").agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch")), "distinct-sketches")
    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pairs, crowd = similar_links(distinct.select("doc", "sketch"), similarity)
    roots = _joined(pairs, None, source, n, similarity)
    wide = written(wide_sketches(crowd, source, n), "wide-sketches")
    for nearest in (3, None):
        chosen = written(_labelled(distinct, roots).join(wide, "doc"), "crowded-sketches")
        roots = _joined(crossing_links(chosen, similarity, nearest=nearest), roots, source, n, similarity)
    placed = distinct.join(roots, F.col("doc") == F.col("node"), "left").select("same", F.coalesce("root", "doc").alias("component_id"))
    return docs.select("doc_id", "same").join(written(placed, "sketch-components"), "same").select("doc_id", "component_id")


def _labelled(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, sketch, label) by the roots so far."""
    return distinct.join(roots, F.col("doc") == F.col("node"), "left").select("doc", "sketch", F.coalesce("root", "doc").alias("label"))


def _joined(pairs: DataFrame, roots: DataFrame | None, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The roots by those before and by (a, b, sure): sure pairs, and the others whose sets are so similar."""
    near = exactly_similar(pairs.where(~F.col("sure")).select("a", "b"), texts, n, similarity)
    links = pairs.where("sure").select("a", "b").unionByName(near)
    if roots is not None:
        links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(links)


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """``df`` with one document of each group of ``similar_groups``: the one with the smallest key.

    Repeated rows of that key all stay, as they are one document, and so do rows
    with a null key, which belong to no group. Columns are those of ``df``.
    """
    found = similar_groups(df, key, text, n, similarity)
    gone = written(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct(), "later-documents")
    return df.join(gone, df[key].cast("long") == gone["_gone"], "left_anti")
