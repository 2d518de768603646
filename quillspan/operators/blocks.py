"""Postings in compressed blocks.

A row is a block: at most 128 postings of a term in a field, in the order of
their document numbers. Gaps between numbers, frequencies, lengths and gaps
between positions are packed, each column in as many bits as its widest value in
the block needs. Beside them lie the block's first and last number, its shortest
text and its greatest frequency, from which a bound of all its scores follows
for any statistics of the whole index.

Both directions work on all blocks of an Arrow batch at once, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SIZE = 128  # postings of a block, at most
#: Places that are packed or unpacked at once: each takes some hundred bytes meanwhile, as every bit of it is an array's item.
AT_ONCE = 1 << 17
POSTING = "field string, term string, doc_no bigint, tf bigint, length bigint"
BLOCK = "field string, term string, first bigint, last bigint, n int, n_places bigint, shortest bigint, most bigint, gap_bits tinyint, tf_bits tinyint, length_bits tinyint, place_bits tinyint, gaps binary, tfs binary, lengths binary, places binary"


#: Postings of a term in some successive documents, as they come from one part of the texts.
RUN = "field string, term string, first bigint, n_places bigint, doc_nos array<bigint>, tfs array<bigint>, lengths array<bigint>, positions array<int>"
RUN_SIZE = 4 * SIZE  # postings of a run, at most


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 and so on within each of the runs of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Bits a value, and packed bytes, of each block; ``counts`` values that are not negative are of a block."""
    owner = np.repeat(np.arange(len(counts)), counts)
    widest = np.zeros(len(counts), np.int64)
    np.maximum.at(widest, owner, values)
    # the bits of a number: where it lies among the powers of two
    width = np.searchsorted(1 << np.arange(63, dtype=np.int64), widest, side="right")
    size = (counts * width + 7) // 8
    began = np.cumsum(size) - size
    own = width[owner]
    place = 8 * began[owner] + _runs(counts) * own
    bit = _runs(own)
    flags = np.zeros(8 * int(size.sum()), np.uint8)
    flags[np.repeat(place, own) + bit] = (np.repeat(values, own) >> bit) & 1
    data = np.packbits(flags, bitorder="little")
    offsets = np.concatenate([began, [size.sum()]]).astype(np.int32)
    return width.astype(np.int8), pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(width: np.ndarray, packed: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The values of all blocks, one after the other."""
    width = width.astype(np.int64)
    offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset).astype(np.int64)
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    flags = np.unpackbits(data, bitorder="little")
    own = np.repeat(width, counts)
    place = 8 * np.repeat(offsets[:-1] - offsets[0], counts) + _runs(counts) * own
    bit = _runs(own)
    out = np.zeros(len(own), np.int64)
    some = own > 0
    if some.any():
        parts = flags[np.repeat(place, own) + bit].astype(np.int64) << bit
        out[some] = np.add.reduceat(parts, (np.cumsum(own) - own)[some])
    return out


def portions(batch: pa.RecordBatch, sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, so many at a time that their sizes make at most ``most``, or one."""
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        passed = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, passed + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def run_rows(doc_nos: np.ndarray, field: str, lengths: np.ndarray, tokens: pa.Array) -> pa.RecordBatch:
    """The runs of some texts in ascending order of their numbers: ``lengths`` tokens are of each."""
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, place = np.repeat(np.arange(len(doc_nos)), lengths), _runs(lengths)
    order = np.argsort(code * len(doc_nos) + owner, kind="stable")
    code, owner, place = code[order], owner[order], place[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    posting = np.flatnonzero(new)
    tf = np.diff(np.append(posting, len(code)))
    of, text = code[posting], owner[posting]
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    start = np.flatnonzero(new)
    new[_runs(np.diff(np.append(start, len(of)))) % RUN_SIZE == 0] = True
    start = np.flatnonzero(new)
    ends, places = np.append(start, len(of)).astype(np.int32), np.append(posting[start], len(code)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64))) for x in (doc_nos[text], tf, lengths[text])]
    lists.append(pa.ListArray.from_arrays(pa.array(places), pa.array(place.astype(np.int32))))
    terms = coded.dictionary.take(pa.array(of[start]))
    columns = [pa.array([field] * len(start), pa.string()), terms.cast(pa.string()), pa.array(doc_nos[text[start]]), pa.array(np.diff(places).astype(np.int64)), *lists]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RUN.split(", ")])


def _opened(runs: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of runs."""
    owner = pa.array(np.repeat(np.arange(runs.num_rows), pc.list_value_length(runs.column("doc_nos")).to_numpy(zero_copy_only=False)))
    tf = runs.column("tfs").flatten()
    offsets = np.append(0, np.cumsum(tf.to_numpy(zero_copy_only=False))).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(offsets), runs.column("positions").flatten())
    columns = [runs.column("field").take(owner), runs.column("term").take(owner), runs.column("doc_nos").flatten(), tf, runs.column("lengths").flatten(), positions]
    return pa.RecordBatch.from_arrays(columns, names=["field", "term", "doc_no", "tf", "length", "positions"])


def of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (field, term, doc_no, tf, length, positions) of batches of runs, in the task that made them: a step of its own would be a second Python process for each task."""
    for batch in batches:
        for part in portions(batch, batch.column("n_places").to_numpy(zero_copy_only=False)):
            yield _opened(part)


def _encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    field, term = batch.column("field"), batch.column("term")
    numbers = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_no", "tf", "length")}
    changes = np.ones(n, bool)
    changes[1:] = pc.or_(pc.not_equal(field[1:], field[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(changes)
    first = changes | (_runs(np.diff(np.append(starts, n))) % SIZE == 0)
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, n))
    gaps = np.diff(numbers["doc_no"], prepend=0)
    gaps[starts] = 0
    shortest = np.minimum.reduceat(numbers["length"], starts)
    held = batch.column("positions")
    places = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    steps = np.diff(places, prepend=0)
    begin = np.cumsum(numbers["tf"]) - numbers["tf"]
    steps[begin] = places[begin]
    n_places = np.add.reduceat(numbers["tf"], starts)
    packed = [pack(gaps, counts), pack(numbers["tf"] - 1, counts), pack(numbers["length"] - np.repeat(shortest, counts), counts), pack(steps, n_places)]
    columns = [field.take(pa.array(starts)), term.take(pa.array(starts)), numbers["doc_no"][starts], numbers["doc_no"][starts + counts - 1], counts.astype(np.int32), n_places, shortest, np.maximum.reduceat(numbers["tf"], starts)]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in [*columns, *[w for w, _ in packed], *[d for _, d in packed]]]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BLOCK.split(", ")])


def encoded(postings: DataFrame) -> DataFrame:
    """Blocks of postings (field, term, doc_no, tf, length, positions), or of runs, whose partitions are sorted by field, term and number.

    A block ends with its term, after 128 postings, or with a portion of its
    Arrow batch, so a term of any number of postings is encoded by as many tasks
    as hold it, and nothing is gathered.
    """
    as_runs = "doc_nos" in postings.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, batch.column("n_places" if as_runs else "tf").to_numpy(zero_copy_only=False)):
                yield _encoded(_opened(part) if as_runs else part)

    columns = [c.split()[0] for c in RUN.split(", ")] if as_runs else ["field", "term", "doc_no", "tf", "length", "positions"]
    return postings.select(*columns).mapInArrow(run, BLOCK)


def decoded(blocks: DataFrame, positions: bool = False) -> DataFrame:
    """Postings (field, term, doc_no, tf, length, and positions if asked) of blocks; their packed positions are read only then. Other columns of ``blocks`` are not kept."""
    packed = ["gaps", "tfs", "lengths"] + ["places"] * positions
    bits = ["gap_bits", "tf_bits", "length_bits"] + ["place_bits"] * positions
    schema = POSTING + ", positions array<int>" * positions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, batch.column("n_places" if positions else "n").to_numpy(zero_copy_only=False)):
                yield postings_of(part, positions)

    return blocks.select("field", "term", "first", "n", "shortest", "n_places", *bits, *packed).mapInArrow(run, schema)


def numbers_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(the block that it is in, number, tf, length) of each posting of a batch of blocks."""
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = number("n")
    gaps, tfs, lengths = (unpack(number(b), batch.column(c), counts) for b, c in (("gap_bits", "gaps"), ("tf_bits", "tfs"), ("length_bits", "lengths")))
    passed = np.cumsum(gaps)
    starts = np.cumsum(counts) - counts
    docs = passed - np.repeat(passed[starts], counts) + np.repeat(number("first"), counts)
    return np.repeat(np.arange(batch.num_rows), counts), docs, tfs + 1, lengths + np.repeat(number("shortest"), counts)


def postings_of(batch: pa.RecordBatch, positions: bool = False) -> pa.RecordBatch:
    """Postings of the blocks of a batch, all at once."""
    owner, docs, tfs, lengths = numbers_of(batch)
    columns = [batch.column("field").take(pa.array(owner)), batch.column("term").take(pa.array(owner)), pa.array(docs), pa.array(tfs), pa.array(lengths)]
    names = [c.split()[0] for c in POSTING.split(", ")]
    if positions:
        number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        steps = unpack(number("place_bits"), batch.column("places"), number("n_places"))
        passed = np.cumsum(steps)
        begin = np.cumsum(tfs) - tfs
        at = passed - np.repeat(passed[begin] - steps[begin], tfs)
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, tfs.sum()).astype(np.int32)), pa.array(at.astype(np.int32))))
        names.append("positions")
    return pa.RecordBatch.from_arrays(columns, names=names)
