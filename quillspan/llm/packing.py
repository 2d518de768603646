"""Vector bin packing of examples into training sequences.

A sequence is a bin with three limits that hold at once: tokens, segments and
loss-bearing tokens. Of a bounded window of waiting pieces, the one that fits
and has the largest dot product between its demands and what is left of the
limits goes next. Where examples may be cut, a piece is cut to close a sequence
without padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import slices
from .encode import encoder_of

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary())])


class VectorPacker:
    """Packs a stream of examples; one per task.

    tokens, segments, loss: the limits of a sequence. cut: whether examples may
    be cut; if not, an example over a limit is refused with ValueError. window:
    waiting pieces among which the heuristic chooses; it bounds memory.
    """

    def __init__(self, tokens: int = 2048, segments: int = 64, loss: int | None = None, cut: bool = True, window: int = 1024):
        if min(tokens, segments, window, loss or tokens) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([tokens, segments, loss or tokens], float)
        self.tokens, self.segments, self.loss, self.cut, self.window = tokens, segments, loss or tokens, cut, window
        self.slots = window + segments  # what is cut off a sequence waits again: a piece for each segment at most
        self.demand = np.zeros((3, self.slots))
        self.weights = 1 / self.limits**2
        self.items: list = [None] * self.slots
        self.free = list(range(self.slots))

    def add(self, key, tokens: int, loss: int) -> Iterator[list[tuple]]:
        """Sequences that adding the example completes: lists of (key, start, length, offset).

        Loss-bearing tokens are the last ``loss`` of an example, as an answer follows its prompt.
        """
        if not 0 <= loss <= tokens:
            raise ValueError("loss-bearing tokens are some of an example's tokens")
        if not self.cut and (tokens > self.tokens or loss > self.loss):
            raise ValueError(f"example {key} is over a limit and may not be cut")
        start = 0
        while start < tokens:
            length = tokens - start
            room = self._prefix(length, loss, self.tokens, self.loss) if self.cut else length
            rest = min(loss, length - room)
            if room == self.tokens:
                yield [(key, start, room, 0)]
            else:
                while len(self.free) <= self.segments:
                    yield self._sequence()
                self._wait(key, start, room, loss - rest)
            start, loss = start + room, rest

    def finish(self) -> Iterator[list[tuple]]:
        """The rest. With cuts, the last tokens go to sequences whose lengths are powers of two."""
        while len(self.free) < self.slots:
            yield from self._last() if self.cut and self.demand[0].sum() < self.tokens else [self._sequence()]

    def _prefix(self, length: int, loss: int, tokens: int, most_loss: int) -> int:
        """The longest prefix of a piece within so many tokens and loss-bearing tokens."""
        return min(length, tokens, length - loss + most_loss)

    def _wait(self, key, start: int, length: int, loss: int) -> None:
        slot = self.free.pop()
        self.items[slot] = (key, start, length, loss)
        self.demand[:, slot] = length, 1, loss

    def _take(self, slot: int) -> tuple:
        item, self.items[slot] = self.items[slot], None
        self.demand[:, slot] = 0
        self.free.append(slot)
        return item

    def _sequence(self) -> list[tuple]:
        left, used, placed = self.limits.copy(), 0, []
        while left[0] >= 1 and left[1] >= 1:
            size, count, bearing = self.demand
            waiting = count > 0
            fits = waiting & (size <= left[0]) & (bearing <= left[2])
            if left[1] == 1 and self.cut:
                fits &= size == left[0]
            if fits.any():
                score = np.where(fits, (left * self.weights) @ self.demand, -1.0)
                slot = int(score.argmax())
                key, start, length, loss = self._take(slot)
            elif self.cut and waiting.any():
                slot = int(size.argmax())
                key, start, whole, loss = self.items[slot]
                length = self._prefix(whole, loss, int(left[0]), int(left[2]))
                if length < 1:
                    break
                self._take(slot)
                rest = min(loss, whole - length)
                if whole > length:
                    self._wait(key, start + length, whole - length, rest)
                loss -= rest
            else:
                break
            placed.append((key, start, length, used))
            used += length
            left -= (length, 1, loss)
        if self.cut and used < self.tokens and used & (used - 1):
            placed = self._trimmed(placed, 1 << (used.bit_length() - 1))
        return placed

    def _trimmed(self, placed: list[tuple], most: int) -> list[tuple]:
        """A sequence cut to ``most`` tokens, which needs no padding; what is cut off waits again, counted as loss-bearing throughout."""
        out = []
        for key, start, length, offset in placed:
            keep = max(0, min(length, most - offset))
            if keep:
                out.append((key, start, keep, offset))
            if keep < length:
                self._wait(key, start + keep, length - keep, length - keep)
        return out

    def _last(self) -> Iterator[list[tuple]]:
        """All that waits, less than one sequence: lengths by the binary digits of the total."""
        waiting = [i for i in range(self.slots) if self.items[i] is not None]
        total = int(self.demand[0].sum())
        items = [list(self._take(i)) for i in waiting]
        while total:
            size = 1 << (total.bit_length() - 1)
            placed, used, spent = [], 0, 0
            while used < size and len(placed) < self.segments:
                key, start, length, loss = items[-1]
                keep = self._prefix(length, loss, size - used, self.loss - spent)
                if keep < 1:
                    break
                placed.append((key, start, keep, used))
                rest = min(loss, length - keep)
                used, spent = used + keep, spent + loss - rest
                if keep == length:
                    items.pop()
                else:
                    items[-1] = [key, start + keep, length - keep, rest]
            if used & (used - 1):
                fit = 1 << (used.bit_length() - 1)
                for key, start, length, offset in reversed(placed):
                    if offset + length > fit:
                        keep = max(0, fit - offset)
                        items.append([key, start + keep, length - keep, length - keep])
                placed = [(k, s, min(n, fit - o), o) for k, s, n, o in placed if o < fit]
                used = fit
            total -= used
            yield placed


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    tokens: int = 2048,
    segments: int = 64,
    loss: int | None = None,
    window: int = 1024,
) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence, and its ids.

    A document is its whole text's ids and then ``end_id``; all of them bear
    loss. It is cut where a sequence is full. Each task packs what it reads, so
    there is no shuffle, and a lost executor's tasks give whole sequences again;
    ``sequence_id`` has the task's number in its upper bits. ``ids`` holds
    little-endian unsigned 32-bit ids.

    A null or empty text is one end id. Repeated rows are packed each on their
    own. Rows with a null key are packed too, under a null ``doc_id``. An empty
    table gives no rows. Other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        packer = VectorPacker(tokens, segments, loss, True, window)
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}
        rows: list[list] = [[] for _ in _ARROW.names]
        made = serial = 0

        def keep(sequences: Iterator[list[tuple]]) -> None:
            nonlocal made
            for placed in sequences:
                for n, start, length, offset in placed:
                    doc, ids, left = held[n]
                    held[n][2] = left - length
                    if left == length:
                        del held[n]
                    for out, value in zip(rows, (doc, start, length, len(ids) // 4, first + made, offset, ids[4 * start : 4 * (start + length)]), strict=True):
                        out.append(value)
                made += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)
            for c in rows:
                c.clear()
            return batch

        for batch in slices(batches, "text", 1 << 20):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                held[serial] = [doc, ids, len(ids) // 4]
                keep(packer.add(serial, len(ids) // 4, len(ids) // 4))
                serial += 1
            yield flush()
        keep(packer.finish())
        yield flush()

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


EXAMPLES = T.StructType([T.StructField("example_id", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("loss_tokens", T.LongType())])


def pack_examples(df: DataFrame, key: str, n_tokens: str, n_loss: str, tokens: int = 2048, segments: int = 64, loss: int | None = None, window: int = 1024) -> DataFrame:
    """Whole instruction examples, of known token and loss-bearing counts, placed in sequences.

    No example is cut; one that is over a limit fails the job, with its key in
    the message. Null counts are taken as 0; an example of no tokens takes a
    segment of no length. Repeated rows are placed each on their own. An empty
    table gives no rows; other columns are not read.
    """
    names = [f.name for f in EXAMPLES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(tokens, segments, loss, False, window)
        first, made = TaskContext.get().partitionId() << 40, 0

        def rows(sequences: Iterator[list[tuple]]) -> list[tuple]:
            nonlocal made
            out = []
            for placed in sequences:
                out += [(key[0], first + made, offset, length, key[1]) for key, _, length, offset in placed]
                made += 1
            return out

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(5)], names=names)

        for batch in batches:
            found: list[tuple] = []
            for k, n, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if n == 0:
                    found += rows([[((k, 0), 0, 0, 0)]])
                else:
                    found += rows(packer.add((k, m), n, m))
            yield batch_of(found)
        yield batch_of(rows(packer.finish()))

    cols = [F.col(key).cast("long").alias("k"), F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)).alias("n"), F.coalesce(F.col(n_loss).cast("long"), F.lit(0)).alias("m")]
    return df.select(cols).mapInArrow(run, EXAMPLES)
