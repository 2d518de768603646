"""Embeddings behind a protocol, and the stored table of vectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector

#: Prefixes of texts and of queries, and texts in a batch.
PASSAGE, QUERY = "passage: ", "query: "
BATCH = 32
VECTOR_VERSION = 1


class Embedder(Protocol):
    """What a build and a search need of a model; it is pickled to the executors."""

    def spec(self) -> dict: ...

    def count_tokens(self, text: str) -> int: ...

    def embed_passages(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...

    def artifacts(self) -> dict[str, str]:
        """Checksums of the model's files, by name."""
        ...


@dataclass(frozen=True)
class HashingEmbedder:
    """A model without weights: signed counts of words and their parts by hashes. For tests, and where no model is at hand."""

    dimension: int = 64

    def spec(self) -> dict:
        return {"model": "hashing", "dimension": self.dimension, "version": 1}

    def count_tokens(self, text: str) -> int:
        return len(text.split()) + 2

    def embed_passages(self, texts: list[str]) -> list[list[float]]:
        return [self._embed(PASSAGE, t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._embed(QUERY, text)

    def artifacts(self) -> dict[str, str]:
        return {}

    def _embed(self, prefix: str, text: str) -> list[float]:
        out = [0.0] * self.dimension
        for word in text.lower().split() or [prefix]:
            for place, sign in _hashed(word, self.dimension):
                out[place] += sign
        return out if any(out) else np.eye(1, self.dimension)[0].tolist()


@lru_cache(1 << 14)
def _hashed(word: str, dimension: int) -> list[tuple[int, int]]:
    """(place, sign) of a word and of its parts."""
    found = []
    for part in {word, *(word[i : i + 4] for i in range(max(0, len(word) - 3)))}:
        digest = int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        found.append((digest % dimension, 1 if digest >> 32 & 1 else -1))
    return found


def checked(values: list[float], dimension: int) -> list[float]:
    """Of length 1; ValueError for another size, or what is zero or not finite."""
    length = math.sqrt(math.fsum(x * x for x in values)) if all(map(math.isfinite, values)) else math.nan
    if len(values) != dimension or not 0 < length < math.inf:
        raise ValueError(f"a vector must have {dimension} finite numbers, not all zero")
    return [x / length for x in values]


def embedded(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """(content_hash, embedding) of (content_hash, text), in the model's batches, of length 1."""
    size = embedder.spec()["dimension"]
    schema = pa.schema([("content_hash", pa.string()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, BATCH) for at in range(0, whole.num_rows, BATCH)):
                made = [checked(v, size) for v in embedder.embed_passages(batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("content_hash"), pa.array(made, pa.list_(pa.float32()))], schema=schema)

    # a model takes long for a text's bytes, by which alone what is grouped would come in few tasks; what is grouped by the hash is not dealt by it alone again
    dealt = texts.select("content_hash", "text").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "content_hash", "text")
    return dealt.mapInArrow(run, "content_hash string, embedding array<float>")


def vectors(chunks: DataFrame, embedder: Embedder, stored: DataFrame | None = None) -> DataFrame:
    """(vector_row, chunk_id, content_hash, embedding, reused) of chunks: a stored vector of the same content, the one with the smallest row, is taken; each other content is embedded once, for all its chunks."""
    wanted = chunks.groupBy("content_hash").agg(F.min("text").alias("text"))
    rows = chunks.select("vector_row", "chunk_id", "content_hash")
    if stored is None:
        made = embedded(wanted, embedder).withColumn("reused", F.lit(False))
    else:
        known = stored.groupBy("content_hash").agg(F.min_by("embedding", "vector_row").alias("embedding"))
        missing = wanted.join(known.select("content_hash"), "content_hash", "left_anti")
        held = known.join(wanted.select("content_hash"), "content_hash", "left_semi").withColumn("reused", F.lit(True))
        made = held.unionByName(embedded(missing, embedder).withColumn("reused", F.lit(False)))
    return rows.join(made, "content_hash").select("vector_row", "chunk_id", "content_hash", "embedding", "reused")


def verified(table: DataFrame, dimension: int) -> DataFrame:
    """A stored table of vectors, opened: ValueError if rows are not 0, 1, 2 and so on, or a vector is of another size, not finite or not of length 1."""
    from .navigate import dense

    found = vector.health(table, "embedding", dimension).first()
    if found["n_wrong_size"] or found["n_not_finite"] or found["n_not_unit"]:
        raise ValueError(f"vectors are damaged: {found.asDict()}")
    if not dense(table, "vector_row").first()["contiguous"]:
        raise ValueError("vector rows have gaps or repeats")
    return table


def row(table: DataFrame, number: int) -> list[float]:
    """One vector by its row; ValueError beyond the table."""
    found = table.where(F.col("vector_row") == number).select("embedding").take(1)
    if not found:
        raise ValueError(f"there is no vector row {number}")
    return list(found[0]["embedding"])
