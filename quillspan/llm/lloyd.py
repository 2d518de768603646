"""Plain Lloyd clustering over exact integers.

A vector's components become fixed-point integers, so distances and sums are
exact and the clusters do not depend on how rows are partitioned. In each round
the centroids go to the tasks, each task gives the nearest of every vector and
sums its own vectors by centroid, and one row a centroid and task is shuffled.
Only centroids come to the driver: ``k`` times ``dims`` integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import fresh, written

BLOCK = 1 << 20  # components whose differences a task holds at once


def largest_integer(dims: int) -> int:
    """What an integer component may be, up or down, so that no squared distance leaves a long."""
    return isqrt((1 << 62) // dims) // 2


def usable(vector: Column, dims: int, scale: int) -> Column:
    """Whether a vector has ``dims`` components, none null, NaN, infinite or too large for an exact distance."""
    most = float(largest_integer(dims)) / scale
    fits = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < most), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & fits, F.lit(False))


def integers(vectors: pd.Series, scale: int) -> np.ndarray:
    """A row a vector: floor(scale * x) of each component as a double."""
    return np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * scale).astype(np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point, the lowest of those as near, and the squared distance to it."""
    apart = np.empty((len(centroids), len(points)), np.int64)
    for j, centroid in enumerate(centroids):
        difference = points - centroid
        apart[j] = np.einsum("ij,ij->i", difference, difference)
    least = apart.argmin(axis=0)
    return least, apart[least, np.arange(len(points))]


def _blocks(frames: Iterator[pd.DataFrame], scale: int, dims: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    rows = max(1, BLOCK // dims)
    for frame in frames:
        for at in range(0, len(frame), rows):
            part = frame.iloc[at : at + rows]
            yield part, integers(part["vector"], scale)


def _moved(points: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: exact floors of means, and those of no vector as they are."""
    sent = points.sparkSession.sparkContext.broadcast(centroids)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed = sent.value
        sums, counts = np.zeros_like(fixed), np.zeros(len(fixed), np.int64)
        for _, block in _blocks(frames, scale, fixed.shape[1]):
            which, _ = nearest(block, fixed)
            counts += np.bincount(which, minlength=len(fixed))
            # rows in the order of their centroids, so that each has one run to add up
            order = np.argsort(which, kind="stable")
            met, starts = np.unique(which[order], return_index=True)
            sums[met] += np.add.reduceat(block[order], starts, axis=0)
        met = np.flatnonzero(counts)
        if len(met):
            yield pd.DataFrame({"cluster": met.astype(np.int32), "n": counts[met], "sums": list(sums[met])})

    partial = points.select("vector").mapInPandas(summed, "cluster int, n long, sums array<long>")
    sizes = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])])
    moved = centroids.copy()
    for cluster, n, *sums in sizes.collect():
        moved[cluster] = [s // n for s in sums]
    sent.destroy()
    return moved


def first_centroids(points: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``, in its order; ties by the vectors themselves."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("key", F.lit(""))), 256)
    rows = points.select("vector", order.alias("drawn")).orderBy("drawn", "vector").limit(k).collect()
    return integers(pd.Series([np.array(r.vector) for r in rows]), scale) if rows else np.empty((0, 0), np.int64)


def digest(centroid: np.ndarray) -> str:
    """sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def fit(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> np.ndarray:
    """The centroids, a row each, after ``rounds`` rounds over the usable vectors of ``df``."""
    points = _points(df, id_column, vector, dims, scale)
    centroids = first_centroids(points, k, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(points, centroids, scale)
    return centroids


def _points(df: DataFrame, id_column: str, vector: str, dims: int, scale: int) -> DataFrame:
    # an id goes through pandas as text, in which a null costs no digits
    found = df.select(df[f"`{id_column}`"].cast("string").alias("key"), df[f"`{vector}`"].alias("vector"))
    return found.where(usable(F.col("vector"), dims, scale))


def assign(df: DataFrame, centroids: np.ndarray, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, cluster int, distance long) of each usable vector: the nearest centroid and the squared distance to it."""
    name, kind = id_column, df.schema[id_column].dataType
    if not len(centroids):
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(name, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed = sent.value
        for part, block in _blocks(frames, scale, fixed.shape[1]):
            which, distance = nearest(block, fixed)
            yield pd.DataFrame({"key": part["key"].to_numpy(), "cluster": which.astype(np.int32), "distance": distance})

    found = _points(df, id_column, vector, centroids.shape[1], scale).mapInPandas(placed, "key string, cluster int, distance long")
    return found.select(F.col("key").cast(kind).alias(name), "cluster", "distance")


def cluster(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of each usable vector.

    Vectors are usable with exactly ``dims`` components, none null, NaN or
    infinite, nor of a size (2^19 for 64 components and scale 256) whose squared
    distances a long cannot hold; others get no row. Component x is
    floor(scale * x). The first centroids are the vectors with the smallest
    sha256 of ``seed:id``; where fewer than ``k`` are usable, each is one. A
    vector goes to the nearest centroid, of several as near to the lowest
    number; a centroid becomes the floor of its vectors' mean, and stays where
    it has none. Repeated rows count each; a null id counts as an empty text; an
    empty table gives none. Sums of distances beyond a long are null. Other
    columns of ``df`` do not take part.

    Sums are added within a task before the shuffle, so a cluster that holds a
    third of all rows is still one row a task. The assignment is written to the
    shared folder, so a lost executor costs the tasks it ran.
    """
    centroids = fit(df, id_column, vector, dims, scale, k, rounds, seed)
    spark = df.sparkSession
    found = written(assign(df, centroids, id_column, vector, scale), "assigned")
    # a row a centroid
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}
    total = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    number = fresh([id_column], "cluster")[0]
    rows = [(j, inertia[j], total, c.tolist(), digest(c)) for j, c in enumerate(centroids) if j in inertia]
    about = spark.createDataFrame(rows, f"{number} int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return found.join(F.broadcast(about), number)
