"""Exact search by cosine over arrays of floats, inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Of length 1; a vector that is zero or not finite is an error."""
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.raise_error("vector is zero or not finite"))


def top_k(df: DataFrame, key: str, vector: str, query: list[float], k: int, allowed: Column | None = None) -> DataFrame:
    """(key, score) of the ``k`` nearest by cosine, ties by key; scores are shown to six places and ranked as they are.

    The filter goes before the arithmetic; each task keeps its own first k. A
    vector of another size than the query is an error, as is one that is zero or
    not finite.
    """
    if k < 1:
        raise ValueError("k is 1 or more")
    length = math.sqrt(math.fsum(x * x for x in query))
    if not query or not math.isfinite(length) or length == 0:
        raise ValueError("the query is empty, zero or not finite")
    unit = F.array(*[F.lit(x / length) for x in query])
    rows = df if allowed is None else df.where(allowed)
    held = F.when(F.size(vector) == len(query), F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector has another size than the query's {len(query)}")))
    scored = rows.select(key, dot(normalized(held), unit).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k).withColumn("score", F.round("score", 6))


def health(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Counts of vectors, and of those of another size, with a number that is not finite, and not of length 1 within 1e-4."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(True))).alias
    return df.agg(F.count("*").alias("n_vectors"), count(F.size(v) != dimension)("n_wrong_size"), count(~finite)("n_not_finite"), count(F.abs(norm(v) - 1) > 1e-4)("n_not_unit"))
