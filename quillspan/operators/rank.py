"""Fusion of ranked legs, boosts, caps and pages."""

from __future__ import annotations

import base64
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Boosts.
SYMBOL_BOOST, HEADING_BOOST, OTHER_CLASS_WEIGHT, FACET_BOOST = 3.0, 1.25, 0.35, 1.03
PER_SECTION = 2
MOST_FUSED = 300


def ranked(leg: DataFrame, name: str, most: int = 100) -> DataFrame:
    """(chunk_id, leg, rank): the first ``most`` of (chunk_id, score), ties by id."""
    top = leg.orderBy(F.desc("score"), "chunk_id").limit(most)
    return top.select("chunk_id", F.lit(name).alias("leg"), F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank"))


def fused(*legs: DataFrame) -> DataFrame:
    """(chunk_id, rrf, n_legs): the sum over legs of 1 / (60 + rank)."""
    both = reduce(DataFrame.unionByName, legs)
    return both.groupBy("chunk_id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"), F.count("*").alias("n_legs"))


def boost(symbol_hit: Column, heading_hit: Column, content_class: Column, n_facets: int = 0) -> Column:
    return F.when(symbol_hit, SYMBOL_BOOST).otherwise(1.0) * F.when(heading_hit, HEADING_BOOST).otherwise(1.0) * F.when(content_class != "substantive", OTHER_CLASS_WEIGHT).otherwise(1.0) * F.lit(FACET_BOOST**n_facets)


def heading_of(text: Column) -> Column:
    """The first three lines, in lower case, joined by spaces."""
    return F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, 3), " "))


def capped(df: DataFrame, section: str, score: str, key: str, most: int = PER_SECTION) -> DataFrame:
    """The first ``most`` rows of each section in order of score, ties by key; the filter on the rank lets each task drop the rest before the shuffle."""
    order = Window.partitionBy(section).orderBy(F.desc(score), key)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def page(df: DataFrame, score: str, key: str, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit in order of score, ties by key, with their position."""
    if not 1 <= limit <= 50:
        raise ValueError("limit is 1 to 50")
    if not 0 <= offset < MOST_FUSED:
        raise ValueError(f"offset is 0 to {MOST_FUSED - 1}")
    first = df.orderBy(F.desc(score), key).limit(offset + limit)
    return first.withColumn("position", F.row_number().over(Window.orderBy(F.desc(score), key))).where(F.col("position") > offset)


def request_hash(request: dict) -> str:
    """Of a request without its cursor."""
    return hashlib.sha256(json.dumps({k: v for k, v in request.items() if k != "cursor"}, sort_keys=True).encode()).hexdigest()


def encode_cursor(snapshot_id: str, request: dict, offset: int, sort_key: str) -> str:
    data = {"snapshot_id": snapshot_id, "request_hash": request_hash(request), "offset": offset, "sort_key": sort_key}
    return base64.urlsafe_b64encode(json.dumps(data).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, snapshot_id: str, request: dict, most: int = 10_000) -> tuple[int, str]:
    """(offset, sort key); ValueError if it is broken, or of another snapshot or request."""
    try:
        data = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
        offset, key = int(data["offset"]), str(data["sort_key"])
        of = data["snapshot_id"], data["request_hash"]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("the cursor is broken") from error
    if of != (snapshot_id, request_hash(request)):
        raise ValueError("the cursor is of another snapshot or request")
    if not 0 <= offset <= most:
        raise ValueError("the cursor is out of range")
    return offset, key
