"""First k texts of each query by scores of blocks, without reading the blocks that cannot matter.

A block's bound is the score of its shortest text with its greatest frequency. A
first read, of the best blocks of a query's heaviest terms, gives k texts, and
their least score a threshold that the first k reach in any case. Terms that
together stay below it need not be read through: every text among the first k
has another term. So the other terms' blocks are read where they can reach the
threshold with all else at its best, and the texts in them are candidates. Of
the light terms then only the blocks with a candidate are read that can still
reach it with what its blocks promise.

Every step is a join or an aggregate over blocks, and all queries of a table go
through it together. Blocks are shuffled as they are, packed, to the ranges of
document numbers that they reach into; scores of a range are summed there as an
array a query, and only those that can matter leave it. So what is shuffled
grows with the blocks, and not with queries times texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import blocks
from quillspan.operators.blocks import decoded
from quillspan.operators.index import Index
from quillspan.operators.lexical import saturation
from quillspan.store import written

#: Scores are compared and shown to six places, so what is nearer than this may be equal.
MARGIN = 2e-6
KEY = ["field", "term"]
#: Document numbers of a range whose scores one task sums, at most and at least, and queries that it does so for.
WIDEST, NARROWEST, QUERIES = 1 << 15, 1 << 10, 256
#: Terms that are told to the scan of the blocks.
TOLD = 64
PACKED = ("first", "n", "shortest", "gap_bits", "tf_bits", "length_bits", "gaps", "tfs", "lengths")


@dataclass(frozen=True)
class First:
    """Scores of what may be among the first k, ties included, and the blocks that are read for it."""

    scores: DataFrame  # query_id, doc_no, score
    asked: DataFrame  # query_id, field, term, weight, mean and what is known of the term's blocks
    seeds: DataFrame  # field, term, first: blocks read for the threshold
    heavy: DataFrame  # blocks of terms that are read for candidates
    light: DataFrame | None  # blocks of the other terms that a candidate is in; None if there are no such terms


def first(index: Index, clauses: DataFrame, k: int, binary: bool = True, allowed: DataFrame | None = None) -> First:
    """What may be among the first ``k`` of each query of ``clauses`` (query_id, field, term, weight, mean).

    A text's score is the sum over its clauses of weight times the saturation of
    its frequency, or of 1. A term that a query asks for twice in a field counts
    twice. ``allowed`` (doc_no) leaves other documents out, of the threshold too.

    Three tables are written on the way: the plan of the terms, the candidates,
    and the blocks that these are in. Blocks' bounds are read from the index
    again where they are needed, without the packed columns.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    terms = clauses.groupBy("query_id", *KEY, "mean").agg(F.sum("weight").alias("weight"))
    reach = saturation(F.lit(1.0) if binary else F.col("most").cast("double"), F.col("shortest").cast("double"), F.col("mean"))

    def heads(of: DataFrame) -> DataFrame:
        """Blocks of some terms, with what each can give for a weight of 1."""
        return index.blocks.select(*KEY, "first", "last", "n", "shortest", "most").join(of.select(*KEY, "mean").distinct(), KEY).withColumn("reach", reach).select(*KEY, "first", "last", "n", "reach")

    known = heads(terms).groupBy(*KEY).agg(F.max("reach").alias("peak"), F.sum("n").alias("n_with"), F.count("*").alias("n_blocks"), F.min("first").alias("least"), F.max("last").alias("greatest"))
    # blocks of a term are about as wide as its range divided by their number
    width = F.greatest(F.lit(1), F.ceil((F.col("greatest") - F.col("least") + 1) / F.col("n_blocks"))).cast("long")
    asked = terms.join(known, KEY).select("query_id", *KEY, "weight", "mean", (F.col("weight") * F.col("peak")).alias("bound"), "n_with", "n_blocks", width.alias("width"))
    # a query's terms are few: its windows are over them
    heaviest = Window.partitionBy("query_id").orderBy(F.desc("bound"), *KEY).rowsBetween(Window.unboundedPreceding, -1)
    asked = written(asked.withColumn("seed", F.coalesce(F.sum("n_with").over(heaviest), F.lit(0)) < k), "asked")

    best = Window.partitionBy(*KEY).orderBy(F.desc("reach"), "first")
    seeds = heads(asked.where("seed")).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).select(*KEY, "first")
    threshold = _kth(scored(index, _blocks(index, seeds), asked.where("seed"), binary, k, allowed), k)
    lightest = Window.partitionBy("query_id").orderBy("bound", *KEY)
    planned = asked.join(threshold, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - MARGIN)
    planned = planned.withColumns({"light": F.sum("bound").over(lightest) < F.col("least"), "others": F.sum("bound").over(Window.partitionBy("query_id")) - F.col("bound")})
    # no more candidates than postings of heavy terms: a light term with fewer postings is read through as well
    most = F.sum(F.when(F.col("light"), 0).otherwise(F.col("n_with"))).over(Window.partitionBy("query_id"))
    planned = written(planned.withColumn("light", F.col("light") & (F.col("n_with") > most)), "planned")

    own = planned.where(~F.col("light"))
    heavy = heads(own).join(own.select("query_id", *KEY, "weight", "others", "least"), KEY).where(F.col("weight") * F.col("reach") + F.col("others") >= F.col("least")).select(*KEY, "first").distinct()
    rest = planned.groupBy("query_id").agg(F.sum(F.when(F.col("light"), F.col("bound")).otherwise(0.0)).alias("rest"), F.first("least").alias("least"))
    # what cannot reach the threshold with all light terms at their best does not leave its range
    sums = scored(index, _blocks(index, heavy), own.drop("least").join(rest.select("query_id", (F.col("least") - F.col("rest")).alias("least")), "query_id"), binary, None, allowed)
    faint = planned.where("light").select("query_id", *KEY, "weight", "mean", "width")
    if not faint.take(1):
        return First(sums, asked, seeds, heavy, None)
    found = written(sums.join(rest, "query_id").select("query_id", "doc_no", "score", "least"), "candidates")

    # which block of a light term a candidate would be in: by ranges as wide as the term's blocks
    probes = found.join(faint, "query_id").withColumn("_range", F.expr("doc_no div width"))
    ranges = F.explode(F.sequence(F.expr("first div width"), F.expr("last div width")))
    spread = heads(faint).join(faint.select(*KEY, "width").distinct(), KEY).withColumn("_range", ranges).select(*KEY, "_range", "first", "last", "reach")
    met = probes.join(spread, [*KEY, "_range"]).where(F.col("doc_no").between(F.col("first"), F.col("last")))
    each = ["query_id", "doc_no"]
    met = written(met.select(*each, *KEY, "first", "weight", "mean", (F.col("weight") * F.col("reach")).alias("promised")), "met")
    hopeful = found.join(met.groupBy(*each).agg(F.sum("promised").alias("promised")), each, "left")
    hopeful = hopeful.where(F.col("score") + F.coalesce("promised", F.lit(0.0)) >= F.col("least")).select(*each, "score")
    wanted = met.join(hopeful.select(*each), each, "left_semi")
    light = wanted.select(*KEY, "first").distinct()
    more = _postings(index, light).join(wanted, ["doc_no", *KEY]).select(*each, (F.col("weight") * _saturated(binary)).alias("score"))
    full = hopeful.unionByName(more).groupBy(*each).agg(F.sum("score").alias("score"))
    return First(full, asked, seeds, heavy, light)


def _saturated(binary: bool) -> Column:
    return saturation(F.lit(1.0) if binary else F.col("tf").cast("double"), F.col("length").cast("double"), F.col("mean"))


def _blocks(index: Index, chosen: DataFrame) -> DataFrame:
    return index.blocks.join(chosen, [*KEY, "first"], "left_semi")


def _postings(index: Index, chosen: DataFrame) -> DataFrame:
    return decoded(_blocks(index, chosen))


def best(index: Index, clauses: DataFrame, k: int, binary: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_no, score) of what may be among the first ``k`` of each query, by all postings of its terms: as ``first``, without bounds."""
    if k < 1:
        raise ValueError("k is at least 1")
    asked = written(clauses.select("query_id", *KEY, "weight", "mean"), "asked")
    told = asked.select(*KEY).distinct().limit(TOLD + 1).collect()
    held = index.blocks
    if len(told) <= TOLD:
        held = held.where(F.col("term").isin(sorted({r["term"] for r in told})) & F.col("field").isin(sorted({r["field"] for r in told})))
    return scored(index, held, asked, binary, k, allowed)


def scored(index: Index, held: DataFrame, asked: DataFrame, binary: bool, k: int | None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_no, score) by blocks of the index, over clauses (query_id, field, term, weight, mean) of each query.

    ``k`` keeps of each range of numbers the first k of a query, with what is as
    near as a tie; without it, a column least of the clauses tells the score
    that counts. ``allowed`` (doc_no) leaves other documents out. A task holds
    the postings of a range's texts that are asked for, and ``QUERIES`` queries.
    """
    spark = index.spark
    if index.manifest["removals"]:
        allowed = index.docs.select("doc_no") if allowed is None else index.docs.select("doc_no").join(allowed, "doc_no", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = min(WIDEST, max(NARROWEST, -(-index.manifest["next"] // (2 * parts))))
    n_ranges = max(1, -(-index.manifest["next"] // width))
    n_groups = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
    asked = asked.withColumn("_group", F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).cast("int"))
    reach = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width)))
    # a row a term and group of queries
    left = held.select(*KEY, "last", *PACKED).join(asked.select(*KEY, (F.col("_group") + 0).alias("_group")).distinct(), KEY).withColumn("_range", reach).drop("last")
    if allowed is not None:
        listed = allowed.select("doc_no", F.floor(F.col("doc_no") / width).alias("_range")).groupBy("_range").agg(F.collect_list("doc_no").alias("_allowed"))
        left = left.unionByName(listed.crossJoin(F.broadcast(spark.range(n_groups).select(F.col("id").cast("int").alias("_group")))), allowMissingColumns=True)
    right = asked.crossJoin(F.broadcast(spark.range(n_ranges).select(F.col("id").alias("_range"))))
    n, by = min(4096, max(parts, n_ranges * n_groups)), ["_range", "_group"]
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_no bigint, score double"
    sides = (df.repartition(n, *by).groupBy(*by) for df in (left, right))
    return next(sides).cogroup(next(sides)).applyInArrow(_summed(width, binary, k, allowed is not None), schema)


def _summed(width: int, binary: bool, k: int | None, filtered: bool) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        base = key[0].as_py() * width
        names = pc.binary_join_element_wise(right["field"], right["term"], "\0").combine_chunks()
        vocabulary = names.unique()
        asked = pc.index_in(names, value_set=vocabulary).to_numpy(zero_copy_only=False)
        weight, mean = right["weight"].to_numpy(), right["mean"].to_numpy()
        shown = np.ones(width, bool)
        if filtered:
            shown = np.zeros(width, bool)
            shown[pc.list_flatten(left["_allowed"]).to_numpy().astype(np.int64) - base] = True
            left = left.filter(pc.is_valid(left["term"]))
        found: list[tuple[np.ndarray, ...]] = []
        for batch in left.combine_chunks().to_batches():
            of = pc.index_in(pc.binary_join_element_wise(batch.column("field"), batch.column("term"), "\0"), value_set=vocabulary).to_numpy(zero_copy_only=False)
            at = 0
            for part in blocks.portions(batch, batch.column("n").to_numpy(zero_copy_only=False)):
                owner, doc, tf, length = blocks.numbers_of(part)
                doc -= base
                here = (doc >= 0) & (doc < width)
                here[here] = shown[doc[here]]
                found.append((of[at : at + part.num_rows][owner[here]].astype(np.int32), doc[here].astype(np.int32), tf[here].astype(np.float32 if binary else np.float64), length[here].astype(np.float64)))
                at += part.num_rows
        term, doc, tf, length = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        order = np.argsort(term, kind="stable")
        doc, tf, length = doc[order], tf[order], length[order]
        ends = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        gains: dict[tuple[int, float], np.ndarray] = {}

        def gain(t: int, m: float) -> np.ndarray:
            if (t, m) not in gains:
                own = slice(ends[t], ends[t + 1])
                gains[t, m] = saturation(1.0 if binary else tf[own], length[own], m)
            return gains[t, m]

        queries = right["query_id"].combine_chunks().dictionary_encode()
        query = queries.indices.to_numpy(zero_copy_only=False)
        by_query = np.argsort(query, kind="stable")
        borders = np.searchsorted(query[by_query], np.arange(len(queries.dictionary) + 1))
        sums, touched = np.zeros(width), np.zeros(width, bool)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q in range(len(queries.dictionary)):
            clauses = by_query[borders[q] : borders[q + 1]]
            sums[:], touched[:] = 0, False
            for c in clauses.tolist():
                t = asked[c]
                at = doc[ends[t] : ends[t + 1]]
                sums[at] += weight[c] * gain(t, mean[c])
                touched[at] = True
            texts = np.flatnonzero(touched)
            score = sums[texts]
            if k is None:
                kept = score >= right["least"][int(clauses[0])].as_py()
            elif len(score) > k:
                kept = score >= np.partition(score, len(score) - k)[len(score) - k] - MARGIN
            else:
                kept = np.ones(len(score), bool)
            out.append((np.full(int(kept.sum()), q, np.int32), texts[kept] + base, score[kept]))
        of, doc_no, score = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
        columns = [queries.dictionary.take(pa.array(of, pa.int32())), pa.array(doc_no.astype(np.int64)), pa.array(score.astype(np.float64))]
        return pa.Table.from_arrays(columns, names=["query_id", "doc_no", "score"])

    return run


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th score of each query that has so many; the rank filter works before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_no")
    cut = scores.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return cut.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")
