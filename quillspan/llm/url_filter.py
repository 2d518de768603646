"""URL filter: rules on hosts and paths, and a ratio of character language models for the rest.

The accepted and the rejected URLs, as rules decide them, train a smoothed
variable-order Markov model of characters each. A URL that no rule fits goes by
the difference of its two log-likelihoods, divided by its length, against a
threshold that is calibrated on URLs which the models did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import fresh, slices, without, written

ORDER = 5  # characters of context at most
ALPHABET = 256


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there to ``?``, ``#`` or the end. Both are empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, gram) of each byte and end of the URLs: the byte in the lowest eight bits, above it the ``ORDER`` bytes before it, which do not reach before its URL's start marks."""
    pad = b"\x01" * ORDER
    raw = [pad + u.encode("utf-8", "surrogatepass") + b"\x02" for u in urls]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(raw)), lengths)
    real = np.arange(len(data)) - np.repeat(starts, lengths) >= ORDER
    gram = data.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= data[:-k] << (8 * k)
    return owner[real], gram[real]


def url_hashes(url: Column) -> list[Column]:
    """Two hashes that share no state: a URL's name in 128 bits, however long it is."""
    return [F.xxhash64(url).alias("u1"), F.xxhash64(F.concat(F.lit("\x01"), url)).alias("u2")]


def url_grams(df: DataFrame, url: str) -> DataFrame:
    """(u1, u2, gram, n): how often each gram, of each byte and end, is in each row's URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "url", 1 << 18):
            if batch.num_rows:
                owner, gram = _grams(batch.column("url").to_pylist())
                order = np.lexsort((gram, owner))
                owner, gram = owner[order], gram[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])]))
                names = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays([batch.column("u1").take(names), batch.column("u2").take(names), pa.array(gram[first]), pa.array(np.diff(np.append(first, len(gram))))], names=["u1", "u2", "gram", "n"])

    seen = F.coalesce(F.col(url), F.lit(""))
    return df.select(*url_hashes(seen), seen.alias("url")).mapInArrow(run, "u1 bigint, u2 bigint, gram bigint, n bigint")


def count_grams(df: DataFrame) -> DataFrame:
    """(gram, accepted, rejected): how often each gram occurs in the rows of (url, verdict), exactly; a task sums its own before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "url", 1 << 20):
            if not batch.num_rows:
                continue
            owner, gram = _grams(batch.column("url").to_pylist())
            allowed = np.array([v == "allow" for v in batch.column("verdict").to_pylist()])[owner]
            found, at = np.unique(gram, return_inverse=True)
            sums = [np.bincount(at[which], minlength=len(found)) for which in (allowed, ~allowed)]
            yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], names=["gram", "accepted", "rejected"])

    rows = df.select(F.coalesce("url", F.lit("")).alias("url"), "verdict").mapInArrow(run, "gram bigint, accepted bigint, rejected bigint")
    return written(rows.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams")


def gram_ratios(counts: DataFrame, wanted: DataFrame, strength: float = 2.0) -> DataFrame:
    """(gram, ratio) of distinct grams: the log of the accepted over the rejected model's probability of its byte after its context.

    Longer contexts are interpolated with shorter ones by Witten and Bell's idea
    with a constant: each order takes ``strength`` counts from the one below.
    The ratio is a whole number of 2**-40, so that sums do not depend on their order.
    """
    models = ("accepted", "rejected")
    totals = counts.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in models]).first()
    out = wanted.select("gram", *[F.lit(1 / ALPHABET).alias(f"p_{m}") for m in models])
    for k in range(ORDER + 1):
        joint, context = F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1), F.shiftright("gram", 8).bitwiseAND((1 << 8 * k) - 1)
        out = out.withColumns({"joint": joint, "context": context})
        out = out.join(counts.groupBy(joint.alias("joint")).agg(*[F.sum(m).alias(f"n_{m}") for m in models]), "joint", "left")
        if k:
            out = out.join(counts.groupBy(context.alias("context")).agg(*[F.sum(m).alias(f"of_{m}") for m in models]), "context", "left")
        else:
            out = out.withColumns({f"of_{m}": F.lit(totals[m]) for m in models})
        zero = F.lit(0)
        p = [((F.coalesce(f"n_{m}", zero) + strength * F.col(f"p_{m}")) / (F.coalesce(f"of_{m}", zero) + strength)).alias(f"p_{m}") for m in models]
        out = out.select("gram", *p)
    return out.select("gram", F.round((F.log("p_accepted") - F.log("p_rejected")) * 2.0**40).cast("long").alias("ratio"))


@dataclass(frozen=True)
class RatioModel:
    """Two Markov models as the exact counts of their grams, a table that grows with the URLs they saw, and the threshold."""

    counts: DataFrame
    threshold: float

    def scores(self, urls: list[str]) -> np.ndarray:
        """The difference of log-likelihoods by character."""
        spark = self.counts.sparkSession
        asked = spark.createDataFrame([(u,) for u in urls], "url string")
        found = {r["url"]: r["score"] for r in asked.select("url", *url_hashes(F.col("url"))).join(url_scores(self.counts, asked, "url"), ["u1", "u2"]).collect()}
        return np.array([found[u] for u in urls])


def url_scores(counts: DataFrame, df: DataFrame, url: str) -> DataFrame:
    """(u1, u2, score) of the distinct URLs: the difference of log-likelihoods by character, their ends included. A null URL is an empty one."""
    grams = written(url_grams(df.select(F.coalesce(F.col(url), F.lit("")).alias("url")).distinct(), "url"), "scored-grams")
    ratios = written(gram_ratios(counts, grams.select("gram").distinct()), "gram-ratios")
    score = F.sum(F.col("ratio") * F.col("n")) / F.sum("n") / F.lit(2.0**40)
    return written(grams.join(ratios, "gram").groupBy("u1", "u2").agg(score.alias("score")), "url-scores")


def calibrated(df: DataFrame, bins: int = 400, span: float = 8.0) -> float:
    """The threshold for (score, verdict) with the least mean of both error rates, from counts in bins; of equal ones the middle."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("score") + span) / (2 * span) * bins))).cast("int")
    counts = np.zeros((2, bins))
    for r in df.groupBy(at.alias("bin"), "verdict").count().collect():
        counts[int(r["verdict"] == "allow"), r["bin"]] += r["count"]
    if not counts.sum(axis=1).all():
        return 0.0
    rejected, accepted = counts / counts.sum(axis=1, keepdims=True)
    error = np.concatenate([[0], accepted.cumsum()]) + 1 - np.concatenate([[0], rejected.cumsum()])
    best = np.flatnonzero(error <= error.min() + 1e-12)
    run = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    middle = max(run, key=len).mean()
    return float(middle / bins * 2 * span - span)


def learn(df: DataFrame) -> RatioModel:
    """A model of all rows (url, verdict). A fifth of them, by a hash of the URL, calibrates; the others are counted, and so equal URLs fall on one side."""
    held_out = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counts, calibrating = count_grams(df.where(~held_out)), df.where(held_out)
    named = calibrating.select("verdict", *url_hashes(F.coalesce("url", F.lit(""))))
    return RatioModel(counts, calibrated(named.join(url_scores(counts, calibrating, "url"), ["u1", "u2"]).select("score", "verdict")))


def filter_urls(df: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict and score.

    The longest rule that fits a host or one of its parents, and the start of
    the path, decides; otherwise the verdict is allow if the score, a number a
    character, reaches the calibrated threshold. The models see each URL without
    its scheme. Where the rules accept or reject nothing, the threshold is 0.

    A null URL, or one without ``://``, has an empty host and path, fits no rule,
    and is scored as an empty text. Repeated rows are judged each, and count in
    the models as often as they occur; an empty table stays empty; columns of
    ``df`` with the names of the new ones, in any case, are replaced.
    """
    kept = without(df, "host", "path", "rule", "verdict", "score")
    seen, judged = fresh([*kept.columns, "host", "path", "rule", "verdict", "score"], "seen", "judged")
    host, path = host_and_path(kept[url])
    parts = kept.withColumns({"host": host, "path": path})
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, judged: verdict, seen: F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]*://", "")})
    model = learn(parts.where(F.col(judged).isNotNull()).select(F.col(seen).alias("url"), F.col(judged).alias("verdict")))
    own_score, u1, u2 = fresh(parts.columns, "own_score", "u1", "u2")
    scores = url_scores(model.counts, parts, seen).select(F.col("u1").alias(u1), F.col("u2").alias(u2), F.col("score").alias(own_score))
    own = F.when(F.col("score") >= model.threshold, F.lit("allow")).otherwise(F.lit("block"))
    h1, h2 = url_hashes(F.col(seen))
    found = parts.withColumns({u1: h1, u2: h2}).join(scores, [u1, u2]).withColumnRenamed(own_score, "score")
    return found.withColumn("verdict", F.coalesce(F.col(judged), own)).drop(seen, judged, u1, u2)
