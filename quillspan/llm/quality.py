"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on statistics of labelled texts; each path from a root
is a rule, a conjunction of comparisons. A logistic model with lasso weights
keeps few of them, and the kept ones are compiled into Spark column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import fresh, slices

STATISTICS = (
    "n_chars",
    "n_words",
    "word_length",
    "longest_word",
    "upper_share",
    "digit_share",
    "mark_share",
    "sentence_mark_share",
    "beyond_ascii_share",
    "distinct_share",
    "repeat_share",
    "bare_mark_share",
    "marked_word_share",
    "line_length",
    "distinct_line_share",
    "top_byte_share",
)
_MARKS = np.array([0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E for b in range(256)])
_SENTENCE = np.array([b in b".,;?'-" for b in range(256)])
_MARK_BYTES = bytes(b for b in range(256) if _MARKS[b] and not _SENTENCE[b])


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS; shares of nothing are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(counts[0x41:0x5B].sum() + counts[0x61:0x7B].sum() + counts[0x80:].sum()))
    shown = max(1, int(counts[0x21:].sum()))
    found = raw.split()
    words = max(1, len(found))
    lines = raw.split(b"\n")
    marked = sum(map(len, found)) - sum(map(len, raw.translate(None, _MARK_BYTES).split()))
    return [
        float(len(raw)),
        float(len(found)),
        sum(map(len, found)) / words,
        float(max(map(len, found), default=0)),
        float(counts[0x41:0x5B].sum()) / letters,
        float(counts[0x30:0x3A].sum()) / shown,
        float(counts[_MARKS & ~_SENTENCE].sum()) / shown,
        float(counts[_SENTENCE].sum()) / shown,
        float(counts[0x80:].sum()) / shown,
        len(set(found)) / words,
        sum(map(eq, found, found[1:])) / words,
        sum(1 for w in found if len(w) < 3 and not w.isalnum()) / words,
        marked / words,
        len(raw) / len(lines),
        len(set(lines)) / len(lines),
        float(counts[0x21:].max()) / shown,
    ]


def with_statistics(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with a struct ``name`` of the statistics."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            table = np.array([statistics(t) for t in batch.column(text).to_pylist()]).reshape(-1, len(STATISTICS))
            struct = pa.StructArray.from_arrays([pa.array(c) for c in table.T.copy()], names=list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=schema.names)

    return df.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, limit)


def grow(x: np.ndarray, residual: np.ndarray, depth: int, least: int, limits: list[np.ndarray]) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on the residuals: the rules of its nodes but the root, and its fitted values."""
    rules: list[Rule] = []
    fitted = np.zeros(len(x))

    def split(rows: np.ndarray, path: Rule, depth: int) -> None:
        fitted[rows] = residual[rows].mean()
        if not depth or len(rows) < 2 * least:
            return
        best, total = None, residual[rows].sum()
        for j, cuts in enumerate(limits):
            if not len(cuts):
                continue
            bins = np.searchsorted(cuts, x[rows, j], side="left")
            n = np.bincount(bins, minlength=len(cuts) + 1).cumsum()[:-1]
            s = np.bincount(bins, residual[rows], len(cuts) + 1).cumsum()[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            if not ok.any():
                continue
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1), -np.inf)
            k = int(gain.argmax())
            if best is None or gain[k] > best[0]:
                best = gain[k], j, float(cuts[k])
        if best is None or best[0] <= total**2 / len(rows) * (1 + 1e-9) + 1e-12:
            return
        _, j, cut = best
        above = x[rows, j] > cut
        for side in (False, True):
            rule = (*path, (j, side, cut))
            rules.append(rule)
            split(rows[above == side], rule, depth - 1)

    split(np.arange(len(x)), (), depth)
    return rules, fitted


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is not penalised."""
    n, m = z.shape
    center = z.mean(axis=0)
    zc = z - center
    step = 4.0 * n / max(1e-9, np.linalg.norm(zc.T @ zc, 2) + n)
    w, b = np.zeros(m), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    w_old, b_old, t = w, b, 1.0
    for _ in range(rounds):
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        wy, by = w + (t - 1) / t_new * (w - w_old), b + (t - 1) / t_new * (b - b_old)
        p = 1 / (1 + np.exp(-(zc @ wy + by)))
        g = zc.T @ (p - y) / n
        w_old, b_old, t = w, b, t_new
        w = wy - step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * penalty)
        b = by - step * (p - y).mean()
    return w, float(b - center @ w)


@dataclass(frozen=True)
class RuleModel:
    """Kept rules with their weights."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, statistics: str) -> Column:
        """The score as a Spark expression over the struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [(F.col(f"{statistics}.{STATISTICS[j]}") > cut) if above else (F.col(f"{statistics}.{STATISTICS[j]}") <= cut) for j, above, cut in rule]
            holds = tests[0]
            for test in tests[1:]:
                holds &= test
            total += F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * covers(rule, x)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 5e-4, seed: int = 0) -> RuleModel:
    """A rule ensemble of labelled statistics. No rows: a score of 0.5; one class only: that class's share, smoothed."""
    if not len(y):
        return RuleModel((), (), 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return RuleModel((), (), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64)))[:-1] for j in range(x.shape[1])]
    margin = np.full(len(y), np.log(share / (1 - share)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), max(2, len(y) * 2 // 3), replace=False) if len(y) > 2 else np.arange(len(y))
        residual = y - 1 / (1 + np.exp(-margin))
        rules, _ = grow(x[rows], residual[rows], depth, max(3, len(rows) // 400), limits)
        found.update(dict.fromkeys(rules))
        leaves = np.zeros(len(y), int)
        for i, rule in enumerate(rules, 1):
            leaves[covers(rule, x)] = i  # deeper rules come after the rules they refine
        total = np.bincount(leaves, residual, len(rules) + 1) / np.maximum(1, np.bincount(leaves, minlength=len(rules) + 1))
        margin += 1.2 * total[leaves]
    rules = list(found)
    if not rules:
        return RuleModel((), (), float(np.log(share / (1 - share))))
    z = np.stack([covers(r, x) for r in rules], axis=1).astype(float)
    _, kept = np.unique(z, axis=1, return_index=True)
    kept = np.sort(kept)
    w, b = lasso_logistic(z[:, kept], y.astype(float), penalty)
    strong = np.flatnonzero(np.abs(w) > 1e-3)
    return RuleModel(tuple(rules[kept[i]] for i in strong), tuple(float(w[i]) for i in strong), b)


def learn(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, most_rows: int = 8_000) -> RuleModel:
    """A model of the labelled rows of ``df``.

    At most ``most_rows`` labelled keys are used, those with the smallest hash of
    the key; that bounds what the driver gets to 16 numbers for each. They are
    taken in order of the keys, and of rows with one key the text that sorts
    first, so the model does not depend on the order of rows.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).cast("long").alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    chosen = chosen.join(df.select(F.col(key).cast("long").alias("_key")).distinct(), "_key", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(most_rows)
    rows = df.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    got = with_statistics(rows, "_text", "_s").select("_key", "_label", "_s.*").toPandas().sort_values("_key")
    return fit_rules(got[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), got["_label"].to_numpy(int))


def score_quality(df: DataFrame, model: RuleModel, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with a double ``name``: the chance that a whole text is labelled 1.

    Null and empty texts have statistics of 0 and get the score of those.
    Repeated rows are scored each; an empty table stays empty; a column called
    ``name``, in any case, is replaced.
    """
    kept = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()])
    (held,) = fresh([*kept.columns, name], "statistics")
    return with_statistics(kept, text, held).withColumn(name, model.column(held)).drop(held)


def keep_accepted(df: DataFrame, labels: DataFrame, threshold: float, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``df`` with its own columns, without rows that score below ``threshold`` under a model of its own labelled rows."""
    (name,) = fresh(df.columns, "score")
    return score_quality(df, learn(df, labels, key, text, label), text, name).where(F.col(name) >= threshold).drop(name)
