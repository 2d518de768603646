"""Toxicity by weak supervision.

Many weak voters look at a text: lexicons of words and of word beginnings, which
labelled rows suggest, and patterns of how and where such words stand. A
generative model of the votes of all documents estimates each voter's accuracy,
with voters that agree beyond it tied into groups that count once. Its posterior
labels of all documents train a linear classifier over terms, which gives the
scores. Gold labels choose the voters' terms and set the scale of the scores;
they are no targets of the classifier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import slices, without, written
from .simhash import shingle_hashes

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are terms of their own, marked by a final hyphen.
BEGINNINGS = (4, 5, 6, 7)
#: A term counts by the number of a text's distinct words that have it, up to so many.
MOST_WORDS = 8
#: Characters that stand for letters in disguised words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_DISGUISED = re.compile(r"[^\W_]*[0134578@$!*.\-][^\W_]+(?:[@$!*.\-]?[^\W_]+)*")
_STRETCHED = re.compile(r"(\w)\1{2,}")
_MARKED = re.compile(r"[0134578@$!*.\-](?=[^\W\d_])")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def terms(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if len(word) > n]]


def undisguised(text: str) -> set[str]:
    """Words that a lower-case text may hide: with digits and marks for letters, or marks between them, or letters drawn out."""
    found = set()
    for token in _DISGUISED.findall(text) if _MARKED.search(text) else ():
        bare = re.sub(r"[\W_\d]", "", token.translate(DISGUISES))
        if len(bare) > 2 and bare != token:
            found.add(bare)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) > 2 and ((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] > 0x2F)).any():
        found |= {_STRETCHED.sub(r"\1", w) for w in _WORD.findall(text) if _STRETCHED.search(w)}
    return found


class TermTable:
    """How many distinct words of a text have each of a fixed list of terms, by a bounded table from words to terms."""

    def __init__(self, known: list[str], most: int = 300_000):
        self.number = {t: i for i, t in enumerate(known)}
        self.most = most
        self.of: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> dict[int, int]:
        return self.counted(words(text))

    def counted(self, found: set[str]) -> dict[int, int]:
        out: dict[int, int] = {}
        if len(self.of) > self.most:
            self.of.clear()
        for word in found:
            own = self.of.get(word)
            if own is None:
                own = self.of[word] = tuple(self.number[t] for t in terms(word) if t in self.number)
            for i in own:
                out[i] = out.get(i, 0) + 1
        return out


@dataclass(frozen=True)
class Voters:
    """Voters over a text and the terms that suggest label 1. Each says 1 or 0, or abstains.

    A lexicon of words says 1 for any of them; one of beginnings, for a beginning
    that two distinct words share. The patterns say 1 for: three hits or more; a
    word of a lexicon twice; two such words within twelve words; hits in a
    fiftieth of the words; a word of a lexicon in disguise. They say 0 for: no
    word of any lexicon; no shared beginning; a long text with at most one hit.
    """

    lexicons: tuple[tuple[str, ...], ...]

    @property
    def count(self) -> int:
        return len(self.lexicons) + 8

    def votes(self, text: str | None, found: dict[str, int]) -> list[int]:
        """-1 for an abstention, else the label, of a text and its terms with their numbers of words."""
        hits = [sum(found.get(t, 0) > t.endswith("-") for t in lexicon) for lexicon in self.lexicons]
        start = sum(h for h, lexicon in zip(hits, self.lexicons, strict=True) if lexicon and lexicon[0].endswith("-"))
        word = sum(hits) - start
        lower = (text or "").lower()
        size = lower.count(" ") + 1
        twice = near = False
        if word:
            at = [(i, w) for i, w in enumerate(_WORD.findall(lower)) if w in self.whole]
            twice = len(at) > len({w for _, w in at})
            near = any(j - i <= 12 and v != w for (i, v), (j, w) in zip(at, at[1:], strict=False))
        hidden = bool(self.whole) and any(w in self.whole and w not in found for w in undisguised(lower))
        return [
            *[1 if h else -1 for h in hits],
            1 if word + start >= 3 else -1,
            1 if twice else -1,
            1 if near else -1,
            1 if 50 * (word + start) >= size else -1,
            1 if hidden else -1,
            -1 if word else 0,
            -1 if start else 0,
            0 if size >= 200 and word + start <= 1 else -1,
        ]

    @cached_property
    def whole(self) -> frozenset[str]:
        return frozenset(t for lexicon in self.lexicons for t in lexicon if not t.endswith("-"))


def pattern_of(votes: list[int]) -> int:
    """The votes as digits of base 3."""
    out = 0
    for v in reversed(votes):
        out = 3 * out + v + 1
    return out


def votes_of(patterns: np.ndarray, count: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(count)[None, :] % 3 - 1


@dataclass
class LabelModel:
    """A generative model of votes: P(vote | label) of each voter, and the weight each has in its group of correlated voters."""

    prior: float
    chance: np.ndarray  # voter, label, vote + 1
    weight: np.ndarray
    correlation: np.ndarray = field(repr=False)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.chance)
        total = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for v in range(votes.shape[1]):
            total += self.weight[v] * log[v, :, votes[:, v] + 1]
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60)))

    @property
    def accuracy(self) -> np.ndarray:
        """Of the votes that are no abstentions, by voter."""
        right = self.prior * self.chance[:, 1, 2] + (1 - self.prior) * self.chance[:, 0, 1]
        wrong = self.prior * self.chance[:, 1, 1] + (1 - self.prior) * self.chance[:, 0, 2]
        return right / (right + wrong)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60, tied: float = 0.3) -> LabelModel:
    """By expectation and maximisation over distinct vote patterns with their counts.

    Voters start a little better than chance. After each step, correlations of
    votes that the labels do not explain are estimated, and a voter's weight is
    one over the sum of those above ``tied`` that it has with others and itself.
    """
    count = votes.shape[1]
    chance = np.full((count, 2, 3), 1 / 3)
    for v in range(count):
        for vote in (0, 1):
            chance[v, vote, vote + 1] = 0.5
            chance[v, 1 - vote, vote + 1] = 0.1
        chance[v] /= chance[v].sum(axis=1, keepdims=True)
    model = LabelModel(float(np.clip(prior, 0.01, 0.5)), chance, np.ones(count), np.eye(count))
    total = counts.sum()
    if not total:
        return model
    said = (votes >= 0).astype(float) * np.where(votes == 1, 1.0, -1.0)
    for _ in range(rounds):
        q = model.posterior(votes)
        for label, share in ((0, counts * (1 - q)), (1, counts * q)):
            for v in range(count):
                model.chance[v, label] = (np.bincount(votes[:, v] + 1, share, 3) + 0.5) / (share.sum() + 1.5)
        model.prior = float(np.clip((counts * q).sum() / total, 0.005, 0.5))
        mean = [(share[:, None] * said).sum(axis=0) / max(share.sum(), 1e-9) for share in (counts * (1 - q), counts * q)]
        rest = [said - m for m in mean]
        cov = sum((share[:, None] * r).T @ r for share, r in zip((counts * (1 - q), counts * q), rest, strict=True)) / total
        deviation = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        model.correlation = cov / deviation[:, None] / deviation[None, :]
        strong = np.where(np.abs(model.correlation) > tied, np.abs(model.correlation), 0.0)
        np.fill_diagonal(strong, 1.0)
        model.weight = 1 / strong.sum(axis=1)
    return model


@dataclass(frozen=True)
class LinearModel:
    """A logistic classifier over terms."""

    terms: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def margin(self, found: dict[int, int]) -> float:
        """Of the numbers of words by term."""
        return self.intercept + sum(self.weights[i] * min(n, MOST_WORDS) for i, n in sorted(found.items()))


def fit_linear(rows: DataFrame, known: list[str], penalty: float = 1e-4) -> LinearModel:
    """On (terms, n, q): texts of a list of terms, each as often as it counts, how many there are, and the share of label 1 among them.

    A text counts under both labels, by its share of each; the fit is
    distributed, so all documents take part. Weights are rounded, so that the
    order in which tasks end does not show.
    """
    total = rows.agg(F.coalesce(F.sum(F.col("n") * F.col("q")), F.lit(0.0)).alias("toxic"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    share = (total["toxic"] + 1) / (total["all"] + 2)
    flat = LinearModel((), (), float(np.log(share / (1 - share))))
    if not known or not 0 < total["toxic"] < total["all"]:
        return flat
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("q").alias("part")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("q")).alias("part"))))
    weighted = rows.select("terms", "n", both.alias("side")).select("terms", F.col("side.label").alias("label"), (F.col("n") * F.col("side.part")).alias("weight")).where("weight > 0")
    vectors = CountVectorizerModel.from_vocabulary(known, inputCol="terms", outputCol="features").transform(weighted)
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=penalty, maxIter=60, standardization=False).fit(vectors)
    weights = np.round(fitted.coefficients.toArray(), 6)
    strong = np.flatnonzero(np.abs(weights) > 1e-3)
    return LinearModel(tuple(known[i] for i in strong), tuple(float(weights[i]) for i in strong), round(float(fitted.intercept), 6))


def scaled(model: LinearModel, rows: list[dict[str, int]], labels: np.ndarray, rounds: int = 50) -> LinearModel:
    """The model with its margins scaled and moved, two numbers that labelled rows set by Newton steps; as it is where they have one label only."""
    if not model.terms or not len(rows) or labels.min() == labels.max():
        return model
    number = {t: i for i, t in enumerate(model.terms)}
    x = np.array([model.margin({number[t]: n for t, n in r.items() if t in number}) for r in rows])
    design = np.column_stack([x, np.ones(len(x))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -60, 60)))
        # a weak pull to the model as it is keeps separable rows finite
        gradient = design.T @ (p - labels) + 1e-1 * (w - (1.0, 0.0))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    w = np.round(w, 6)
    if w[0] <= 0:
        return model
    return LinearModel(model.terms, tuple(float(w[0] * v) for v in model.weights), float(w[0] * model.intercept + w[1]))


def suggested(df: DataFrame, odds: float = 4.0, significance: float = 15.0) -> list[tuple[str, int, int]]:
    """(term, in so many texts of label 1, of label 0) for terms that texts (text, label) of label 1 have more often.

    By ``odds`` after smoothing, and beyond chance: twice the log-likelihood ratio
    of two shares against one is at least ``significance``. The rule is the same
    for any number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label].update({t for w in words(text) for t in terms(w)})
            names = sorted(set(counts[0]) | set(counts[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([counts[i][t] for t in names], pa.int64()) for i in (1, 0)]], names=["term", "a", "c"])

    sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    part = lambda x, n, of: F.when(x > 0, x * F.log(x * of / n)).otherwise(0.0)
    a, c = F.col("a"), F.col("c")
    ratio = 2 * (part(a, a + c, (n1 + n0) / n1) + part(c, a + c, (n1 + n0) / n0))
    found = df.select("text", "label").mapInArrow(run, "term string, a bigint, c bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    good = found.where(((a + 0.5) / (n1 + 1) >= odds * (c + 0.5) / (n0 + 1)) & (ratio >= significance)).collect()
    return sorted(((r["term"], r["a"], r["c"]) for r in good), key=lambda x: (-x[1], x[0]))


def least_hashes(text: str | None, n: int = 5, times: int = 16) -> list[int]:
    """Minimum hashes of a text's ``n``-word shingles."""
    hashes = shingle_hashes(text, n)
    return [int((hashes * np.uint64(2 * k + 3) ^ hashes >> np.uint64(31 - k)).min() >> np.uint64(1)) if len(hashes) else 0 for k in range(times)]


def one_of_copies(rows: list[tuple[int, int, list[int]]], agreeing: int = 10) -> set[int]:
    """Of (key, label, least hashes) the keys to keep: one of each group of copies with one label, so that copies do not make words look suggestive.

    In order of the keys, one goes if a kept one of its label agrees in at least
    ``agreeing`` of the hashes, which at 10 of 16 is likely from a similarity of
    0.6 on.
    """
    kept: set[int] = set()
    seen: dict[tuple[int, int, int], list[int]] = {}
    for key, label, hashes in sorted(rows):
        met = Counter(k for i, h in enumerate(hashes) for k in seen.get((label, i, h), ()))
        if met and met.most_common(1)[0][1] >= agreeing:
            continue
        kept.add(key)
        for i, h in enumerate(hashes):
            seen.setdefault((label, i, h), []).append(key)
    return kept


def make_voters(found: list[tuple[str, int, int]], sizes: tuple[int, int], lexicons: int = 4, odds: float = 8.0) -> Voters:
    """Words dealt to ``lexicons`` voters in turn, beginnings to three by their length; of the terms, those of these odds."""
    n1, n0 = sizes
    good = [t for t, a, c in found if (a + 0.5) / (n1 + 1) >= odds * (c + 0.5) / (n0 + 1)]
    whole = [t for t in good if not t.endswith("-")]
    starts = [t for t in good if t.endswith("-")]
    dealt = [tuple(whole[i::lexicons]) for i in range(lexicons)]
    dealt += [tuple(t for t in starts if len(t) - 1 in lengths) for lengths in (BEGINNINGS[:1], BEGINNINGS[1:2], BEGINNINGS[2:])]
    return Voters(tuple(dealt))


def learn(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, most_rows: int = 12_000) -> tuple[LinearModel, LabelModel]:
    """The classifier and the label model.

    Of the labelled keys at most ``most_rows`` suggest terms and scale the
    scores, those with the smallest hash of the key. The label model and the
    classifier learn from all rows of ``df``: votes and terms are made in one
    pass, equal ones are counted together on the executors, and the driver gets
    the distinct vote patterns with their counts. The outcome does not depend on
    the order of rows; of rows with one key, the text that sorts first is the
    labelled one.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).cast("long").alias("_key")).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(most_rows)
    texts = df.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = written(texts.join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.min("text").alias("text"), F.max("label").alias("label")), "toxicity-rows")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("label"), pa.array([least_hashes(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], names=["_key", "label", "least"])

    signed = [(r["_key"], r["label"], list(r["least"])) for r in rows.mapInArrow(sign, "_key bigint, label int, least array<bigint>").collect()]
    single = one_of_copies(signed)
    known_labels = {k: y for k, y, _ in signed if k in single}
    sizes = (sum(known_labels.values()), sum(1 - y for y in known_labels.values()))
    of_copies = df.sparkSession.createDataFrame([(k,) for k in sorted(set(k for k, _, _ in signed) - single)], "_key bigint")
    rows = rows.join(F.broadcast(of_copies), "_key", "left_anti")
    found = suggested(rows)
    known = [t for t, _, _ in found]
    voters = make_voters(found, sizes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable(known)
        for batch in slices(batches, "text"):
            counts: Counter = Counter()
            for value in batch.column("text").to_pylist():
                own = {known[i]: n for i, n in sorted(table(value).items())}
                counts[pattern_of(voters.votes(value, own)), tuple(t for t, n in own.items() for _ in range(min(n, MOST_WORDS)))] += 1
            patterns = [p for p, _ in counts]
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.int64()), pa.array([list(t) for _, t in counts], pa.list_(pa.string())), pa.array(list(counts.values()), pa.int64())], names=["pattern", "terms", "n"])

    seen = texts.mapInArrow(look, "pattern bigint, terms array<string>, n bigint").groupBy("pattern", "terms").agg(F.sum("n").alias("n"))
    seen = written(seen, "toxicity-votes")
    patterns = seen.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    prior = sizes[0] / max(1, sum(sizes))
    votes = votes_of(patterns["pattern"].to_numpy(int), voters.count)
    model = fit_label_model(votes, patterns["n"].to_numpy(float), prior)
    posterior = df.sparkSession.createDataFrame(list(zip(patterns["pattern"].tolist(), model.posterior(votes).tolist(), strict=True)), "pattern bigint, q double")
    linear = fit_linear(seen.join(F.broadcast(posterior), "pattern"), known)
    return scaled(linear, *_labelled_terms(rows, known)), model


def _labelled_terms(rows: DataFrame, known: list[str]) -> tuple[list[dict[str, int]], np.ndarray]:
    """Terms with their numbers of words, and labels, of (_key, text, label), in order of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable(known)
        for batch in slices(batches, "text"):
            own = [sorted((known[i], n) for i, n in table(t).items()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(own, pa.map_(pa.string(), pa.int32())), batch.column("label")], names=["_key", "terms", "label"])

    got = sorted(rows.select("_key", "text", "label").mapInArrow(run, "_key bigint, terms map<string,int>, label int").collect(), key=lambda r: r["_key"])
    return [r["terms"] for r in got], np.array([r["label"] for r in got], float)


def score_toxicity(df: DataFrame, model: LinearModel, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with a double ``name``: the chance that a whole text is labelled 1.

    Null and empty texts have no terms and get the score of those. Repeated rows
    are scored each; an empty table stays empty; a column called ``name``, in any
    case, is replaced.
    """
    kept = without(df, name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable(list(model.terms))
        for batch in slices(batches, text):
            margin = np.array([model.margin(table(t)) for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(margin, -60, 60))))], names=schema.names)

    return kept.mapInArrow(run, schema)
