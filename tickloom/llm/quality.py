"""Quality scores by positive-unlabelled learning.

Trusted good texts are the positives and the corpus the unlabelled texts; texts labelled bad are not used. Texts are
described by how they are written and by words that are more or less frequent among the good ones. The share of good texts
in the corpus is estimated first; a linear model then minimises the non-negative unbiased risk: the unlabelled texts'
loss, less what their good part must contribute, floored at zero, and the good texts' loss by that share. With the
logistic loss this is convex, so a few Newton steps do, each one pass over the descriptions of all training rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import documents, id_remainder, labels, map_batches, stored
from tickloom.llm.style import NAMES, style
from tickloom.llm.toxicity import word_features

#: Labelled good rows whose words are candidates, and that are positives, at most.
POSITIVES = 8000
#: Candidate words (the most frequent among the good texts), the fewest good texts with one, and words that are kept.
CANDIDATES, LEAST_TEXTS, WORDS = 1500, 5, 50
#: Newton steps at most, of the model that the prior is read from and of the final one.
PRIOR_STEPS, STEPS = 6, 10
#: Ridge on the weights of style and of words in either model, divided by the number of positives: with few of them words
#: tell little. Chosen, with the number of words, by fitting on two thirds of the training rows and comparing on the rest.
PRIOR_RIDGE, RIDGE = (1.0, 200.0), (5.0, 1000.0)
#: Rows of descriptions that are made dense at a time.
BLOCK = 1024
THRESHOLD = 0.7
N_STYLE = len(NAMES)


def candidate_words(good: DataFrame, most: int = CANDIDATES, least: int = LEAST_TEXTS) -> list[str]:
    """The words and beginnings of words that most of the good texts hold, by how many do, then by name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                count.update(word_features(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    found = map_batches(good.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in found.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def descriptions(docs: DataFrame, words: list[str]) -> DataFrame:
    """docs without its texts, with ``style`` and the ascending numbers of the ``words`` that each text holds."""
    number = {w: k for k, w in enumerate(words)}
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.keys()
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            styles = np.array([style(t) for t in raw], np.float64).reshape(-1)
            held = [sorted(number[w] for w in word_features(t.decode() if t else None) & known) for t in raw]
            at = pa.array(np.arange(len(raw) + 1) * N_STYLE, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.ListArray.from_arrays(at, pa.array(styles)), pa.array(held, pa.list_(pa.int32()))], names=[*rest, "style", "words"]
            )

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return map_batches(docs, run, f"{schema}, style array<double>, words array<int>")


@dataclass
class Features:
    """How a description becomes numbers: style less its mean by its scale, then whether it holds each kept word, then 1."""

    mean: np.ndarray
    scale: np.ndarray
    kept: np.ndarray

    def matrix(self, styles: pa.Array, words: pa.Array) -> np.ndarray:
        x = np.zeros((len(styles), N_STYLE + len(self.kept) + 1))
        x[:, :N_STYLE] = (np.array(styles.flatten()).reshape(-1, N_STYLE) - self.mean) / self.scale
        of = np.full(int(self.kept.max(initial=-1)) + 1, -1)
        of[self.kept] = np.arange(len(self.kept))
        held = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
        column = np.where(held < len(of), of[np.minimum(held, len(of) - 1)] if len(of) else -1, -1)
        x[row[column >= 0], N_STYLE + column[column >= 0]] = 1
        x[:, -1] = 1
        return x


def _sigmoid(s):
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def block_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a Newton step needs of some rows: their number, the sums of log(1 + e^s), of s, of x and of sigmoid x, and the
    curvature; one after another in one array."""
    s = x @ w
    p = _sigmoid(s)
    curved = (x * (p * (1 - p))[:, None]).T @ x
    return np.concatenate([[len(x), np.logaddexp(0, s).sum(), s.sum()], x.sum(0), p @ x, curved.ravel()])


@dataclass
class Sums:
    """Means over rows, from ``block_sums``."""

    n: float
    loss: float
    score: float
    x: np.ndarray
    p: np.ndarray
    curved: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, d: int) -> Sums:
        n = max(flat[0], 1.0)
        parts = np.split(flat[3:] / n, [d, 2 * d])
        return cls(flat[0], flat[1] / n, flat[2] / n, parts[0], parts[1], parts[2].reshape(d, d))


def ridges(ridge: tuple[float, float], d: int, n_good: int) -> np.ndarray:
    """The ridge on each weight; the last one has next to none."""
    return np.r_[np.full(N_STYLE, ridge[0]), np.full(d - N_STYLE - 1, ridge[1]), 1e-3] / n_good


def _newton(gradient: np.ndarray, curvature: np.ndarray, w: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    return np.linalg.solve(curvature + np.diag(ridge + 1e-9), gradient + ridge * w)


def contrast(sums, ridge: np.ndarray, steps: int = PRIOR_STEPS) -> np.ndarray:
    """Weights that tell positives from unlabelled rows, both weighing the same; ``sums(w)`` gives the Sums of both."""
    w = np.zeros(len(ridge))
    for _ in range(steps):
        p, u = sums(w)
        step = _newton(p.p - p.x + u.p, p.curved + u.curved, w, ridge)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def nn_pu(sums, prior: float, ridge: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk with the logistic loss.

    The risk is mean_u log(1 + e^s) - prior * mean_p s. A step that would make the negative part, mean_u log(1 + e^s) -
    prior * mean_p log(1 + e^s), fall under zero, or the risk grow, is halved; the last weights that did neither count.
    """
    good, ahead, least = np.zeros(len(ridge)), np.zeros(len(ridge)), np.inf
    for _ in range(steps):
        p, u = sums(ahead)
        risk = u.loss - prior * p.score + float(ridge @ ahead**2) / 2
        if u.loss - prior * p.loss < 0 or risk > least + 1e-12:
            ahead = (good + ahead) / 2
            continue
        good, least = ahead, risk
        step = _newton(u.p - prior * p.x, u.curved, good, ridge)
        ahead = good - step
        if np.abs(step).max() < 1e-3:
            break
    return good


def prior_of(thresholds: np.ndarray, above_p: np.ndarray, above_u: np.ndarray) -> float:
    """Share of good texts among the unlabelled: how much rarer the best-scored regions are among them than among the
    positives; the median over the regions."""
    ratios = above_u / np.maximum(1e-9, above_p)
    return float(np.clip(np.median(ratios), 0.02, 0.98)) if len(thresholds) else 0.5


def _pass(rows: DataFrame, features: Features, fn) -> tuple[np.ndarray, np.ndarray]:
    """The sums over positive and over all rows of ``fn(x)``, an array of numbers for some rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                part = batch.slice(k, BLOCK)
                x = features.matrix(part.column("style"), part.column("words"))
                good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)
                both = np.stack([fn(x[good]), fn(x)])
                total = both if total is None else total + both
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), pa.array(total[0]), pa.array(total[1])], names=["k", "p", "u"])

    found = map_batches(rows.select("style", "words", "good"), run, "k long, p double, u double").groupBy("k").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    got = found.orderBy("k").toArrow()
    return got["p"].to_numpy(), got["u"].to_numpy()


def _features(rows: DataFrame, n_words: int, keep: int = WORDS) -> Features:
    """Mean and scale of the styles of all rows, and the words that tell most between good and all rows, by their counts."""
    both = [F.sum(e.cast("double")) for k in range(N_STYLE) for e in (F.col("style")[k], F.col("style")[k] * F.col("style")[k])]
    n, n_good, *moments = rows.agg(F.count("*"), F.count_if("good"), *both).first()
    mean = np.array(moments[::2]) / n
    scale = np.sqrt(np.maximum(np.array(moments[1::2]) / n - mean**2, 1e-12))
    count = np.zeros((2, n_words))
    held = rows.select("good", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if("good").alias("g"))
    for r in held.collect():  # a row a candidate
        count[:, r["word"]] = r["g"], r["n"]
    a, b = (count[0] + 0.5) / (n_good + 1), (count[1] + 0.5) / (n + 1)
    tells = n_good * (a * np.log(a / b) + (1 - a) * np.log((1 - a).clip(1e-9) / (1 - b).clip(1e-9)))
    return Features(mean, np.maximum(scale, 1e-6), np.sort(np.argsort(-tells, kind="stable")[:keep]))


def fit(rows: DataFrame, n_words: int) -> tuple[Features, np.ndarray] | None:
    """The features and weights learnt from ``rows(style, words, good)``, or None without positives or other rows."""
    n, n_good = rows.agg(F.count("*"), F.count_if("good")).first()
    if not 0 < n_good < n:
        return None
    features = _features(rows, n_words)
    d = N_STYLE + len(features.kept) + 1

    def sums(w: np.ndarray) -> tuple[Sums, Sums]:
        return tuple(Sums.of(flat, d) for flat in _pass(rows, features, lambda x: block_sums(x, w)))

    w = contrast(sums, ridges(PRIOR_RIDGE, d, n_good))
    edges = np.linspace(-40, 40, 8001)
    p, u = (h[::-1].cumsum()[::-1] / h.sum() for h in _pass(rows, features, lambda x: np.histogram(np.clip(x @ w, -40, 40), edges)[0].astype(float)))
    at = np.unique([int(np.searchsorted(-p, -q)) for q in np.linspace(0.3, 0.9, 13)]).clip(0, len(p) - 1)
    return features, nn_pu(sums, prior_of(edges[at], p[at], u[at]), ridges(RIDGE, d, n_good))


def quality_scores(docs: DataFrame, labels: DataFrame, training: Column, positives: int = POSITIVES) -> DataFrame:
    """(doc_id, score) for each row of docs: the probability that its text is good.

    Null, empty and blank texts have no style and no words and are scored by that like any other text; texts of any length
    are described whole. When nothing can be learnt (no positives, nothing but positives, an empty table) every score is
    0.5. Repeated rows get equal scores. Label rows of one document that disagree count as good. At most ``positives``
    labelled rows are positives; the unlabelled texts are all rows where ``training`` holds. Other columns are ignored.
    """
    good = labels.where("quality = 1").where(training).select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id").alias("_h")).distinct()
    good = F.broadcast(good.orderBy("_h", "_id").limit(positives).select("_id", F.lit(True).alias("good")))  # bounded
    d = docs.select("doc_id", training.alias("train"), "text")
    words = candidate_words(d.where("train").join(good, F.col("doc_id") == F.col("_id")))
    d = d.join(good, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce("train", F.lit(False)).alias("train"), (F.coalesce("good", F.lit(False)) & F.coalesce("train", F.lit(False))).alias("good"), "text")
    rows = stored(descriptions(d, words), "descriptions")
    model = fit(rows.where("train"), len(words))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    features, w = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.slice(k, BLOCK) for k in range(0, len(batch), BLOCK)]
            s = [_sigmoid(features.matrix(b.column("style"), b.column("words")) @ w) for b in parts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(s) if s else np.zeros(0))], names=["doc_id", "score"])

    return map_batches(rows.select("doc_id", "style", "words"), run, "doc_id long, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    out = quality_scores(documents(spark, sf_dir), labels(spark, sf_dir), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
