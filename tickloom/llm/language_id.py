"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is trained online by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled
rows; document frequencies come from all training rows, and a temperature fitted on rows kept back from training
turns the scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tickloom.llm.common import documents, id_remainder, map_batches, stored, unused_names

#: Hashed character n-grams of 1 to 3 characters.
BUCKETS, LONGEST = 1 << 14, 3
#: Training rows of one language, and of all languages, at most; every language keeps some, and the sample does not grow
#: with the corpus.
ROWS_A_LANGUAGE, ROWS_IN_ALL, LEAST_A_LANGUAGE = 1500, 20_000, 10
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and its lower case where that is one character."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            letter[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return letter, lower


def ngram_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts of the text's hashed character n-grams; None without a letter. What is no letter counts as a blank."""
    if not text:
        return None
    letter, lower = _alphabet()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letter[cp]
    if not keep.any():
        return None
    cp = np.where(keep, lower[cp], np.uint32(32))
    keep = np.r_[True, (cp[1:] != 32) | (cp[:-1] != 32)]
    cp = np.concatenate(([np.uint32(32)], cp[keep], [np.uint32(32)])).astype(np.uint64)
    h, parts = np.zeros(len(cp), np.uint64), []
    for n in range(1, LONGEST + 1):
        h = h[: len(cp) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + cp[n - 1 :] + np.uint64(n)
        parts.append(((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(buckets))
    return np.bincount(np.concatenate(parts).astype(np.int64), minlength=buckets)


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(texts, texts holding each bucket) over all rows; every task sends one vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                c = ngram_counts(text, buckets)
                if c is not None:
                    seen += c > 0
                    n += 1
        at = np.r_[-1, np.flatnonzero(seen)]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[n, seen[at[1:]]])], names=["b", "n"])

    out = map_batches(docs.select("text"), run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    b, n = out["b"].to_numpy(), out["n"].to_numpy()
    df = np.zeros(buckets, np.int64)
    df[b[b >= 0]] = n[b >= 0]
    return int(n[b < 0].sum()), df


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(1e-12, np.sqrt((x * x).sum()))


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with l1 and l2 penalties."""

    def __init__(self, classes: int, buckets: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z = np.zeros((classes, buckets))
        self.n = np.zeros((classes, buckets))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[y] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[:, at] += g - sigma * w
        self.n[:, at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least negative log likelihood."""
    if not len(y):
        return 1.0
    tried = np.exp(np.linspace(np.log(0.02), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def _sample(train: DataFrame, counts: dict[str, int], rows: int) -> DataFrame:
    """(doc_id, lang, h) of each language's rows with the lowest id hashes h.

    Only rows whose hash is low enough for their language's size are shuffled, about three times as many as are kept,
    so a language with most of the rows weighs no more than others. Rows of one doc_id count once, with the language
    first in the alphabet.
    """
    shares = [(lang, min(2**63 - 1, (2**63 - 1) * (3 * rows + 100) // n)) for lang, n in counts.items()]
    shares = train.sparkSession.createDataFrame(shares, "lang string, below long")  # one row a language
    narrow = train.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(shares), "lang")
    narrow = narrow.where(F.shiftrightunsigned("h", 1) <= F.col("below"))
    narrow = narrow.groupBy("doc_id").agg(F.min(F.struct("lang", "h")).alias("x")).select("doc_id", "x.*")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return narrow.withColumn("nth", nth).where(F.col("nth") <= rows).drop("nth")


def fit(docs: DataFrame, training: Column, rows: int = ROWS_A_LANGUAGE, epochs: int = 2):
    """(langs, weights, idf) learnt from the rows where ``training`` holds; weights are divided by the temperature.

    None if no such row has a language and a letter.
    """
    labelled = docs.where(training).where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return None
    rows = min(rows, max(LEAST_A_LANGUAGE, ROWS_IN_ALL // len(langs)))
    chosen = stored(_sample(labelled, counts, rows), "sample").withColumnRenamed("lang", "lang_y")
    n_docs, df = document_frequencies(docs.where(training))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [ngram_counts(t) for t in batch.column("text").to_pylist()]
            at = [None if c is None else np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("h"),
                    batch.column("lang_y"),
                    pa.array([None if a is None else pa.compress(a.astype(np.uint16).tobytes(), "zstd", asbytes=True) for a in at], pa.binary()),
                    pa.array([None if a is None else pa.compress(c[a].astype(np.uint32).tobytes(), "zstd", asbytes=True) for a, c in zip(at, counts, strict=True)], pa.binary()),
                    pa.array([0 if a is None else len(a) for a in at], pa.int32()),
                ],
                names=["h", "lang", "at", "n", "k"],
            )

    sample = labelled.join(F.broadcast(chosen), "doc_id").where("lang = lang_y").select("h", "lang_y", "text")
    got = map_batches(sample, run, "h long, lang string, at binary, n binary, k int").where("at is not null").orderBy("h", "lang").toArrow()
    idf = np.log((1 + n_docs) / (1 + df)) + 0.1
    number = {v: k for k, v in enumerate(langs)}
    size = len(got)
    if not size:
        return None
    y = np.array([number[v] for v in got["lang"].to_pylist()])
    held = got["k"].to_pylist()
    ends = np.cumsum([0, *held])
    at_all, n_all = np.empty(ends[-1], np.uint16), np.empty(ends[-1], np.uint32)
    for out, name in ((at_all, "at"), (n_all, "n")):
        for i, k, raw in zip(ends.tolist(), held, got[name].to_pylist(), strict=False):
            out[i : i + k] = np.frombuffer(pa.decompress(raw, k * out.itemsize, "zstd"), out.dtype)
    del got

    def example(k: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = at_all[ends[k] : ends[k + 1]].astype(np.int64), n_all[ends[k] : ends[k + 1]]
        x = (1 + np.log(n)) * idf[at]
        return at, x / max(1e-12, np.sqrt((x * x).sum()))

    model = Ftrl(len(langs), BUCKETS)
    for e in range(epochs):
        for k in np.random.default_rng(e).permutation(size):
            if k % 5 or size < 20:
                model.learn(*example(k), y[k])
    w = model.weights(slice(None))
    back = np.arange(0, size, 5)
    scores = np.array([w[:, at] @ x for at, x in map(example, back)])
    return langs, w / temperature(scores, y[back]), idf


def identify(docs: DataFrame, training: Column, rows: int = ROWS_A_LANGUAGE) -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    Null texts and texts without a letter are ``und`` with score 1; so is every text, with score 0, when nothing could
    be learnt. Ties go to the language first in the alphabet. Texts are whole; repeated rows get equal answers.
    """
    others = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    return predicted(others, docs, training, rows, ["lang_pred", "score"])


def predicted(docs: DataFrame, learnt_from: DataFrame, training: Column, rows: int, own: list[str]) -> DataFrame:
    """docs with the language and its score in the two columns named ``own``, which docs must not have."""
    model = fit(learnt_from, training, rows)
    fields = docs.schema.fields
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                c = ngram_counts(text) if model else None
                if c is None:
                    langs.append(UNKNOWN)
                    scores.append(1.0 if model else 0.0)
                    continue
                at, x = tf_idf(c, model[2])
                p = softmax(model[1][:, at] @ x)
                k = int(np.argmax(p))
                langs.append(model[0][k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, *own])

    schema = StructType([*fields, StructField(own[0], StringType()), StructField(own[1], DoubleType())])
    return map_batches(docs, run, schema)


def identified(docs: DataFrame, training: Column, least: float = 0.5, rows: int = ROWS_A_LANGUAGE) -> DataFrame:
    """Documents whose language is recognised with a score of at least ``least``, with their own columns as they are.

    Null texts, texts without a letter, and all texts when no row has a language to learn from, are not recognised.
    """
    lang, score = unused_names(docs.columns, ["lang_pred", "score"])
    found = predicted(docs, docs, training, rows, [lang, score])
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
