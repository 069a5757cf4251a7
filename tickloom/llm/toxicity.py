"""Toxicity by a classifier chain.

Categories are predicted one after another; each later linear model also sees the earlier categories' probabilities.
For training these are out-of-fold predictions, so that a later model meets them as unsure as they will be on new texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tickloom.llm.common import documents, drop_stored, labels, map_batches, stored, unused_names
from tickloom.llm.style import NAMES, style

#: Rows of each class of each category that the chain is trained on at most; independent of the corpus.
ROWS_A_CLASS = 4000
#: Word features of each category, and the least number of training texts that hold one.
WORD_FEATURES, LEAST_TEXTS = 300, 5
FOLDS = 3
#: Training rows whose products are summed at a time, so that the driver holds one single-precision matrix and little else.
BLOCK = 2048
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


def word_features(text: str | None) -> set[str]:
    """The text's lower-case words, and their beginnings as ``beginning*``."""
    words = set(WORD.findall(text.lower())) if text else set()
    starts = {w[:k] + "*" for k in PREFIXES for w in words if len(w) > k}
    return words | starts


def training_rows(docs: DataFrame, labels: DataFrame, categories: Sequence[str], per_class: int) -> DataFrame:
    """(h, text, y) of a bounded sample that holds both classes of every category.

    Label rows of one doc_id that disagree count as one row with the larger label of each category.
    """
    narrow = labels.select("doc_id", F.xxhash64("doc_id").alias("h"), F.array(*[F.col(c).cast("int") for c in categories]).alias("y"))
    parts = [
        narrow.where(F.col("y")[k] == v).orderBy("h", "doc_id").limit(per_class) for k in range(len(categories)) for v in (0, 1)
    ]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    chosen = chosen.where(~F.exists("y", lambda v: v.isNull()))
    largest = F.array(*[F.max(F.col("y")[k]) for k in range(len(categories))])
    ids = chosen.groupBy(F.col("doc_id").alias("label_id"), "h").agg(largest.alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("h", "text", "y")


def select_words(rows: DataFrame, n_categories: int, best: int, least: int) -> list[str]:
    """For each category the words and beginnings that tell most about it, by the G statistic of presence and label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, hits, n, pos = Counter(), [Counter() for _ in range(n_categories)], 0, np.zeros(n_categories, np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found = word_features(text)
                count.update(found)
                n += 1
                pos += y
                for k in range(n_categories):
                    if y[k]:
                        hits[k].update(found)
        words = ["", *count]
        flat = [int(v) for k, w in enumerate(words) for v in (pos if k == 0 else [h[w] for h in hits])]
        at = pa.array(np.arange(len(words) + 1) * n_categories, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words), pa.array([n, *count.values()], pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat, pa.int64()))],
            names=["word", "n", "pos"],
        )

    sums = [F.sum(F.col("pos")[k]).alias(f"p{k}") for k in range(n_categories)]
    found = map_batches(rows.select("text", "y"), run, "word string, n long, pos array<long>").groupBy("word").agg(F.sum("n").alias("n"), *sums)
    found = stored(found.where((F.col("word") == "") | (F.col("n") >= least)), "words")
    totals = found.where(F.col("word") == "").first()
    if totals is None or not totals["n"]:
        return []
    n = float(totals["n"])
    chosen: set[str] = set()
    for k in range(n_categories):
        pos = float(totals[f"p{k}"])

        def term(seen, expected):
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

        a, b = F.col(f"p{k}").cast("double"), (F.col("n") - F.col(f"p{k}")).cast("double")
        share, rest = pos / n, 1 - pos / n
        if not 0 < share < 1:
            continue
        g = term(a, F.col("n") * share) + term(b, F.col("n") * rest)
        absent = F.lit(n) - F.col("n")
        g = g + term(F.lit(pos) - a, absent * share) + term(F.lit(n - pos) - b, absent * rest)
        top = found.where(F.col("word") != "").orderBy(F.desc(g), "word").limit(best)
        chosen |= {r["word"] for r in top.select("word").collect()}
    drop_stored(found)
    return sorted(chosen)


def describe(texts: list[bytes | None], words: dict[str, int]) -> np.ndarray:
    """Presence of each chosen word, then the style numbers, for every text."""
    x = np.zeros((len(texts), len(words) + len(NAMES)), np.float32)
    known = words.keys()
    for k, raw in enumerate(texts):
        for w in word_features(None if raw is None else raw.decode()) & known:
            x[k, words[w]] = 1
        x[k, len(words) :] = style(raw)
    return x


def logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray, l2: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last one is the intercept) of ridge logistic regression on some rows of x, by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        g, h = ridge * w, np.diag(ridge + 1e-9)
        for k in range(0, len(rows), BLOCK):
            part = rows[k : k + BLOCK]
            z = np.ones((len(part), len(w)), np.float32)
            z[:, :-1] = x[part]
            p = probability(z[:, :-1], w)
            g += z.T @ (p - y[part])
            h += (z * (p * (1 - p)).astype(np.float32)[:, None]).T @ z
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))


def fit_chain(x: np.ndarray, y: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector for each column of y, in order; later ones have the earlier probabilities as features.

    The last columns of x, one fewer than categories, are room for those probabilities; they are filled here.
    """
    models, fold, width = [], np.arange(len(x)) % folds, x.shape[1] - y.shape[1] + 1
    for k in range(y.shape[1]):
        seen = x[:, : width + k]
        for f in range(folds) if k + 1 < y.shape[1] else ():
            learn, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            x[rest, width + k] = probability(seen[rest], logistic(seen, y[:, k], learn)) if len(learn) else 0.5
        models.append(logistic(seen, y[:, k], np.arange(len(x))))
    return models


def run_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    found = np.empty((len(x), 0))
    for w in models:
        p = probability(x, w)
        x, found = np.c_[x, p], np.c_[found, p]
    return found


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], per_class: int = ROWS_A_CLASS):
    """(words, models) learnt from a bounded labelled sample; None without labelled texts."""
    rows = training_rows(docs, labels, categories, per_class)
    names = select_words(rows, len(categories), WORD_FEATURES, LEAST_TEXTS)
    words = {w: k for k, w in enumerate(names)}
    width = len(words) + len(NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = describe(batch.column("text").cast(pa.binary()).to_pylist(), words)
            bits = np.packbits(x[:, : len(words)] > 0, axis=1)
            raw = [b.tobytes() + r.astype(np.float32).tobytes() for b, r in zip(bits, x[:, len(words) :], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(raw, pa.binary()), batch.column("y")], names=["h", "x", "y"])

    got = map_batches(rows, run, "h long, x binary, y array<int>").orderBy("h").toArrow()
    if not len(got):
        return None
    y = np.array(got["y"].to_pylist(), float).reshape(len(got), len(categories))
    x = np.zeros((len(got), width + len(categories) - 1), np.float32)
    raw = np.frombuffer(b"".join(got["x"].to_pylist()), np.uint8).reshape(len(got), -1)
    held = -(-len(words) // 8)
    x[:, : len(words)] = np.unpackbits(raw[:, :held], axis=1, count=len(words))
    x[:, len(words) : width] = np.ascontiguousarray(raw[:, held:]).view(np.float32)
    del got, raw
    return words, fit_chain(x, y)


def toxicity(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), threshold: float = 0.5, per_class: int = ROWS_A_CLASS
) -> DataFrame:
    """docs with p_<category> for each category, and ``is_toxic`` from the last one (columns of these names are replaced).

    Null, empty and wordless texts are judged by their (empty) features like all others. Without labelled texts every
    probability is 0 and nothing is toxic. Texts are whole, repeated rows get equal answers; a probability equal to the
    threshold is toxic. Labels without a document, and those with a null category, teach nothing.
    """
    own = [*[f"p_{c}" for c in categories], "is_toxic"]
    others = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    return judged(others, docs, labels, categories, threshold, per_class, own)


def judged(
    docs: DataFrame, learnt_from: DataFrame, labels: DataFrame, categories: Sequence[str], threshold: float, per_class: int, own: Sequence[str]
) -> DataFrame:
    """docs with the categories' probabilities and the verdict in columns named ``own``, which docs must not have."""
    model = fit(learnt_from, labels, categories, per_class)
    fields = docs.schema.fields
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            p = np.zeros((len(texts), len(categories)))
            if model is not None and texts:
                p = run_chain(describe(texts, model[0]), model[1])
            columns = [*[batch.column(n) for n in names], *[pa.array(p[:, k]) for k in range(len(categories))]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p[:, -1] >= threshold)], names=[*names, *own])

    schema = StructType([*fields, *[StructField(n, DoubleType()) for n in own[:-1]], StructField(own[-1], BooleanType())])
    return map_batches(docs, run, schema)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The label table with the two categories of the chain: low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = ROWS_A_CLASS) -> DataFrame:
    """Documents that are not toxic, with their own columns as they are, whatever their names.

    Null and empty texts are judged like all others. Without labelled texts every document stays; an empty table stays
    empty.
    """
    own = unused_names(docs.columns, ["p_low_quality", "p_toxic", "is_toxic"])
    found = judged(docs, docs, chain_labels(labels), ("low_quality", "toxic"), threshold, per_class, own)
    return found.where(~F.col(own[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = toxicity(docs, chain_labels(labels(spark, sf_dir)))
    return out.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
