"""Toxicity by a classifier chain of linear models.

Method: the categories are predicted one after the other. Each has a logistic
regression on the text's features and on the probabilities of the categories
before it; in training those probabilities are out-of-fold predictions, so a
later model sees them as noisy as it will find them on new texts.

Categories, in order: ``disruptive`` (label quality = 0), ``toxic`` (label
toxic = 1), ``severe`` (labelled toxic with at least ``SEVERE`` occurrences of
marker terms, which texts labelled otherwise hardly have).

Features: log counts of the ``terms`` words and word beginnings (4 characters)
that tell the labels apart best, the log count of all marker terms, shares of
symbols, of capitals and of repeated words, and the log length. Terms are counted over the whole texts of the
training rows on the executors; the driver gets the chosen terms and a sparse
matrix of at most ``max_labelled`` rows.

Bounds: the models are fitted on at most ``max_labelled`` labelled documents,
those with the smallest hash of their id; every document is scored, over its
whole text.

Defined cases: null text counts as empty; rows with a null label or id are no
training rows, of repeated labels the largest counts; with fewer than two
classes a category's probability is the share seen (0 without labels); equal
texts get equal scores; an empty table gives no rows; columns of the table that
are named like a result column are replaced."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORIES = ("disruptive", "toxic", "severe")
MAX_LABELLED, TERMS, FOLDS, SEVERE, START = 20_000, 256, 4, 4, 4
DENSE = 5
#: A term's rates under the two labels differ by this factor at least; terms
#: below it mostly tell languages apart.
RATIO, SUPPORT = 5.0, 8
#: Marker terms are that many times as frequent in toxic rows.
MARK = 30.0
_WORD = re.compile(r"\w+")


def term_counts(text: str) -> tuple[Counter, int]:
    """Counts of the words and (``^``) word beginnings, and of the words."""
    words = Counter(_WORD.findall(text.lower()))
    starts = Counter()
    for w, n in words.items():
        starts["^" + w[:START]] += n
    total = sum(words.values())
    words.update(starts)
    return words, total


def dense_features(text: str, counts: Counter, total: int) -> list[float]:
    size = max(1, len(text))
    distinct = sum(1 for w in counts if w[0] != "^")
    return [np.log1p(total) / 5, 5 * min(0.2, len(re.findall(r"[#*$%&|<>!]", text)) / size),
            len(re.findall(r"[A-Z]", text)) / size, 1 - distinct / max(1, total)]


def sparse_row(text: str | None, index: dict[str, int], markers: frozenset[str]) -> tuple[list[int], list[float]]:
    text = text or ""
    counts, total = term_counts(text)
    there = index.keys() & counts.keys()
    hits = [(index[w], float(np.log1p(counts[w]))) for w in there]
    hits += [(len(index) + i, v) for i, v in enumerate(dense_features(text, counts, total))]
    hits.append((len(index) + DENSE - 1, float(np.log1p(sum(counts[w] for w in there & markers)))))
    return [i for i, _ in hits], [v for _, v in hits]


@dataclass
class Linear:
    """A logistic regression (or, without weights, a constant share)."""
    weights: np.ndarray | None
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.bias)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.1, ridge: float = 1e-5) -> Linear:
    """Logistic regression by full-batch Adam steps."""
    if len(y) == 0 or y.min() == y.max():
        return Linear(None, float(y.mean()) if len(y) else 0.0)
    w, b = np.zeros(x.shape[1], x.dtype), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        error = ((Linear(w, b).predict(x) - y) / len(y)).astype(x.dtype)
        grad = np.append(x.T @ error + ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = (w - step[:-1]).astype(x.dtype), b - step[-1]
    return Linear(w, float(b))


@dataclass
class Chain:
    """The terms and the models of the categories, in order."""
    index: dict[str, int]
    markers: frozenset[str]
    models: list[Linear]

    def row(self, text: str | None):
        return sparse_row(text, self.index, self.markers)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), 0), x.dtype)
        for model in self.models:
            out = np.column_stack([out, model.predict(np.column_stack([x, out]))])
        return out

    def matrix(self, rows) -> np.ndarray:
        x = np.zeros((len(rows), len(self.index) + DENSE), np.float32)
        for k, (at, values) in enumerate(rows):
            x[k, at] = values
        return x


def fit_chain(chain: Chain, x: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> Chain:
    """Models for the columns of ``labels``; out-of-fold probabilities of each
    category are features of the next ones."""
    models, seen = [], x
    for y in labels.T:
        models.append(fit_linear(seen, y))
        out = np.zeros(len(x), x.dtype)
        for k in range(folds):
            out[fold == k] = fit_linear(seen[fold != k], y[fold != k]).predict(seen[fold == k])
        seen = np.column_stack([seen, out])
    return Chain(chain.index, chain.markers, models)


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, quality, toxic of the labelled documents to train on."""
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna()
           .groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # at most max_labelled rows of three numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")


def _terms(rows: DataFrame, terms: int) -> Chain:
    """A chain without models yet: the terms that tell the toxic rows apart
    best, and the markers: word beginnings that hardly any other rows have."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found[int(toxic > 0)].update(term_counts(text.as_py() or "")[0].keys())
            every = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), pa.array([found[1][w] for w in every], pa.int64()), pa.array([found[0][w] for w in every], pa.int64())],
                names=["term", "pos", "neg"])

    total = rows.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("pos"), F.sum((F.col("toxic") <= 0).cast("long")).alias("neg")).first()
    if not total["pos"] or not total["neg"]:
        return Chain({}, frozenset(), [])
    counted = rows.select("text", "toxic").mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, n = (F.col("pos") + 0.5) / (total["pos"] + 1), (F.col("neg") + 0.5) / (total["neg"] + 1)
    best = counted.filter(F.col("pos") + F.col("neg") >= SUPPORT).filter(F.abs(F.log(p / n)) >= np.log(RATIO)).withColumn("lift", p / n).withColumn("gain", F.abs(p - n) * F.abs(F.log(p / n))).orderBy(F.desc("gain"), "term").limit(terms).collect()
    return Chain({r["term"]: i for i, r in enumerate(best)}, frozenset(r["term"] for r in best if r["lift"] >= MARK and r["term"][0] == "^"), [])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, terms: int = TERMS, folds: int = FOLDS) -> Chain:
    """A chain fitted on the labelled rows of ``docs``."""
    rows = training_rows(docs, labels, max_labelled)
    chain = _terms(rows, terms)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [chain.row(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64())), *batch.columns[1:]],
                names=["at", "value", "fold", "quality", "toxic"])

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("long")
    data = (rows.select("text", fold.alias("fold"), F.col("quality").cast("long"), F.col("toxic").cast("long"))
            .mapInArrow(run, "at array<int>, value array<double>, fold long, quality long, toxic long").collect())
    x = chain.matrix([(r["at"], r["value"]) for r in data])
    toxic = np.array([r["toxic"] > 0 for r in data], np.float32)
    marks = np.expm1(x[:, -1])
    y = np.column_stack([np.array([r["quality"] == 0 for r in data], np.float32), toxic, toxic * (marks >= SEVERE)])
    return fit_chain(chain, x, y, np.array([r["fold"] for r in data]), folds)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with p_<category> for every category."""
    names = [f"p_{c}" for c in CATEGORIES]
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    every = [*docs.columns, *names]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = chain.predict(chain.matrix([chain.row(t.as_py()) for t in batch.column(at)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, i].astype(np.float64)) for i in range(len(names)))], names=every)

    return docs.mapInArrow(run, schema)
