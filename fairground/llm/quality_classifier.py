"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its mean and covariance, from sums that Spark adds up over the labelled training rows (at most
``SAMPLE_ROWS``, taken by hash of the id, whose labels are broadcast to the texts); the covariance is shrunk towards the pooled one and then towards its own mean variance.  A score is the
logistic of the difference of the two Mahalanobis log-densities (by Cholesky factors made once) plus
the log prior odds, tempered by the number of statistics.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1.  An empty or null text has all-zero
statistics and a score like any other.  With a class missing, every score is the share of label 1 (0.5 without
labels).  A null doc_id is never a training row and is not held out.  Repeated rows each get their score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm._shared import batch, column, frugal, labelled_texts, table
from fairground.llm._stats import Stats
from fairground.llm._words import blocks, owners, sums

SAMPLE_ROWS = 20_000
TOWARDS_POOLED = 0.3
TOWARDS_SPHERE = 0.02
FEATURES = ["symbols", "upper", "shouts", "bars", "digits", "repeats", "stutter", "dup_lines", "word_length", "distinct"]


def statistics(s: Stats) -> np.ndarray:
    """A row of transformed statistics for each text of the block."""
    words, letters, lines = np.maximum(s.n_words, 1), np.maximum(s.n_letters, 1), np.maximum(s.n_lines, 1)
    row = owners(s.words[2])
    again = np.zeros(len(row), np.int64)
    again[1:] = (s.word_hashes[1:] == s.word_hashes[:-1]) & (row[1:] == row[:-1])
    return np.stack(
        [
            np.log1p(4 * s.n_symbols / words),
            np.sqrt(s.n_upper / letters),
            np.sqrt(s.n_shouts / words),
            np.sqrt(s.n_bars / words),
            np.sqrt(s.n_digits / np.maximum(s.word_chars, 1)),
            np.sqrt(s.n_repeat_words / words),
            np.sqrt(sums(again, s.words[2]) / words),
            np.sqrt(s.n_dup_lines / lines),
            np.log1p(s.word_chars / words),
            np.log1p(s.n_distinct / words),
        ],
        axis=1,
    ).astype(float)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> (rows, sum, sum of outer products), from (text, label); partial sums are made where the rows are."""
    d = len(FEATURES) + 1
    schema = pa.schema([("label", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for rows in batches:
            labels = column(rows, "label").to_numpy()
            for first, end, data, offsets in blocks(column(rows, "text")):
                x = statistics(Stats(data, offsets))
                x, of = np.hstack([np.ones((len(x), 1)), x]), labels[first:end]
                for k in np.unique(of):
                    total[int(k)] = total.get(int(k), 0) + x[of == k].T @ x[of == k]
        for k, m in total.items():
            i, j = np.indices((d, d))
            yield batch(schema, np.full(d * d, k), i.ravel(), j.ravel(), m.ravel())

    added = labelled.mapInArrow(frugal(partial), "label int, i int, j int, v double").groupBy("label", "i", "j").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in added:
        out.setdefault(r.label, np.zeros((d, d)))[r.i, r.j] = r.v
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in out.items()}


class Discriminant:
    """Means, Cholesky factors and log-determinants of both classes."""

    def __init__(self, moments, pooled_share: float = TOWARDS_POOLED, sphere_share: float = TOWARDS_SPHERE):
        total = sum(m[0] for m in moments.values())
        self.constant = None
        if len(moments) < 2:
            self.constant = 0.5 if not total else float(moments.get(1, (0,))[0] / total)
            return
        means = {k: s / n for k, (n, s, _) in moments.items()}
        covariances = {k: q / n - np.outer(means[k], means[k]) for k, (n, _, q) in moments.items()}
        pooled = sum(moments[k][0] * covariances[k] for k in moments) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.scale, self.means, self.factors, self.offsets = scale, {}, {}, {}
        for k in (0, 1):
            c = (1 - pooled_share) * covariances[k] + pooled_share * pooled
            c = c / np.outer(scale, scale)
            c = (1 - sphere_share) * c + sphere_share * (np.trace(c) / len(c) + 1e-3) * np.eye(len(c))
            root = np.linalg.cholesky(c)
            self.means[k], self.factors[k] = means[k] / scale, np.linalg.inv(root)
            self.offsets[k] = -np.log(np.diag(root)).sum() + np.log(moments[k][0] / total)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = {k: self.offsets[k] - 0.5 * (((x / self.scale - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)}
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / len(FEATURES), -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Discriminant:
    return Discriminant(class_moments(labelled_texts(docs, labels.where(~held_out()), label, sample_rows)))


def _scores(model: Discriminant, texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.score(statistics(Stats(data, offsets))) for _, _, data, offsets in blocks(texts))])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    docs, model = docs.select("doc_id", "text"), fit(docs, labels)

    def scan(batches):
        for rows in batches:
            score = _scores(model, column(rows, "text"))
            yield batch(schema, column(rows, "doc_id"), score, (score >= 0.5).astype(np.int32))

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    return docs.mapInArrow(frugal(scan), "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, with their own columns, whatever these are called."""
    model = fit(docs, labels)

    def scan(batches):
        for rows in batches:
            yield rows.filter(pa.array(_scores(model, column(rows, "text")) >= 0.5))

    return docs.mapInArrow(frugal(scan), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
