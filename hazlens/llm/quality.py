"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text gives a vector of statistics of its bytes, words and lines, brought
near to normal by logarithms and square roots. Each class has a mean and a
covariance, the latter shrunk towards the pooled one and its diagonal; its
Cholesky factor is kept. A score is the logistic of the difference of the two
log densities (half the Mahalanobis distances and log determinants, and the
prior), on a slope fitted to the training rows, since such densities are far too
sure of themselves.

Training collects the statistics of at most ``TRAIN_ROWS`` labelled documents, one row
of each doc_id.
Scoring reads whole texts and nothing but texts.

Defined results: a null or empty text is scored as a text of no words; with no
labelled rows, or one class only, every score is the share of label 1 (0.5
without any); rows with a null doc_id are scored but never learned from; repeated
rows are all scored; an empty table gives an empty table; ``scored`` ignores other
columns, ``accepted`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazlens.llm import labelled, runs

#: Bound on the labelled rows that a fit collects.
TRAIN_ROWS = 20_000
#: Shrinkage of a class's covariance towards the pooled one, and of that mixture towards its diagonal.
POOLED, DIAGONAL = 0.2, 0.1
THRESHOLD = 0.3
#: Bytes of text whose statistics are made at once; the masks and sums take some fifty times that.
PIECE_BYTES = 2 << 20
#: Words at which a text's statistics weigh as much as the prior: a few words tell little.
FEW_WORDS = 8


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    data, at = runs.flat(texts)
    n = len(at) - 1
    _, codes, first = runs.distinct(data, at)
    begin, end, word_at = runs.words(data, at)
    words = (word_at[1:] - word_at[:-1]).astype(float)
    some, size = np.maximum(words, 1), np.maximum(at[1:] - at[:-1], 1).astype(float)
    upper, lower = _sums((data >= 65) & (data <= 90), at), _sums((data >= 97) & (data <= 122), at)
    kind = {c: _sums(data == ord(c), at) for c in "!|,.\n"}
    digits = _sums((data >= 48) & (data <= 57), at)
    wide = _sums(data >= 0xC0, at)
    odd = np.isin(np.arange(256), [ord(c) for c in "#$%&*+<=>@\\^_`{}~"])
    symbols = _sums(odd[data], at)
    letters = np.maximum(upper + lower, 1)
    # runs with their leading white space stand for words here: the same word at a line's start is another run
    owner = np.repeat(np.arange(n), first[1:] - first[:-1])
    pair, count = np.unique(owner * (1 << 32) + codes, return_counts=True)
    of = pair >> 32
    distinct, top, twice = np.bincount(of, minlength=n).astype(float), np.zeros(n), np.zeros(n)
    np.maximum.at(top, of, count)
    np.add.at(twice, of, np.where(count > 1, count, 0))
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    again = np.bincount(owner, weights=same, minlength=n)
    many = np.maximum(first[1:] - first[:-1], 1)
    bytes_of_words = _word_bytes(end - begin, word_at)
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p(bytes_of_words / some),
            np.sqrt(upper / letters),
            np.log1p(20 * kind["!"] / some),
            np.log1p(20 * kind["|"] / some),
            np.log1p(20 * symbols / some),
            np.sqrt(kind[","] / some),
            np.sqrt(kind["."] / some),
            np.sqrt(digits / size),
            np.sqrt(wide / size),
            np.sqrt(kind["\n"] / some),
            np.sqrt(distinct / many),
            np.sqrt(top / many),
            np.sqrt(again / many),
            np.sqrt(twice / many),
        ]
    )


def _word_bytes(sizes: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(sizes)])
    return (total[word_at[1:]] - total[word_at[:-1]]).astype(float)


class Discriminant:
    """The two class densities and the slope of the score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> None:
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = bool(len(y)) and 0 < self.share < 1
        if not self.fitted:
            return
        self.center, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.center) / self.scale
        means = [z[y == c].mean(0) for c in (0, 1)]
        within = [(z[y == c] - means[c]).T @ (z[y == c] - means[c]) for c in (0, 1)]
        both = (within[0] + within[1]) / len(z)
        self.classes = []
        for c in (0, 1):
            k = int((y == c).sum())
            cov = (1 - pooled) * within[c] / max(k - 1, 1) + pooled * both
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            # the inverse of the factor is kept: a distance is then one product
            self.classes.append((means[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))
        self.slope, self.shift = self._calibrated(self.ratio(x), y)

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, in tens and within bounds, less sure for few words."""
        z = (x - self.center) / self.scale
        density = [-0.5 * ((((z - m) @ inverse.T) ** 2).sum(1) + log_det) for m, inverse, log_det in self.classes]
        words = np.expm1(x[:, 0])
        return np.clip((density[1] - density[0]) / 10, -5, 5) * words / (words + FEW_WORDS)

    @staticmethod
    def _calibrated(ratio: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and shift of the logistic by Newton's method."""
        w = np.zeros(2)
        design = np.column_stack([ratio, np.ones(len(ratio))])
        for _ in range(30):
            p = 1 / (1 + np.exp(-design @ w))
            gradient = design.T @ (y - p) - 1e-2 * w
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            w = w + np.linalg.solve(hessian, gradient)
        return float(max(w[0], 1e-3)), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-(self.slope * self.ratio(x) + self.shift)))


def _labelled_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs.pieces(batches, limit=PIECE_BYTES):
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "label")), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "h", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Discriminant:
    """Densities of ``labels.quality`` from at most ``rows`` documents outside the held-out fold."""
    made = runs.mapped(labelled.sample(docs, labels, "quality", rows), _labelled_statistics, "doc_id long, h long, label int, x array<double>")
    # in order of doc_id, so that sums don't depend on which task ends first
    got = labelled.one_a_document(made).toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float)
    return Discriminant(x, got.column("label").to_numpy())


def scored(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(F.col("doc_id")).alias("held_out"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs.pieces(batches, limit=PIECE_BYTES):
            score = model.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    out = runs.mapped(rows, work, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with their columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs.pieces(batches, limit=PIECE_BYTES):
            yield batch.filter(pa.array(model.score(statistics(batch.column("text"))) >= threshold))

    return runs.mapped(docs, work, docs.schema)
