"""Quality classifier (operator 8): regularised quadratic discriminant over document statistics.

Each class has a Gaussian over transformed statistics of a text.  The covariances are shrunk twice, towards their
pooled matrix and towards a multiple of the identity, and kept as Cholesky factors, so a score is two triangular
solves.  Only the text is looked at: language, source and identifier are never inputs.

Defined results: a null text is an empty one and is scored like any other; repeated rows get equal scores; labels that
are null or name no document are left out; with fewer than two labelled documents of a class every score is the share
of label 1 (0.5 without labels); an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import text as T
from tessera.llm.labels import fold, labelled_sample

FEATURES = ("log_words", "word_length", "word_length_spread", "upper", "digits", "marks", "symbols", "accents", "spaces", "distinct_words", "top_word", "distinct_trigrams", "repeated_lines", "line_words", "marks_per_word", "long_words")
#: Labelled documents that a fit reads at most; chosen by the hash of doc_id.
MAX_ROWS = 20_000
POOLED, RIDGE = 0.1, 0.05
#: Variance that the identity's multiple stands for at least, where a class's documents are all alike.
LEAST_VARIANCE = 1e-6

_KIND = np.full(256, 0, np.uint8)  # 0: other
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_KIND[0x80:] = 6
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 7


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(texts)
    data, offsets = T.buffers(texts)
    w = T.words(texts)
    rows, counts = w.rows(), w.counts()
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 8 + _KIND[data], minlength=8 * n).reshape(n, 8).astype(float)
    total = np.maximum(kinds.sum(1), 1)
    length = (w.end - w.start).astype(float)
    some = np.maximum(counts, 1)
    mean = _per_row(length, w.bounds) / some
    spread = np.sqrt(np.maximum(_per_row(length**2, w.bounds) / some - mean**2, 0))

    order = np.lexsort((w.hash, rows))
    h, r = w.hash[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[new], runs)
    distinct = np.bincount(r[new], minlength=n)
    at = T.starts(w.bounds, 3)
    trigrams = np.diff(T.distinct(rows[at], T.grams(w.hash, 3, at), n)[1])
    n_trigrams = np.maximum(counts - 2, 1)

    lines = T.words(texts, _IN_LINE)
    n_lines = np.maximum(lines.counts(), 1)
    d_lines = np.diff(T.distinct(lines.rows(), lines.hash, n)[1])
    share = lambda x: np.log((x + 0.002) / (1.002 - np.minimum(x, 1)))
    return np.column_stack([
        np.log1p(counts), np.log1p(mean), np.log1p(spread),
        share(kinds[:, 2] / np.maximum(kinds[:, 1] + kinds[:, 2], 1)), share(kinds[:, 3] / total), share(kinds[:, 4] / total), share(kinds[:, 5] / total), share(kinds[:, 6] / total), share(kinds[:, 7] / total),
        np.log((distinct + 1) / (counts + 1)) / np.log(counts + 2), share(top / some), share(trigrams / n_trigrams) * (counts > 2), share(1 - d_lines / n_lines), np.log1p(counts / n_lines),
        np.log1p((kinds[:, 4] + kinds[:, 5]) / some), share(_per_row(length > 20, w.bounds) / some),
    ])


_IN_LINE = np.ones(256, bool)
_IN_LINE[[0x0A, 0x0D]] = False


class QuadraticDiscriminant:
    """Two Gaussians with shrunk covariances; score() is the chance of label 1 from their log-density difference."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> None:
        self.constant = float(y.mean()) if len(y) else 0.5
        self.parts: list[tuple[np.ndarray, np.ndarray, float]] = []
        if min((y == 0).sum(), (y == 1).sum()) < 2:
            return
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.shift) / self.scale
        own = [np.cov(z[y == c], rowvar=False) for c in (0, 1)]
        both = sum(((y == c).sum() - 1) * own[c] for c in (0, 1)) / (len(y) - 2)
        for c in (0, 1):
            cov = (1 - pooled) * own[c] + pooled * both
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), LEAST_VARIANCE) * np.eye(len(cov))
            chol = np.linalg.cholesky(cov)
            self.parts.append((z[y == c].mean(0), np.linalg.inv(chol).T, float(2 * np.log(np.diag(chol)).sum() - 2 * np.log((y == c).mean()))))
        self.slope, self.offset = _calibrated(self.difference(x), y)

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        low, high = (-0.5 * ((((z - mean) @ solve) ** 2).sum(1) + const) for mean, solve, const in self.parts)
        return high - low

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -36, 36)))


def _calibrated(d: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve from log-density difference to label; the slope stays above 0."""
    goal = np.where(y == 1, 1 - 1 / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    scale = np.std(d) + 1e-9
    a, b, x = 1.0, 0.0, d / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, p - goal
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * x).sum(), g.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.05) / scale, float(b)


def fit(documents: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS) -> QuadraticDiscriminant:
    """Learns from labelled rows outside the held-out fold (crc32 of doc_id as text, modulo `modulus`)."""
    sample = labelled_sample(documents, labels, "quality", modulus, held_out, max_rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # Rows in one order, so that sums, and with them scores, don't depend on how Spark dealt the rows.
    rows = sorted((r.doc_id, r.y, r.x) for r in sample.mapInArrow(measured, "doc_id long, y int, x array<double>").collect())
    x = np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES))
    return QuadraticDiscriminant(x, np.array([r[1] for r in rows], int))


def classify(documents: DataFrame, model: QuadraticDiscriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, text's score and predicted (score >= threshold) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                score = shared.value.score(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double, predicted int")


def keep_good(documents: DataFrame, model: QuadraticDiscriminant, threshold: float = 0.3) -> DataFrame:
    """The rows of documents, all columns, that score at least `threshold`.  Kept rows aren't joined back: the verdict
    is taken as each row passes."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                yield part.filter(pa.array(shared.value.score(statistics(part.column("text"))) >= threshold))

    return documents.mapInArrow(good, documents.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels come from folds 1 to 4 of crc32(doc_id) mod 5 only."""
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents, fit(documents, labels)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
