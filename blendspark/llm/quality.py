"""Quality by regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendspark.llm import words
from blendspark.llm.frames import text_of
from blendspark.llm.labels import training_labels
from blendspark.operators.lineage import cut

#: Share of the pooled covariance in each class, and of a round one in both.
POOLED, ROUND = 0.1, 0.02
#: Log-odds are bent to stay within this, so that scores keep their order.
STEEPEST = 20.0

# Classes of bytes whose shares are statistics.
CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "line": (10,), "blank": (9, 32),
    "stop": b".!?", "comma": b",;:", "bang": b"!", "bar": b"|", "mark": b"#$%&*@^~+=", "bracket": b"()[]{}<>",
    "quote": b"\"'`", "slash": b"/\\_-", "wide": range(128, 256),
}
STATISTICS = (
    "words", "word_length", "long_words", "kinds", "pairs", "repeated_next", "lines", "line_words", *CLASSES,
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics per text: logarithms of counts, log-odds of shares.
    An empty text has those of no counts at all."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    start, end, of = words.words(data, offsets)
    count = np.diff(of).astype(float)
    row = np.repeat(np.arange(n), np.diff(of))
    length = (end - start).astype(float)
    hashes = words.word_hashes(data, start, end)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log((part + 0.5) / (whole - part + 0.5))

    def kinds(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct hashes of each row."""
        if not len(h):
            return np.zeros(n)
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])
        return np.bincount(rows[new], minlength=n).astype(float)

    inside = row[1:] == row[:-1]
    pair = words.mix(hashes[1:] * np.uint64(3) + hashes[:-1])[inside]
    same = np.bincount(row[1:][inside], (hashes[1:] == hashes[:-1])[inside], n)
    breaks = np.bincount(row_of_byte, data == 10, n)
    pairs = np.maximum(count - 1, 0)
    columns = [
        np.log1p(count), np.log1p(np.bincount(row, length, n) / np.maximum(count, 1)),
        share(np.bincount(row, length > 12, n), count), share(kinds(hashes, row), count), share(kinds(pair, row[1:][inside]), pairs),
        share(same, pairs), np.log1p(breaks), np.log1p(count / (breaks + 1)),
    ]
    member = np.zeros((len(CLASSES), 256))
    for i, values in enumerate(CLASSES.values()):
        member[i, list(values)] = 1
    for bytes_of in member:
        columns.append(share(np.bincount(row_of_byte, bytes_of[data], n), size))
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of ``STATISTICS``), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(data, offsets) for _, data, offsets in words.slices(batch.column("text"))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Per class (0, 1): mean, inverse Cholesky factor of the covariance, and what the
    log-density has besides the distance."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    constant: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.mean, self.factor, self.constant, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = self.log_odds(x)
        return 1 / (1 + np.exp(-odds / np.sqrt(1 + (odds / STEEPEST) ** 2)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: number, sum, sum of outer products of x.  Tasks add up their rows;
    two rows per task are shuffled, one per class reaches the driver."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            y = np.asarray(batch.column("y"))
            for c in (0, 1):
                part = x[y == c]
                sums[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([c] * sums.shape[1]), pa.array(np.arange(sums.shape[1])), pa.array(sums[c])], ["y", "i", "v"])

    rows = labelled.select("x", "y").mapInArrow(run, "y long, i long, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).toArrow()
    found = np.zeros((2, 1 + d + d * d))
    found[rows.column("y").to_numpy(), rows.column("i").to_numpy()] = rows.column("v").to_numpy()
    return {c: (found[c, 0], found[c, 1:1 + d], found[c, 1 + d:].reshape(d, d)) for c in (0, 1)}


def fit(statistics_rows: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """The model from all labelled rows of the training fold.  Where a class has no
    row, its density is that of both together, and only the shares decide."""
    known = training_labels(labels, column)
    sums = moments(statistics_rows.join(known, "doc_id"))
    d = len(STATISTICS)
    n = np.array([sums[c][0] for c in (0, 1)])
    total = max(n.sum(), 1.0)
    centre = (sums[0][1] + sums[1][1]) / total
    both = (sums[0][2] + sums[1][2]) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
    within, means, own = np.zeros((d, d)), [], []
    for c in (0, 1):
        size = max(n[c], 1.0)
        mean = sums[c][1] / size if n[c] else centre
        cov = sums[c][2] / size - np.outer(mean, mean) if n[c] else both
        cov = cov / np.outer(scale, scale)
        means.append((mean - centre) / scale)
        own.append(cov)
        within += cov * n[c] / total
    factors, constants = [], []
    for c in (0, 1):
        cov = (1 - POOLED) * own[c] + POOLED * within
        cov = (1 - ROUND) * cov + ROUND * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        constants.append(np.log((n[c] + 0.5) / (total + 1)) - np.log(np.diag(low)).sum())
    return Model(centre, scale, np.array(means), np.array(factors), np.array(constants))


def score(statistics_rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: how likely label 1 is, 0 to 1, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return statistics_rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, anything else): doc_id, score.

    Texts are read once; their statistics (``len(STATISTICS)`` numbers a row) are kept
    in the shared folder for fitting and scoring.  Null text counts as empty and is
    scored like any other; rows that repeat are scored alike; without labels every
    score is one half.
    """
    rows = cut(with_statistics(docs))
    return score(rows, fit(rows, labels))
