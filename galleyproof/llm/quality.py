"""Quality classification by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (logs and log ratios, so that classes
are near to normal). For each class, sums over all training rows give its mean and
covariance, which is shrunk towards the pooled covariance and its diagonal; the score is
the logistic of the difference of the classes' log densities, whose Mahalanobis distances
come from Cholesky factors computed once, plus the log ratio of the class sizes.

All labelled rows that ``train`` allows are used; only their sums reach the driver. Null
and empty texts have the statistics of an empty text and are scored like any other. With
rows of fewer than two classes to learn from, every score is the smoothed share of label
1. Rows without a label are ignored in training; repeated rows count as often as they
come. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.llm.common import materialise, text_chunks
from galleyproof.llm.words import split_words
from galleyproof.session import map_arrow

STATISTICS = ("size", "upper", "symbols", "bars", "exclamations", "digits", "stops", "repeats", "variety", "word_length", "lines", "entropy")
_D = len(STATISTICS)


def _counted(chars: str) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars.encode())] = 1
    return mask


_CLASSES = np.stack(
    [
        _counted("".join(map(chr, range(65, 91)))),
        _counted("".join(map(chr, range(97, 123)))),
        _counted("#$%&*@^~<>=+\\_{}[]`"),
        _counted("|"),
        _counted("!"),
        _counted("0123456789"),
        _counted(".,;:?"),
        _counted("\n"),
    ],
    axis=1,
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of transformed statistics for each text."""
    words = split_words(texts)
    n_words = np.diff(words.bounds)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = np.bincount(words.doc, weights=same, minlength=len(texts))
    order = np.lexsort((words.hash, words.doc))
    ordered = words.hash[order]
    new = np.ones(len(ordered), bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    distinct = np.bincount(words.doc, weights=new, minlength=len(texts))
    bytes_seen = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]).astype(float)
    n = bytes_seen.sum(axis=1)
    upper, lower, symbols, bars, exclamations, digits, stops, lines = (bytes_seen @ _CLASSES).T
    share = bytes_seen / np.maximum(n, 1)[:, None]
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
    rate = lambda x, of: np.log((x + 0.5) / (of + 1.0))
    return np.stack(
        [
            np.log1p(n), np.log((upper + 0.5) / (lower + 0.5)), rate(symbols, n), rate(bars, n), rate(exclamations, n), rate(digits, n),
            rate(stops, n), rate(repeats, n_words), np.log((distinct + 0.5) / (n_words - distinct + 0.5)), np.log1p((n - n_words) / (n_words + 1)), rate(lines, n), entropy,
        ],
        axis=1,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_chunks(batches):
        rows = statistics(texts)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * _D)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the transformed statistics of each row of ``docs`` (doc_id, text)."""
    return map_arrow(docs.select("doc_id", "text"), _measure, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors and log normalisers of the classes 0 and 1, and the log ratio of their sizes."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    prior: float

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float, ridge: float) -> Discriminant:
        if min(counts) < 2:
            return cls(np.zeros((0, _D)), np.zeros((0, _D, _D)), np.zeros(0), float(np.log((counts[1] + 1) / (counts[0] + 1))))
        means = sums / counts[:, None]
        own = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.tensordot(counts / counts.sum(), own, 1)
        spread = np.diag(np.maximum(np.diag(pooled), 1e-6))
        factors = np.stack([np.linalg.cholesky((1 - shrink - ridge) * c + shrink * pooled + ridge * spread + 1e-9 * np.eye(_D)) for c in own])
        logs = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
        return cls(means, factors, logs, float(np.log(counts[1] / counts[0])))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        odds = np.full(len(x), self.prior)
        for k in range(len(self.means)):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            density = -0.5 * (z * z).sum(axis=0) - self.logs[k]
            odds += density if k else -density
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, shrink: float = 0.15, ridge: float = 0.05) -> Discriminant:
    """Learn from the rows of ``labels`` (doc_id, ``label``) that satisfy ``train``; only sums are collected."""
    rows = labels.where(F.col(label).isin(0, 1)).where(F.lit(True) if train is None else train).select("doc_id", F.col(label).cast("int").alias("y"))
    known = measured.join(rows, "doc_id").select("y", F.concat(F.array(F.lit(1.0)), "x").alias("x"))
    terms = known.select("y", F.posexplode(F.expr(f"flatten(transform(sequence(0, {_D}), i -> transform(slice(x, i + 1, {_D + 1} - i), v -> v * x[i])))"))).groupBy("y", "pos").agg(F.sum("col").alias("v"))
    totals = np.zeros((2, _D + 1, _D + 1))
    place = [(i, j) for i in range(_D + 1) for j in range(i, _D + 1)]
    for r in terms.collect():  # 2 x 91 rows
        i, j = place[r["pos"]]
        totals[r["y"], i, j] = totals[r["y"], j, i] = r["v"]
    return Discriminant.fit(totals[:, 0, 0], totals[:, 0, 1:], totals[:, 1:, 1:], shrink, ridge)


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text): the probability of label 1."""
    measured = materialise(document_statistics(docs), "statistics")
    return _scored(measured, fit(measured, labels, label, train))


def _scored(measured: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, _D)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return map_arrow(measured, run, "doc_id long, score double")


def good_documents(docs: DataFrame, labels: DataFrame, train: Column | None = None, least: float = 0.3) -> DataFrame:
    """``docs`` without the documents that score below ``least``; rows without doc_id are judged where they stand."""
    measured = materialise(document_statistics(docs.where("doc_id is not null")), "statistics")
    model = fit(measured, labels, train=train)
    rejected = _scored(measured, model).where(F.col("score") < least).select("doc_id").distinct()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for ids, texts in text_chunks([batch]):
                yield batch.slice(start, len(ids)).filter(pa.array(model.score(statistics(texts)) >= least))
                start += len(ids)

    placed = docs.where("doc_id is not null").join(rejected, "doc_id", "left_anti").select(*docs.columns)
    return placed.unionAll(map_arrow(docs.where("doc_id is null"), keep, docs.schema))
