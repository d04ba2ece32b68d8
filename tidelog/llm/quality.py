"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text is turned into a vector of transformed statistics (lengths, shares
of character classes, repetition). Each class has a Gaussian whose covariance
is shrunk towards the pooled one and its diagonal; a score is the logistic of
the difference of the two Mahalanobis log-densities, less the cut that makes
fewest errors on the training rows, with the Cholesky factors computed once.

The fit uses at most about ``FIT_ROWS`` labelled rows, chosen by a hash of
their id; at that size they are broadcast to the scan, and their statistics,
a few megabytes, come to the driver. Scoring is one narrow map.

Defined results: null and empty texts are scored as zero words; labels other
than 0 and 1 and null ids teach nothing; a repeated label counts each time;
with no labels of one class every score is 0 or 1, with none at all 0.5; an
empty table gives an empty result. ``held_out`` of a null id is false.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import fold_of, pick
from tidelog.llm.words import BLANK_LOWER, Words, steps

#: Expected labelled rows that a fit uses at most.
FIT_ROWS = 20_000
#: Share of the pooled covariance, and of its diagonal, in each class's covariance.
SHRINK, SHRINK_DIAGONAL = 0.2, 0.1
#: Log-density differences are divided by this before the logistic.
SOFTEN = 4.0

# Byte classes: 1 lower-case, 2 upper-case, 3 digit, 4 blank, 5 newline, 6 full stop or comma, 7 other ASCII, 8 lead byte, 0 continuation byte
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[[44, 46]] = 4, 5, 6
_CLASS[192:] = 8


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    words = Words(column, BLANK_LOWER)
    kinds, offsets, n = _CLASS[words.raw], words.offsets, len(words.count)
    by = np.zeros((n, 9))
    for k in range(1, 9):
        total = np.zeros(len(kinds) + 1, np.int32)
        np.cumsum(kinds == k, out=total[1:], dtype=np.int32)
        by[:, k] = np.diff(total[offsets])
    chars = by.sum(axis=1)
    c, w = np.maximum(chars, 1), np.maximum(words.count, 1)
    doc, h = words.doc, words.hashes()
    repeat = [np.bincount(doc[k:][(h[k:] == h[:-k]) & (doc[k:] == doc[:-k])], minlength=n) for k in (1, 2)]
    distinct, most = np.zeros(n), np.zeros(n)
    if len(h):
        order = np.lexsort((h, doc))
        d, s = doc[order], h[order]
        new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
        distinct = np.bincount(d[new], minlength=n)
        np.maximum.at(most, d[new], np.diff(np.r_[new, len(s)]))
    letters = by[:, 1] + by[:, 2] + by[:, 8]
    return np.column_stack([
        np.log1p(chars),
        np.log1p(letters / w),
        np.sqrt(by[:, 7] / c),
        np.sqrt(by[:, 7] / w),
        np.sqrt(by[:, 6] / w),
        np.sqrt(by[:, 3] / c),
        np.sqrt(by[:, 2] / c),
        np.sqrt(by[:, 5] / w),
        np.sqrt(repeat[0] / w),
        np.sqrt(repeat[1] / w),
        np.sqrt(most / w),
        np.log1p(distinct) / np.log1p(w),
        np.sqrt(by[:, 8] / c),
    ])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of the two classes, and where to cut."""

    scale: np.ndarray
    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    logdet: list[float]
    cut: float = 0.0
    only: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, whiten, logdet in zip(self.mean, self.whiten, self.logdet, strict=True):
            z = (x / self.scale - mean) @ whiten.T
            density.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        return 1 / (1 + np.exp(-np.clip((self.margin(x) - self.cut) / SOFTEN, -50, 50)))


def _cut(margin: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cuts with fewest errors."""
    order = np.argsort(margin, kind="stable")
    margin, y = margin[order], y[order]
    wrong = np.r_[0, np.cumsum(y == 1)] + np.r_[np.cumsum((y == 0)[::-1])[::-1], 0]
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.r_[margin[0], margin, margin[-1]]
    k = best[len(best) // 2]
    return float(edges[k] + edges[k + 1]) / 2


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    if len(x) == 0 or y.min() == y.max():
        return Discriminant(np.ones(1), [], [], [], only=0.5 if len(x) == 0 else float(y[0]))
    parts = [x[y == k] for k in (0, 1)]
    scale = np.sqrt(sum(((p - p.mean(axis=0)) ** 2).sum(axis=0) for p in parts) / len(x)) + 1e-3
    parts = [p / scale for p in parts]
    mean = [p.mean(axis=0) for p in parts]
    own = [(p - m).T @ (p - m) / max(1, len(p)) for p, m in zip(parts, mean, strict=True)]
    pooled = sum(s * len(p) for s, p in zip(own, parts, strict=True)) / len(x)
    target = np.diag(np.diag(pooled) + 1e-3)
    factors = [np.linalg.cholesky((1 - SHRINK - SHRINK_DIAGONAL) * s + SHRINK * pooled + SHRINK_DIAGONAL * target) for s in own]
    model = Discriminant(scale, mean, [np.linalg.inv(f) for f in factors], [2 * float(np.log(np.diag(f)).sum()) for f in factors])
    model.cut = _cut(model.margin(x), y)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Discriminant:
    """Learns from labelled rows outside the held-out third."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("label IN (0, 1)").where(fold_of("doc_id", 3) != 1)
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))

    def measure(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    rows = pick(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("label", "text").mapInArrow(measure, "label int, x array<double>").collect()
    width = statistics(pa.array([""])).shape[1]
    return fit(np.array([r.x for r in rows]).reshape(-1, width), np.array([r.label for r in rows], int))


def scores(docs: DataFrame, model: Discriminant, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def rate(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(statistics(part.column("text"))))], names=["doc_id", "score"])

    rated = pick(docs, id_col, text_col).mapInArrow(rate, "doc_id long, score double")
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    return rated.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: Discriminant, *, text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, that the classifier does not reject."""

    def keep(batches):
        for batch in batches:
            for part in steps(batch, text_col):
                yield part.filter(pa.array(model.score(statistics(part.column(text_col))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
