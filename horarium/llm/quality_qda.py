"""Text quality by regularised quadratic discriminant analysis.

Each text is reduced to transformed statistics (``STATISTICS``): logs of counts,
variance-stabilised shares of character classes, repetition of words and lines.
Class means and covariances come from sums that Spark gathers over *all*
labelled rows outside the held-out fold.  Each covariance is shrunk towards the
pooled one and the pooled one towards its diagonal; the Cholesky factors and
their inverses are computed once and shared with the tasks, which need one
product a class to get the Mahalanobis log-density difference and, from it, a score.

Discriminant scores of correlated statistics are over-confident, so the
log-density difference is divided by a temperature that is fitted on the same
labelled rows (one number, the best of a grid of 200 on a histogram of differences).

Edge cases: null and empty texts have defined statistics (all zero) and so a
score; an empty table gives an empty result; if a class has no labelled row the
score is the prior share of the other; repeated rows are scored one by one and
equal texts alike; a doc_id that is labelled twice counts with both labels;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship_code
from .common import held_out

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "space", "newline", "stop_marks",
    "exclaim", "symbols", "high_bytes", "type_token", "top_word", "repeated_lines", "log_lines", "byte_entropy", "symbol_words",
)
DIM = len(STATISTICS)
_CLASS = np.zeros(256, np.int64)
for _bytes, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3), (b"\n\r", 4), (b".,;:?'\"-()", 5), (b"!", 6), (b"#$%&*+/<=>@[\\]^_`{|}~", 7), (bytes(range(128, 256)), 8)):
    _CLASS[np.frombuffer(_bytes, np.uint8)] = _kind


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text."""
    out = np.zeros(DIM)
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    if not n:
        return out
    counts = np.bincount(raw, minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=9) / n
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / n
    out[0], out[1], out[15] = np.log1p(n), np.log1p(len(words)), np.log1p(len(lines))
    out[4:12] = np.arcsin(np.sqrt(share[1:9]))
    out[16] = -(p * np.log2(p)).sum()
    if words:
        sizes = np.fromiter(map(len, words), np.float64, len(words))
        tally: dict[str, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        out[2], out[3] = np.log(sizes.mean()), np.log1p(sizes.std())
        out[12] = len(tally) / len(words) ** 0.8
        out[13] = np.arcsin(np.sqrt(max(tally.values()) / len(words)))
        out[17] = np.arcsin(np.sqrt(sum(c for w, c in tally.items() if not w[-1].isalnum() and w[-1] not in ".,;:?") / len(words)))
    if lines:
        out[14] = np.arcsin(np.sqrt(1 - len(set(lines)) / len(lines)))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, DIM)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, DIM), pa.int32()), pa.array(rows.ravel(), pa.float64()))
        yield pa.record_batch([b.column(0), cells], names=["doc_id", "stats"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the array of statistics; the only pass over the texts."""
    ship_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {kind}, stats array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: the sums of 1, x and x x' as rows (class, cell, value)."""
    total = np.zeros((2, DIM + 1, DIM + 1))
    for b in batches:
        y = b.column(0).to_numpy(zero_copy_only=False).astype(int)
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
        x = np.hstack([np.ones((len(x), 1)), x])
        for k in (0, 1):
            total[k] += x[y == k].T @ x[y == k]
    k, cell = np.divmod(np.arange(total.size), (DIM + 1) ** 2)
    yield pa.record_batch([pa.array(k, pa.int32()), pa.array(cell, pa.int32()), pa.array(total.ravel())], names=["label", "cell", "value"])


@dataclass
class QdaModel:
    prior: float  # share of label 1
    means: np.ndarray  # (2, DIM)
    factors: np.ndarray  # lower Cholesky factors, (2, DIM, DIM); empty: a class is missing
    log_dets: np.ndarray
    temperature: float = 1.0

    @cached_property
    def whiteners(self) -> np.ndarray:
        """Inverses of the factors."""
        return np.array([np.linalg.inv(f) for f in self.factors])


def fit(moments: np.ndarray, shrink: float = 0.1, ridge: float = 0.05) -> QdaModel:
    """Shrunk class covariances and their factors from the sums over all labelled rows."""
    n = moments[:, 0, 0]
    prior = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < 2:
        return QdaModel(prior, np.zeros((2, DIM)), np.zeros((0, DIM, DIM)), np.zeros(2))
    means = moments[:, 0, 1:] / n[:, None]
    scatter = np.array([moments[k, 1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = scatter.sum(0) / n.sum()
    pooled = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(DIM)
    lam = np.maximum(shrink, DIM / (n + DIM))
    cov = [(1 - lam[k]) * scatter[k] / n[k] + lam[k] * pooled for k in (0, 1)]
    factors = np.array([np.linalg.cholesky(c) for c in cov])
    return QdaModel(prior, means, factors, np.array([2 * np.log(np.diag(f)).sum() for f in factors]))


def log_density_difference(model: QdaModel, x: np.ndarray) -> np.ndarray:
    """log p(x | 1) - log p(x | 0)."""
    out = np.zeros(len(x))
    for k, sign in ((0, -1), (1, 1)):
        z = model.whiteners[k] @ (x - model.means[k]).T
        out += sign * -0.5 * ((z * z).sum(0) + model.log_dets[k])
    return out


def scores(model: QdaModel, x: np.ndarray) -> np.ndarray:
    if not len(model.factors):
        return np.full(len(x), model.prior)
    z = log_density_difference(model, x) / model.temperature + np.log(model.prior / (1 - model.prior))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _temperature(labelled: DataFrame, model: QdaModel) -> float:
    """Temperature of least log-loss, from a histogram of differences over all labelled rows."""
    edges = np.concatenate([-np.geomspace(1e4, 0.05, 120), np.geomspace(0.05, 1e4, 120)])
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(edges) + 1), np.int64)
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            at = np.searchsorted(edges, log_density_difference(shared.value, x))
            np.add.at(total, (b.column(0).to_numpy(zero_copy_only=False).astype(int), at), 1)
        k, cell = np.divmod(np.arange(total.size), len(edges) + 1)
        yield pa.record_batch([pa.array(k, pa.int32()), pa.array(cell, pa.int32()), pa.array(total.ravel())], names=["label", "cell", "n"])

    hist = np.zeros((2, len(edges) + 1))
    for r in labelled.mapInArrow(binned, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect():
        hist[r.label, r.cell] = r.n
    centre = np.concatenate([[edges[0]], (edges[1:] + edges[:-1]) / 2, [edges[-1]]])
    bias = np.log(model.prior / (1 - model.prior))
    loss = lambda t: (hist[1] * np.logaddexp(0, -(centre / t + bias)) + hist[0] * np.logaddexp(0, centre / t + bias)).sum()
    grid = np.geomspace(0.5, 50, 200)
    return float(grid[np.argmin([loss(t) for t in grid])])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep=None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    `keep` stores the statistics between the passes (`common.stash` on a
    cluster); without it they are recomputed.
    """
    stats = (keep or (lambda df: df))(measure(docs))
    known = labels.filter(~held_out()).filter(F.col("quality").isNotNull()).select("doc_id", "quality")
    labelled = stats.join(known, "doc_id").select("quality", "stats")
    sums = np.zeros((2, (DIM + 1) ** 2))
    for r in labelled.mapInArrow(_moments, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():
        sums[r.label, r.cell] = r.value
    model = fit(sums.reshape(2, DIM + 1, DIM + 1))
    if len(model.factors):
        model.temperature = _temperature(labelled, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            yield pa.record_batch([b.column(0), pa.array(scores(shared.value, x))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = stats.mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
