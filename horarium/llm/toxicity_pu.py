"""Toxicity scores by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts (P) and unlabelled texts (U) only.  A
numpy network is trained on the non-negative risk estimator
``pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))`` (Kiryo et al., 2017), where
``pi`` is the class prior.  When the corrected negative part falls below zero
its gradient is reversed, which keeps the network from memorising P.

Inputs of the network are a handful of per-text statistics over *cue* weights:
every distinct word and its prefixes of four to six bytes are hashed to
``2**BITS`` buckets, and a bucket's cue weight is its log-ratio of document
frequencies in P and U, kept where it is no accident of sampling.  Weights and network are cross-fitted (each half of the
sample is described by weights from the other half), so the network is not
fooled by cues that are only seen in the texts that produced them.

Bounds: the learner is fitted on a bounded sample (``max_positive`` and
``max_unlabelled`` distinct ids, those of least hash, one text an id); the prior
uses every labelled row, and every whole text is scored.  Spark counts and
describes the sample; the driver receives at most ``4 * 2**BITS`` counts and
seven numbers a text.  The model (1 MB) is the only broadcast.

Edge cases: null and empty texts are scored like any text, from no words; an
empty table gives an empty result; without positive examples every score is
0.0; repeated rows and repeated doc_ids are scored one by one, and count once
in the sample (the least text of an id); equal texts have equal scores; a
doc_id that is labelled twice counts as toxic if any label says so; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship_code
from .common import held_out, stash

BITS = 18
PREFIXES = (4, 5, 6)
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_CACHE_WORDS = 200_000


@dataclass
class PuModel:
    cues: np.ndarray  # float32[2**BITS]
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # w1, b1, w2, b2; empty: no positive example was seen


def _buckets(word: bytes) -> tuple[int, ...]:
    keys = [b"=" + word] + [b"%d:" % k + word[:k] for k in PREFIXES if len(word) > k]
    return tuple({xxhash.xxh32_intdigest(k) & ((1 << BITS) - 1) for k in keys})


def text_buckets(text: str | None, cache: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """Distinct hash buckets of a whole text's words and word prefixes."""
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower().encode("utf-8", "replace"))):
        ids = cache.get(word)
        if ids is None:
            if len(cache) >= _CACHE_WORDS:
                cache.clear()
            ids = cache[word] = _buckets(word)
        found.update(ids)
    return np.fromiter(found, np.int64, len(found))


def _describe(cues: np.ndarray, buckets: np.ndarray) -> list[float]:
    v, n = cues[buckets], len(buckets)
    root, strong, certain = np.sqrt(n + 1.0), int((v > 1.2).sum()), int((v > 1.8).sum())
    return [strong / root, np.log1p(strong), certain / root, np.log1p(certain), np.log1p(n), float(v.sum()) / root, float(v[v > 0].sum()) / root]


def _cue_weights(cp: np.ndarray, n_pos: int, cu: np.ndarray, n_unl: int) -> np.ndarray:
    """Weights from the numbers of P and U texts that hold each bucket."""
    r = np.log((cp + 0.5) / (n_pos + 1)) - np.log((cu + 0.5) / (n_unl + 1))
    expected = cu * (n_pos / max(n_unl, 1))
    sure = np.abs(cp - expected) > 3.5 * np.sqrt(expected + 0.5)
    return np.where(sure & (np.abs(r) > 0.7), r, 0).astype(np.float32)


def _forward(layers, x):
    h = np.tanh(x @ layers[0] + layers[1])
    return h, h @ layers[2] + layers[3][0]


def fit_nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 8, steps: int = 300, rate: float = 0.02, seed: int = 7) -> list[np.ndarray]:
    """Minimise the non-negative PU risk (logistic loss) by Adam; returns the layers."""
    g, d = np.random.default_rng(seed), pos.shape[1]
    layers = [g.normal(0, 0.3, (d, hidden)), np.zeros(hidden), g.normal(0, 0.3, hidden), np.array([np.log(prior / (1 - prior))])]
    m, v = [0 * x for x in layers], [0 * x for x in layers]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        (hp, zp), (hu, zu) = _forward(layers, pos), _forward(layers, unl)
        negative_part = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative_part >= 0:
            gp = -prior * (sigmoid(-zp) + sigmoid(zp)) / len(zp)
            gu = sigmoid(zu) / len(zu)
        else:
            gp = prior * sigmoid(zp) / len(zp)
            gu = -sigmoid(zu) / len(zu)
        grads = [1e-4 * x for x in layers]
        for x, h, gz in ((pos, hp, gp), (unl, hu, gu)):
            back = np.outer(gz, layers[2]) * (1 - h * h)
            for k, part in enumerate((x.T @ back, back.sum(0), h.T @ gz, gz.sum(keepdims=True))):
                grads[k] = grads[k] + part
        for k, grad in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
            layers[k] = layers[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def score_buckets(model: PuModel, buckets: list[np.ndarray]) -> np.ndarray:
    if not model.layers or not buckets:
        return np.zeros(len(buckets))
    x = (np.array([_describe(model.cues, b) for b in buckets]) - model.centre) / model.scale
    return 1 / (1 + np.exp(-np.clip(_forward(model.layers, x)[1], -500, 500)))


def _sample(ids: DataFrame, rows: int) -> DataFrame:
    """The `rows` distinct ids of least hash: the same ones on every run."""
    return ids.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict = {}
    for b in batches:
        found = [text_buckets(t.as_py(), cache).astype(np.int32).tobytes() for t in b.column(2)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["positive", "half", "buckets"])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, half, bucket, n) of a task: at most four times 2**BITS rows."""
    total = np.zeros((2, 2, 1 << BITS), np.int64)
    for b in batches:
        for positive, half, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[positive, half][np.frombuffer(cells, np.int32)] += 1
    positive, half, bucket = np.nonzero(total)
    yield pa.record_batch([pa.array(positive.astype(np.int32)), pa.array(half.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[positive, half, bucket])], names=["positive", "half", "bucket", "n"])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 6000) -> PuModel:
    """Fit on confirmed toxic texts against unlabelled ones; held-out labels are not read.

    `docs` has doc_id and text, `labels` doc_id and toxic.  The two id samples
    are bounded by the parameters, so that their join with `docs` may broadcast.
    """
    known = labels.filter(~held_out()).filter(F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n, n_pos = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(max((n_pos or 0) / n if n else 0.0, 0.0), 0.99)
    ids_p = _sample(known.filter("toxic = 1"), max_positive).withColumn("positive", F.lit(1))
    ids_u = _sample(docs.filter(~held_out()), max_unlabelled).withColumn("positive", F.lit(0))
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids_p.unionByName(ids_u)), "doc_id")
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)).cast("int")
    chosen = chosen.groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("positive", half.alias("half"), "text")
    chosen = stash(chosen.mapInArrow(_bucket_rows, "positive int, half int, buckets binary"), "pu-sample")
    size, count = np.zeros((2, 2), np.int64), np.zeros((2, 2, 1 << BITS))
    for r in chosen.groupBy("positive", "half").count().collect():
        size[r.positive, r.half] = r["count"]
    held = chosen.mapInArrow(_bucket_counts, "positive int, half int, bucket int, n long").groupBy("positive", "half", "bucket").agg(F.sum("n").alias("n")).toPandas()
    count[held["positive"], held["half"], held["bucket"]] = held["n"]
    cues = _cue_weights(count[1].sum(0), size[1].sum(), count[0].sum(0), size[0].sum())
    if size[1].sum() < 2 or size[0].sum() < 2 or not 0 < prior < 1:
        return PuModel(cues, np.zeros(7), np.ones(7), [])
    crossed = np.stack([_cue_weights(count[1, 1 - h], size[1, 1 - h], count[0, 1 - h], size[0, 1 - h]) for h in (0, 1)])
    shared = docs.sparkSession.sparkContext.broadcast(crossed)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [_describe(shared.value[h], np.frombuffer(c, np.int32)) for h, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["positive", "x"])

    rows = chosen.mapInArrow(described, "positive int, x array<double>").orderBy("positive", "x").toPandas()
    x, positive = np.array(rows["x"].tolist()), rows["positive"].to_numpy() == 1
    centre, scale = x[~positive].mean(0), x[~positive].std(0) + 1e-9
    return PuModel(cues, centre, scale, fit_nn_pu((x[positive] - centre) / scale, (x[~positive] - centre) / scale, prior))


def score(docs: DataFrame, model: PuModel) -> DataFrame:
    """doc_id and score for every row of `docs`; text may be null."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            s = score_buckets(shared.value, [text_buckets(t.as_py(), cache) for t in b.column(1)])
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: PuModel, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that score below the threshold, unchanged."""
    ship_code(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            s = score_buckets(shared.value, [text_buckets(t.as_py(), cache) for t in b.column(at)])
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(kept, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scores = score(docs, train(docs, labels))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
