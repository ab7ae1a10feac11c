"""Learned operators: held-out accuracy, edge cases, and the pipeline against a brute-force version."""

import hashlib
import re

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from horarium.llm import quality_qda, toxicity_pu


def held(spark, scores, labels, name):
    rows = scores.join(labels, "doc_id").filter("held_out").select("score", "predicted", name).collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r[name] for r in rows])


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    score, predicted, label = held(spark, quality_qda.quality_scores(docs, labels), labels, "quality")
    assert ((score >= 0) & (score <= 1)).all() and (predicted == label).mean() > 0.95


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    score, predicted, label = held(spark, toxicity_pu.toxicity_scores(docs, labels), labels, "toxic")
    assert ((score >= 0) & (score <= 1)).all() and (predicted == label).mean() > 0.95
    assert score[label == 1].mean() > 0.8 > 0.2 > score[label == 0].mean()


def test_held_out_labels_are_not_read(spark):
    import zlib

    rows = [(k, f"word{k % 7} idiot" if k % 5 == 0 else f"word{k % 7} fine", k) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    out = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(k, int(k % 5 == 0) ^ (flip if zlib.crc32(str(k).encode()) % 4 == 2 else 0), 1) for k in range(400)], "doc_id long, toxic int, quality int")
        out.append({r.doc_id: r.score for r in toxicity_pu.toxicity_scores(docs, labels).collect()})
    assert out[0] == out[1] and out[0][0] > 0.5 > out[0][1]


def test_edge_cases(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], none.schema)
    for labels in (none, some):
        for f in (toxicity_pu.toxicity_scores, quality_qda.quality_scores):
            rows = f(docs, labels).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
            assert f(empty, labels).count() == 0


def test_one_id_many_times(spark):
    """A repeated id is one example; the sample keeps its bound."""
    rows = [(k % 3, f"word{k % 7} idiot") for k in range(600)] + [(k, f"word{k % 7} fine") for k in range(3, 203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(3)] + [(k, 0) for k in range(3, 203)], "doc_id long, toxic int")
    assert len(toxicity_pu.toxicity_scores(docs, labels).collect()) == 800


def test_toxicity_scores_against_plain_numpy(spark):
    """Every score from the model's numbers alone: buckets by hand, the network written out."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity_pu.train(docs, labels)
    w1, b1, w2, b2 = model.layers
    got = {r.doc_id: r.score for r in toxicity_pu.score(docs, model).collect()}
    for r in docs.collect():
        words = set(re.findall(rb"[a-z0-9\x80-\xff]+", (r.text or "").lower().encode()))
        keys = {b"=" + w for w in words} | {b"%d:" % k + w[:k] for w in words for k in (4, 5, 6) if len(w) > k}
        cells = sorted({xxhash.xxh32_intdigest(k) % 2**18 for k in keys})
        v, n = model.cues[cells], len(cells)
        strong, certain = sum(x > 1.2 for x in v), sum(x > 1.8 for x in v)
        x = np.array([strong / (n + 1) ** 0.5, np.log(1 + strong), certain / (n + 1) ** 0.5, np.log(1 + certain), np.log(1 + n), v.sum() / (n + 1) ** 0.5, v[v > 0].sum() / (n + 1) ** 0.5])
        z = np.tanh((x - model.centre) / model.scale @ w1 + b1) @ w2 + b2[0]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-5


def test_quality_scores_against_dense_gaussians(spark):
    """Densities from inverted covariances instead of Cholesky factors."""
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(0, 1, (200, quality_qda.DIM)), g.normal(0.6, 2, (300, quality_qda.DIM))])
    y = np.r_[np.zeros(200, int), np.ones(300, int)]
    one = np.c_[np.ones(len(x)), x]
    model = quality_qda.fit(np.array([one[y == k].T @ one[y == k] for k in (0, 1)]))
    logs = []
    pooled = sum(((x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in (0, 1))) / len(x)
    pooled = 0.95 * pooled + 0.05 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
    for k in (0, 1):
        own, n = x[y == k], (y == k).sum()
        lam = max(0.1, quality_qda.DIM / (n + quality_qda.DIM))
        cov = (1 - lam) * np.cov(own.T, bias=True) + lam * pooled
        d = x - own.mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(quality_qda.log_density_difference(model, x), logs[1] - logs[0], atol=1e-6)
    assert np.allclose(quality_qda.scores(model, x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log(1.5), -500, 500))))


def test_nn_pu_recovers_a_boundary():
    g = np.random.default_rng(0)
    pos, neg = g.normal(2, 1, (300, 2)), g.normal(-2, 1, (700, 2))
    layers = toxicity_pu.fit_nn_pu(pos, np.vstack([g.normal(2, 1, (300, 2)), neg]), 0.3)
    z = toxicity_pu._forward(layers, np.vstack([pos, neg]))[1]
    assert ((z > 0) == np.r_[np.ones(300, bool), np.zeros(700, bool)]).mean() > 0.97


def test_pipeline_stages_on_odd_tables(spark, docs, empty, sf_dir):
    """Nulls, repeated rows, columns with the stages' own names, and no rows at all."""
    import corpus_pipeline as P

    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema["n_words"] == docs.schema["n_words"], name
        left = {r.doc_id for r in out.collect()}
        assert left <= set(range(len(docs.collect()))) and {2, 3, 6} & left, name
        assert stage(spark, empty, sf_dir).count() == 0, name
    tokens = P.STAGES[-1][1]
    assert tokens(spark, docs, sf_dir).count() == docs.count() and tokens(spark, empty, sf_dir).count() == 0


def test_pipeline(spark, sf_dir):
    """Each stage on the one before it, by plain Python over the few documents."""
    import corpus_pipeline as P

    from .test_exact import base_spans, shingles, windows

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = toxicity_pu.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id: r.text for r in docs.collect() if toxicity_pu.score_buckets(model, [toxicity_pu.text_buckets(r.text, {})])[0] < 0.3}
    sets = {k: shingles(t) for k, t in kept.items()}
    least = {k: k for k in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    kept = {k: t for k, t in kept.items() if least[k] == k}
    wins = set().union(*(windows(t)[1] for t in bench))
    for k, t in list(kept.items()):
        words, hit = windows(t)[0], set()
        for n in {len(w) for w in wins}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
        if hit and 20 * len(hit) >= len(words):
            del kept[k]
    for k, t in kept.items():
        found, taken = list(base_spans(t)), set()
        for span in found:
            taken |= set(range(*map(int, span.split(":")[1:])))
        for m in re.finditer("(?<![A-Za-z0-9])[A-Za-z0-9]{16,}(?![A-Za-z0-9])", t):
            if len(re.findall("[0-9]", m.group())) >= 4 <= len(re.findall("[A-Za-z]", m.group())) and not taken & set(range(*m.span())):
                found.append(f"secret:{m.start()}:{m.end()}")
        for span in sorted(found, key=lambda s: -int(s.split(":")[1])):
            kind, a, z = span.split(":")
            t = t[: int(a)] + f"<{kind}>" + t[int(z) :]
        kept[k] = t
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in P.run(spark, sf_dir).collect()}
    assert got.keys() == kept.keys()
    for k, t in kept.items():
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]
