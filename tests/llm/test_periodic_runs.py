"""op13 against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from horarium.llm import periodic_runs as periodic
from horarium.llm.queries import QUERIES


def brute_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, e - a, q) for (a, e), q in found.items())


def brute(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if plant and n and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


def repetitive(seed, n):
    r, out = random.Random(seed), []
    while len(out) < n:
        unit = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(1, 30))]
        out += unit * r.randint(1, 9) + [r.choice("xyz")] * r.randint(0, 2)
    return out[:n]


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 9000]
    wanted = {d: brute(d, t) for d, t in rows}
    got = {r[0]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert {d: got[d] for d in wanted} == wanted and sum(x[1] for x in wanted.values())


def test_odd_texts_short_and_tiled(spark, docs):
    rows = [(k, " \n".join(repetitive(k, 40 + 7 * k))) for k in range(60)]
    rows += [(None, "a " * 30), (None, None), (3, ""), (3, " \t"), (4, "a b a b a b a b"), (4, "a b a b a b a b"), (5, "a a a a a"), (6, "\x0bé é é é é é\x0c")]
    rows += [(700 + k, " ".join(repetitive(k, 900))) for k in range(8)]
    df = spark.createDataFrame([(d, t, "en", 1, True, 5, 0.5) for d, t in rows], docs.schema)
    want = sorted((brute(d, t) for d, t in rows), key=str)
    assert _got(periodic.report(df, plant=True)) == want
    assert _got(periodic.report(df, plant=True, long_chars=10)) == want  # nearly all through tiles
    assert _got(periodic.report(docs)) == sorted((brute(r.doc_id, r.text, False) for r in docs.collect()), key=str)


def test_empty_table(spark, empty):
    assert periodic.report(empty).collect() == []


def test_tiles_stitch(monkeypatch):
    monkeypatch.setattr(periodic, "SHARED_OCTAVES", 2)
    for seed in range(150):
        words = [w.encode() for w in repetitive(seed, 20 + 3 * seed)]
        ids, pieces = periodic.number(words), {}
        for first, n, a, z in periodic.tiles(len(words)):
            for q, s, e in zip(*(x.tolist() for x in periodic.stretches(ids[a:z], [z - a] * n, first)), strict=True):
                pieces.setdefault(q, []).append((s + a, e + a))
        whole = []
        for q, parts in pieces.items():
            for s, e in sorted(parts):
                if whole and whole[-1][0] == q and s <= whole[-1][2]:
                    whole[-1] = (q, whole[-1][1], max(e, whole[-1][2]))
                else:
                    whole.append((q, s, e))
        assert periodic.settle(ids, whole) == brute_runs(words)


def test_a_million_equal_words():
    assert periodic.runs_of([[b"a"] * 1_000_000]) == [[(0, 1_000_000, 1)]]


def test_a_false_match_is_not_a_run():
    ids = periodic.number([w.encode() for w in "a b a b a b a b x y z".split()])
    assert periodic.settle(ids, [(2, 0, 9)]) == [(0, 8, 2)]
