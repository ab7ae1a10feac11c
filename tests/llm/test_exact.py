"""Exact operators against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from horarium.llm import bpe_tree, decontaminate, fingerprint, jaccard, pii_bootstrap, suffix_levels, token_counts, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def table(df):
    """Rows by doc_id; repeated rows must agree."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r.doc_id, r) == r
    return out


def all_texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("hot", "most_hot", "family"), [(1000, 100_000, 8 << 20), (2, 100_000, 1), (2, 3, 500)])
def test_substrings(docs, hot, most_hot, family):
    """Without hot keys, with them, and with more than are broadcast; families that end with every key."""
    got, n = table(suffix_levels.remove_repeats(docs, hot, most_hot, family)), suffix_levels.LENGTH
    raw = [(k, t.encode()) for k, t in all_texts(docs)]
    seen = Counter(b[i : i + n] for _, b in raw for i in range(len(b) - n + 1))
    for k, b in raw:
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                covered[i : i + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~covered[:-1]]) if b else b""
        spans = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_level_family_merges_geometrically():
    family, rng = suffix_levels.LevelFamily(), np.random.default_rng(1)
    for _ in range(12):
        family.add(rng.integers(0, 255, 600, np.uint8).tobytes(), np.arange(400))
    assert len(family.levels) <= 5 and not family.hit.any()


def test_a_passage_in_very_many_documents(spark):
    """One key of 100,000 occurrences: parts meet, and nothing is compared with everything."""
    passage = "".join(chr(97 + k * k % 23) for k in range(230))
    docs = spark.range(100_000).selectExpr("id as doc_id", f"concat('own ', id, '{passage}', md5(cast(id as string))) as text")
    got = suffix_levels.remove_repeats(docs).selectExpr("n_removed >= 230 as passage", "n_spans = 1 as once").groupBy("passage", "once").count().collect()
    assert [tuple(r) for r in got] == [(True, True, 100_000)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(sets):
    """Least id of each class by fixed-point iteration over all pairs."""
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0]
    least, changed = {k: k for k in sets}, True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def family(size):
    """Edits of one text at random places: many just reach the similarity, many just miss it; and texts that share a passage only."""
    rng, words = np.random.default_rng(7), [f"w{k}" for k in range(60)]
    for k in range(size):
        own = list(words)
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            own[at] = f"e{k}x{at}"
        yield " ".join(own)
    for k in range(size):
        yield " ".join([*words[:20], *(f"p{k}y{j}" for j in range(12))])


@pytest.mark.parametrize("sizes", [{}, {"batch": 50, "block": 40, "split": 2}])
def test_jaccard(docs, sizes):
    got = table(jaccard.link_groups(docs, **sizes))
    sets = {k: shingles(t) for k, t in all_texts(docs)}
    least = brute_components(sets)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(sets[k]), least[k]) for k in sets}
    if sizes:
        return
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k in sets if least[k] == k)


@pytest.mark.parametrize("sizes", [{}, {"batch": 60, "block": 100, "split": 2}])
def test_jaccard_of_a_large_family(spark, sizes):
    docs = spark.createDataFrame(list(enumerate(family(60))), "doc_id long, text string").repartition(5)
    sets = {k: shingles(t) for k, t in all_texts(docs)}
    got = {r.doc_id: r.component_id for r in jaccard.link_groups(docs, **sizes).collect()}
    least = brute_components(sets)
    assert got == least and 1 < len({least[k] for k in range(60)}) < 60


def test_jaccard_ids(spark):
    """No id, one id with several texts, and ids that are strings."""
    base, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(None, base), (None, None), ("b", base), ("a", base + " x"), ("c", other), ("c", base), ("d", other + " y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id or "", r.n_shingles, r.component_id) for r in jaccard.link_groups(docs).collect()), key=str)
    assert got == [("", 0, None), ("", 36, None), ("a", 37, "a"), ("b", 36, "a"), ("c", 36, "a"), ("c", 36, "c"), ("d", 37, "c")]
    assert jaccard.keep_one(docs).count() == 5


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return w, {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()


@pytest.mark.parametrize("block_chars", [1 << 20, 300])
def test_decontamination(spark, docs, texts, block_chars, monkeypatch):
    items = [("x", texts[5][50:400]), ("x2", texts[5][200:380]), ("short", "two THREE"), ("one", "one"), ("none", " -- "), ("null", None), (None, "alpha1"), ("own", texts[20])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontaminate.scan, "__defaults__", (13, block_chars))
    got = table(decontaminate.report(docs, bench))
    for k, t in all_texts(docs):
        words, _ = windows(t)
        hit, found = set(), set()
        for name, item in items:
            for win in windows(item or "")[1] if name else ():
                for i in range(len(words) - len(win) + 1):
                    if tuple(words[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(name)
        want = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(words))
        assert tuple(got[k])[1:] == want
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, r in got.items() if not r.contaminated}
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.count() == docs.count() and not any(r.contaminated for r in decontaminate.report(cut, bench).collect() if r.doc_id not in (3, 4))


def luhn(digits):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))) % 10 == 0


def base_spans(t):
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, rule in rules:
        for m in re.finditer(rule, t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                yield f"{kind}:{m.start()}:{m.end()}"


def test_personal_data(spark):
    odd = ["a@b.c_d@e.fg x..d@e.f a@b.c..d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111-1 1 2 3 4 5 6 7 8 9 0 1 2 3", "+1 (425) 555-0100 x+12345678901234567 ++44 20 7946 0958.",
           "日本 a@b.co 😀 +49 30 1234567", "", None, "a@" * 50 + "b.c", "1 " * 5000, "x@" + "a." * 5000 + "b"]
    cued = [f"please ring helpline: +1 (425) 555-01{k:02d} today" for k in range(6)] + ["please ring helpline: 425-555-0199 today", "the year 1999-2000-2001 was long"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(odd + cued)], "doc_id long, text string, spans int")
    got = table(pii_bootstrap.report(docs))
    for k, t in enumerate(odd + cued):
        want = list(base_spans(t or ""))
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii_bootstrap.KINDS] == [sum(w.startswith(x) for w in want) for x in pii_bootstrap.KINDS]
    found = len(odd) + 6
    assert got[found].spans == "phone:22:34" and got[found].n_added == 1 and got[found + 1].spans == ""
    red = {r.doc_id: r.text for r in pii_bootstrap.redact(docs).collect()}
    assert red[found] == "please ring helpline: <phone> today" and red[4] == "日本 <email> 😀 <phone>" and red[6] is None


@pytest.mark.parametrize("digits", [32, 1])
def test_fingerprints(docs, digits):
    got, order = {}, sorted(all_texts(docs))
    for r in fingerprint.fingerprints(docs, digits).collect():
        got.setdefault(r.doc_id, r)
    canon = {}
    for n, (k, t) in enumerate(order):
        if n + 1 < len(order) and order[n + 1][0] == k:
            continue  # the repeated row precedes itself
        if n and order[n - 1][0] == k:
            continue
        new = fingerprint.edited(t, order[(n + 1) % len(order)][1])
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        same = lambda a, b: float(fingerprint.canonical(a) == fingerprint.canonical(b))
        assert (got[k].near_edited, got[k].near_next) == (same(t, new), same(t, order[(n + 1) % len(order)][1]))
        for mark, text in ((got[k].fingerprint, t), (got[k].edited_fingerprint, new)):
            assert canon.setdefault(mark, fingerprint.canonical(text)) == fingerprint.canonical(text)
    assert len(set(canon.values())) == len(canon)


@pytest.mark.parametrize("digits", [2, 32])
def test_fingerprints_of_one_repeated_id(spark, digits):
    """Linear in the rows of an id; every row is reported."""
    rows = [(7, f"text {k % 5}") for k in range(20_000)] + [(8, "text 1")]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), digits).collect()
    assert len(got) == 20_001 and len({r.fingerprint for r in got}) == 5
    assert sum(r.near_next == 1.0 for r in got) >= 19_990  # rows of one id stand beside their equals


def test_fingerprints_of_equal_neighbours(spark):
    """White space and case alone do not tell texts apart; the last document is followed by the first."""
    docs = spark.createDataFrame([(1, "Ab  c"), (2, "aB c"), (3, "x"), (4, "ab c ")], "doc_id int, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert [got[k].near_next for k in (1, 2, 3, 4)] == [1, 0, 0, 1] and got[3].near_edited == 1 and got[4].edited_sha256 == hashlib.sha256(b"ab cA").hexdigest()


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (fingerprint.fingerprints, lambda d: token_files.write_token_files(d, WORD)):
        with pytest.raises(TypeError):
            f(docs)


@pytest.mark.parametrize("sizes", [{}, {"leaf": 64, "piece": 700}])
def test_bpe(docs, sizes):
    library = Tokenizer.from_file(BYTE)
    got, ids = table(bpe_tree.round_trip(docs, BYTE, **sizes)), bpe_tree.encode(docs, BYTE, **sizes)
    for k, t in all_texts(docs):
        want = library.encode(t, add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe_tree.decode(ids, BYTE).collect()} == dict(all_texts(docs))


def test_bpe_joins_on_random_strings():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc = bpe_tree.TreeEncoder(BYTE, leaf=8)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="ab e'stlI\n\t 1!äß日<|endoftext|>", max_size=200))
    def check(text):
        assert enc.encode(text) == enc.library.encode(text, add_special_tokens=False).ids

    check()


def test_token_files(docs):
    manifest, dictionary = token_files.write_token_files(docs, WORD)
    library, start = Tokenizer.from_file(WORD), 0
    rows = token_files.read_token_files(manifest, dictionary).orderBy("start").collect()
    for r, (k, t) in zip(rows, sorted(all_texts(docs)), strict=True):
        want = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert tuple(r) == (k, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    uri = manifest.first().uri
    shard = token_files.ShardReader(uri, dictionary)
    assert token_files.read_document(uri, dictionary, int(shard.doc_ids[0])).tolist() == shard.ids(0).tolist()
    with pytest.raises(ValueError):
        token_files.ShardReader(uri, dictionary + b"x")


def test_token_files_keep_null_and_least_ids(spark):
    rows = [(None, "a"), (-(1 << 63), "b c"), (None, None), (0, "d")]
    manifest, dictionary = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORD)
    got = [r.doc_id for r in token_files.read_token_files(manifest, dictionary).orderBy("start").collect()]
    assert got == [None, None, -(1 << 63), 0]
    uris = [r.uri for r in manifest.collect()]
    assert any(token_files.read_document(u, dictionary, -(1 << 63)) is not None for u in uris) and all(token_files.read_document(u, dictionary, 5) is None for u in uris)


@pytest.mark.parametrize("block", [5, 1000])
def test_token_counts(docs, block):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    names = token_counts.write_flat_files(docs, BYTE, 50256)
    counts = token_counts.count_tokens(names.select("uri").distinct(), 50256, block_tokens=block)
    got = table(names.join(counts, ["uri", "ordinal"]).select("doc_id", "n_tokens"))
    assert {k: r.n_tokens for k, r in got.items()} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in all_texts(docs)}


def test_counts_are_never_broadcast(docs):
    """Files of lengths are a two-hundredth of their rows; what looks small filled the driver."""
    counts = token_counts.document_counts(docs, BYTE, 50256)
    assert counts.count() == docs.count()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_ids_must_fit(docs):
    with pytest.raises(ValueError):
        token_counts.write_flat_files(docs, BYTE, 50256, width=1)


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id string, text string")
    for df in (suffix_levels.remove_repeats(empty), jaccard.link_groups(empty), decontaminate.report(empty, bench), pii_bootstrap.report(empty), fingerprint.fingerprints(empty), bpe_tree.round_trip(empty, BYTE), token_files.read_token_files(*token_files.write_token_files(empty, WORD)), token_counts.document_counts(empty, BYTE, 50256)):
        assert df.count() == 0
