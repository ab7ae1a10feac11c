"""op11 against a decoder that keeps every path's whole text."""

import hashlib
import random
import re
import zlib

import pytest

from horarium.llm import conversation_repair as repair
from horarium.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies int"


def _best(rows):
    """(cost, audit, digest): all least paths by state, each with its complete edits and output."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {"u": "user", "a": "assistant"}

    def insert(best):
        todo = list(best)
        while todo:
            p = todo.pop()
            for c in "ua":
                if (p, c) in step:
                    one = (best[p][0] + 5, best[p][1] + "I", best[p][2] + [name[c] + ":"])
                    if step[p, c] not in best or one[:2] < best[step[p, c]][:2]:
                        best[step[p, c]] = one
                        todo.append(step[p, c])
        return best

    best = insert({0: (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for p, (cost, audit, out) in best.items():
            options = [(p, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (p, role[:1]) in step:
                    options.append((step[p, role[:1]], more, "K", [f"{role}:{text}"]))
                options += [(step[p, c], more + 1, "R", [f"{name[c]}:{text}"]) for c in "ua" if (p, c) in step]
            for to, more, op, put in options:
                one = (cost + more, audit + op, out + put)
                if to not in new or one[:2] < new[to][:2]:
                    new[to] = one
        best = insert(new)
    cost, audit, out = min((best[p] for p in (0, 3) if p in best), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute(table):
    """The contract over (conv_id, turn, role, text) rows, in plain Python."""
    text_of = lambda x: " " if x is None else str(x)
    by = {}
    for conv, turn, role, text in table:
        rows = by.setdefault(conv, [])
        role, text = text_of(role), text_of(text)
        code = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, marked = set(), dict(blank=0, duplicate=0, truncated=0), []
        for _, role, text in rows:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else None if ink[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, *faults.values(), illegal, *_best(marked))
    return out


def _got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", *repair.REPORT).collect()}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(QUERIES["op11_conversation_repair"](spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    r = random.Random(7)
    texts = ["Hello.", "Why?", "no end", "", None, " \t\n", "é!", "x.", "a.b", "."]
    rows = [(r.choice([None, 1, 2, 3, *range(4, 60)]), r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", None, "", "tool", "author"]), r.choice(texts)) for _ in range(900)]
    rows += rows[:40]
    df = spark.createDataFrame([(*x, "clash", 9) for x in rows], SCHEMA)
    assert _got(repair.report(repair.damage(df))) == brute(rows)


def test_no_rows(spark):
    assert _got(repair.report(repair.damage(spark.createDataFrame([], SCHEMA)))) == {}
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 1, "user", "x.", "", 1)], SCHEMA)
    assert _got(repair.report(repair.damage(one))) == {dropped: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}


def test_intact_rows_keep(spark):
    rows = [(1, 0, "system", "S.", "", 0), (1, 1, "user", "Q?", "", 0), (1, 2, "assistant", "A.", "", 0)]
    got = _got(repair.report(repair.intact(spark.createDataFrame(rows, SCHEMA))))
    assert got[1][5:7] == (0, "KKK") and got[1][7] == hashlib.sha256(b"system:S.\nuser:Q?\nassistant:A.").hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_decoder_is_exact_and_shallow(seed):
    r, decoder, deepest = random.Random(seed), repair.Decoder(), 0
    rows = []
    for k in range(3000):
        role = r.choice(["user", "assistant"]) if r.random() < 0.2 else ("user", "assistant")[k % 2]
        rows.append((role, str(k), r.choice([None] * 12 + ["blank", "duplicate", "truncated"])))
        decoder.step(role[:1], {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}[rows[-1][2]], role, str(k))
        deepest = max(deepest, decoder.undecided)
    cost, digest = decoder.finish()
    assert (cost, "".join(decoder.emitted), digest) == _best(rows)
    assert deepest < 300


def test_ties_that_never_settle():
    """Rows that must all change: whether one goes is known at the end, and then the earliest goes."""
    for n in (5, 6, 400, 401):
        decoder = repair.Decoder()
        for k in range(n):
            decoder.step("", repair.NONE, "tool", str(k))
        cost, digest = decoder.finish()
        assert (cost, "".join(decoder.emitted), digest) == _best([("tool", str(k), None) for k in range(n)])
