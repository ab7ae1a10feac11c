"""Patterns of personal data: which are kept and how often they are counted to occur."""

import re
from collections import Counter, defaultdict

from horarium.llm import pii_bootstrap


def spans(spark, texts):
    rows = pii_bootstrap.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r.spans for r in rows}


def test_a_hot_source_hides_no_pattern(spark):
    cued = [f"please ring helpline: +1 (425) 555-01{k:02d} today" for k in range(3)]
    hot = ["office +49 30 1234567 berlin"] * 4000
    got = spans(spark, [*cued, "please ring helpline: 425-555-0199 today", *hot])
    assert got[3] == "phone:22:34" and got[0] == "phone:22:39" and got[4] == "phone:7:21"


def test_glued_patterns_are_counted(spark):
    cued = [f"w{k}w tel:+4930123456{k}" for k in range(3)]
    marked = [f"v{k}v 10.0.0.{k}!!" for k in range(3)]
    got = spans(spark, [*cued, "u tel:030-1234567", *marked, "t 999.1.1.1.1!!", "so !! it", *[f"wow{k}!!" for k in range(20)]])
    assert got[3] == "phone:6:17"  # never stands alone
    assert got[7] == ""  # stands alone once, and glued to many words that are no identifiers


def brute_scores(edges, rounds):
    """The pattern-instance graph in plain Python: (good patterns with scores, accepted instances with beliefs)."""
    accepted = {}
    for _ in range(rounds):
        total, mine, values = Counter(), Counter(), defaultdict(set)
        for side, word, value, seed, n in edges:
            total[side, word] += n
            kind = seed or accepted.get(value, (None,))[0]
            if kind:
                mine[kind, side, word] += n
                values[kind, side, word].add(value)
        good = {p: mine[p] / total[p[1:]] for p in mine if len(values[p]) >= pii_bootstrap.MIN_SUPPORT and mine[p] / total[p[1:]] >= pii_bootstrap.CONFIDENCE}
        doubt = defaultdict(lambda: 1.0)
        for side, word, value, seed, _ in edges:
            for (kind, *at), score in good.items():
                if not seed and at == [side, word] and suits(kind, value):
                    doubt[value, kind] *= 1 - min(score, 0.999)
        for (value, kind), d in doubt.items():
            if 1 - d >= pii_bootstrap.CONFIDENCE and 1 - d > accepted.get(value, ("", 0))[1]:
                accepted[value] = (kind, 1 - d)
    return good, accepted


def suits(kind, value):
    digits, plain = len(re.sub("[^0-9]", "", value)), not re.search(r"[A-Za-z@:]|[\[(]at[\])]", value)
    if kind == "secret":
        return bool(re.fullmatch("(?=.*[A-Za-z])[A-Za-z0-9]{6,}", value))
    return {"email": "@" in value, "ip": ":" in value, "card": plain and 12 <= digits <= 19, "phone": plain and 7 <= digits <= 15}[kind]


def test_graph_against_plain_python(spark):
    """Accepted instances induce a pattern that no seed has, in a later round."""
    rows = [("before", "password=", f"{k}a1b2c3d4e5f6a7b8", "secret", 2) for k in range(4)] + [("before", "password=", f"hunter{k}x", None, 1) for k in range(4)]
    rows += [("after", "rotated", f"hunter{k}x", None, 3) for k in range(4)] + [("after", "rotated", "s3cret", None, 1), ("after", "rotated", "1999", None, 1)]
    rows += [("before", "the", f"10.0.0.{k}", "ip", 1) for k in range(3)] + [("before", "the", str(k), None, 1) for k in range(9)] + [("label", "atthe", "2024", None, 5)]
    rows += [("before", "tel:", f"+49301234{k}", "phone", 1) for k in range(3)] + [("before", "tel:", "0301234567", None, 1), ("after", "now", "0301234567", None, 1)]
    edges = spark.createDataFrame(rows, "side string, word string, value string, seed string, n long")
    for rounds in (1, 3):
        good, accepted = pii_bootstrap.score_graph(edges, rounds)
        want_good, want = brute_scores(rows, rounds)
        assert {(r.kind, r.side, r.word): round(r.score, 9) for r in good.collect()} == {p: round(s, 9) for p, s in want_good.items()}
        assert {r.value: (r.kind, round(r.belief, 9)) for r in accepted.collect()} == {v: (k, round(b, 9)) for v, (k, b) in want.items()}
        assert ("s3cret" in want) == (rounds == 3) and "0301234567" in want and "1999" not in want


def test_secrets_and_labels(spark):
    """Strong strings are seeds; weaker ones and short passwords are found by what stands before the seeds."""
    strong = [f"login password=ab12cd34ef56ab12cd34ef5{k} ok" for k in range(4)]
    texts = [*strong, "login password=tiger7 ok", "the year 2024 was 12 ok", 'x token = "ab12cd34ef56ab12cd34ef56" y', "login password=12345678901234567890abcd12345 ok", "a serial 12345678901234567890abcd12345 alone"]
    rows = pii_bootstrap.report(spark.createDataFrame(list(enumerate(texts[:-1])), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.spans, r.n_added, r.n_induced) for r in rows}
    assert got[0] == ("secret:15:39", 1, 0) and got[4] == ("secret:15:21", 1, 1) and got[5] == ("", 0, 0)
    assert got[6] == ("secret:11:35", 1, 0) and got[7] == ("secret:15:44", 1, 1)
    assert spans(spark, texts[:3] + texts[-1:])[3] == ""  # without a cue a weak string stays


def test_edges(spark):
    """Null and empty texts, null ids, a clashing column and a very long text."""
    rows = [(None, "a@b.co", 1), (1, None, 2), (2, "", 3), (3, "w 1 " * 40_000 + "10.0.0.1", 4), (3, "a@b.co", 5), (3, "a@b.co", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = pii_bootstrap.report(docs).collect()
    assert len(got) == 6 and sum(r.n_email for r in got) == 3 and sum(r.n_ip for r in got) == 1
    red = sorted(map(tuple, pii_bootstrap.redact(docs).collect()), key=lambda r: r[2])
    assert [r[2] for r in red] == [1, 2, 3, 4, 5, 5] and red[0][1] == red[4][1] == "<email>" and red[3][1].endswith(" <ip>") and red[1][1] is None
