"""Candidates, providers, snapshots and versioned tables on small cases."""

import pytest
from pyspark.sql import functions as F

from horarium.operators import venues
from horarium.plans import candidates, providers
from horarium.sources import html, versions


def test_the_best_candidate(spark):
    """Lane, then a plug-in for one provider, rows, structure, confidence, and the earlier."""
    place = "struct<kind:int,at:int>"
    tried = [
        ("a", (0, 0), "enumerator:table_x", "html_table", 0.9), ("a", (2, 0), "platform:mawaqit", "widget", 0.1), ("a", (2, 1), "platform:generic_table", "html_table", 1.0),
        ("b", (0, 0), "enumerator:x", "html_table", 0.5), ("b", (0, 1), "enumerator:y", "html_table", 0.5), ("b", (1, 0), "enumerator:media_pdf", "pdf", 0.9),
        ("c", (0, 0), "enumerator:x", "html_table", 0.5), ("c", (1, 1), "enumerator:media_pdf", "pdf", 0.9), ("d", (0, 0), "enumerator:x", "html_table", 0.5),
    ]
    found = spark.createDataFrame([(s, p, o, k, None, None, c) for s, p, o, k, c in tried], f"source_id string, place {place}, origin string, shape string, table_no int, url string, confidence double")
    lane = {("b", (1, 0)): "deferred", ("c", (0, 0)): "reject", ("c", (1, 1)): "deferred", ("d", (0, 0)): "reject"}
    verdicts = spark.createDataFrame([((s, p), lane.get((s, p), "auto_accept")) for s, p, *_ in tried], f"source_id struct<source_id:string,place:{place}>, lane string")
    rows = spark.createDataFrame([(("a", (0, 0)),)] * 9 + [(("b", (0, k)),) for k in (0, 1)], f"source_id struct<source_id:string,place:{place}>")
    got = {r.source_id: (tuple(r.place), r.lane, r.rows) for r in candidates.best(found, rows, verdicts).collect()}
    assert got == {"a": ((2, 0), "auto_accept", 0), "b": ((0, 0), "auto_accept", 1), "c": ((1, 1), "deferred", 0)}


def test_media_candidates_are_few_and_likely(spark):
    media = spark.createDataFrame([("s", f"u{k}", (False, k), "pdf", float(k)) for k in range(9)], "source_id string, url string, ordinal struct<later:boolean,n:int>, media string, score double")
    got = sorted((r.place["at"], r.url, r.confidence) for r in candidates.media_candidates(media).collect())
    assert got == [(1, "u2", 0.5), (2, "u3", 0.75), (3, "u4", 1.0), (4, "u5", 1.0)]


def test_fixed_sessions(spark):
    texts = ["Friday Jumu'ah first 12:30 second 1:30 pm 13:30", "jumu 11:00 14:00 99:99 14:30", "no 13:00", None, "Jumuah 13:15 " + "x " * 120 + "14:00", "JUMUAH 2nd 13.00 3rd 14:00"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", providers.fixed_sessions(F.col("text")).alias("s")).collect()
    got = {r.k: [(x["label"], x["time"]) for x in r.s or []] for r in rows}
    assert got == {0: [("first Jumu'ah", "12:30"), ("second Jumu'ah", "13:30")], 1: [("1st Jumu'ah", "14:00")], 2: [], 3: [], 4: [("1st Jumu'ah", "13:15")], 5: [("2nd Jumu'ah", "13:00"), ("3rd Jumu'ah", "14:00")]}


def test_a_registry_of_ones_own(spark):
    """The first plug-in that knows a page has it; pages that none knows are left out."""
    page = spark.createDataFrame([(1, "https://a.example/", "<p>alpha beta</p>"), (2, "https://b.example/", "<p>beta</p>"), (3, "https://c.example/", None)], "source_id int, url string, html string")
    fetched = page.select("url", "html").limit(0)
    knows = lambda word: lambda pages: providers.match(html.visible_text(pages.page, "source_id").filter(F.contains("text", F.lit(word))), word, "widget")
    got = lambda *words: {r.source_id: r.platform for r in providers.detect(page, fetched, "2026-06-15", [knows(w) for w in words]).collect()}
    assert got("alpha", "beta") == {1: "alpha", 2: "beta"} and got("beta", "alpha") == {1: "beta", 2: "beta"} and got("gamma") == {}
    with pytest.raises(ValueError, match="no plug-in"):
        providers.detect(page, fetched, "2026-06-15", [])


def test_calendar_payloads(spark):
    texts = ['<b>{</b>confData = {"a": "}", "b": {}} tail {"c": 1}', "mawaqit.net", "confData = {'a': 1}", None, "confData = {"]
    page = spark.createDataFrame(list(enumerate(texts)), "source_id int, html string")
    assert [tuple(r) for r in providers.calendar_payloads(page).collect()] == [(0, '{"a": "}", "b": {}}')]


def test_versions(spark, tmp_path, monkeypatch):
    """Two writes, a repeated one, a killed one and one that comes too late: the last good version stays."""
    root, schema = str(tmp_path), "source_id int, v string"
    now = lambda: sorted(map(tuple, versions.load(spark, root).collect()))
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    with pytest.raises(FileNotFoundError):
        versions.load(spark, root)
    first = frame((1, "a"), (1, "b"), (2, "a"), (3, "a"))
    assert versions.replace_sources(first, first, root, "w", 0, buckets=2)
    assert versions.replace_sources(frame((1, "c")), frame((1, ""), (3, "")), root, "w", 1)
    assert now() == [(1, "c"), (2, "a")]
    assert not versions.replace_sources(frame((1, "d")), frame((1, "")), root, "w", 1) and now() == [(1, "c"), (2, "a")]
    switch = versions._switch

    def killed(*_):
        raise OSError("killed")

    monkeypatch.setattr(versions, "_switch", killed)
    with pytest.raises(OSError, match="killed"):
        versions.replace_sources(frame((2, "x")), frame((2, "")), root, "w", 2)
    assert now() == [(1, "c"), (2, "a")]
    stale = versions.manifest(spark, root)
    monkeypatch.setattr(versions, "_switch", switch)
    assert versions.replace_sources(frame((2, "y")), frame((2, "")), root, "w", 2) and now() == [(1, "c"), (2, "y")]
    with pytest.raises(versions.VersionConflict):
        versions._switch(spark, root, stale | {"number": stale["number"] + 1})
    assert versions.replace_sources(frame(), frame((1, ""), (2, "")), root, "other", 0) and now() == []
    assert [r.v for r in versions.load(spark, root).collect()] == []


def test_snapshot_tag(spark):
    """The same for any partitioning and order, another after one change."""
    rows = spark.range(5000).selectExpr("id as venue_id", "id % 7 as n", "if(id % 3 = 0, null, 'x') as note")
    tag = lambda df: venues.snapshot_tag(df, "venue_id").first()
    base = tag(rows)
    assert base == tag(rows.repartition(7, "n").select("note", "n", "venue_id")) and base.rows == 5000 and len(base.tag) == 18
    assert tag(rows.withColumn("n", F.expr("if(venue_id = 4321, 99, n)"))).tag != base.tag != tag(rows.filter("venue_id < 4999")).tag
    assert tag(rows.limit(0)).rows == 0
