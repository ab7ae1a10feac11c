"""Small operators that no query shows alone."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from horarium.operators import evidence, lookups, schema
from horarium.sources import html, scratch, stores


def test_route(spark):
    """Several tables, one, media, a widget, an end, and nothing."""
    rows = [("a", 1, 0, 0, []), ("a", 3, 1, 1, []), ("b", 1, 2, 0, ["x"]), ("c", 0, 1, 1, []), ("d", 0, 0, 1, ["x"]), ("e", 0, 0, 0, ["x"]), ("f", 0, 0, 0, [])]
    pages = spark.createDataFrame(rows, "host string, tables int, timetable_media int, widgets int, terminal_hints array<string>")
    want = {"a": "table_choice", "b": "table_repair", "c": "media", "d": "widget", "e": "terminal", "f": "unknown"}
    assert {r.host: r.kind for r in evidence.route(pages, "host").collect()} == want


def test_usable_fetches(spark):
    rows = [("ok", None, "x", 200), ("moved", None, "x", 399), ("error", "timeout", "x", 200), ("none", None, None, 200), ("empty", None, "", 200), ("gone", None, "x", 404), ("unknown", None, "x", None)]
    got = evidence.usable(spark.createDataFrame(rows, "k string, error string, html string, status int"))
    assert sorted(r.k for r in got.collect()) == ["moved", "ok"]


def test_bundles_round_trip(spark, tmp_path):
    """A second save replaces what was there; null lists come back empty."""
    path = f"{tmp_path}/bundles"
    rows = [(7, "u", [("p", "<p>é</p>", 1.5)], ["x"]), (8, "v", None, None)]
    stores.save_bundles(spark.createDataFrame([(9, "old", None, None)], stores.BUNDLE), path)
    stores.save_bundles(spark.createDataFrame(rows, stores.BUNDLE), path)
    got = sorted(stores.load_bundles(spark, path).collect())
    assert [(r.venue_id, r.url, [tuple(p) for p in r.pages or []], r.evidence) for r in got] == [(7, "u", [("p", "<p>é</p>", 1.5)], ["x"]), (8, "v", [], [])]


def test_tables_tell_slots_times_and_dates(spark):
    """Slots in first-seen order: the header by columns, the body by rows; clock times of the body; columns of which half are dates."""
    page = "<table><tr><th>Day<th>Asr<th>Fajr<tr><td>1<td>17:00<td>5:00<tr><td>Mon 2<td>Isha<td>5:01<tr><td>x<td>17:02<td></table><table><tr><td>Isha</table>"
    items = html.page_items(spark.createDataFrame([("p", page)], "k string, html string"), "k")
    depth = spark.createDataFrame([("p", 0, 1), ("p", 1, 1)], "k string, table_no int, depth int")
    got = {r.table_no: (r.prayers, r.times, r.date_columns) for r in schema.table_evidence(html.cells_of(items, "k"), depth, "k", 2026).collect()}
    assert got == {0: (["asr", "fajr", "isha"], 4, [0]), 1: (["isha"], 0, [])}


def test_widgets_and_month_navigation(spark):
    texts = ["<iframe src='//mawaqit.net/x'></iframe><a href='https://mawaqit.net/y'>m</a>", "<a href='https://time.my-masjid.com/s/1'>t</a>", "<!-- masjidbox -->", "<b>June</b><b>Next</b>", "<b>Next</b>"]
    pages = spark.createDataFrame([(k, "https://x.example/", t) for k, t in enumerate(texts)], "k int, url string, html string")
    items = html.page_items(pages, "k")
    got = sorted((r.k, r.provider, r.url, r.confidence) for r in evidence.widget_hints(items, pages, "k").collect())
    assert got == [(0, "mawaqit", "https://mawaqit.net/x", 0.9), (1, "mylocalmasjid", "https://time.my-masjid.com/s/1", 0.8), (2, "masjidbox", None, 0.5)]
    assert [tuple(r) for r in evidence.month_navigation(items, "k").collect()] == [(3, "next")]


def test_overlapping_days_keep_the_greater_rank(spark):
    rows = [(1, datetime.date(2026, 6, 1), 3), (1, datetime.date(2026, 6, 1), 5)]
    ranked = evidence.capped(spark.createDataFrame(rows, "s int, day date, v int"), ["s"], ["v"], 1)
    assert [r.v for r in ranked.collect()] == [3]


def test_request_values():
    assert lookups.box_of(None) is None and lookups.box_of("-1,2, 3.5,4") == (-1.0, 2.0, 3.5, 4.0) and lookups.spot_of("52,-1") == (52.0, -1.0)
    for bad in ("1,2,3", "1,2,3,4,5", "a,b,c,d", ""):
        with pytest.raises(ValueError, match="min_lng"):
            lookups.box_of(bad)
    with pytest.raises(ValueError, match="lat,lng"):
        lookups.spot_of("1")


def test_a_point_lookup_reaches_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    found = lookups.lookup(spark.read.parquet(f"{tmp_path}/t"), "id", 7)
    assert "EqualTo(id,7)" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


def test_intermediate_tables_are_cleared(spark):
    kept = scratch.stored(spark.range(5), "kept")
    folder = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert kept.count() == 5 and os.path.isdir(folder)
    scratch.clear(spark)
    assert not os.path.exists(folder)


def test_stored_tables_are_not_broadcast(spark):
    a, b = (scratch.stored(spark.range(50).withColumn("text", F.lit("x")), n) for n in "ab")
    joined = a.filter("id > 3").join(b.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("c")), "id")
    assert joined.count() == 92
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
