"""Tables, layouts, extraction and evidence of small pages."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from horarium.functions import pyudfs
from horarium.operators import evidence, grids, schema
from horarium.plans import evaluate, extract
from horarium.sources import html, stores

TODAY = "2026-06-01"
SLOTS = ("Fajr", "Dhuhr", "Asr", "Maghrib", "Isha")
TIMES = ("05:10", "13:30", "18:00", "21:15", "22:45")


def matrix(page, table=0):
    """The dense cells of a table of a page."""
    cells = {(i[2], i[3]): i[4] for i in html.items_of(page) if i[0] == "cell" and i[1] == table}
    rows, cols = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
    return [[cells[r, c] for c in range(cols)] for r in range(rows)]


@pytest.mark.parametrize(("page", "want"), [
    ("<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td>d<tr><td>e</table>", [["a", "b", "b"], ["a", "c", "d"], ["e", "", ""]]),
    ("<table><tr><td>a<td>b<td rowspan=2>c<tr><td>x<tr><td>p<td>q<td>r</table>", [["a", "b", "c"], ["x", "", "c"], ["p", "q", "r"]]),
    ("<table><tr><td>a<td colspan=x rowspan=0>b</table>", [["a", "b"]]),
    ("<table><tr><td>o<table><tr><td>i</table><tr><td>z</table>", [["o i", "i"], ["i", ""], ["z", ""]]),
])
def test_dense_tables(page, want):
    assert matrix(page) == want


def table(rows, head="td"):
    """A table of text rows, the first in heading cells."""
    line = lambda r, tag: "<tr>" + "".join(f"<{tag}>{x}</{tag}>" for x in r) + "</tr>"
    return "<table>" + line(rows[0], head) + "".join(line(r, "td") for r in rows[1:]) + "</table>"


DAYS = [f"2026-06-{d:02d}" for d in (1, 2, 3)]
ACROSS = table([("Date", *SLOTS), *((d, *TIMES) for d in DAYS)], "th")
DOWN = table([("", *DAYS), *((s, *[t] * 3) for s, t in zip(SLOTS, TIMES, strict=True))])
SINGLE = table([SLOTS, TIMES])
LABELS = table([("Prayer", "Begins", "Jamaat"), ("Fajr", "4:10 am", "5:10 am"), ("Sunrise", "-", "-"), *((s, t, "+10") for s, t in zip(SLOTS[1:], TIMES[1:], strict=True))])
GROUPED = "<table><thead><tr><th rowspan=2>Date<th colspan=2>Asr<th>Fajr<th>Isha<tr><th>Begins<th>Jamaat<th>Jamaat<th>Jamaat</thead>" + "".join(f"<tr><td>{d}<td>17:00<td>+15<td>05:00<td>22:00" for d in DAYS) + "</table>"
MENU = table([("Dish", "Price"), ("Soup", "3"), ("Rice", "4")])


@pytest.fixture(scope="module")
def laid(spark):
    pages = {"across": ACROSS, "down": DOWN, "single": SINGLE, "labels": LABELS, "grouped": GROUPED, "menu": MENU, "none": None}
    items = html.page_items(spark.createDataFrame(list(pages.items()), "page string, html string"), "page").cache()
    cells = html.cells_of(items, "page")
    tables = items.filter("kind = 'table'").select("page", F.col("n").alias("table_no"), F.col("row").alias("thead_rows"))
    rows = items.filter("kind = 'row'").select("page", F.col("n").alias("table_no"), F.col("row").alias("row_no"), F.col("flag").alias("heading"))
    depth = grids.header_depth(tables, rows, cells, "page").cache()
    return cells, depth, schema.table_layouts(cells, depth, "page", TODAY).cache()


def test_layouts(laid):
    cells, depth, layouts = laid
    assert {r.page: r.depth for r in depth.collect()} == {"across": 1, "down": 1, "single": 1, "labels": 1, "grouped": 2, "menu": 3}
    header = {(r.page, r.col_no): r.header for r in grids.combined_header(cells, depth, "page").collect()}
    assert [header["grouped", c] for c in range(5)] == ["Date", "Asr Begins", "Asr Jamaat", "Fajr Jamaat", "Isha Jamaat"]
    got = {r.page: (r.layout, r.date_col, r.label_col, [(c.col_no, c.slot, c.kind, c.value_kind) for c in r.columns]) for r in layouts.collect()}
    plain = [(k + 1, s.lower(), "jamaah", None) for k, s in enumerate(SLOTS)]
    assert got["across"] == ("horizontal_multiday", 0, None, plain) and got["down"] == ("transpose_multiday", 0, None, plain)
    assert got["single"] == ("horizontal_single_day", None, None, [(c - 1, *x) for c, *x in plain])
    assert got["labels"] == ("prayer_rows", None, 0, [(1, None, "begin", None), (2, None, "jamaah", "offset")])
    assert got["grouped"] == ("horizontal_multiday", 0, None, [(1, "asr", "begin", None), (2, "asr", "jamaah", "offset"), (3, "fajr", "jamaah", None), (4, "isha", "jamaah", None)])
    assert set(got) == {"across", "down", "single", "labels", "grouped"}


def test_extract(laid):
    cells, _, layouts = laid
    got = {}
    for r in extract.extract(cells, layouts, "page", TODAY).collect():
        got.setdefault(r.page, set()).add((str(r.day), r.slot, r.kind, r.time, r.offset))
    grid = {(d, s.lower(), "jamaah", t, None) for d in DAYS for s, t in zip(SLOTS, TIMES, strict=True)}
    assert got["across"] == grid == got["down"] and got["single"] == {(TODAY, *x[1:]) for x in grid}
    assert got["labels"] == {(TODAY, "fajr", "begin", "04:10", None)} | {(TODAY, s.lower(), "begin", t, None) for s, t in zip(SLOTS[1:], TIMES[1:], strict=True)} | {(TODAY, s.lower(), "jamaah", None, 10) for s in SLOTS[1:]}
    assert ("2026-06-02", "asr", "jamaah", None, 15) in got["grouped"] and len(got["grouped"]) == 12
    with pytest.raises(Exception, match="unknown layout: odd"):
        extract.extract(cells, layouts.withColumn("layout", F.lit("odd")), "page", TODAY).collect()


def test_close_spellings_need_times(spark):
    """A header that is nearly a slot's name counts only over a column of times."""
    rows = [[("Date", "Fajrr", "Dhuhr", "Asr", "Ishaq"), *[(d, "05:00", "13:00", "17:00", "x") for d in DAYS]], [("Date", "Fajr", "Dhuhr", "Asrr"), *[(d, "05:00", "13:00", "note") for d in DAYS]]]
    cells = spark.createDataFrame([(str(p), 0, r, c, x) for p, m in enumerate(rows) for r, line in enumerate(m) for c, x in enumerate(line)], "page string, table_no int, row_no int, col_no int, text string")
    depth = cells.select("page", "table_no").distinct().withColumn("depth", F.lit(1))
    got = {r.page: [c.slot for c in r.columns] for r in schema.table_layouts(cells, depth, "page", TODAY).collect()}
    assert got == {"0": ["fajr", "dhuhr", "asr"]}


def test_month_sections(spark):
    months = [[("May 2026",) * 4, ("Day", "Fajr", "Asr", "Isha"), ("1", "05:00", "17:00", "22:00")], [("June",) * 4, ("Day", "Fajr", "Asr", "Isha"), ("1", "04:00", "18:00", "23:00"), ("31", "04:00", "18:00", "23:00")]]
    pages = spark.createDataFrame([("one", table(months[0] + months[1])), ("two", "".join(table(m) for m in months)), ("single", table(months[1])), ("caption", "<table><caption>July</caption>" + table(months[0][1:])[7:])], "page string, html string")
    items = html.page_items(pages, "page").cache()
    captions = items.filter("kind = 'table'").select("page", F.col("n").alias("table_no"), F.col("text").alias("caption"))
    sections = grids.month_sections(html.cells_of(items, "page"), captions, "page").cache()
    assert {r.month for r in sections.filter("page = 'caption'").collect()} == {7}
    layout = schema.section_layouts(sections, "page", TODAY)
    got = {}
    for r in extract.month_sections(sections, layout, "page", TODAY).collect():
        got.setdefault(r.page, set()).add((str(r.day), r.slot, r.time))
    want = {("2027-05-01", s, t) for s, t in (("fajr", "05:00"), ("asr", "17:00"), ("isha", "22:00"))} | {("2026-06-01", s, t) for s, t in (("fajr", "04:00"), ("asr", "18:00"), ("isha", "23:00"))}
    assert got == {"one": want, "two": want}


def test_bare_headers(spark):
    page = "<table><thead><th colspan=1>Date<th colspan=2>Asr</thead><thead><th><th>Begins<th>Jamaat</thead>" + "".join(f"<tr><td>{d}<td>17:00<td>17:30" for d in DAYS) + "</table>"
    items = html.page_items(spark.createDataFrame([("p", page)], "page string, html string"), "page")
    one = spark.createDataFrame([("p", 0, 1)], "page string, table_no int, depth int")
    cells, depth = grids.with_bare_headers(html.cells_of(items, "page"), html.cells_of(items, "page", "bare"), one, "page")
    header = [r.header for r in grids.combined_header(cells, depth, "page").orderBy("col_no").collect()]
    assert header == ["Date", "Asr Begins", "Asr Jamaat"] and grids.body(cells, depth, "page").count() == 9


def test_calendars(spark):
    six, five = ["5:00", "6:30", "13:00", "17:00", "20:00", "22:00"], ["+10", "13:30", "5:30", "+5", "x"]
    conf = {"calendar": [{}, {"3": six, "x": six}], "iqamaCalendar": [{}, {"3": five}]}
    page = f'<script>var confData = {json.dumps(conf)};</script>'
    payload = spark.createDataFrame([("m", pyudfs.first_object(page, "confData"))], "k string, json string")
    got = {(str(r.day), r.slot, r.kind, r.time, r.offset) for r in extract.calendar_cells(payload, "k", 2026, 2).collect()}
    begin = {("2026-02-03", s, "begin", t, None) for s, t in zip(("fajr", "dhuhr", "asr", "maghrib", "isha"), ("05:00", "13:00", "17:00", "20:00", "22:00"), strict=True)}
    assert got == begin | {("2026-02-03", "fajr", "jamaah", None, 10), ("2026-02-03", "dhuhr", "jamaah", "13:30", None), ("2026-02-03", "asr", "jamaah", "17:30", None), ("2026-02-03", "maghrib", "jamaah", None, 5)}
    model = {"model": {"salahTimings": [{"day": 1, "month": 6, "fajr": "03:00", "iqamah_Fajr": "04:00", "zuhr": "1:10", "iqamah_Zuhr": None}, {"day": 31, "month": 6, "fajr": "03:00"}], "jumahSalahIqamahTimings": [{"time": "13:00", "iqamahTime": "13:20", "isPrimary": False}, {"time": "13:30", "iqamahTime": "", "isPrimary": True}]}}
    payload = spark.createDataFrame([("m", json.dumps(model)), ("bad", "<html>")], "k string, json string")
    got = {(r.k, str(r.day), r.slot, r.kind, r.time) for r in extract.timings_cells(payload, "k", 2026).collect()}
    assert got == {("m", "2026-06-01", "fajr", "begin", "03:00"), ("m", "2026-06-01", "fajr", "jamaah", "04:00"), ("m", "2026-06-01", "dhuhr", "begin", "13:10")} | {("m", f"2026-06-{d:02d}", "jumuah", "begin", "13:30") for d in (5, 12, 19, 26)}


FILL = "Welcome to a page with more than forty characters of text. "
PAGES = {
    "structured": (FILL + ACROSS, "structured_html"), "frame": (FILL + '<iframe src="https://x.example/w"></iframe>', "iframe_or_widget"), "mark": (FILL + "<!-- powered by mawaqit -->", "iframe_or_widget"),
    "image": (FILL + '<img src="/prayer-times-2026.jpg" alt="">', "media_only"), "bare logo": ('<img src="/a.png">', "media_only"), "shell": ('<div id="root"></div> Fajr and Asr', "js_shell"),
    "app": ('<script src="/app.js"></script>', "js_shell"), "widget": (FILL + "Fajr soon, Isha later", "daily_widget"), "named": (FILL + "Fajr 5:00 Isha 22:00", "structured_html"),
    "links": (FILL + '<a href="/prayer">here</a>', "unknown"), "building": ("Coming soon: our new web site, please come back later", "under_construction"), "sold": (FILL + "Buy this domain", "parked_or_spam"),
    "empty": ("<p>hi</p>", "empty"), "menu": (FILL + MENU + "Book a table", "irrelevant"), "prose": (FILL, "unknown"), "nav": (FILL + "<b>June 2026</b> <a href='#'>›</a>", "iframe_or_widget"), "null": (None, "empty"),
}


def test_page_classes(spark):
    pages = spark.createDataFrame([(k, f"https://{k.replace(' ', '-')}.example/home", h) for k, (h, _) in PAGES.items()], "page string, url string, html string")
    got = {r.page: r for r in evidence.page_evidence(pages, "page", 2026).collect()}
    assert {k: r.page_class for k, r in got.items()} == {k: c for k, (_, c) in PAGES.items()}
    assert got["structured"].timed_tables == 1 and got["structured"].table_times == 15 and got["menu"].terminal_hints == ["book a table"]
    assert not got["structured"].needs_render and got["widget"].needs_render and not got["prose"].needs_render


def test_verdicts(spark):
    rows = [("a", "empty", 0), ("a", "irrelevant", 0), ("b", "empty", 0), ("b", "unknown", 0), ("c", "under_construction", 1), ("d", "parked_or_spam", 0), ("d", "empty", 0)]
    pages = spark.createDataFrame(rows, "host string, page_class string, pdfs int")
    for c in ("timetable_media", "widgets", "iframes", "navs", "named_tables", "js_marks"):
        pages = pages.withColumn(c, F.lit(0))
    assert {r.host: (r.verdict, r.status) for r in evidence.terminal_verdict(pages, "host").collect()} == {"a": ("irrelevant", "wrong_site"), "b": (None, None), "c": (None, None), "d": ("parked_or_spam", "parked_or_spam")}


def test_overlay_and_cache(spark, tmp_path):
    page = spark.createDataFrame([("a", "x"), ("b", "y")], "url string, html string")
    assert {tuple(r) for r in evidence.overlay(page, spark.createDataFrame([("b", "z"), ("c", "w")], page.schema), "url").collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    asked = spark.createDataFrame([("a", False), ("b", True), ("n", None)], "url string, requires_js boolean")
    assert {(r.url, r.html, r.to_fetch) for r in stores.cached_scan(asked, page).collect()} == {("a", "x", False), ("b", None, True), ("n", None, True)}
    (tmp_path / "venue_id=7").mkdir()
    (tmp_path / "venue_id=7" / "old.json").write_text('{"url": "u"}')
    old = stores.load_bundles(spark, str(tmp_path)).first()
    assert (old.venue_id, old.url, old.pages, old.evidence) == (7, "u", None, [])
    for _ in range(2):
        stores.append_runs(page, f"{tmp_path}-runs")
    assert spark.read.parquet(f"{tmp_path}-runs").count() == 4


def test_evaluate(spark):
    """A dated page, a paged source whose second month is missing, an image, and a source without its page."""
    bare = lambda m: table([("Day", *SLOTS), *((str(d), *TIMES) for d in range(1, 29))], "th").replace("05:10", f"05:1{m}")
    fetched = spark.createDataFrame([("u1", ACROSS), ("t/6", bare(1))], "url string, html string")
    source = spark.createDataFrame([("dated", "u1", None, "html_table"), ("paged", "p", "t/{month}", "html_table"), ("image", "i", None, "image"), ("gone", "nowhere", None, "html_table")], "source_id string, url string, template string, shape string")
    docs = evaluate.documents_of(source, fetched, TODAY, 35)
    column = "array<struct<col_no:int,slot:string,kind:string,value_kind:string,header:string>>"
    layout = spark.createDataFrame([(s, 0, "horizontal_multiday", 0, None, [(k + 1, x.lower(), "jamaah", None, x) for k, x in enumerate(SLOTS)]) for s in ("dated", "paged")], f"source_id string, table_no int, layout string, date_col int, label_col int, columns {column}")
    session = spark.createDataFrame([("dated", 1, None, "13:15", None), ("image", 1, None, "13:15", None)], "source_id string, idx int, label string, text string, season string")
    rows, verdicts = evaluate.evaluate(source, docs, layout, session, TODAY, 35)
    got = {r.source_id: (r.lane, r.status, r.reason, r.flags) for r in verdicts.collect()}
    assert got["image"] == ("deferred", "deferred_media", None, []) and got["gone"] == ("reject", "needs_reauthor", "empty body", [])
    assert got["dated"] == ("auto_accept", "authored", None, ["partial_horizon"])
    assert got["paged"] == ("review", "review", "constant", ["partial_horizon"])
    assert rows.filter("source_id = 'paged'").count() == 28 * 5 and rows.filter("source_id = 'dated' and slot = 'asr'").count() == 3
    old = spark.createDataFrame([(s, datetime.date(2026, 6, 1), "asr", 0, "11:11", None, None, False) for s in ("dated", "paged", "gone")], rows.schema)
    state = spark.createDataFrame([(s, "authored", '["x"]') for s in ("dated", "paged", "image", "gone")], "source_id string, status string, flags string")
    kept, states = evaluate.persist(old, state, rows, verdicts)
    assert {(r.source_id, r.time) for r in kept.filter("slot = 'asr'").collect()} == {("dated", "18:00"), ("paged", "11:11"), ("gone", "11:11")}
    assert {r.source_id: (r.status, r.flags) for r in states.collect()} == {"dated": ("authored", '["partial_horizon"]'), "paged": ("review", '["x"]'), "image": ("deferred_media", '["x"]'), "gone": ("needs_reauthor", '["x"]')}


def test_merge_venues(spark):
    from horarium.operators import state

    day = datetime.date(2026, 6, 1)
    venue = spark.createDataFrame([(1, "A", ["x"]), (2, "B", ["A", ""]), (3, "C", None)], "venue_id int, name string, aliases array<string>")
    source = spark.createDataFrame([(10, 1), (20, 2)], "source_id int, venue_id int")
    occurrence = spark.createDataFrame([(10, 1, day, "asr", 0, "17:00"), (20, 2, day, "asr", 0, "18:00"), (20, 2, day, "isha", 0, "22:00")], "source_id int, venue_id int, day date, slot string, session int, time string")
    run = spark.createDataFrame([(10, "ok"), (20, "ok")], "source_id int, result string")
    pairs = spark.createDataFrame([(2, 1), (9, 1)], "dropped int, survivor int")
    for _ in range(2):
        made = state.merge_venues(venue, source, occurrence, run, pairs)
        venue, source, occurrence, run = made["venue"], made["source"], made["occurrence"], made["run"]
        assert {(r.venue_id, tuple(r.aliases or ())) for r in venue.collect()} == {(1, ("x", "B")), (3, ())}
        assert [tuple(r) for r in source.collect()] == [(10, 1)] and [tuple(r) for r in run.collect()] == [(10, "ok")]
        assert {(r.source_id, r.venue_id, r.slot, r.time) for r in occurrence.collect()} == {(10, 1, "asr", "17:00"), (None, 1, "isha", "22:00")}
