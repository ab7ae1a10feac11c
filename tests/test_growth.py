"""Steps whose cost must not grow faster than their input."""

from horarium.functions.pyudfs import exact, exact_slot, once
from horarium.operators import evidence, records, schema
from horarium.plans import extract, materialize
from horarium.sources import adapters, elements, html
from horarium.sources.scratch import stored


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_read_once_for_all_phrases(spark):
    """A text is lower-cased once for all its phrases, and close spellings are not looked for where they do not count."""
    page = spark.createDataFrame([(1, "Buy this Domain", "https://x.example/")], "k int, text string, url string")
    found = evidence.classify(page)
    assert [(r.page_class, r.terminal_hints) for r in found.collect()] == [("parked_or_spam", ["buy this domain"])]
    assert _plan(found).count("lower(text") == 1 and "__low" not in found.columns
    texts = spark.createDataFrame([(1, "Fajjr Asr-Salat FRIDAY asr"), (2, "Fajjr")], "k int, text string")
    assert [tuple(r) for r in evidence.slots_in_text(texts, "k").collect()] == [(1, 2)]
    assert exact("Fajjr") is None and exact("Asr Salat") == "asr" and exact("Asr Salat", "kind") == "jamaah"


def test_distinct_texts_go_through_python_once(spark):
    """A filter on what Python says of a text stays behind the aggregate that makes the texts distinct."""
    texts = spark.createDataFrame([("Fajr",), ("Fajr",), ("x",)], "text string")
    named = once(texts, exact_slot("text"), lambda n: n.isNotNull(), "slot")
    assert [tuple(r) for r in named.collect()] == [("Fajr", "fajr")]
    plan = _plan(named)
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Aggregate")


def test_forward_controls_are_normalised_once(spark):
    pages = spark.createDataFrame([(k, f"<b>June</b><i>{t}</i>") for k, t in enumerate(["Next", "NEXT-month", "x", "»"])], "k int, html string")
    found = evidence.month_navigation(html.page_items(pages, "k"), "k")
    assert sorted(r.k for r in found.collect()) == [0, 1, 3]
    assert "normalise_token" not in _plan(found)  # it ran over distinct texts, which are kept


COLUMNS = "array<struct<col_no:int,slot:string,kind:string,value_kind:string,header:string>>"


def test_cells_meet_their_tables_once(spark):
    """Of many layouts, and of several of one table, cells are joined once."""
    rows = [(1, 0, r, c, t) for r, line in enumerate((("2024-01-01", "05:00", "06:00"), ("2024-01-02", "05:01", "x"))) for c, t in enumerate(line)]
    cells = stored(spark.createDataFrame(rows, "k int, table_no int, row_no int, col_no int, text string"), "cells")
    layouts = [(1, 0, "a", schema.MULTIDAY, 0, None, [(1, "fajr", "begin", None, "")]), (1, 0, "b", schema.SINGLE_DAY, None, None, [(2, "fajr", "jamaah", None, "")]), (1, 0, "c", schema.MULTIDAY, 1, None, [(1, "fajr", "begin", None, "")])]
    layout = spark.createDataFrame(layouts, f"k int, table_no int, of string, layout string, date_col int, label_col int, columns {COLUMNS}")
    documents = spark.createDataFrame([(1, 2024, 1)], "k int, year int, month int")
    found = extract.extract(cells, layout, "k", "2024-03-01", documents, ("of",))
    assert sorted((r.of, str(r.day), r.kind, r.time) for r in found.collect()) == [("a", "2024-01-01", "begin", "05:00"), ("a", "2024-01-02", "begin", "05:01"), ("b", "2024-03-01", "jamaah", "06:00")]
    assert sum("Join" in line for line in _plan(found).splitlines()) <= 5


def test_tables_without_slots_down_a_column_are_not_turned(spark):
    rows = [(k, 0, r, c, t) for k in (1, 2) for r, line in enumerate((("Date", "2024-01-01"), ("Fajr", "5:00"), ("Asr", "17:00"), ("Isha", "22:00"))) for c, t in enumerate(line) if k == 1 or t != "Asr"]
    cells = stored(spark.createDataFrame(rows, "k int, table_no int, row_no int, col_no int, text string"), "cells")
    depth = stored(spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "k int, table_no int, depth int"), "depth")
    assert {(r.k, r.flips) for r in schema.placed(cells, depth, "k", "2024-01-01").collect()} == {(1, True), (2, False)}
    assert [(r.k, r.layout, [c.slot for c in r.columns]) for r in schema.table_layouts(cells, depth, "k", "2024-01-01").collect()] == [(1, schema.TRANSPOSED, ["fajr", "asr", "isha"])]


def test_texts_of_siblings_are_read_where_their_shape_fits(spark, monkeypatch):
    row = "<section><p>2024-01-0{0}</p><p>5:0{0}</p><p>17:0{0}</p></section>"
    pages = spark.createDataFrame([(1, "<body><main>" + "".join(row.format(k) for k in (1, 2, 3)) + "</main></body>")], "k int, html string")
    asked, read = [], records.readings

    def noted(rows, **values):
        asked.extend(r.text for r in rows.select("text").collect())
        return read(rows, **values)

    monkeypatch.setattr(records, "readings", noted)
    cells = records.sibling_cells(stored(elements.page_elements(pages, "k"), "elements"), "k")
    assert len(cells.collect()) == 9 and len(asked) == 9 and all(" " not in t for t in asked)


def test_days_need_no_last_event(spark, sf_dir):
    days, all_ = adapters.days(spark, sf_dir), adapters.occurrence(spark, sf_dir).select("venue_id", "day").distinct()
    assert days.count() == all_.count() and not days.exceptAll(all_).count() and "max_by" not in _plan(days)


def test_a_day_is_shuffled_once(spark):
    cell = spark.createDataFrame([(1, 1, "2024-03-02", "asr", "begin", "16:00", None, None), (1, 2, "2024-03-02", "isha", "jamaah", None, 10, "asr")], "source_id int, seq int, day string, slot string, kind string, time string, offset int, base_slot string").selectExpr("source_id", "seq", "cast(day as date) as day", "slot", "kind", "time", "offset", "base_slot")
    made = materialize.grid_rows(cell, "2024-03-01", 5)
    assert [(r.slot, r.time, r.derived) for r in made.collect()] == [("isha", "16:10", True)] and "Join" not in _plan(made)
