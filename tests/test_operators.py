"""State changes, gates, page relations and materialisation on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from horarium.operators import state, venues
from horarium.plans import extract, gates, materialize
from horarium.sources import html, seeds


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_page_to_occurrences(spark):
    page = "<script>var x = '9:99'</script><table><tr><th>Date<th>Begins<th>Asr</tr>" + "".join(f"<tr><td>{d}/6/2026<td>4:0{d}<td>+15</tr>" for d in (1, 2)) + "</table>"
    pages = spark.createDataFrame([("s", page), ("t", None)], "source_id string, html string")
    cells = html.table_cells(pages, "source_id")
    column = "array<struct<col_no:int,slot:string,kind:string,value_kind:string,header:string>>"
    layout = spark.createDataFrame([("s", 0, "horizontal_multiday", 0, None, [(1, "asr", "begin", None, ""), (2, "asr", "jamaah", "offset", "")])], f"source_id string, table_no int, layout string, date_col int, label_col int, columns {column}")
    cell = extract.multiday(cells, layout, "source_id", "2026-06-01")
    made = materialize.grid_rows(cell, "2026-06-01", 20)
    assert rows(made.select("day", "time", "begin", "derived")) == [(datetime.date(2026, 6, d), f"16:{15 + d}", f"16:0{d}", True) for d in (1, 2)]
    assert html.visible_text(pages, "source_id").filter("source_id = 's'").first().text.startswith("Date Begins Asr")


def test_lanes(spark):
    good = {"fajr": "05:00", "dhuhr": "13:00", "asr": "17:00", "maghrib": "20:00", "isha": "21:30"}
    data = []
    for source, change in (("ok", {}), ("late", {"fajr": "09:00"}), ("gap", {"asr": None}), ("lied", {})):
        data += [(source, datetime.date(2026, 6, 1), s, 0, t, None, None, False) for s, t in (good | change).items() if t]
    row = spark.createDataFrame(data, "source_id string, day date, slot string, session int, time string, begin string, label string, derived boolean")
    text = row.groupBy("source_id").agg(F.array_join(F.collect_list("time"), " ").alias("text")).withColumn("text", F.when(F.col("source_id") == "lied", "").otherwise(F.col("text")))
    source = spark.createDataFrame([(s,) for s in ("ok", "late", "gap", "lied", "none")], "source_id string")
    got = {r.source_id: (r.lane, r.reason) for r in gates.lanes(source, row, text).collect()}
    assert got == {"ok": ("auto_accept", None), "late": ("reject", "implausible"), "gap": ("review", "incomplete"), "lied": ("reject", "self-match failed"), "none": ("reject", "no occurrences produced")}


def test_drift_guard_keeps_the_last_good_rows(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "source_id string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 2)], "source_id string, v int")
    verdict = spark.createDataFrame([("a", "auto_accept"), ("b", "reject")], "source_id string, lane string")
    assert rows(state.drift_guard(old, new, verdict)) == [("a", 2), ("b", 1)]


def test_merge_prefers_the_survivor(spark):
    occ = spark.createDataFrame([("s", 1, "asr", 0, "x"), ("d", 1, "asr", 0, "y"), ("d", 2, "asr", 0, "z")], "venue_id string, day int, slot string, session int, time string")
    pairs = spark.createDataFrame([("d", "s")], "dropped string, survivor string")
    assert rows(state.merge_rows(occ, pairs), "day") == [("s", 1, "asr", 0, "x"), ("s", 2, "asr", 0, "z")]


def test_blocked_hosts(spark):
    urls = spark.createDataFrame([("m.facebook.com",), ("notfacebook.com",), ("x.com",), ("",)], "host string")
    got = {r.host: r.blocked for r in venues.blocked(urls, seeds.read_hosts(spark)).collect()}
    assert got == {"m.facebook.com": True, "notfacebook.com": False, "x.com": True, "": False}


def test_weekly_and_empty_tables(spark):
    empty = spark.createDataFrame([], "venue_id long, day date, slot string, session int, time string, begin string")
    assert venues.day_pivot(empty).count() == 0
    one = spark.createDataFrame([(1, datetime.date(2026, 6, 5), "jumuah", 2, "14:00", None), (1, datetime.date(2026, 6, 5), "jumuah", 1, "13:15", None)], empty.schema)
    day = venues.day_pivot(one).first()
    assert [x.time for x in day.jumuah] == ["13:15", "14:00"] and day.begin is None


def test_stream_refresh(spark, tmp_path):
    from horarium.streaming.refresh import refresh

    from horarium.sources import versions

    root, schema = str(tmp_path / "table"), "source_id string, v int"
    (tmp_path / "in").mkdir()
    both = spark.createDataFrame([("a", 1), ("b", 1)], schema)
    versions.replace_sources(both, both, root, "daily", 0)
    spark.createDataFrame([("a", 2), ("b", 2)], schema).write.mode("append").json(str(tmp_path / "in"))
    verdict = lambda docs: docs.select("source_id").withColumn("lane", F.expr("if(source_id = 'a', 'auto_accept', 'review')"))
    for k in range(2):  # a new checkpoint repeats the first batch
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        refresh(stream, lambda docs: (docs, verdict(docs)), root, str(tmp_path / f"ck{k}")).awaitTermination(60)
        assert rows(versions.load(spark, root)) == [("a", 2), ("b", 1)] and versions.manifest(spark, root)["number"] == 2


def test_entry_without_the_corpus_package(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert "flagship_times_near" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_lint_layouts(spark):
    """Label columns name no slot; repeated items need columns; a template must be fillable."""
    kinds = "source_id string, shape string, columns array<struct<kind:string,slot:string>>, template string, single_day boolean, month_sections boolean, label_index int"
    asr, bare = [("jamaah", "asr")], [("jamaah", None)]
    data = [
        ("rows", "html_table", bare, None, True, False, 0), ("rows paged", "html_table", bare, "https://x/{year}/{month:02d}", False, False, 0), ("items", "html_repeated", [], None, False, False, None),
        ("bare", "html_table", bare, None, False, False, None), ("odd", "html_table", asr, "https://x/{month}/{week}", False, False, None), ("good", "html_table", asr, "https://x/{year}-{month:02d}", False, False, None),
    ]
    got = {r.source_id: r.problems for r in gates.lint(spark.createDataFrame(data, kinds)).collect()}
    assert got == {"rows": [], "rows paged": ["paging with a label column"], "items": ["no columns"], "bare": ["column without slot"], "odd": ["template cannot be filled"], "good": []}


def test_seed_round_trip(spark, tmp_path):
    data = [(str(k), f"Zähl {{{k}}}", ["a", "b"], None, "x", None, "GB", 1.0 * k, 2.0, None) for k in range(5)]
    seed = spark.createDataFrame(data, seeds.SEED).coalesce(1)
    seeds.write_seed(seed, f"{tmp_path}/seed")
    assert sorted(map(tuple, seeds.read_seed(spark, f"{tmp_path}/seed").collect())) == data
    (tmp_path / "one.json").write_text('[{"id": "1", "name": "n", "lat": 1, "lng": 2},\n {"id": "2", "name": "m", "lat": 1}]')
    with pytest.raises(Exception, match="record 1 has no lng"):
        seeds.read_seed(spark, f"{tmp_path}/one.json").select("name").collect()


def test_authoring_problems(spark):
    kinds = "source_id string, shape string, row_selector string, columns array<struct<kind:string,slot:string,index:int,selector:string,time_index:int>>, label_index int, date struct<index:int,selector:string>, single_day boolean, month_sections boolean, template string"
    asr = ("jamaah", "asr", 1, None, None)
    data = [
        ("good", "html_table", None, [asr], None, (0, None), None, None, None), ("rules", "rules", None, None, None, None, None, None, None), ("bare", "html_table", None, None, -1, None, None, None, None),
        ("column", "html_table", None, [("jamaah", None, None, None, -1), ("begin", "isha", -2, None, None)], None, (None, None), None, None, None), ("items", "html_repeated", " ", [asr], None, (0, None), False, None, None),
        ("today", "html_table", None, [asr], None, None, True, None, None), ("paged", "html_table", None, [asr], None, None, None, None, "t/{month}"),
    ]
    got = {r.source_id: r.problems for r in gates.authoring_problems(spark.createDataFrame(data, kinds)).collect()}
    assert got == {
        "good": [], "rules": [], "today": [], "paged": [], "bare": ["no columns", "negative label index", "no date axis"],
        "column": ["column 0 (jamaah label) needs an index from 0", "column 0 (jamaah label) has a negative time index", "column 1 (begin isha) has a negative index", "date without its place"],
        "items": ["no row selector", "column 0 (jamaah asr) needs a selector", "date without its place"],
    }
