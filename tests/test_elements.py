"""The element relation, selectors, and timetables that are no tables."""

import pytest
from pyspark.sql import functions as F

from horarium.operators import records, regions
from horarium.sources import elements as E
from horarium.sources import html


def page(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, html string")


def tree(text):
    names = [x.split()[0] for x in E.ELEMENT.split(", ")]
    return {r["el"]: r for r in (dict(zip(names, row, strict=True)) for row in E.elements_of(text))}


def test_nesting_and_ends():
    t = tree("<ul id=a class='x  y'><li>one<li>two <b>bold</b><br/></ul></i><p>p<div data-q>d<script>no</script></div>")
    assert [(t[k]["tag"], t[k]["parent"], t[k]["last"], t[k]["kids"], t[k]["text"]) for k in sorted(t)] == [
        ("ul", -1, 4, 2, "one two bold"), ("li", 0, 1, 0, "one"), ("li", 0, 4, 2, "two bold"), ("b", 2, 3, 0, "bold"), ("br", 2, 4, 0, ""),
        ("p", -1, 5, 0, "p"), ("div", -1, 7, 1, "d"), ("script", 6, 7, 0, ""),
    ]
    assert t[0]["classes"] == ["x", "y"] and t[3]["path"] == [0, 2] and dict(t[6]["attrs"]) == {"data-q": ""}
    assert tree(None) == {} and tree("") == {} and tree("a < b") == {}


def test_source_positions():
    text = "<p>é\r\n😀<b\n>x</b ></p><table><tr><td>1<td>2</table>"
    t = tree(text)
    assert [text[t[k]["begin"] : t[k]["end"]] for k in sorted(t)] == ["<p>é\r\n😀<b\n>x</b ></p>", "<b\n>x</b >", "<table><tr><td>1<td>2</table>", "<tr><td>1<td>2", "<td>1", "<td>2"]


def test_selectors(spark):
    pages = page(spark, "<div id=a class='p q'><div class=p><i class=z>1</i></div><i class='z y' data-r=v>2</i></div><p class=p><i>3</i></p>", "<i>only</i>", None)
    elements = E.page_elements(pages, "k")
    asked = ["i", "#a i", "#a > i", "div.p > i.z", "div.p.q i.z.y", ".p i", "p>i", "[data-r]", "i[data-r='v']", "i[data-r=w]", "div  div i", "*", "div > div > i", "p.p"]
    selectors = spark.createDataFrame([(0, n, s) for n, s in enumerate(asked)] + [(1, 0, "i"), (1, 1, ""), (1, 2, None), (2, 0, "i")], "k int, name int, selector string")
    got = {}
    for r in E.select(elements, selectors, "k").collect():
        got.setdefault((r.k, r.name), []).append(r.text)
    want = {"i": "1 2 3", "#a i": "1 2", "#a > i": "2", "div.p > i.z": "1 2", "div.p.q i.z.y": "2", ".p i": "1 2 3", "p>i": "3", "[data-r]": "2", "i[data-r='v']": "2", "div  div i": "1", "div > div > i": "1", "p.p": "3"}
    assert {asked[n]: " ".join(sorted(v)) for (k, n), v in got.items() if k == 0 and asked[n] != "*"} == want
    assert len(got[0, asked.index("*")]) == 6 and got[1, 0] == ["only"]
    with pytest.raises(Exception, match="selector not understood"):
        E.select(elements, spark.createDataFrame([(0, 0, "a:hover")], "k int, name int, selector string"), "k").collect()


def test_long_texts_come_from_the_page(spark):
    long = " ".join(f"word{k}" for k in range(400))
    pages = page(spark, f"<p>a</p><div>{long}</div>")
    found = E.page_elements(pages, "k")
    assert found.filter("text is null").count() == 1
    assert {r.text for r in E.with_text(found, html.visible_text(pages, "k"), "k").collect()} == {"a", long}


def documents(pages):
    return pages.select("k", F.lit(2026).alias("year"), F.lit(6).alias("month"))


def stream(spark, *texts):
    pages = page(spark, *texts)
    found = records.dom_records(E.page_elements(pages, "k"), documents(pages), "k", "2026-06-15")
    return sorted((r.k, str(r.day), r.slot, r.kind, r.time) for r in found.collect())


def test_streams(spark):
    day = "<div><p>{0} June 2026</p><p>Monday</p><span>Fajr</span><b>3:10am</b><b>4:00am</b><span>Shuruq</span><b>4:50</b><span>Asr</span><b>6:30</b><b>6:30</b><span>Isha</span><b>—</b></div>"
    got = stream(spark, f"<body><nav><b>Fajr</b><b>1:00</b></nav><main>{day.format(1)}{day.format(2)}</main><footer><b>Fajr</b><b>2:00</b></footer></body>")
    want = [x for d in ("2026-06-01", "2026-06-02") for x in ((0, d, "asr", "jamaah", "18:30"), (0, d, "fajr", "begin", "03:10"), (0, d, "fajr", "jamaah", "04:00"))]
    assert got == sorted(want)
    # one date: the whole body is the region, and what precedes the date is dropped
    assert stream(spark, f"<body><b>Fajr</b><b>1:00</b>{day.format(1)}</body>") == want[:3]
    # none: all is the day of the run, a label that is no slot takes its times
    assert stream(spark, "<head><title>Asr 1:00</title></head><body><p>Asr 5:00 5:30 Sunset 9:00</p></body>", "<p>no times</p>", "", None) == [(0, "2026-06-15", "asr", "begin", "17:00"), (0, "2026-06-15", "asr", "jamaah", "17:30")]


def test_streams_without_a_body(spark):
    assert stream(spark, "<title>Asr 1:00</title><div>Isha 10:00</div>") == [(0, "2026-06-15", "isha", "jamaah", "22:00")]


def test_repeated_elements_take_the_first(spark):
    pages = page(spark, "<ul><li><b>1 June</b><b>2 June</b><i class=f>3:00</i><i class=f>4:00</i><li><b>nothing</b><i class=f>3:00</i><li><b>3 June</b><i>none</i></ul><b>9 June</b>")
    layout = spark.createDataFrame([(0, "ul > li", "li > b", False, [("i.f", "fajr", "jamaah"), ("i.f", None, "jamaah"), ("", "asr", "begin")])], "k int, row_selector string, date_selector string, single_day boolean, columns array<struct<selector:string,slot:string,kind:string>>")
    found = records.repeated_cells(E.page_elements(pages, "k"), layout, documents(pages), "k", "2026-06-15")
    assert [(str(r.day), r.slot, r.kind, r.time) for r in found.collect()] == [("2026-06-01", "fajr", "jamaah", "03:00")]
    single = records.repeated_cells(E.page_elements(pages, "k"), layout.withColumn("single_day", F.lit(True)), documents(pages), "k", "2026-06-15")
    assert sorted(str(r.day) for r in single.collect()) == ["2026-06-01", "2026-06-15"]


def matrix(spark, text):
    rows = {}
    for r in records.dom_matrix(E.page_elements(page(spark, text), "k"), "k").collect():
        rows.setdefault(r.row_no, {})[r.col_no] = r.text
    return [[rows[r][c] for c in sorted(rows[r])] for r in sorted(rows)]


def test_grids(spark):
    aria = "<div role=table><div role=row><b role=columnheader>Day</b><b role=columnheader>Asr</b></div><div role=row><p><b role=cell>1</b></p></div><div role=row></div></div>"
    assert matrix(spark, aria) == [["Day", "Asr"], ["1", ""]]
    rows = lambda n, t: "<div>" + f"<div><b>{t}</b><b>2:00</b><i></i></div>" * n + "</div>"
    assert matrix(spark, rows(3, "1:00") + rows(4, "x") + rows(3, "3:00")) == [["1:00", "2:00"]] * 3  # most times, then the first
    assert matrix(spark, rows(4, "x")) == [] and matrix(spark, rows(2, "1:00")) == []
    assert matrix(spark, "<div>" + "<div><b>1:00</b><b>2:00</b></div>" * 3 + "<hr></div>") == []  # a child without cells


def test_richest_region(spark):
    text = "<body><table><tr><td>Fajr<td>5:00</table><table><tr><td>Fajr Asr<td>5:00 6:00<tr><td><table><tr><td>Isha 9:00</table></table></body>"
    pages = page(spark, text, "<body>none</body>", "<table><tr><td>x</table>", "<p>a</p><p>b</p>", "")
    found = regions.richest_region(E.page_elements(pages, "k"), html.visible_text(pages, "k"), "k")
    got = {r.k: r.region for r in E.region(pages, found, "k").collect()}
    assert got == {0: text[text.index("<table><tr><td>Fajr Asr") : -len("</body>")], 1: "<body>none</body>", 2: "<table><tr><td>x</table>", 3: "<p>a</p>"}


def test_plain_pages_are_read_like_all_others():
    plain = ["<title>a</title><ul id=a><li>one<li class='x y'>two &amp; three<br></ul></i>tail", "<p a=1 a=2>x<div data-q><img src=/a/b></div>\n<td>1<th>2", "", "no tags"]
    for text in plain:
        tree_ = E._Tree(text)
        tree_.read()
        words, rows = E._quick(text)
        assert words == tree_.words and [tuple(r) for r in rows] == [tuple(r) for r in tree_.done]
    assert all(E._quick(text) is None for text in ("<script>a<b</script>", "<!-- x --><p>", "a < b", "<p a='>'>", "<title>a<b>c</title>", "<br/>"))
