"""Queries of pages whose timetables are no tables, of regions and of month controls, each with its oracle.

Pages are laid out from the events of each venue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import records, regions, schema
from ..plans import extract
from ..sources import elements as E
from ..sources import html
from ..sources.scratch import spread, stored
from .core import ORACLE_SQL, QUERIES, query
from .pages import GRID, NAMES, TODAY, _day_times, _days, _depth

__all__ = ["ORACLE_SQL", "QUERIES"]


def _pages(days: DataFrame, before: Column, of_day: Column, after: Column) -> DataFrame:
    """(venue_id, html): what stands before, the days in order, and what stands after."""
    line = days.select("venue_id", "k", of_day.alias("day"))
    body = line.groupBy("venue_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "day"))), lambda x: x["day"]), "").alias("body"))
    return spread(stored(body.select("venue_id", F.concat(before, "body", after).alias("html")), "laid-out-pages"))


def _documents(pages: DataFrame) -> DataFrame:
    day = F.lit(TODAY).cast("date")
    return pages.select("venue_id", F.year(day).alias("year"), F.month(day).alias("month"))


@query(f"""WITH {GRID}, kept AS (SELECT venue_id, CASE WHEN venue_id % 5 = 0 THEN DATE '{TODAY}' ELSE day END AS day, slot, time FROM grid WHERE venue_id % 5 > 0 OR k = 1)
  SELECT venue_id, day, slot, 'jamaah' AS kind, left(time, 2) || ':59' AS time FROM kept UNION ALL SELECT venue_id, day, slot, 'begin', time FROM kept WHERE right(time, 2) <> '59'""")
def dom_records(spark, d):
    """Days as blocks of plain elements; one venue in five shows a single day without a date."""
    single = F.col("venue_id") % 5 == 0
    days = _days(spark, d).filter(~single | (F.col("k") == 1))
    date = F.when(single, "").otherwise(F.concat(F.lit("<p>"), F.date_format("day", "d MMMM yyyy"), F.lit("</p><p>"), F.date_format("day", "EEEE"), F.lit("</p>")))
    times = [(n, F.concat(F.substring(t, 1, 2), F.lit(":59")), t) for (n, _), t in zip(NAMES, _day_times(), strict=True)]
    # the later time stands first, and a label that is no slot keeps its time to itself
    parts = [F.concat(F.lit(f"<div><span>{n}</span><span>"), late, F.lit("</span><span>"), t, F.lit("</span></div>" + ("<div><i>Shuruq</i><b>06:10</b></div>" if n == "Fajr" else ""))) for n, late, t in times]
    pages = _pages(days, F.lit("<html><head><title>Fajr 1:00</title></head><body><header><a href=/>Open 9:00</a></header><main>"), F.concat(F.lit("<div><div>"), date, F.lit("</div>"), *parts, F.lit("</div>")), F.lit("</main></body></html>"))
    found = records.dom_records(stored(E.page_elements(pages, "venue_id"), "record-elements"), _documents(pages), "venue_id", TODAY)
    return found.select("venue_id", "day", "slot", "kind", "time")


@query(f"""WITH {GRID} SELECT venue_id, CASE WHEN venue_id % 3 = 2 THEN DATE '{TODAY}' ELSE day END AS day, slot, CASE WHEN i % 2 = 0 THEN 'jamaah' ELSE 'begin' END AS kind, time FROM grid""")
def html_repeated(spark, d):
    """Days as repeated elements, in three kinds of markup with selectors of their own; a third has no dates."""
    v = F.col("venue_id") % 3
    pick = lambda *c: F.when(v == 0, c[0]).when(v == 1, c[1]).otherwise(c[2])
    date, times = F.date_format("day", "d MMMM"), _day_times()
    cells = lambda tag, attr: F.concat(*[x for (n, _), t in zip(NAMES, times, strict=True) for x in (F.lit(f"<{tag} {attr}{n.lower()}\">"), t, F.lit(f"</{tag}>"))])
    day = pick(
        F.concat(F.lit('<li class="row day"><b>'), date, F.lit("</b>"), cells("span", 'class="t '), F.lit("<ul><li class=day-note>9:99</ul>")),
        F.concat(F.lit('<div class=day><p class=when data-role="date">'), date, F.lit("</p><div>"), cells("i", 'data-slot="'), F.lit("</div></div>")),
        F.concat(F.lit("<article>"), cells("em", 'id="'), F.lit("</article>")),
    )
    outside = F.lit("<div class=day><b>1 May</b></div><article><em id=fajr>4:00</em></article><main id=m><section class='month now'>")
    before = pick(F.concat(outside, F.lit("<ul>")), outside, outside)
    pages = _pages(_days(spark, d), before, day, F.lit("</section></main>"))
    column = lambda selector: F.array(*[F.struct(F.format_string(selector, F.lit(n.lower())).alias("selector"), F.lit(n.lower()).alias("slot"), F.lit(("jamaah", "begin")[i % 2]).alias("kind")) for i, (n, _) in enumerate(NAMES)])
    layout = pages.select(
        "venue_id", pick(F.lit("#m section.month > ul > li.day.row"), F.lit("main#m .now>div.day"), F.lit("section article")).alias("row_selector"), pick(F.lit("li > b"), F.lit("div p.when[data-role='date']"), F.lit(None)).alias("date_selector"),
        (v == 2).alias("single_day"), pick(column("span.t.%s"), column("div i[data-slot=%s]"), column("em#%s")).alias("columns"),
    )
    found = records.repeated_cells(stored(E.page_elements(pages, "venue_id"), "repeated-elements"), layout, _documents(pages), "venue_id", TODAY)
    return found.select("venue_id", "day", "slot", "kind", "time")


def _grids(spark, d) -> DataFrame:
    """Elements of pages with a grid by role, or of equal siblings, beside a menu and a smaller grid."""
    aria = F.col("venue_id") % 2 == 0
    row = lambda cells: F.when(aria, F.concat(F.lit("<div role=row><div>"), *[F.concat(F.lit("<span role=cell>"), c, F.lit("</span>")) for c in cells], F.lit("</div></div>"))).otherwise(F.concat(F.lit("<section>"), *[F.concat(F.lit("<p>"), c, F.lit("<p></p>")) for c in cells], F.lit("</section>")))
    head = row([F.lit(x) for x in ("Date", *(n for n, _ in NAMES))])
    menu = F.lit("<nav>" + "<div><a href=/>Home</a><a href=/x>Shop</a></div>" * 4 + "</nav>" + "<aside>" + "<div><b>1:00</b><i>2:00</i></div>" * 2 + "<div><b>x</b></div></aside>")
    return stored(E.page_elements(_pages(_days(spark, d), F.concat(F.lit("<body>"), menu, F.lit("<main>"), head), row([F.date_format("day", "yyyy-MM-dd"), *_day_times()]), F.lit("</main></body>")), "venue_id"), "grid-elements")


_SHOWN = "venue_id IN (SELECT venue_id FROM days GROUP BY 1 HAVING venue_id % 2 = 0 OR count(*) >= 2)"


@query(f"""WITH {GRID} SELECT * FROM (SELECT venue_id, k AS row_no, i + 1 AS col_no, time AS text FROM grid UNION ALL SELECT venue_id, k, 0, CAST(day AS VARCHAR) FROM days
  UNION ALL SELECT DISTINCT venue_id, 0, i + 1, name FROM grid UNION ALL SELECT DISTINCT venue_id, 0, 0, 'Date' FROM days) WHERE {_SHOWN}""")
def dom_matrix(spark, d):
    """Cells of grids of other elements: venues of fewer than two days have no grid of siblings."""
    cells = records.dom_matrix(_grids(spark, d), "venue_id")
    return cells.select("venue_id", "row_no", "col_no", "text")


@query(f"WITH {GRID} SELECT venue_id, day, slot, time FROM grid WHERE {_SHOWN}")
def dom_matrix_cells(spark, d):
    """The same grids read by the layouts that are inferred for tables."""
    cells = stored(records.dom_matrix(_grids(spark, d), "venue_id"), "grid-cells")
    layout = stored(schema.table_layouts(cells, _depth(cells), "venue_id", TODAY), "grid-layouts")
    return extract.extract(cells, layout, "venue_id", TODAY).select("venue_id", "day", "slot", "time")


@query(f"""WITH {GRID}, rows AS (SELECT venue_id, k, '<tr><td>' || day || string_agg('<td>' || time, '' ORDER BY i) AS tr FROM grid GROUP BY venue_id, k, day),
  t AS (SELECT venue_id, '<table><tr><th>Date<th>Fajr<th>Dhuhr<th>Asr<th>Maghrib<th>Isha' || string_agg(tr, '' ORDER BY k) || '</table>' AS html FROM rows GROUP BY 1)
  SELECT venue_id, CASE WHEN venue_id % 3 = 0 THEN '<table id=a><tr><td>x</table>' WHEN venue_id % 3 = 1 THEN html ELSE '<body>Fajr 5:00</body>' END AS region FROM t""")
def page_region(spark, d):
    """The slice of each page's source that shows its timetable: the richest table, the first, or the body."""
    kind = F.col("venue_id") % 3
    row = F.concat(F.lit("<tr><td>"), F.date_format("day", "yyyy-MM-dd"), *[x for t in _day_times() for x in (F.lit("<td>"), t)])
    head = "<table><tr><th>Date" + "".join(f"<th>{n}" for n, _ in NAMES)
    before = F.when(kind == 0, "<table id=a><tr><td>x</table>").when(kind == 1, f"<p>Ünï😀\n<table><tr><td>Fajr<td>5:00</table>\r\n{head}").otherwise("<body>Fajr 5:00")
    after = F.when(kind == 0, "<table><tr><td>Fajr 5:00</table>").when(kind == 1, "</table><table><tr><td>Fajr Asr 5:00</table>").otherwise("</body><p>")
    pages = _pages(_days(spark, d), before, F.when(kind == 1, row).otherwise(""), after)
    elements = stored(E.page_elements(pages, "venue_id"), "region-elements")
    return E.region(pages, regions.richest_region(elements, html.visible_text(pages, "venue_id"), "venue_id"), "venue_id")


@query(f"""WITH {GRID} SELECT DISTINCT venue_id, CASE WHEN venue_id % 6 < 4 THEN 'select' ELSE 'next' END AS kind,
  ['select#m', 'select[name=''month'']', 'select.pick', 'select', 'text=Next month', 'text=»'][1 + venue_id % 6] AS selector FROM days WHERE venue_id % 7 > 0""")
def month_controls(spark, d):
    """How pages of one month reach the others; one venue in seven names no month."""
    v = F.col("venue_id") % 6
    options = "".join(f"<option>{m.title()}" for m in S.MONTHS)
    control = F.when(v == 0, f"<select id=m class=a>{options}</select><a>Next</a>").when(v == 1, f"<select name=month>{options}</select>").when(v == 2, f"<select class='pick b'>{options}</select>").when(v == 3, f"<p>›</p><select>{options}</select>").when(v == 4, "<a href=#> Next  month </a><b>»</b>").otherwise("<select><option>March</select><button>»</button>")
    caption = F.when(F.col("venue_id") % 7 == 0, "<select><option>x</select>").otherwise(F.concat(F.lit("<h2>"), F.date_format("day", "MMMM yyyy"), F.lit("</h2>")))
    control = F.when((F.col("venue_id") % 7 == 0), "<b>»</b>").otherwise(control)
    pages = _pages(_days(spark, d).filter("k = 1"), F.lit("<body>"), F.concat(caption, control), F.lit("</body>"))
    return regions.month_controls(stored(E.page_elements(pages, "venue_id"), "control-elements"), "venue_id")
