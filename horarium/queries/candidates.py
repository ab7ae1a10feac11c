"""Queries of candidates, providers and what is written, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import none_match, time_values
from ..operators import evidence, grids, schema, venues
from ..plans import candidates, extract, providers
from ..sources import adapters as A
from ..sources import html, versions
from ..sources.scratch import kept, shared_dir, spread, stored
from .core import OCC, ORACLE_SQL, QUERIES, VENUE, query
from .elements import GRID, NAMES, TODAY, _day_times, _days  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]



def _candidate_pages(spark, d) -> DataFrame:
    """(venue_id, url, html): a widget of one day above a table of all, a table without two slots, one that tells no day's order; links to media."""
    v, times, date = F.col("venue_id") % 5, _day_times(), F.date_format("day", "yyyy-MM-dd")
    cells = lambda t: F.concat(F.lit("<tr><td>"), date, *[x for c in t for x in (F.lit("<td>"), c)])
    of_day = F.when(v == 1, cells(times[:3])).when(v == 2, cells([times[4], *times[:4]])).otherwise(cells(times))
    line = _days(spark, d).select("venue_id", "k", of_day.alias("tr"))
    rows = line.groupBy("venue_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tr"))), lambda x: x["tr"]).alias("rows"))
    names = [n for n, _ in NAMES]
    widget = "<table><tr><th>" + "<th>".join(names) + "<tr>" + "".join(f"<td>{h}:00" for h in ("5", "13", "17", "20", "22")) + "</table>"
    links = "<a href='/prayer-timetable-2024.pdf'>Prayer timetable</a><a href=/menu.pdf>x</a><img src=/times-january.jpg alt='prayer times'>"
    head = F.when(v == 1, "<th>".join(["Date", *names[:3]])).otherwise("<th>".join(["Date", *names]))
    table = F.concat(F.lit("<table><tr><th>"), head, F.array_join("rows", ""), F.lit("</table>"))
    page = F.when(v == 0, F.concat(F.lit(widget), table)).when(v == 1, F.concat(F.lit(links), table)).when(v == 2, F.concat(table, F.lit(links))).when(v == 3, F.lit("<p>nothing</p>")).otherwise(table)
    return spread(stored(rows.select("venue_id", F.concat(F.lit("https://v"), "venue_id", F.lit(".example/")).alias("url"), page.alias("html")), "candidate-pages"))


_IN = f"day BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 60"


@query(f"""WITH {GRID}, n AS (SELECT venue_id, count(DISTINCT day) AS days FROM grid WHERE {_IN} GROUP BY 1), v AS (SELECT DISTINCT venue_id FROM days), all_v AS (SELECT venue_id, coalesce(days, 0) AS days FROM v LEFT JOIN n USING (venue_id))
  SELECT venue_id, CASE venue_id % 5 WHEN 2 THEN 'enumerator:media_pdf' ELSE 'enumerator:table_horizontal_multiday' END AS origin, CASE venue_id % 5 WHEN 1 THEN 'review' WHEN 2 THEN 'deferred' ELSE 'auto_accept' END AS lane,
  CASE venue_id % 5 WHEN 1 THEN 3 * days WHEN 2 THEN 0 ELSE 5 * days END AS rows FROM all_v WHERE venue_id % 5 <> 3 AND days > 1""")
def best_candidate(spark, d):
    """Of what each page suggests, what extracts most: every candidate of every page is evaluated at once."""
    pages = _candidate_pages(spark, d)
    items = stored(html.page_items(pages, "venue_id"), "candidate-items")
    cells = html.cells_of(items, "venue_id")
    tables = items.filter("kind = 'table'").select("venue_id", F.col("n").alias("table_no"), F.col("row").alias("thead_rows"))
    rows = items.filter("kind = 'row'").select("venue_id", F.col("n").alias("table_no"), F.col("row").alias("row_no"), F.col("flag").alias("heading"))
    depth = stored(grids.header_depth(tables, rows, cells, "venue_id"), "candidate-headers")
    named = lambda df: df.withColumnRenamed("venue_id", "source_id")
    layouts = named(stored(schema.table_layouts(cells, depth, "venue_id", TODAY), "candidate-found"))
    found = candidates.table_candidates(layouts, named(schema.table_evidence(cells, depth, "venue_id", 2024)))
    tried = stored(found.unionByName(candidates.media_candidates(named(evidence.media_links(items, pages, "venue_id")))), "candidates")
    page = named(pages)
    start = F.lit(TODAY).cast("date")
    values = stored(page.select("source_id", time_values(F.col("html")).alias("values")), "candidate-values")
    made, verdicts = candidates.verify(tried, named(cells), layouts, values, page.select("source_id", F.year(start).alias("year"), F.month(start).alias("month")), TODAY, 60)
    best = candidates.best(tried, made, verdicts)
    days = named(_days(spark, d)).filter(F.col("day").between(start, F.date_add(start, 60))).groupBy("source_id").agg(F.count("*").alias("n")).filter("n > 1")
    return best.join(days, "source_id").select(F.col("source_id").alias("venue_id"), "origin", "lane", F.col("rows").cast("long").alias("rows"))


_NAMES = [n for n, _ in NAMES]
_MONTH = int(TODAY[5:7])


def _provided(spark, d) -> tuple[DataFrame, DataFrame]:
    """(page, fetched): pages of eleven kinds and of none, and what their plug-ins would fetch."""
    v, times = F.col("venue_id") % 12, _day_times()
    cells = lambda first: F.concat(F.lit("<tr><td>"), first, *[x for t in times for x in (F.lit("<td>"), t)])
    across = lambda first: F.concat(F.lit("<div role=row><b role=cell>"), first, *[x for t in times for x in (F.lit("</b><b role=cell>"), t)], F.lit("</b></div>"))
    record = F.concat(F.lit("<div><p>"), F.date_format("day", "d MMMM yyyy"), F.lit("</p>"), *[x for n, t in zip(_NAMES, times, strict=True) for x in (F.lit(f"<b>{n}</b><i>"), t, F.lit("</i>"))], F.lit("</div>"))
    days = _days(spark, d).select("venue_id", "k", cells(F.date_format("day", "d")).alias("bare"), cells(F.date_format("day", "yyyy-MM-dd")).alias("dated"), across(F.date_format("day", "yyyy-MM-dd")).alias("grid"), record.alias("stream"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]), "").alias(c)
    lists = days.groupBy("venue_id").agg(*[joined(c) for c in ("bare", "dated", "grid", "stream")])
    head = "<tr><th>Date<th>" + "<th>".join(_NAMES)
    table = lambda attr, rows: F.concat(F.lit(f"<table {attr}>{head}"), rows, F.lit("</table>"))
    frame = "<iframe src='//www.masjidbox.com/w/1'></iframe>"
    calendar = '<script>var confData = {"calendar":[{"1":["5:00","6:30","13:00","17:00","20:00","22:00"],"32":["5:00"]}],"note":"}"}; //mawaqit.net</script>'
    plugin = "<script>var timetable_params = {'x':1,\"ajaxurl\":\"https:\\/\\/a.example\\/ajax.php\"};</script><p>Jumu'ah 1st 12:45 pm then 13:30, 13:30 and 16:00</p>"
    endpoint = "<p>Prayer times</p><script>var url='https://b.example/wp-admin/admin-ajax.php'; load({action: 'get_posts', month: 1}); load({action: 'month_view', 'month': m})</script>"
    page = (
        F.when(v == 0, F.concat(F.lit(frame), table("class='x dpt_table'", "bare"))).when(v == 1, F.lit(calendar)).when(v == 2, F.lit("<a href='https://my-masjid.com/screen/g-1'>x</a>"))
        .when(v == 3, F.concat(F.lit("<table><tr><td>x</table>"), table("class='x dpt_table'", "bare"))).when(v == 4, F.lit(plugin)).when(v == 5, F.lit(endpoint)).when(v == 6, F.lit("<p>nothing</p>"))
        .when(v == 7, table("id=t", "dated")).when(v == 9, F.concat(F.lit("<div role=row>" + "".join(f"<b role=cell>{n}</b>" for n in ("Date", *_NAMES)) + "</div>"), "grid")).when(v == 10, F.concat(F.lit("<body><h2>January 2024</h2><a>›</a>"), "stream", F.lit("</body>")))
        .when(v == 11, "<table><tr><th>" + "<th>".join(_NAMES) + "<tr><td>5:00<td>13:00<td>17:00<td>20:00<td>22:00</table>").otherwise(F.concat(F.lit("<script>confData = {'calendar': oops}</script>"), table("", "dated")))
    )
    site = F.concat(F.lit("https://v"), "venue_id", F.lit(".example/x/"))
    address = {4: f"https://a.example/ajax.php?action=get_monthly_timetable&month={_MONTH}&display=table", 5: "https://b.example/wp-admin/admin-ajax.php?action=month_view&month=1"}
    one = lambda k, attr: F.concat(F.lit("<table></table>"), table(attr, "dated"))
    got = lists.filter(v.isin(*address)).groupBy(v.alias("v")).agg(F.min("venue_id").alias("venue_id")).drop("v").join(lists, "venue_id")
    fetched = got.select(F.when(v == 4, address[4]).otherwise(address[5]).alias("url"), F.when(v == 4, one(4, "class='dptTimetable y'")).otherwise(table("", "dated")).alias("html"))
    return spread(stored(lists.select(F.col("venue_id").alias("source_id"), site.alias("url"), page.alias("html")), "provider-pages")), kept(fetched, "provider-fetched")


@query(f"""WITH {GRID}, v AS (SELECT venue_id, venue_id % 12 AS v, count(*) AS n FROM days GROUP BY 1)
  SELECT venue_id, ['masjidbox', 'mawaqit', 'mylocalmasjid', 'wp_prayer', 'wp_dpt', 'endpoint_month', NULL, 'generic_table', 'generic_table', 'dom_grid', 'dom_records', 'generic_table'][v + 1] AS platform, CASE WHEN v = 0 THEN 'html_repeated' WHEN v IN (1, 2) THEN 'widget' WHEN v = 9 THEN 'dom_grid' WHEN v = 10 THEN 'dom_records' ELSE 'html_table' END AS shape, v IN (0, 9, 10) AS requires_js,
  CASE WHEN v IN (0, 1, 2, 10) THEN NULL WHEN v = 11 THEN 'horizontal_single_day' ELSE 'horizontal_multiday' END AS layout, CASE WHEN v = 10 AND n > 1 THEN 'text=›' END AS nav,
  CASE v WHEN 0 THEN 'https://www.masjidbox.com/w/1' WHEN 2 THEN 'https://time.my-masjid.com/api/TimingsInfoScreen/GetMasjidTimings?GuidId=g-1' ELSE 'https://v' || venue_id || '.example/x/' END AS url,
  CASE v WHEN 4 THEN 'https://a.example/ajax.php?action=get_monthly_timetable&month={{month}}&display=table' WHEN 5 THEN 'https://b.example/wp-admin/admin-ajax.php?action=month_view&month={{month}}' END AS template,
  CASE v WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 7 THEN 0 WHEN 8 THEN 0 WHEN 9 THEN 0 WHEN 11 THEN 0 END AS table_no, CASE WHEN v IN (1, 2, 10) THEN NULL WHEN v = 11 THEN '0:fajr,1:dhuhr,2:asr,3:maghrib,4:isha' WHEN v = 0 THEN ':fajr,:dhuhr,:asr,:maghrib,:isha' ELSE '1:fajr,2:dhuhr,3:asr,4:maghrib,5:isha' END AS columns,
  CASE WHEN v = 4 THEN '1st Jumu''ah 12:45|1st Jumu''ah 13:30' END AS sessions FROM v WHERE v <> 6""")
def providers_of(spark, d):
    """Which plug-in knows each page, and how it is read; a broken calendar leaves its page to the next."""
    found = providers.detect(*_provided(spark, d), TODAY)
    columns = F.array_join(F.transform("columns", lambda c: F.concat_ws(":", F.coalesce(c["col_no"].cast("string"), F.lit("")), c["slot"])), ",")
    sessions = F.array_join(F.transform("sessions", lambda s: F.concat_ws(" ", s["label"], s["time"])), "|")
    return found.select(F.col("source_id").alias("venue_id"), "platform", "shape", "requires_js", "url", "template", "nav", "layout", "table_no", columns.alias("columns"), sessions.alias("sessions"))


@query(f"""WITH {GRID}, v AS (SELECT DISTINCT venue_id FROM days), t(i, slot, time) AS (VALUES (0, 'fajr', '05:0'), (1, 'dhuhr', '13:0'), (2, 'asr', '17:0'), (3, 'maghrib', '20:0'), (4, 'isha', '22:0'))
  SELECT venue_id, day, slot, 'begin' AS kind, time || (venue_id % 10) AS time, NULL AS "offset" FROM v, t, (VALUES (DATE '2024-01-01'), (DATE '2024-01-31')) x(day) WHERE venue_id % 3 < 2
  UNION ALL SELECT venue_id, DATE '2024-01-31', slot, 'jamaah', NULL, 15 FROM v, t WHERE venue_id % 3 < 2""")
def calendar_page_cells(spark, d):
    """From pages to the cells of the calendars that they carry; broken objects and pages without one give nothing."""
    minute = (F.col("venue_id") % 10).cast("string")
    times = F.concat(F.lit('["5:0'), minute, F.lit('","6:59","13:0'), minute, F.lit('","17:0'), minute, F.lit('","20:0'), minute, F.lit('","22:0'), minute, F.lit('"]'))
    conf = F.concat(F.lit('{"name":"a \\"}{ b","calendar":[{"1":'), times, F.lit(',"31":'), times, F.lit(',"32":'), times, F.lit(',"x":'), times, F.lit('},{"1":[]}],"iqamaCalendar":[{"31":["+15","+15","+15","+15","+15"]}]}'))
    kind = F.col("venue_id") % 3
    body = F.when(kind == 0, F.concat(F.lit("<script>x = {1}; let confData = "), conf, F.lit(";</script><p>{}</p>"))).when(kind == 1, F.concat(F.lit("<!-- mawaqit.net --> confData"), conf)).otherwise("confData = {broken")
    pages = stored(_days(spark, d).select("venue_id").distinct().select(F.col("venue_id").alias("source_id"), body.alias("html")), "calendar-pages")
    found = extract.calendar_cells(providers.calendar_payloads(pages), "source_id", 2024, 1)
    return found.select(F.col("source_id").alias("venue_id"), "day", "slot", "kind", "time", "offset")


@query(f"""WITH {VENUE}, {OCC}, s AS (SELECT venue_id, count(time) AS n, coalesce(string_agg(day || ' ' || slot || ' ' || time, ',' ORDER BY day, slot, session, time), '') AS times FROM venue LEFT JOIN (SELECT * FROM occ WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-03' + 45) o USING (venue_id) GROUP BY 1),
  d AS (SELECT sha256(CAST(venue_id AS VARCHAR)) AS name, sha256(printf('{{"n":%d,"times":"%s","venue_id":%d}}', n, times, venue_id)) AS digest FROM s), r AS (SELECT left(name, 3) AS range, sha256(string_agg(digest, '' ORDER BY name)) AS digest, count(*) AS n FROM d GROUP BY 1)
  SELECT '"' || left(sha256(string_agg(digest, '' ORDER BY range)), 16) || '"' AS tag, CAST(sum(n) AS BIGINT) AS rows, true AS unchanged, false AS other FROM r""")
def snapshot_tag(spark, d):
    """The tag of the snapshot, and whether a client that has it, or another, is up to date."""
    s = venues.snapshot(A.venue(spark, d), A.occurrence(spark, d), "2024-01-03")
    joined = F.array_join(F.transform("times", lambda t: F.concat_ws(" ", t["day"].cast("string"), t["slot"], t["time"])), ",")
    tag = venues.snapshot_tag(s.select("venue_id", F.size("times").cast("long").alias("n"), joined.alias("times")), "venue_id")
    return tag.select("tag", "rows", none_match(F.col("tag"), F.concat(F.lit('"x", '), "tag")).alias("unchanged"), none_match(F.col("tag"), F.lit('"x", "y"')).alias("other"))


@query(f"WITH {OCC} SELECT venue_id AS source_id, day, slot, CASE WHEN venue_id % 3 = 0 THEN '12:34' ELSE time END AS time FROM occ WHERE venue_id % 3 > 0 OR slot = 'asr'")
def versioned_rows(spark, d):
    """A table after two batches, the second repeated: sources that it names have its rows only."""
    root = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    rows = A.occurrence(spark, d).select(F.col("venue_id").alias("source_id"), "day", "slot", "time")
    versions.replace_sources(rows, rows, root, "query", 0)
    third = rows.filter("source_id % 3 = 0")
    for _ in range(2):
        versions.replace_sources(third.filter("slot = 'asr'").withColumn("time", F.lit("12:34")), third, root, "query", 1)
    return versions.load(spark, root)
