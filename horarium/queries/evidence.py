"""Queries of page evidence over pages that Spark lays out from the events of each venue, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bundle, evidence
from ..sources import elements as E
from ..sources import html
from ..sources.scratch import spread, stored
from .candidates import GRID, NAMES, ORACLE_SQL, QUERIES, _day_times, _days, query

__all__ = ["ORACLE_SQL", "QUERIES"]

_FILL = "<p>Welcome to a page with more than forty characters of text.</p>"


def _kinds(spark, d) -> DataFrame:
    """(venue_id, url, html): a timetable, a frame, a document, a shell, a building site, a bare page, a month with a control, prose."""
    v = F.col("venue_id") % 8
    row = F.concat(F.lit("<tr><td>"), F.date_format("day", "yyyy-MM-dd"), *[x for t in _day_times() for x in (F.lit("<td>"), t)])
    lines = _days(spark, d).select("venue_id", "k", row.alias("tr")).groupBy("venue_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tr"))), lambda x: x["tr"]), "").alias("rows"))
    head = f"<title>Times</title>{_FILL}<table class='a b'><caption>Now</caption><tr><th>Date<th>" + "<th>".join(n for n, _ in NAMES)
    page = (
        F.when(v == 0, F.concat(F.lit(head), "rows", F.lit("</table><table><tr><td>x</table>"))).when(v == 1, F.concat(F.lit(_FILL + "<iframe src='https://mawaqit.net/en/m/"), "venue_id", F.lit("' title=W></iframe>")))
        .when(v == 2, f"{_FILL}<a href='/prayer-times-2024.pdf'>Prayer times</a><a href='/prayer-times-2024.pdf'>again</a><img src=logo.png>").when(v == 3, "<div id=\"root\"></div><p>Fajr and Isha</p>")
        .when(v == 4, "Coming soon: our new web site, please come back later").when(v == 5, "<p>hi</p>").when(v == 6, f"{_FILL}<h2>June 2024</h2><a href=#>›</a>").otherwise(_FILL)
    )
    return spread(stored(lines.select("venue_id", F.concat(F.lit("https://v"), "venue_id", F.lit(".example/a/")).alias("url"), page.alias("html")), "evidence-pages"))


@query(f"""WITH {GRID}, v AS (SELECT venue_id, venue_id % 8 AS v, count(*) AS n FROM days GROUP BY 1),
  e(v, page_class, named_tables, timed_tables, media, timetable_media, iframes, widgets, navs, js_marks, prayer_links, slots_in_text, needs_render) AS (VALUES (0, 'structured_html', 1, 1, 0, 0, 0, 0, 0, 0, 0, 5, false), (1, 'iframe_or_widget', 0, 0, 0, 0, 1, 1, 0, 1, 0, 0, false),
    (2, 'media_only', 0, 0, 2, 1, 0, 0, 0, 0, 2, 0, false), (3, 'js_shell', 0, 0, 0, 0, 0, 0, 0, 1, 0, 2, true), (4, 'under_construction', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, false), (5, 'empty', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, false), (6, 'iframe_or_widget', 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, false), (7, 'unknown', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, false))
  SELECT venue_id, e.* EXCLUDE (v, needs_render), needs_render AND (v.v <> 0 OR 5 * n < 5) AS needs_render, CASE WHEN v.v = 0 THEN 5 * n ELSE 0 END AS clocks, CASE WHEN v.v = 0 THEN 5 * n ELSE 0 END AS table_times FROM v JOIN e USING (v)""")
def page_signals(spark, d):
    """What every kind of page shows, and its class."""
    found = evidence.page_evidence(_kinds(spark, d), "venue_id", 2024)
    counts = ("named_tables", "timed_tables", "media", "timetable_media", "iframes", "widgets", "navs", "js_marks", "prayer_links", "slots_in_text", "clocks", "table_times")
    return found.select("venue_id", "page_class", "needs_render", *[F.col(c).cast("long").alias(c) for c in counts])


@query(f"""WITH {GRID}, v AS (SELECT venue_id, venue_id % 8 AS v, count(*) AS n FROM days GROUP BY 1), l AS (SELECT venue_id, k, day || '|' || string_agg(time, '|' ORDER BY i) AS line FROM grid GROUP BY venue_id, k, day),
  m AS (SELECT venue_id, string_agg(line, ';' ORDER BY k) FILTER (k <= 15) AS matrix, string_agg(line, ';' ORDER BY k) FILTER (k <= 6) AS body FROM l GROUP BY 1)
  SELECT venue_id, CASE WHEN v = 0 THEN 2 ELSE 0 END AS tables, CASE WHEN v = 0 THEN 'table_0 table.a Now 1' END AS named, CASE WHEN v = 0 THEN 'Date|Fajr|Dhuhr|Asr|Maghrib|Isha' END AS header, CASE WHEN v = 0 THEN 'Date|Fajr|Dhuhr|Asr|Maghrib|Isha;' || matrix END AS matrix, CASE WHEN v = 0 THEN body END AS body,
  CASE WHEN v = 0 THEN 'fajr,dhuhr,asr,maghrib,isha' END AS prayers, CASE WHEN v = 0 THEN '0' END AS date_columns, CASE v WHEN 2 THEN 'https://v' || venue_id || '.example/prayer-times-2024.pdf pdf,https://v' || venue_id || '.example/a/logo.png image' ELSE '' END AS media,
  CASE v WHEN 1 THEN 'https://mawaqit.net/en/m/' || venue_id || ' W mawaqit' ELSE '' END AS frames, CASE v WHEN 1 THEN 'mawaqit 0.9' ELSE '' END AS widgets, CASE v WHEN 6 THEN 'next text=›' ELSE '' END AS navs FROM v JOIN m USING (venue_id)""")
def evidence_records(spark, d):
    """The nested record of every page, its lists spelled out."""
    pages = _kinds(spark, d)
    items, elements = stored(html.page_items(pages, "venue_id"), "evidence-items"), stored(E.page_elements(pages, "venue_id"), "evidence-elements")
    r = bundle.evidence_records(pages, items, elements, "venue_id", 2024)
    first = F.get("tables", F.lit(0))
    lines = lambda m: F.array_join(F.transform(m, lambda x: F.array_join(x, "|")), ";")
    said = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[k].cast("string") for k in f])), ",")
    return r.select(
        "venue_id", F.size("tables").alias("tables"), F.when(first.isNotNull(), F.concat_ws(" ", first["table_id"], first["selector"], first["caption"], first["header_depth"].cast("string"))).alias("named"), F.array_join(first["header"], "|").alias("header"), lines(first["matrix"]).alias("matrix"),
        lines(first["body_sample"]).alias("body"), F.array_join(first["prayers"], ",").alias("prayers"), F.array_join(F.transform(first["date_columns"], lambda x: x.cast("string")), ",").alias("date_columns"), said("media", "url", "media").alias("media"), said("frames", "url", "text", "provider").alias("frames"),
        said("widgets", "provider", "confidence").alias("widgets"), said("navs", "kind", "selector").alias("navs"),
    )


@query(f"""WITH {GRID}, v AS (SELECT venue_id, count(*) AS n FROM days GROUP BY 1) SELECT venue_id, 'https://v' || venue_id || '.example/' || t AS target, CAST(o AS INT) AS ordinal FROM v, (VALUES ('prayer', 0), ('b', 2), ('NAMAZ', 3)) x(t, o) WHERE venue_id % 4 > 0
  UNION ALL SELECT venue_id, 'https://v' || venue_id || '.example/x/' || k, CAST(4 + k AS INT) FROM days WHERE venue_id % 4 > 0""")
def page_links(spark, d):
    """Links of a page's own host whose address or words name a timetable, the first of each; one venue in four lies on a blocked host."""
    from ..functions import pyudfs
    from ..functions import scalars as S
    from ..operators import venues
    from ..sources.seeds import read_hosts

    links = "".join(f'<a href="{h}">{t}</a>' for h, t in (("/prayer", "x"), ("/a", "News"), ("/b", "Salat"), ("/NAMAZ", ""), ("/b", "salat again")))
    more = _days(spark, d).groupBy("venue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("k")), lambda k: F.concat(F.lit("<a href=/x/"), k, F.lit(">Jamaah times</a>"))), "").alias("more"))
    site = F.when(F.col("venue_id") % 4 == 0, "https://www.facebook.com/").otherwise(F.concat(F.lit("https://v"), "venue_id", F.lit(".example/")))
    pages = stored(more.select("venue_id", F.concat(site, F.lit("y/")).alias("url"), F.concat(F.lit(links), "more", F.lit("<a href=https://else.example/prayer>Prayer</a>")).alias("html")), "link-pages")
    found = html.anchors(pages, "venue_id").join(pages.select("venue_id", "url"), "venue_id").withColumn("target", pyudfs.absolute_url("url", "href"))
    found = found.withColumn("host", S.url_host(F.col("target"))).filter((F.col("host") == S.url_host(F.col("url"))) & S.has_keyword(F.concat_ws(" ", "href", "text")))
    return venues.blocked(found, read_hosts(spark)).filter("not blocked").groupBy("venue_id", "target").agg(F.min("ordinal").alias("ordinal"))
