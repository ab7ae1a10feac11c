"""Queries of page evidence, table layouts, extraction and evaluation, each with its oracle where SQL has one.

The `pages` table holds no timetables, so layouts run on timetables that Spark
lays out from the events of each venue: one of four layouts by venue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence, grids, schema
from ..plans import evaluate, extract
from ..sources import adapters as A
from ..sources import html
from ..sources.scratch import spread, stored
from .core import OCC, ORACLE_SQL, QUERIES, query
from .timetable import HM

__all__ = ["ORACLE_SQL", "QUERIES"]

TODAY = "2024-01-01"
NAMES = (("Fajr", 5), ("Dhuhr", 13), ("Asr", 17), ("Maghrib", 20), ("Isha", 22))
GRID = f"""{OCC}, slots(i, name, h) AS (VALUES {', '.join(f"({k}, '{n}', {h})" for k, (n, h) in enumerate(NAMES))}),
  days AS (SELECT venue_id, day, CAST(row_number() OVER (PARTITION BY venue_id ORDER BY day) AS INT) AS k FROM (SELECT DISTINCT venue_id, day FROM occ)),
  grid AS (SELECT venue_id, day, k, i, name, lower(name) AS slot, printf('%02d:%02d', h, CAST((venue_id * 7 + dayofmonth(day) * 3 + i) % 60 AS INT)) AS time FROM days, slots)"""


def _days(spark, d) -> DataFrame:
    return A.days(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("venue_id").orderBy("day")))


def _grid(days: DataFrame) -> DataFrame:
    """(venue_id, day, k, i, name, time): five times a day."""
    slots = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("h")) for n, h in NAMES])
    rows = days.select("*", F.posexplode(slots).alias("i", "s"))
    minute = ((F.col("venue_id") * 7 + F.dayofmonth("day") * 3 + F.col("i")) % 60).cast("int")
    return rows.select("venue_id", "day", "k", "i", "s.name", F.format_string("%02d:%02d", "s.h", minute).alias("time"))


def _cell(row, col, text) -> F.Column:
    as_int = lambda x: (x if isinstance(x, F.Column) else F.lit(x)).cast("int")
    return F.struct(as_int(row).alias("row_no"), as_int(col).alias("col_no"), (text if isinstance(text, F.Column) else F.lit(text)).alias("text"))


def _day_times() -> list[F.Column]:
    minute = lambda i: ((F.col("venue_id") * 7 + F.dayofmonth("day") * 3 + i) % 60).cast("int")
    return [F.format_string("%02d:%02d", F.lit(h), minute(i)) for i, (_, h) in enumerate(NAMES)]


def _put(days: DataFrame, *cells: F.Column) -> DataFrame:
    """Long cells of one table a venue, from arrays of cells of each day; kept, as layouts read them many times."""
    return spread(stored(days.select("venue_id", F.lit(0).alias("table_no"), F.explode(F.concat(*cells)).alias("c")).select("venue_id", "table_no", "c.*"), "timetables"))


def _timetables(spark, d) -> DataFrame:
    """Cells of one table a venue: days down, days across, one day, or slots down a column."""
    k, t, none = F.col("k"), _day_times(), F.array().cast("array<struct<row_no:int,col_no:int,text:string>>")
    names, first = [n for n, _ in NAMES], F.col("k") == 1
    when = lambda kind, *c: F.when(F.col("venue_id") % 4 == kind, F.array(*c)).otherwise(none)
    once = lambda kind, *c: F.when((F.col("venue_id") % 4 == kind) & first, F.array(*c)).otherwise(none)
    date = F.date_format("day", "yyyy-MM-dd")
    return _put(
        _days(spark, d),
        when(0, _cell(k, 0, date), *[_cell(k, i + 1, x) for i, x in enumerate(t)]), once(0, _cell(0, 0, "Date"), *[_cell(0, i + 1, n) for i, n in enumerate(names)]),
        when(1, _cell(0, k, date), *[_cell(i + 1, k, x) for i, x in enumerate(t)]), once(1, _cell(0, 0, "Date"), *[_cell(i + 1, 0, n) for i, n in enumerate(names)]),
        once(2, *[_cell(0, i, n) for i, n in enumerate(names)], *[_cell(1, i, x) for i, x in enumerate(t)]),
        once(3, _cell(0, 0, "Prayer"), _cell(0, 1, "Jamaat"), *[_cell(i + 1, 0, n) for i, n in enumerate(names)], *[_cell(i + 1, 1, x) for i, x in enumerate(t)]),
    )


def _depth(cells: DataFrame) -> DataFrame:
    tables = cells.groupBy("venue_id", "table_no").agg(F.lit(0).alias("thead_rows"))
    rows = cells.groupBy("venue_id", "table_no", "row_no").agg(F.lit(False).alias("heading"))
    return stored(grids.header_depth(tables, rows, cells, "venue_id"), "timetable-headers")


@query(f"""WITH {GRID} SELECT DISTINCT venue_id, CASE venue_id % 4 WHEN 0 THEN 'horizontal_multiday' WHEN 1 THEN 'transpose_multiday' WHEN 2 THEN 'horizontal_single_day' ELSE 'prayer_rows' END AS layout,
  CASE WHEN venue_id % 4 < 2 THEN 0 END AS date_col, CASE WHEN venue_id % 4 = 3 THEN 0 END AS label_col,
  CASE venue_id % 4 WHEN 2 THEN '0:fajr,1:dhuhr,2:asr,3:maghrib,4:isha' WHEN 3 THEN '1:' ELSE '1:fajr,2:dhuhr,3:asr,4:maghrib,5:isha' END AS columns FROM days""")
def table_layouts(spark, d):
    cells = _timetables(spark, d)
    found = schema.table_layouts(cells, _depth(cells), "venue_id", TODAY)
    columns = F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["col_no"].cast("string"), F.coalesce(c["slot"], F.lit("")))), ",")
    return found.select("venue_id", "layout", "date_col", "label_col", columns.alias("columns"))


@query(f"WITH {GRID} SELECT venue_id, CASE WHEN venue_id % 4 < 2 THEN day ELSE DATE '{TODAY}' END AS day, slot, time FROM grid WHERE venue_id % 4 < 2 OR k = 1")
def layout_cells(spark, d):
    cells = _timetables(spark, d)
    layouts = stored(schema.table_layouts(cells, _depth(cells), "venue_id", TODAY), "timetable-layouts")
    return extract.extract(cells, layouts, "venue_id", TODAY).select("venue_id", "day", "slot", "time")


def _headed(spark, d) -> DataFrame:
    """Tables of venue_id % 3 rows without times above rows with times."""
    days = _days(spark, d).withColumn("h", (F.col("venue_id") % 3).cast("int"))
    body = days.select("venue_id", (F.col("k") + F.col("h") - 1).alias("row_no"), F.date_format("day", "HH:mm").alias("text"))
    head = days.filter("k = 1 and h > 0").select("venue_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row_no"), F.lit("x").alias("text"))
    return body.unionByName(head).select("venue_id", F.lit(0).alias("table_no"), "row_no", F.lit(0).alias("col_no"), "text")


@query(f"WITH {GRID} SELECT venue_id, CASE WHEN venue_id % 5 = 0 THEN 4 WHEN venue_id % 7 = 0 THEN 1 ELSE greatest(venue_id % 3, 1) END AS depth FROM days GROUP BY venue_id")
def header_depth(spark, d):
    cells = _headed(spark, d)
    tables = cells.select("venue_id", "table_no").distinct().withColumn("thead_rows", F.expr("if(venue_id % 5 = 0, 4, 0)"))
    rows = cells.select("venue_id", "table_no", "row_no").distinct().withColumn("heading", F.expr("venue_id % 7 = 0 and row_no = 0"))
    # a table of one row that is all headings has a header of one row
    return grids.header_depth(tables, rows, cells, "venue_id").select("venue_id", "depth")


@query(f"WITH {GRID} SELECT venue_id, CAST(venue_id % 3 AS INT) AS timeless, CAST(count(*) + venue_id % 3 AS INT) AS rows FROM days GROUP BY venue_id")
def leading_run(spark, d):
    return grids.leading_run(_headed(spark, d), "venue_id").select("venue_id", F.col("timeless").cast("int").alias("timeless"), F.col("rows").cast("int").alias("rows"))


@query("SELECT c_custkey AS venue_id, col_no, CASE WHEN c_custkey % 2 = 0 THEN top ELSE whole END AS header FROM customer, (VALUES (0, 'Date', 'Date'), (1, 'Asr', 'Asr Begins'), (2, 'Asr', 'Asr Jamaat'), (3, '', 'Note')) v(col_no, top, whole)")
def combined_header(spark, d):
    texts = F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), F.lit(t).alias("text")) for r, line in enumerate((("Date", "Asr", "Asr", ""), ("Date", "Begins", "Jamaat", "Note"))) for c, t in enumerate(line)])
    cells = A.venue(spark, d).select("venue_id", F.lit(0).alias("table_no"), F.explode(texts).alias("c")).select("venue_id", "table_no", "c.*")
    depth = A.venue(spark, d).select("venue_id", F.lit(0).alias("table_no"), (1 + F.col("venue_id") % 2).cast("int").alias("depth"))
    return grids.combined_header(cells, depth, "venue_id").select("venue_id", "col_no", "header")


@query(f"""WITH {GRID}, m AS (SELECT *, CAST(1 + (venue_id + j) % 12 AS INT) AS month FROM grid, (VALUES (0), (1)) x(j)), f AS (SELECT venue_id, slot, time, TRY_CAST(printf('%04d-%02d-%02d', CASE WHEN month >= 3 THEN 2024 ELSE 2025 END, month, dayofmonth(day)) AS DATE) AS day FROM m)
  SELECT venue_id, day, slot, time FROM f WHERE day IS NOT NULL""")
def month_sections(spark, d):
    """Two months in one table, each below a row with its name."""
    last = Window.partitionBy("venue_id")
    both = _days(spark, d).withColumn("n", F.count("*").over(last)).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("j") * (F.col("n") + 2))
    name = F.get(F.array(*[F.lit(m.title()) for m in S.MONTHS]), ((F.col("venue_id") + F.col("j")) % 12).cast("int"))
    at, row, none = F.col("at"), F.col("at") + 1 + F.col("k"), F.array().cast("array<struct<row_no:int,col_no:int,text:string>>")
    top = F.array(*[_cell(at, c, name) for c in range(6)], _cell(at + 1, 0, "Day"), *[_cell(at + 1, i + 1, n) for i, (n, _) in enumerate(NAMES)])
    cells = _put(both, F.when(F.col("k") == 1, top).otherwise(none), F.array(_cell(row, 0, F.dayofmonth("day").cast("string")), *[_cell(row, i + 1, x) for i, x in enumerate(_day_times())]))
    captions = cells.groupBy("venue_id", "table_no").agg(F.lit(None).cast("string").alias("caption"))
    sections = stored(grids.month_sections(cells, captions, "venue_id"), "timetable-sections")
    return extract.month_sections(sections, schema.section_layouts(sections, "venue_id", "2024-03-01"), "venue_id", "2024-03-01").select("venue_id", "day", "slot", "time")


@query(f"WITH {OCC} SELECT venue_id, count(DISTINCT slot) AS slots FROM occ GROUP BY 1")
def slots_in_text(spark, d):
    word = F.initcap("slot")
    texts = A.occurrence(spark, d).groupBy("venue_id").agg(F.concat(F.lit("Times of "), F.array_join(F.collect_list(word), ", 5:00 ")).alias("text"))
    return evidence.slots_in_text(texts, "venue_id")


@query(f"""WITH {GRID}, c AS (SELECT venue_id, day, slot, i, time FROM grid)
  SELECT venue_id, day, slot, 'begin' AS kind, time, NULL AS "offset" FROM c UNION ALL SELECT venue_id, day, slot, 'jamaah', CASE WHEN i % 2 = 0 THEN time END, CASE WHEN i % 2 = 1 THEN 10 END FROM c""")
def calendar_cells(spark, d):
    """A month's calendar as JSON: lists of six times with sunrise, and of five times or offsets."""
    days = _grid(_days(spark, d)).groupBy("venue_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "time"))), lambda x: x["time"]).alias("t"))
    six = F.concat(F.slice("t", 1, 1), F.array(F.lit("06:59")), F.slice("t", 2, 4))
    five = F.transform("t", lambda x, i: F.when(i % 2 == 0, x).otherwise("+10"))
    month = lambda c: F.array(F.map_from_entries(F.collect_list(F.struct(F.dayofmonth("day").cast("string"), c))))
    payload = days.groupBy("venue_id").agg(month(six).alias("calendar"), month(five).alias("iqamaCalendar")).select("venue_id", F.to_json(F.struct("calendar", "iqamaCalendar")).alias("json"))
    return extract.calendar_cells(payload, "venue_id", 2024, 1).select("venue_id", "day", "slot", "kind", "time", "offset")


@query(f"""WITH {GRID}, v AS (SELECT DISTINCT venue_id FROM days), f AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT venue_id, day, slot, 'begin' AS kind, time FROM grid UNION ALL SELECT venue_id, day, slot, 'jamaah', time FROM grid WHERE slot = 'asr'
  UNION ALL SELECT venue_id, day, 'jumuah', 'begin', '13:15' FROM v, f WHERE isodow(day) = 5 UNION ALL SELECT venue_id, day, 'jumuah', 'jamaah', '13:45' FROM v, f WHERE isodow(day) = 5""")
def timings_cells(spark, d):
    """A year of day rows as JSON, with the primary of two weekly sessions."""
    fields = {"fajr": "fajr", "dhuhr": "zuhr", "asr": "asr", "maghrib": "maghrib", "isha": "isha"}
    pick = lambda s: F.max(F.when(F.lower("name") == s, F.col("time")))
    day = _grid(_days(spark, d)).groupBy("venue_id", "day").agg(*[pick(s).alias(f) for s, f in fields.items()], pick("asr").alias("iqamah_Asr"))
    row = F.struct(F.dayofmonth("day").alias("day"), F.month("day").alias("month"), *fields.values(), "iqamah_Asr")
    week = F.array(*[F.struct(F.lit(t).alias("time"), F.lit(q).alias("iqamahTime"), F.lit(p).alias("isPrimary")) for t, q, p in (("12:30", "12:45", False), ("1:15", "1:45", True))])
    model = day.groupBy("venue_id").agg(F.collect_list(row).alias("salahTimings")).withColumn("jumahSalahIqamahTimings", week)
    payload = model.select("venue_id", F.to_json(F.struct(F.struct("salahTimings", "jumahSalahIqamahTimings").alias("model"))).alias("json"))
    return extract.timings_cells(payload, "venue_id", 2024).select("venue_id", "day", "slot", "kind", "time")


@query("""SELECT o_orderkey, 1 + o_orderkey % 12 AS month, CASE WHEN 1 + o_orderkey % 12 >= 6 THEN 2026 ELSE 2027 END AS year, (o_orderkey % 6) || CASE o_orderkey % 6 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END || ' Jumu''ah' AS label,
  CASE o_orderkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'pdf' END AS media, CASE o_orderkey % 5 WHEN 2 THEN 'mawaqit' WHEN 3 THEN 'mylocalmasjid' END AS provider, o_orderkey % 3 < 2 AS fresh,
  least(1.0, 0.5 + 0.1 * least(o_orderkey % 7, 5) - CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 0.2 END) AS confidence FROM orders""")
def page_scalars(spark, d):
    """The small column functions of pages."""
    key = F.col("o_orderkey")
    of = lambda n, *texts: F.get(F.array(*map(F.lit, texts)), (key % n).cast("int"))
    month = S.month_from_text(F.concat(of(12, *(m.title() if k % 2 else m[:3].upper() for k, m in enumerate(S.MONTHS))), F.when(key % 2 == 0, " 2026").otherwise("")))
    url = of(5, "https://x.example/a.PDF?x=1", "/b.jpeg", "https://mawaqit.net/?wpdmdl=3", "//my-masjid.com/screen/1", "https://x.example/")
    return A.table(spark, d, "orders").select(
        "o_orderkey", month.cast("long").alias("month"), S.year_for_month(month, F.lit("2026-06-15").cast("date")).alias("year"), S.ordinal_label((key % 6)).alias("label"), S.media_kind(url).alias("media"), S.provider_hint(url).alias("provider"),
        S.none_match(F.lit('"a"'), of(3, '"b", "a"', "*", '"c"')).alias("fresh"), S.table_confidence((key % 7).cast("int"), key % 2 == 0).alias("confidence"),
    )


# every signal of a page from an order's key, in the notation that both engines read
_SIGNS = {
    "text": "CASE k % 6 WHEN 0 THEN 'Coming soon' WHEN 1 THEN 'This domain is parked' WHEN 2 THEN 'hi' WHEN 3 THEN 'Please book a table at our restaurant in the old town' ELSE 'plain words that are longer than forty characters are here' END",
    "url": "CASE WHEN k % 4 = 0 THEN 'https://x.example/Prayer' ELSE 'https://x.example/' END", "timed_tables": "CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END", "named_tables": "CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END",
    "table_times": "CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END", "widgets": "CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END", "iframes": "CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END", "navs": "CASE WHEN k % 41 = 0 THEN 1 ELSE 0 END",
    "timetable_media": "CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END", "media": "CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END", "pdfs": "CASE WHEN k % 15 = 0 THEN 1 ELSE 0 END", "js_marks": "CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END",
    "slots_in_text": "CASE WHEN k % 11 = 0 THEN 2 ELSE 0 END", "clocks": "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END", "prayer_links": "CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END", "apps": "CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END",
}
_CLASS = """CASE WHEN timed_tables > 0 THEN 'structured_html' WHEN widgets + iframes + navs > 0 THEN 'iframe_or_widget' WHEN timetable_media > 0 THEN 'media_only' WHEN js_marks > 0 AND (named_tables > 0 OR slots_in_text >= 2 OR contains(url, 'Prayer')) THEN 'js_shell'
  WHEN (named_tables > 0 OR slots_in_text >= 2) AND (table_times > 0 OR clocks > 0) THEN 'structured_html' WHEN named_tables > 0 OR slots_in_text >= 2 THEN 'daily_widget' WHEN prayer_links > 0 THEN 'unknown' WHEN k % 6 = 0 THEN 'under_construction' WHEN k % 6 = 1 THEN 'parked_or_spam'
  WHEN k % 6 = 2 AND media > 0 THEN 'media_only' WHEN k % 6 = 2 AND apps + js_marks > 0 THEN 'js_shell' WHEN k % 6 = 2 THEN 'empty' WHEN k % 6 = 3 THEN 'irrelevant' ELSE 'unknown' END"""
_CLASSED = f"s AS (SELECT o_orderkey AS k, o_custkey AS venue_id, {', '.join(f'{v} AS {c}' for c, v in _SIGNS.items()).replace('k %', 'o_orderkey %')} FROM orders), c AS (SELECT *, {_CLASS} AS page_class FROM s)"


def _signs(spark, d) -> DataFrame:
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("venue_id"))
    return rows.select("*", *[F.expr(v).alias(c) for c, v in _SIGNS.items()])


@query(f"WITH {_CLASSED} SELECT k, page_class FROM c")
def page_class_rules(spark, d):
    return evidence.classify(_signs(spark, d)).select("k", "page_class")


@query(f"""WITH {_CLASSED}, e AS (SELECT k // 2 AS site, CASE WHEN pdfs + timetable_media + widgets + iframes + navs + named_tables + js_marks > 0 THEN NULL WHEN page_class = 'under_construction' THEN 1 WHEN page_class = 'parked_or_spam' THEN 2 WHEN page_class = 'irrelevant' THEN 3 WHEN page_class = 'empty' THEN 4 END AS w FROM c)
  SELECT site, CASE WHEN count(w) = count(*) THEN ['under_construction', 'parked_or_spam', 'irrelevant', 'empty'][min(w)] END AS verdict, CASE WHEN count(w) = count(*) THEN ['under_construction', 'parked_or_spam', 'wrong_site', 'empty_page'][min(w)] END AS status FROM e GROUP BY 1""")
def terminal_rules(spark, d):
    """Verdicts over sites of two pages."""
    return evidence.terminal_verdict(evidence.classify(_signs(spark, d).withColumn("site", F.expr("k div 2"))), "site")


@query(f"WITH {_CLASSED} SELECT venue_id, sum(clocks) AS time_count, sum(table_times) AS table_time_count, sum(widgets) > 0 AS has_widget, sum(media) > 0 AS has_media, sum(clocks) + sum(table_times) + sum(widgets) + sum(media) > 0 AS has_times FROM c GROUP BY 1")
def input_signal(spark, d):
    return evidence.input_signal(_signs(spark, d), "venue_id")


@query("""WITH f AS (SELECT o_orderkey, ['zero_rows', 'fetch_empty', 'invalid_json'][1 + o_orderkey % 3] AS failure, ['table_choice', 'media', 'unknown', 'terminal'][1 + o_orderkey % 4] AS kind FROM orders)
  SELECT o_orderkey, CASE WHEN failure = 'zero_rows' AND kind IN ('table_choice', 'unknown') THEN 'table_repair' WHEN failure = 'fetch_empty' THEN 'terminal' ELSE kind END AS next FROM f""")
def next_kind(spark, d):
    of = lambda n, *texts: F.get(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % n).cast("int"))
    rows = A.table(spark, d, "orders")
    return rows.select("o_orderkey", evidence.next_kind(of(3, "zero_rows", "fetch_empty", "invalid_json"), of(4, "table_choice", "media", "unknown", "terminal")).alias("next"))


@query("SELECT coalesce(a.o_orderkey, b.l_orderkey) AS source_id, coalesce('rendered ' || b.n, a.o_orderstatus) AS body FROM (SELECT o_orderkey, o_orderstatus FROM orders) a FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) b ON o_orderkey = l_orderkey")
def overlay_pages(spark, d):
    static = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("body"))
    rendered = A.table(spark, d, "lineitem").filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.concat(F.lit("rendered "), F.count("*").cast("string")).alias("body"))
    return evidence.overlay(static, rendered, "source_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) <= 4")
def capped_media(spark, d):
    """At most four candidates a source: the limit is the feature."""
    rows = A.table(spark, d, "lineitem")
    return evidence.capped(rows, ["l_orderkey"], [F.desc("l_quantity"), "l_linenumber"], 4).select("l_orderkey", "l_linenumber")


@query()
def page_class(spark, d):
    return evidence.page_evidence(A.table(spark, d, "pages"), "page_id", 2026).select("page_id", "page_class")


@query()
def terminal_verdict(spark, d):
    """Of every host, over all its pages."""
    found = evidence.page_evidence(A.table(spark, d, "pages"), "page_id", 2026).withColumn("host", S.url_host(F.col("url")))
    return evidence.terminal_verdict(found, "host")


@query()
def page_evidence(spark, d):
    found = evidence.page_evidence(A.table(spark, d, "pages"), "page_id", 2026)
    return found.select("page_id", "title", "score", "needs_render", "slots_in_text", "clocks", "media", "widgets", "navs", "prayer_links", "apps", "page_class", F.array_join("terminal_hints", ",").alias("terminal_hints"))


@query(f"WITH {GRID} SELECT venue_id AS source_id, 'auto_accept' AS lane, 'authored' AS status, 'jumuah_missing,partial_horizon' AS flags, count(*) AS rows FROM grid WHERE day BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 60 GROUP BY 1")
def evaluate_sources(spark, d):
    """From a page of each venue, a table of its days, to rows and a verdict."""
    row = _days(spark, d).select("venue_id", "k", F.concat(F.lit("<tr><td>"), F.date_format("day", "d MMMM"), *[x for t in _day_times() for x in (F.lit("<td>"), t)]).alias("tr"))
    head = "<table><tr><th>Date" + "".join(f"<th>{n}" for n, _ in NAMES)
    page = row.groupBy("venue_id").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tr"))), lambda x: x["tr"]), ""), F.lit("</table>")).alias("html"))
    start = F.lit(TODAY).cast("date")
    page = spread(stored(page, "venue-pages"))
    docs = page.select(F.col("venue_id").alias("source_id"), F.lit(0).alias("idx"), F.year(start).alias("year"), F.month(start).alias("month"), "html")
    source = page.select(F.col("venue_id").alias("source_id"), F.lit("html_table").alias("shape"))
    items = stored(html.page_items(page, "venue_id"), "venue-items")
    cells = html.cells_of(items, "venue_id")
    tables = items.filter("kind = 'table'").select("venue_id", F.col("n").alias("table_no"), F.col("row").alias("thead_rows"))
    rows = items.filter("kind = 'row'").select("venue_id", F.col("n").alias("table_no"), F.col("row").alias("row_no"), F.col("flag").alias("heading"))
    depth = stored(grids.header_depth(tables, rows, cells, "venue_id"), "venue-headers")
    layout = schema.table_layouts(cells, depth, "venue_id", TODAY).withColumnRenamed("venue_id", "source_id")
    session = spark.createDataFrame([], f"source_id {source.schema['source_id'].dataType.simpleString()}, idx int, label string, text string, season string")
    of_doc = cells.withColumn("doc", F.struct(F.col("venue_id").alias("source_id"), F.lit(0).alias("idx"))).drop("venue_id")
    made, verdicts = evaluate.evaluate(source, docs, layout, session, TODAY, 60, cells=of_doc)
    counts = made.groupBy("source_id").agg(F.count("*").alias("rows"))
    return verdicts.join(counts, "source_id").select("source_id", "lane", "status", F.array_join("flags", ",").alias("flags"), "rows")
