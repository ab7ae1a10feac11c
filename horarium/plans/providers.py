"""Plug-ins for the providers of timetables: which one knows a page, and how to read it.

A plug-in is a function from captured pages to matches (`MATCH`), for all pages at
once; it filters what it reads first, and all read the same stored elements.  A
page takes the match of the plug-in that was registered first.  Nothing is
fetched: what a plug-in would ask for is looked up among the captured documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pyudfs import absolute_url, json_object_after, resolve_tokens, with_slots
from ..functions.scalars import DAILY, minutes, ordinal_label, parse_time, url_host
from ..operators.grids import body, header_depth, month_sections
from ..operators.records import dom_matrix, dom_records
from ..operators.regions import WORD, month_controls
from ..operators.schema import MULTIDAY, section_layouts, table_layouts
from ..sources.elements import inside, page_elements
from ..sources.html import cells_of, page_items
from ..sources.scratch import stored

COLUMNS = "array<struct<col_no:int,selector:string,slot:string,kind:string>>"
MATCH = (
    f"source_id {{}}, platform string, shape string, url string, requires_js boolean, template string, nav string, table_no int, layout string, date_col int, label_col int, row_selector string, date_selector string, columns {COLUMNS}, sessions array<struct<label:string,time:string>>"
)
# Marks and addresses of the providers, and what their pages are read by.
FRAME_DOMAIN, FRAME_ROW, FRAME_DATE = "masjidbox.com", "div.prayer-day", ".d"
CALENDAR_MARKS = ("mawaqit.net", "confData")
SCREEN = r"(?i)my-masjid\.com/(?:timingscreen|embed|timing|screen|infoscreen|widget)/([A-Za-z0-9._-]+)"
SCREEN_API = "https://time.my-masjid.com/api/TimingsInfoScreen/GetMasjidTimings?GuidId="
TABLE_CLASSES = ("dpt_table", "prayer-times", "mptt-table")
PLUGIN_MARKS = ("daily-prayer-time-for-mosques", "timetable_params")
PLUGIN_URL = r"""timetable_params\s*=\s*\{[^}]*?["']ajaxurl["']\s*:\s*["']([^"']+)["']"""
PLUGIN_TABLE = "dptTimetable"
ENDPOINT_MARKS = ("admin-ajax.php", "/wp-json/")
ENDPOINT_URL = r"""['"](https?://[^'"]*?/admin-ajax\.php)['"]"""
ENDPOINT_PATH = "/wp-admin/admin-ajax.php"
ACTION = r"""(?s)(?=['"]?action)(?=(.{0,200}))['"]?action['"]?\s*[:=]\s*['"]([a-zA-Z0-9_]+)['"]"""
ACTION_HINTS = ("month", "timetable", "prayer", "calendar", "salah", "iqamah")
SCRIPT_HINTS = ("prayer", "timetable", "salah", "namaz", "masjid", "mosque", "dpt", "mptt", "calendar", "month", "iqamah")
RELATED = ("prayer", "salah", "salat", "namaz", "timetable", "iqamah", "jamaah")
MOST_SCRIPTS, LEAST_SLOTS = 4, 3
SESSION_TEXT, SESSION_TIME = 200, r"[0-9]{1,2}[:.][0-9]{2}"
SESSION_ORDINAL = r"(?i)\b([0-9](?:st|nd|rd|th)|first|second|third|fourth)\b"
SESSION_WINDOW = (720, 900)


@dataclass
class Pages:
    """Captured pages and what is known of them: `page` (source_id, url, html), `fetched` (url, html), the day of the run."""

    page: DataFrame
    fetched: DataFrame
    today: str
    elements: DataFrame = field(init=False)
    items: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.elements = stored(page_elements(self.page, "source_id"), "provider-elements")
        self.items = stored(page_items(self.page, "source_id"), "provider-items")


def match(rows: DataFrame, platform: str, shape: str, **given: Column) -> DataFrame:
    """Matches of `rows` (source_id, ...); what is not given is null."""
    fields = [x.split(" ", 1) for x in MATCH.format(rows.schema["source_id"].dataType.simpleString()).split(", ")]
    known = {"source_id": F.col("source_id"), "platform": F.lit(platform), "shape": F.lit(shape), "requires_js": F.lit(False)} | given
    return rows.select(*[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def _has(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return F.coalesce(out, F.lit(False))


def frames(pages: Pages) -> DataFrame:
    """A frame of a known domain, whose days are repeated elements."""
    found = pages.elements.filter("tag = 'iframe'").withColumn("src", F.try_element_at("attrs", F.lit("src"))).filter(F.contains("src", F.lit(FRAME_DOMAIN)))
    first = found.groupBy("source_id").agg(F.min_by("src", "el").alias("src")).join(pages.page.select("source_id", "url"), "source_id")
    columns = F.array(*[F.struct(F.lit(None).cast("int").alias("col_no"), F.lit(f".p-{s}").alias("selector"), F.lit(s).alias("slot"), F.lit("jamaah").alias("kind")) for s in DAILY])
    return match(first, "masjidbox", "html_repeated", url=absolute_url("url", "src"), requires_js=F.lit(True), row_selector=F.lit(FRAME_ROW), date_selector=F.lit(FRAME_DATE), columns=columns)


def calendar_payloads(page: DataFrame) -> DataFrame:
    """(source_id, json): the calendar object that a page carries; nothing else of the page travels on."""
    found = page.filter(_has(F.col("html"), CALENDAR_MARKS)).select("source_id", json_object_after(CALENDAR_MARKS[1])("html").alias("json"))
    return found.filter("json is not null and try_parse_json(json) is not null")


def calendars(pages: Pages) -> DataFrame:
    return match(calendar_payloads(pages.page).drop("json").join(pages.page.select("source_id", "url"), "source_id"), "mawaqit", "widget", url=F.col("url"))


def screens(pages: Pages) -> DataFrame:
    """A screen that loads its year from an API by the id in a reference to it."""
    named = pages.page.select("source_id", F.coalesce(F.nullif(F.regexp_extract("html", SCREEN, 1), F.lit("")), F.nullif(F.regexp_extract("url", SCREEN, 1), F.lit(""))).alias("guid"))
    return match(named.filter("guid is not null"), "mylocalmasjid", "widget", url=F.concat(F.lit(SCREEN_API), "guid"))


def _numbered_tables(elements: DataFrame) -> DataFrame:
    """Table elements with table_no, as the cells number them."""
    return elements.filter("tag = 'table'").withColumn("table_no", (F.row_number().over(Window.partitionBy("source_id").orderBy("el")) - 1).cast("int"))


def plugin_tables(pages: Pages) -> DataFrame:
    """The first table of a known class, if its first row names three daily slots exactly; bare days stand in its first column."""
    known = _numbered_tables(pages.elements).filter(_has(F.array_join("classes", " "), TABLE_CLASSES))
    table = known.groupBy("source_id").agg(F.min("el").alias("el"), F.min("table_no").alias("table_no"))
    row = inside(pages.elements.filter("tag = 'tr'"), table, "source_id").groupBy("source_id").agg(F.min("el").alias("el"))
    cells = inside(pages.elements.filter("tag in ('td', 'th')"), row, "source_id")
    cells = cells.withColumn("col_no", (F.row_number().over(Window.partitionBy("source_id").orderBy("el")) - 1).cast("int"))
    named = resolve_tokens(cells.select("source_id", "col_no", "text"), "text").filter(F.col("name").isin(*DAILY) & ~F.col("fuzzy"))
    first = named.groupBy("source_id", "name").agg(F.min("col_no").alias("col_no"))
    column = F.struct("col_no", F.lit(None).cast("string").alias("selector"), F.col("name").alias("slot"), F.lit("jamaah").alias("kind"))
    per = first.groupBy("source_id").agg(F.array_sort(F.collect_list(column)).alias("columns")).filter(F.size("columns") >= LEAST_SLOTS)
    both = per.join(table.select("source_id", "table_no"), "source_id").join(pages.page.select("source_id", "url"), "source_id")
    return match(both, "wp_prayer", "html_table", url=F.col("url"), table_no=F.col("table_no"), layout=F.lit(MULTIDAY), date_col=F.lit(0), columns=F.col("columns"))


def _template(address: Column, action: Column, display: str = "&display=table") -> Column:
    return F.concat(address, F.when(F.contains(address, F.lit("?")), "&").otherwise("?"), F.lit("action="), action, F.lit("&month={month}" + display))


def sample_layouts(sample: DataFrame, fetched: DataFrame, today: str, table_class: str | None = None) -> DataFrame:
    """`sample` (key, source_id, asked, ...) whose document was captured and whose first table (of a class) has days down its side, with table_no, date_col and columns."""
    got = stored(sample.join(fetched.select(F.col("url").alias("asked"), "html"), "asked").filter("html is not null and html <> ''"), "provider-samples")
    page = got.select(F.col("key").alias("source_id"), "html")
    tables = _numbered_tables(page_elements(page, "source_id"))
    tables = tables if table_class is None else tables.filter(F.array_contains("classes", table_class))
    first = tables.groupBy("source_id").agg(F.min("table_no").alias("table_no"))
    items = stored(page_items(page, "source_id"), "provider-sample-items")
    cells = stored(cells_of(items, "source_id").join(first, ["source_id", "table_no"], "left_semi"), "provider-sample-cells")
    heads = items.filter("kind = 'table'").select("source_id", F.col("n").alias("table_no"), F.col("row").alias("thead_rows")).join(first, ["source_id", "table_no"], "left_semi")
    rows = items.filter("kind = 'row'").select("source_id", F.col("n").alias("table_no"), F.col("row").alias("row_no"), F.col("flag").alias("heading"))
    found = table_layouts(cells, stored(header_depth(heads, rows, cells, "source_id"), "provider-sample-headers"), "source_id", today).filter(F.col("layout") == MULTIDAY)
    columns = F.transform("columns", lambda c: F.struct(c["col_no"].alias("col_no"), F.lit(None).cast("string").alias("selector"), c["slot"].alias("slot"), c["kind"].alias("kind")))
    return got.drop("html").join(found.select(F.col("source_id").alias("key"), "table_no", "date_col", columns.alias("columns")), "key")


def fixed_sessions(text: Column) -> Column:
    """Weekly sessions (label, time) named soon after the word for them: distinct times around midday, with the ordinal before each."""
    at = F.instr(F.lower(text), "jumu")
    window = F.when(at > 0, F.substring(text, at, F.lit(SESSION_TEXT))).otherwise("")
    parts, found = F.split(window, SESSION_TIME), F.regexp_extract_all(window, F.lit(SESSION_TIME), F.lit(0))
    read = F.transform(found, lambda t, i: F.struct(parse_time(t).alias("time"), F.nullif(F.regexp_extract(F.array_join(F.slice(parts, 1, i + 1), " "), f"(?s).*{SESSION_ORDINAL}", 1), F.lit("")).alias("ordinal"), i.alias("i")))
    bad = F.array_min(F.transform(F.filter(read, lambda x: x["time"].isNull()), lambda x: x["i"]))
    low, high = SESSION_WINDOW
    good = F.filter(read, lambda x: (bad.isNull() | (x["i"] < bad)) & minutes(x["time"]).between(low, high))
    times = F.transform(good, lambda x: x["time"])
    first = F.filter(good, lambda x, i: F.array_position(times, x["time"]) == i + 1)
    label = lambda x, k: F.coalesce(F.concat(x["ordinal"], F.lit(" Jumu'ah")), ordinal_label((k + 1).cast("int")))
    return F.transform(first, lambda x, k: F.struct(label(x, k).alias("label"), x["time"].alias("time")))


def plugin_months(pages: Pages) -> DataFrame:
    """A plug-in that shows one day and loads its months from an address."""
    known = pages.page.filter(_has(F.lower("html"), PLUGIN_MARKS))
    address = F.coalesce(F.replace(F.nullif(F.regexp_extract("html", PLUGIN_URL, 1), F.lit("")), F.lit("\\/"), F.lit("/")), absolute_url("url", F.lit(ENDPOINT_PATH)))
    made = known.select("source_id", F.col("source_id").alias("key"), "url", _template(address, F.lit("get_monthly_timetable")).alias("template")).filter("template not rlike '[{}].*[{}].*[{}]'")
    made = made.withColumn("asked", F.replace("template", F.lit("{month}"), F.month(F.lit(pages.today).cast("date")).cast("string")))
    found = sample_layouts(made, pages.fetched, pages.today, PLUGIN_TABLE)
    text = pages.items.filter("kind = 'text'").select("source_id", fixed_sessions(F.col("text")).alias("sessions"))
    both = found.join(text, "source_id", "left")
    return match(both, "wp_dpt", "html_table", url=F.col("url"), template=F.col("template"), table_no=F.col("table_no"), layout=F.lit(MULTIDAY), date_col=F.col("date_col"), columns=F.col("columns"), sessions=F.when(F.size("sessions") > 0, F.col("sessions")))


def _related(pages: Pages) -> DataFrame:
    """(source_id) of pages with a word of the trade, or two slots."""
    text = pages.items.filter("kind = 'text'").select("source_id", "text")
    words = text.select("source_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    slots = resolve_tokens(words, "word").filter(F.col("name").isNotNull() & ~F.col("fuzzy")).groupBy("source_id").agg(F.count_distinct("name").alias("slots")).filter("slots >= 2").select("source_id")
    return text.filter(_has(F.lower("text"), RELATED)).select("source_id").unionByName(slots).distinct()


def endpoint_months(pages: Pages) -> DataFrame:
    """An address that takes a month: actions that scripts name near a month, tried in order."""
    known = pages.page.filter(_has(F.col("html"), ENDPOINT_MARKS)).join(_related(pages), "source_id", "left_semi")
    address = F.coalesce(F.replace(F.nullif(F.regexp_extract("html", ENDPOINT_URL, 1), F.lit("")), F.lit("\\/"), F.lit("/")), F.when(F.contains("html", F.lit(ENDPOINT_MARKS[0])), absolute_url("url", F.lit(ENDPOINT_PATH))))
    known = stored(known.withColumn("address", address).filter("address is not null"), "provider-endpoints")
    scripts = pages.items.filter("kind = 'script'").join(known.select("source_id", "url"), "source_id").withColumn("src", absolute_url("url", "link"))
    scripts = scripts.filter((url_host(F.col("src")) == url_host(F.col("url"))) & _has(F.lower("src"), SCRIPT_HINTS)).groupBy("source_id", "src").agg(F.min("n").alias("n"))
    scripts = scripts.withColumn("blob_no", F.row_number().over(Window.partitionBy("source_id").orderBy("n"))).filter(F.col("blob_no") <= MOST_SCRIPTS)
    blob = known.select("source_id", F.lit(0).alias("blob_no"), F.col("html").alias("blob")).unionByName(scripts.join(pages.fetched, F.col("src") == pages.fetched["url"]).select("source_id", "blob_no", F.col("html").alias("blob")))
    near, names = F.regexp_extract_all("blob", F.lit(ACTION), F.lit(1)), F.regexp_extract_all("blob", F.lit(ACTION), F.lit(2))
    action = blob.select("source_id", "blob_no", F.posexplode(F.arrays_zip(near.alias("near"), names.alias("action"))).alias("i", "a")).filter(F.contains(F.lower("a.near"), F.lit("month")))
    order = F.struct("blob_no", (~_has(F.lower("a.action"), ACTION_HINTS)).alias("plain"), "i")
    action = action.groupBy("source_id", F.col("a.action").alias("action")).agg(F.min(order).alias("order"))
    tried = action.join(known.select("source_id", "url", "address"), "source_id").withColumn("display", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.lit("&display=table").alias("text")), F.struct(F.lit(1).alias("d"), F.lit("").alias("text")))))
    tried = tried.withColumn("template", F.concat(_template(F.col("address"), F.col("action"), ""), "display.text")).withColumn("asked", F.replace("template", F.lit("{month}"), F.lit("1")))
    found = sample_layouts(tried.withColumn("key", F.struct("source_id", "order", "display.d")).drop("display", "address"), pages.fetched, pages.today)
    first = found.groupBy("source_id").agg(F.min_by(F.struct("url", "template", "table_no", "date_col", "columns"), "key").alias("f")).select("source_id", "f.*")
    derived = match(first, "endpoint_month", "html_table", layout=F.lit(MULTIDAY), **{c: F.col(c) for c in ("url", "template", "table_no", "date_col", "columns")})
    return derived.unionByName(_by_select(pages).join(derived.select("source_id"), "source_id", "left_anti"))


def _table_matches(pages: Pages, cells: DataFrame, depth: DataFrame, platform: str, shape: str, only: str | None = None) -> DataFrame:
    """Matches of the first table of each page that a layout (or only this one) fits."""
    found = table_layouts(cells, depth, "source_id", pages.today)
    found = found if only is None else found.filter(F.col("layout") == only)
    fields = ("table_no", "layout", "date_col", "label_col", "columns")
    first = found.groupBy("source_id").agg(F.min_by(F.struct(*fields), "table_no").alias("f")).select("source_id", "f.*").join(pages.page.select("source_id", "url"), "source_id")
    columns = F.transform("columns", lambda c: F.struct(c["col_no"].alias("col_no"), F.lit(None).cast("string").alias("selector"), c["slot"].alias("slot"), c["kind"].alias("kind")))
    return match(first, platform, shape, **{c: F.col(c) for c in ("url", *fields[:-1])}, columns=columns)


def _page_tables(pages: Pages, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, depth) of the tables of pages."""
    items = pages.items if only is None else pages.items.join(only, "source_id", "left_semi")
    cells = stored(cells_of(items, "source_id"), "provider-cells")
    heads = items.filter("kind = 'table'").select("source_id", F.col("n").alias("table_no"), F.col("row").alias("thead_rows"))
    rows = items.filter("kind = 'row'").select("source_id", F.col("n").alias("table_no"), F.col("row").alias("row_no"), F.col("flag").alias("heading"))
    return cells, stored(header_depth(heads, rows, cells, "source_id"), "provider-headers")


def _by_select(pages: Pages) -> DataFrame:
    """Pages of one month with a select of months and a table of days: read by going through the select."""
    steered = stored(month_controls(pages.elements, "source_id").filter("kind = 'select'").select("source_id", F.col("selector").alias("nav")), "provider-selects")
    found = _table_matches(pages, *_page_tables(pages, steered), "endpoint_month", "html_table", MULTIDAY)
    return found.drop("nav").join(steered, "source_id").withColumn("requires_js", F.lit(True)).select(found.columns)


def generic_tables(pages: Pages) -> DataFrame:
    """Day rows below several months' names, else the first table that a layout fits."""
    cells, depth = _page_tables(pages)
    captions = pages.items.filter("kind = 'table'").select("source_id", F.col("n").alias("table_no"), F.col("text").alias("caption"))
    sections = stored(month_sections(cells, captions, "source_id"), "provider-sections")
    by_month = section_layouts(sections, "source_id", pages.today).join(pages.page.select("source_id", "url"), "source_id")
    columns = F.transform("columns", lambda c: F.struct(c["col_no"].alias("col_no"), F.lit(None).cast("string").alias("selector"), c["slot"].alias("slot"), c["kind"].alias("kind")))
    monthly = match(by_month, "generic_table", "html_table", url=F.col("url"), layout=F.lit("month_sections"), date_col=F.col("date_col"), columns=columns)
    rest = _table_matches(pages, cells, depth, "generic_table", "html_table")
    return monthly.unionByName(rest.join(monthly.select("source_id"), "source_id", "left_anti"))


def generic_grids(pages: Pages) -> DataFrame:
    """A grid of other elements that a layout fits; one whose body names slots in several columns is a stream of cards."""
    cells = stored(dom_matrix(pages.elements, "source_id"), "provider-grids")
    heads = cells.select("source_id", "table_no").distinct().withColumn("thead_rows", F.lit(0))
    rows = cells.select("source_id", "table_no", "row_no").distinct().withColumn("heading", F.lit(False))
    depth = stored(header_depth(heads, rows, cells, "source_id"), "provider-grid-headers")
    named = with_slots(body(cells, depth, "source_id"), "text").filter(F.col("slot").isin(*DAILY)).groupBy("source_id").agg(F.count_distinct("col_no").alias("n")).filter("n > 1")
    found = _table_matches(pages, cells, depth, "dom_grid", "dom_grid").join(named, "source_id", "left_anti")
    return found.withColumn("requires_js", F.lit(True))


def generic_streams(pages: Pages) -> DataFrame:
    """A stream of records of three daily slots; pages of several days also say how to reach other months."""
    day = F.lit(pages.today).cast("date")
    cell = dom_records(pages.elements, pages.page.select("source_id", F.year(day).alias("year"), F.month(day).alias("month")), "source_id", pages.today)
    per = cell.groupBy("source_id").agg(F.count_distinct(F.when(F.col("kind") == "jamaah", F.col("slot"))).alias("slots"), F.count_distinct("day").alias("days")).filter(F.col("slots") >= LEAST_SLOTS)
    steered = month_controls(pages.elements, "source_id").select("source_id", "selector")
    both = per.join(steered, "source_id", "left").join(pages.page.select("source_id", "url"), "source_id")
    return match(both, "dom_records", "dom_records", url=F.col("url"), requires_js=F.lit(True), nav=F.when(F.col("days") >= 2, F.col("selector")))


PlugIn = Callable[[Pages], DataFrame]
#: In the order of their right to a page.
REGISTRY: list[PlugIn] = [frames, calendars, screens, plugin_tables, plugin_months, endpoint_months, generic_tables, generic_grids, generic_streams]


def detect(page: DataFrame, fetched: DataFrame, today: str, registry: list[PlugIn] | None = None) -> DataFrame:
    """The match (MATCH) of each page (source_id, url, html) that a plug-in knows: that of the first."""
    pages = Pages(page, fetched, today)
    out = None
    for rank, plug_in in enumerate(REGISTRY if registry is None else registry):
        one = plug_in(pages).withColumn("rank", F.lit(rank))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no plug-in is registered")
    fields = [c for c in out.columns if c not in ("source_id", "rank")]
    best = out.groupBy("source_id").agg(F.min_by(F.struct(*fields), "rank").alias("m"))
    return best.select("source_id", "m.*")

