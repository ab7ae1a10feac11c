"""What pages show of a timetable: one row of signals a page, its class, and verdicts over a host's pages.

`page_items` (sources.html) is grouped by table and then by page; every rule is
a column expression over the counts, so `classify` can be used on any relation
that has them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pyudfs import absolute_url, few, normalise_token, once, with_slots
from ..functions.scalars import PROVIDERS, keyword_score, media_kind, media_score, month_from_text, provider_hint
from ..sources.html import cells_of, page_items
from ..sources.scratch import stored
from .grids import header_depth
from .schema import table_evidence

# Phrases and marks that decide a page's class.
RENDER_TIMES = 5
CLOCK = r"\b[0-9]{1,2}[:.][0-9]{2}\b"
URL_HINTS = ("prayer", "salah", "namaz", "timetable", "time-table", "times")
LINK_HINTS = ("prayer", "timetable", "time-table", "salah", "salat", "namaz", "namaaz", "jamaah", "jamaat", "iqamah")
JS_MARKS = ("squarespace", "wixstatic", "wix.com", "data-reactroot", 'id="root"', "masjidbox", "my-masjid.com", "mawaqit.net")
APP_MARKS = ('id="app"', "id='app'", 'id="__next"', 'id="__nuxt"', 'id="q-app"', "ng-app", "ng-version", "app-root", "data-server-rendered")
CONSTRUCTION = (
    "under construction", "coming soon", "site coming soon", "website coming soon", "be right back", "under maintenance", "maintenance mode",
    "launching soon", "site is being built", "page is being built",
)
PARKED = (
    "domain is for sale", "buy this domain", "this domain is parked", "domain parking", "is for sale", "godaddy", "sedoparking", "namecheap parking",
    "casino", "online betting", "sports betting", "viagra", "payday loan", "porn", "xxx",
)
BUSINESS = (
    "restaurant", "our menu", "book a table", "reservation", "takeaway", "take away", "order online", "add to cart", "add to basket", "checkout",
    "free delivery", "estate agent", "for sale by", "car dealership", "law firm",
)
NEXT = ("›", "»", "→", "❯", "＞", ">", "next", "next month")
MEDIA_SCORE, EMPTY_CHARS, SELECT_MONTHS = 2.0, 40, 12
# Classes that end a search, in the order of their weight, with what is recorded.
TERMINAL = (("under_construction", "under_construction"), ("parked_or_spam", "parked_or_spam"), ("irrelevant", "wrong_site"), ("empty", "empty_page"))

# the columns that `classify` reads, with the value of a page that shows nothing
SIGNALS = {"text": "", "url": "", "named_tables": 0, "timed_tables": 0, "table_times": 0, "media": 0, "timetable_media": 0, "pdfs": 0, "iframes": 0, "widgets": 0, "navs": 0, "js_marks": 0, "prayer_links": 0, "slots_in_text": 0, "clocks": 0, "apps": 0}


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), p) for p in phrases]))


def slots_in_text(texts: DataFrame, key: str) -> DataFrame:
    """(key, slots): how many distinct slots the words of `text` name exactly."""
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ɏ']+"), F.lit(0)))).alias("word"))
    return with_slots(words, "word").filter("slot is not null").groupBy(key).agg(F.count_distinct("slot").alias("slots"))


def empty_grids(items: DataFrame, key: str) -> DataFrame:
    """(key, table_no) of tables whose first row names two slots and whose body has one row at most."""
    cells = cells_of(items, key)
    first = with_slots(cells.filter("row_no = 0"), "text").filter("slot is not null").groupBy(key, "table_no").agg(F.count("*").alias("slots"))
    data = items.filter("kind = 'row' AND col > 0").groupBy(key, F.col("n").alias("table_no")).agg(F.count_if(~F.col("flag")).alias("data"))
    return first.filter("slots >= 2").join(data.filter("data <= 1"), [key, "table_no"]).select(key, "table_no")


def month_navigation(items: DataFrame, key: str) -> DataFrame:
    """(key, nav): a page with the caption of a month and a select of its months, else a forward control."""
    leaf = items.filter("kind = 'leaf'")
    captions = leaf.filter(month_from_text(F.col("text")).isNotNull()).select(key).distinct()
    selects = items.filter("kind = 'option'").groupBy(key, "n").agg(F.count(month_from_text(F.col("text"))).alias("months")).filter(F.col("months") >= SELECT_MONTHS).select(key, F.lit(1).alias("rank"), F.lit("select").alias("nav"))
    # distinct texts go through Python once
    named = few(once(leaf.select(F.col("text").alias("__text")), normalise_token("__text"), lambda n: F.col("__text").isin(*NEXT) | n.isin(*NEXT), "plain"))
    forward = leaf.join(named, F.col("text") == F.col("__text"), "left_semi").select(key, F.lit(2).alias("rank"), F.lit("next").alias("nav"))
    return selects.unionByName(forward).join(captions, key, "left_semi").groupBy(key).agg(F.min_by("nav", "rank").alias("nav"))


def media_links(items: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, url, ordinal, media, text, score): links and then images of media files, the first of each absolute URL."""
    found = items.filter("kind in ('anchor', 'image')").withColumn("media", media_kind(F.col("link"))).filter("media is not null")
    place = F.struct((F.col("kind") == "image").alias("later"), "n")
    both = found.withColumn("place", place).join(pages.select(key, F.col("url").alias("base")), key).withColumn("target", absolute_url("base", "link"))
    one = both.groupBy(key, "target").agg(F.min_by(F.struct("media", "text"), "place").alias("f"), F.min("place").alias("ordinal"))
    return one.select(key, F.col("target").alias("url"), "ordinal", "f.media", "f.text", media_score(F.concat_ws(" ", "target", "f.text")).alias("score"))


def widget_hints(items: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, provider, url, confidence): the strongest sign of each provider; a frame, a link, a mark in the page."""
    linked = items.filter("kind in ('iframe', 'anchor')").join(pages.select(key, F.col("url").alias("base")), key).withColumn("target", absolute_url("base", "link"))
    linked = linked.select(key, provider_hint(F.col("target")).alias("provider"), F.col("target").alias("url"), F.when(F.col("kind") == "iframe", 0.9).otherwise(0.8).alias("confidence"), F.col("n").alias("at"))
    marks = F.array_compact(F.array(*[F.when(_any(F.col("low"), m), name) for name, m in PROVIDERS]))
    bare = pages.select(key, F.lower("html").alias("low")).select(key, F.explode(marks).alias("provider"), F.lit(None).cast("string").alias("url"), F.lit(0.5).alias("confidence"), F.lit(0).alias("at"))
    both = linked.filter("provider is not null").unionByName(bare)
    return both.groupBy(key, "provider").agg(F.max_by(F.struct("url", "confidence"), F.struct("confidence", -F.col("at"))).alias("b")).select(key, "provider", "b.*")


def needs_render() -> Column:
    """Whether a page looks relevant but shows too little without running its scripts (columns as in `classify`, and empty_grids)."""
    hint = _any(F.lower("url"), URL_HINTS) | (F.col("slots_in_text") >= 1)
    return F.when(F.col("clocks") >= RENDER_TIMES, False).when((F.col("empty_grids") > 0) | (F.col("slots_in_text") >= 2), True).otherwise((F.col("js_marks") > F.col("empty_grids")) & hint)


def classify(page: DataFrame) -> DataFrame:
    """`page` (SIGNALS) with page_class and terminal_hints: signs of a timetable first; an end only where there is no sign at all."""
    page = page.select("*", *[F.lit(v).alias(c) for c, v in SIGNALS.items() if c not in page.columns])
    # a column of its own: it is read for every phrase
    page, low, c = page.withColumn("__low", F.lower("text")), F.col("__low"), F.col
    prayers = (c("named_tables") > 0) | (c("slots_in_text") >= 2)
    times = (c("table_times") > 0) | (c("clocks") >= 1)
    construction, parked, business = (phrases_in(low, p) for p in (CONSTRUCTION, PARKED, BUSINESS))
    bare = F.length(F.trim("text")) < EMPTY_CHARS
    kind = (
        F.when(c("timed_tables") > 0, "structured_html").when((c("widgets") > 0) | (c("iframes") > 0) | (c("navs") > 0), "iframe_or_widget").when(c("timetable_media") > 0, "media_only")
        .when((c("js_marks") > 0) & (prayers | _any(F.lower("url"), URL_HINTS)), "js_shell").when(prayers & times, "structured_html").when(prayers, "daily_widget").when(c("prayer_links") > 0, "unknown")
        .when(F.size(construction) > 0, "under_construction").when(F.size(parked) > 0, "parked_or_spam")
        .when(bare & (c("media") > 0), "media_only").when(bare & ((c("apps") > 0) | (c("js_marks") > 0)), "js_shell").when(bare, "empty")
        .when(F.size(business) > 0, "irrelevant").otherwise("unknown")
    )
    page = page.withColumn("page_class", kind)
    hints = F.when(c("page_class") == "under_construction", construction).when(c("page_class") == "parked_or_spam", parked).when(c("page_class") == "irrelevant", business).otherwise(F.array().cast("array<string>"))
    return page.withColumn("terminal_hints", hints).drop("__low")


def page_evidence(pages: DataFrame, key: str, year: int, items: DataFrame | None = None) -> DataFrame:
    """One row a page (`pages`: key, url, html) with SIGNALS, title, score, needs_render, page_class and terminal_hints.

    `items` is `page_items(pages)`, where the caller keeps it.  It is read several
    times, so it is stored here otherwise: pages are parsed once.
    """
    items = stored(page_items(pages, key), "page-items") if items is None else items
    cells = cells_of(items, key)
    table = items.filter("kind = 'table'").select(key, F.col("n").alias("table_no"), F.col("row").alias("thead_rows"))
    depth = stored(header_depth(table, items.filter("kind = 'row'").select(key, F.col("n").alias("table_no"), F.col("row").alias("row_no"), F.col("flag").alias("heading")), cells, key), "page-headers")
    tables = table_evidence(cells, depth, key, year).groupBy(key).agg(F.count_if(F.size("prayers") > 0).alias("named_tables"), F.count_if((F.size("prayers") > 0) & (F.col("times") > 0)).alias("timed_tables"), F.sum("times").alias("table_times"))
    blob = F.lower(F.concat_ws(" ", "link", "text"))
    kind = lambda k: F.col("kind") == k
    # every page has a text; only texts and titles are sorted, the rest is counted
    told = items.filter("kind in ('text', 'title')").groupBy(key).agg(F.max(F.when(kind("text"), F.col("text"))).alias("text"), F.min_by("text", F.when(kind("title"), F.col("n"))).alias("title"))
    counted = items.groupBy(key).agg(
        F.count_if(kind("table")).alias("tables"), F.count_if(kind("iframe")).alias("iframes"),
        F.count_if(kind("anchor") & _any(blob, LINK_HINTS)).alias("prayer_links"), F.count_if(kind("script")).alias("scripts"),
    )
    flat = stored(told.join(counted, key), "page-counts")
    media = media_links(items, pages, key).groupBy(key).agg(F.count("*").alias("media"), F.count_if(F.col("score") >= MEDIA_SCORE).alias("timetable_media"), F.count_if(F.col("media") == "pdf").alias("pdfs"))
    widgets = widget_hints(items, pages, key).groupBy(key).agg(F.count("*").alias("widgets"))
    navs = month_navigation(items, key).groupBy(key).agg(F.count("*").alias("navs"))
    grids = empty_grids(items, key).groupBy(key).agg(F.count("*").alias("empty_grids"))
    named = slots_in_text(flat.select(key, "text"), key).withColumnRenamed("slots", "slots_in_text")
    # the page's source is read here and stays here: only counts go on
    low = F.col("__low")
    out = pages.select(key, "url", F.coalesce(F.lower("html"), F.lit("")).alias("__low")).select(key, "url", F.size(phrases_in(low, JS_MARKS)).alias("js_marks"), _any(low, APP_MARKS).cast("int").alias("apps"))
    for part in (flat, tables, media, widgets, navs, grids, named):
        out = out.join(part, key, "left")
    counts = ["tables", "iframes", "prayer_links", "scripts", "named_tables", "timed_tables", "table_times", "media", "timetable_media", "pdfs", "widgets", "navs", "empty_grids", "slots_in_text"]
    out = out.fillna(0, counts).fillna("", ["text", "url"])
    out = out.withColumn("clocks", F.regexp_count("text", F.lit(CLOCK))).withColumn("js_marks", F.col("js_marks") + F.least("empty_grids", F.lit(1)))
    out = out.withColumn("apps", F.col("scripts") + F.col("apps")).withColumn("score", keyword_score(F.col("text")))
    return classify(out.withColumn("needs_render", needs_render()))


def terminal_verdict(pages: DataFrame, by: str) -> DataFrame:
    """(by, verdict, status): the weightiest class, if every page of a group ends the search and none shows a sign; else null."""
    order = F.array(*[F.lit(c) for c, _ in TERMINAL])
    c = F.col
    sign = (c("pdfs") > 0) | (c("timetable_media") > 0) | (c("widgets") > 0) | (c("iframes") > 0) | (c("navs") > 0) | (c("named_tables") > 0) | (c("js_marks") > 0)
    both = pages.withColumn("weight", F.array_position(order, F.col("page_class"))).withColumn("ends", (F.col("weight") > 0) & ~sign)
    best = both.groupBy(by).agg(F.bool_and("ends").alias("all_end"), F.min("weight").alias("weight"))
    at = F.when(F.col("all_end"), F.col("weight").cast("int") - 1)
    return best.select(by, F.get(order, at).alias("verdict"), F.get(F.array(*[F.lit(s) for _, s in TERMINAL]), at).alias("status"))


def input_signal(pages: DataFrame, by: str) -> DataFrame:
    """(by, time_count, table_time_count, has_widget, has_media, has_times): what a group's pages give a reader."""
    out = pages.groupBy(by).agg(F.sum("clocks").alias("time_count"), F.sum("table_times").alias("table_time_count"), (F.sum("widgets") > 0).alias("has_widget"), (F.sum("media") > 0).alias("has_media"))
    return out.withColumn("has_times", (F.col("time_count") > 0) | (F.col("table_time_count") > 0) | F.col("has_widget") | F.col("has_media"))


def route(pages: DataFrame, by: str) -> DataFrame:
    """(by, kind): what to ask about a group's pages, by its strongest evidence."""
    per = pages.groupBy(by).agg(F.max("tables").alias("tables"), F.sum("timetable_media").alias("media"), F.sum("widgets").alias("widgets"), F.max(F.size("terminal_hints")).alias("ends"))
    kind = F.when(F.col("tables") > 1, "table_choice").when(F.col("tables") > 0, "table_repair").when(F.col("media") > 0, "media").when(F.col("widgets") > 0, "widget").when(F.col("ends") > 0, "terminal").otherwise("unknown")
    return per.select(by, kind.alias("kind"))


# Failures that point at a wrong table mapping, and the questions that they sharpen.
TABLE_FAILURES = ("zero_rows", "self_match", "plausibility", "lint", "incomplete", "invalid_schema")
TABLE_KINDS = ("table_repair", "table_choice", "unknown")


def next_kind(failure: Column, kind: Column) -> Column:
    """What to ask next after a failure."""
    return F.when(failure.isin(*TABLE_FAILURES) & kind.isin(*TABLE_KINDS), "table_repair").when(failure == "fetch_empty", "terminal").otherwise(kind)


def usable(fetch: DataFrame) -> DataFrame:
    """Fetches (error, html, status) without an error, with a body and a status below 400."""
    return fetch.filter("error is null and html is not null and html <> '' and status < 400")


def overlay(static: DataFrame, rendered: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, the columns of the right one, as far as they are given, win."""
    rest = [c for c in static.columns if c != key]
    both = static.alias("a").join(rendered.alias("b"), key, "full")
    return both.select(key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in rest])


def capped(ranked: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group: a limit that is the feature (tables, media and scripts that are considered)."""
    from pyspark.sql import Window

    return ranked.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= most).drop("__k")
