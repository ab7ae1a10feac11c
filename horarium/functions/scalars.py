"""Scalar functions as native column expressions.

The parsers match each rule once a row: the parts of the matches are bound to a
variable (`bind`), from which the value is chosen.  Bound expressions are
evaluated in the JVM outside the generated code; all others are part of it.
The few functions that Spark cannot express are in `pyudfs`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The daily slots in their order of the day, and the weekly one.
DAILY = ("fajr", "dhuhr", "asr", "maghrib", "isha")
WEEKLY = "jumuah"

# Month and weekday names as dates spell them.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

# A clock time as pages write it.
_CLOCK = r"([0-9]{1,2})\s*[:.٫]\s*([0-9]{2})\s*([ap]\.?m\.?)?"


def ascii_digits(text: Column) -> Column:
    """Arabic-Indic and extended Arabic-Indic digits as 0-9."""
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def clean(text: Column) -> Column:
    return F.lower(F.trim(ascii_digits(text)))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is evaluated once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def given(value: Column) -> Column:
    """A generator of the value, for select: rows where it is null go, and later filters do not compute it anew."""
    return F.explode(F.array_compact(F.array(value)))


def clock(hour: Column, minute: Column, mark: Column, prefer_pm: Column | None) -> Column:
    """HH:MM of matched parts, null if out of range."""
    hh, mm, m = hour.cast("int"), minute.cast("int"), F.substring(mark, 1, 1)
    pm = prefer_pm if prefer_pm is not None else F.lit(None).cast("boolean")
    hh = (
        F.when(m == "p", F.when(hh == 12, hh).otherwise(hh + 12))
        .when(m == "a", F.when(hh == 12, 0).otherwise(hh))
        .when(pm & hh.between(1, 11), hh + 12)
        .when(~pm & (hh == 12), 0)
        .otherwise(hh)
    )
    return F.when((mm <= 59) & (hh <= 23), F.format_string("%02d:%02d", hh, mm))


def _clock_parts(text: Column) -> Column:
    """Hour, minute and half-day mark of the first clock time."""
    part = [F.nullif(F.regexp_extract(text, _CLOCK, k), F.lit("")).alias(n) for k, n in ((1, "h"), (2, "m"))]
    return F.struct(*part, F.regexp_extract(text, _CLOCK, 3).alias("mark"))


def parse_time(text: Column, prefer_pm: Column | None = None) -> Column:
    """The first clock time in a text as HH:MM; a bad first hit gives null, later ones are not tried."""
    return bind(_clock_parts(clean(text)), lambda x: clock(x["h"], x["m"], x["mark"], prefer_pm))


def parse_times(text: Column, prefer_pm: Column | None = None) -> Column:
    """All valid clock times in order, duplicates kept."""
    hits = F.transform(F.regexp_extract_all(clean(text), F.lit(_CLOCK), F.lit(0)), _clock_parts)
    return F.filter(F.transform(hits, lambda x: clock(x["h"], x["m"], x["mark"], prefer_pm)), lambda x: x.isNotNull())


def time_values(text: Column) -> Column:
    """Every reading of every clock time in a text, distinct."""
    hits = F.array_distinct(F.transform(F.regexp_extract_all(clean(text), F.lit(_CLOCK), F.lit(0)), _clock_parts))
    modes = (None, F.lit(True), F.lit(False))
    read = F.flatten(F.transform(hits, lambda x: F.array(*[clock(x["h"], x["m"], x["mark"], pm) for pm in modes])))
    return F.array_distinct(F.array_compact(read))


def parse_offset(text: Column) -> Column:
    """Minutes of a text that is nothing but a signed or united number."""
    rule = r"^([+\-–−]?)\s*([0-9]{1,3})\s*(m|min|mins|minute|minutes)?\.?$"
    t = clean(text)
    sign, number, unit = (F.regexp_extract(t, rule, k) for k in (1, 2, 3))
    value = F.nullif(number, F.lit("")).cast("int")
    return F.when((sign != "") | (unit != ""), F.when(sign.isin("-", "–", "−"), -value).otherwise(value))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    first = F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(year, month, F.lit(1)))
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def month_number(name: Column, short: bool = True) -> Column:
    """1-12 of a full or three-letter month name, else null."""
    found = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    if short:
        found = F.when(found > 0, found).otherwise(F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name))
    return F.when(found > 0, found).cast("int")


def month_from_text(text: Column) -> Column:
    """Month of a text that is a month name, with a year or without."""
    return month_number(F.regexp_extract(clean(text), r"^([a-z]+)(?:\s+[0-9]{4})?$", 1))


# The forms of a date, in the order in which they are tried.
_ISO = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
_DAY_MONTH = r"\b([0-9]{1,2})[/.\-]([0-9]{1,2})(?:[/.\-]([0-9]{2,4}))?\b"
_DAY_WORD = r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,})\b"
_WORD_DAY = r"\b([a-z]{3,})\s+([0-9]{1,2})(?:st|nd|rd|th)?\b"
_WEEK = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?"
_BARE = (r"^([0-9]{1,2})(?:st|nd|rd|th)?$", rf"^{_WEEK}\s+([0-9]{{1,2}})(?:st|nd|rd|th)?$", rf"^([0-9]{{1,2}})(?:st|nd|rd|th)?\s*{_WEEK}$")


def parse_date(text: Column, year: Column, month: Column | None = None) -> Column:
    """A date by ordered rules; a numeric hit decides even if there is no such day.

    yyyy-mm-dd; d/m[/y]; d month; month d; and with a month in context a bare
    day, "weekday d" and "d weekday".  Only the first hit of a rule counts.
    """
    t = clean(text)
    # one match a rule; its parts are read off the short hit
    hit = lambda rule, name, k=0: F.nullif(F.regexp_extract(t, rule, k), F.lit("")).alias(name)
    parts = [hit(_ISO, "iso"), F.split(hit(_DAY_MONTH, "dm"), r"[/.\-]").alias("dm"), hit(_DAY_WORD, "dw"), hit(_WORD_DAY, "wd"), year.alias("year")]
    if month is not None:
        parts += [month.alias("month"), F.coalesce(*[hit(rule, "bare", 1) for rule in _BARE]).alias("bare")]

    def chosen(x: Column) -> Column:
        ymd = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
        number, word = (lambda c: F.regexp_extract(c, "[0-9]+", 0)), (lambda c: F.regexp_extract(c, "[a-z]{3,}", 0))
        y = F.try_element_at(x["dm"], F.lit(3)).cast("int")
        day_word = F.regexp_extract(x["dw"], "[a-z]+$", 0)
        first, second = month_number(day_word), month_number(word(x["wd"]))
        chain = (
            F.when(x["iso"].isNotNull(), ymd(F.substring(x["iso"], 1, 4), F.substring(x["iso"], 6, 2), F.substring(x["iso"], 9, 2)))
            .when(x["dm"].isNotNull(), ymd(F.when(y < 100, y + 2000).otherwise(F.coalesce(y, x["year"])), x["dm"][1], x["dm"][0]))
            .when(first.isNotNull(), ymd(x["year"], first, number(x["dw"])))
        )
        if month is not None:
            chain = chain.when(x["month"].isNotNull() & day_word.rlike(f"^{_WEEK}$"), ymd(x["year"], x["month"], number(x["dw"])))
        chain = chain.when(second.isNotNull(), ymd(x["year"], second, number(x["wd"])))
        if month is not None:
            chain = chain.when(x["month"].isNotNull() & x["bare"].isNotNull(), ymd(x["year"], x["month"], x["bare"]))
        return chain

    return bind(bind(F.struct(*parts), chosen), lambda d: day_of(d["y"], d["m"], d["d"]))


def minutes(hhmm: Column) -> Column:
    """Minutes after midnight of HH:MM."""
    return F.substring(hhmm, 1, 2).cast("int") * 60 + F.substring(hhmm, 4, 2).cast("int")


def apply_offset(hhmm: Column, offset: Column) -> Column:
    """HH:MM moved by minutes; null outside the day."""
    m = minutes(hhmm) + offset
    return F.when(m.between(0, 1439), F.concat(F.lpad(F.floor(m / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("int").cast("string"), 2, "0")))


def horizon_months(today: Column, days: int) -> Column:
    """First days of the months from today's to the horizon's, in order."""
    return F.sequence(F.trunc(today, "MM"), F.trunc(F.date_add(today, days), "MM"), F.expr("interval 1 month"))


def horizon_days(today: Column, days: int) -> Column:
    return F.sequence(today, F.date_add(today, days))


def is_friday(day: Column) -> Column:
    return F.weekday(day) == 4


def season(day: Column) -> Column:
    return F.when(F.month(day).between(4, 9), "summer").otherwise("winter")


def year_for_month(month: Column, today: Column) -> Column:
    return F.when(month >= F.month(today), F.year(today)).otherwise(F.year(today) + 1)


def content_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, with or without a scheme; credentials and port dropped."""
    u = F.when(F.instr(url, "//") > 0, url).otherwise(F.concat(F.lit("//"), url))
    authority = F.regexp_extract(u, r"//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


# Words that point to a timetable page.
KEYWORDS = ("prayer", "timetable", "salah", "salat", "namaz", "jamaah", "iqamah", "times")

# Words that a timetable's image or file has in its name.
MEDIA_HINTS = ("prayer", "timetable", "time-table", "time table", "salah", "salat", "namaz", "jamaat", "jamaah", "iqamah", "iqamat", "schedule")


def keyword_score(text: Column) -> Column:
    """Occurrences of each keyword, each counted on its own, plus 5 if there is a colon."""
    t = F.lower(text)
    found = sum((F.regexp_count(t, F.lit(k)) for k in KEYWORDS[1:]), F.regexp_count(t, F.lit(KEYWORDS[0])))
    return (found + F.when(F.contains(t, F.lit(":")), 5).otherwise(0)).cast("double")


def has_keyword(text: Column) -> Column:
    """Whether any keyword occurs."""
    t = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(t, F.lit(k)) for k in KEYWORDS))


def media_kind(url: Column) -> Column:
    """pdf or image by extension, pdf for a download endpoint, else null."""
    path = F.lower(F.regexp_extract(url, r"^([^?]*)", 1))
    return F.when(path.rlike(r"\.pdf$"), "pdf").when(path.rlike(r"\.(png|jpg|jpeg|webp)$"), "image").when(F.contains(F.lower(url), F.lit("wpdmdl=")), "pdf")


def media_score(text: Column) -> Column:
    """2 for each hint, 1 for a year 20xx, 1 for a month; 2 and more is a timetable."""
    t = F.lower(text)
    hints = sum((F.contains(t, F.lit(k)).cast("int") for k in MEDIA_HINTS[1:]), F.contains(t, F.lit(MEDIA_HINTS[0])).cast("int"))
    months = "|".join((*MONTHS, *(m[:3] for m in MONTHS), "sept"))
    return (2 * hints + t.rlike(r"\b20[0-9]{2}\b").cast("int") + t.rlike(rf"\b({months})\b").cast("int")).cast("double")


def assign_times(times: Column) -> Column:
    """(main, begin) of the distinct times of a slot: none, one, or latest and earliest."""
    t = F.array_distinct(times)
    return F.struct(F.array_max(t).alias("main"), F.when(F.size(t) >= 2, F.array_min(t)).alias("begin"))


# Failure classes with the phrases that tell them, in the order of the test.
FAILURES = (
    ("invalid_json", ("no json object", "not a json object")),
    ("lint", ("lint:",)),
    ("zero_rows", ("no occurrences produced",)),
    ("self_match", ("self-match failed",)),
    ("plausibility", ("out of window", "non-monotonic", "jumuah")),
    ("incomplete", ("incomplete", "missing")),
    ("fetch_empty", ("render failed", "empty body", "navigation produced no")),
    ("invalid_schema", ("invalid config", "validation error", "field required")),
)


def classify_failure(text: Column) -> Column:
    """Failure class of an error text; the first class with a phrase in it decides."""
    t, chain = F.lower(text), F
    for name, phrases in FAILURES:
        chain = chain.when(reduce(lambda a, b: a | b, (F.contains(t, F.lit(p)) for p in phrases)), name)
    return chain.otherwise("unknown")


def ordinal_label(k: Column) -> Column:
    return F.concat(k.cast("string"), F.when(k == 1, "st").when(k == 2, "nd").when(k == 3, "rd").otherwise("th"), F.lit(" Jumu'ah"))


def table_confidence(slots: Column, has_times: Column) -> Column:
    score = F.lit(0.5) + F.lit(0.1) * F.least(slots, F.lit(5)) - F.when(has_times, 0.0).otherwise(0.2)
    return F.least(F.lit(1.0), score.cast("double"))


def none_match(tags: Column, header: Column) -> Column:
    """If-None-Match: one of a comma list equals the tag, or a star."""
    given = F.transform(F.split(header, ","), lambda x: F.trim(x))
    return F.array_contains(given, tags) | F.array_contains(given, F.lit("*"))


# Providers of embedded timetables, in the order of the test, with what tells them.
PROVIDERS = (("mawaqit", ("mawaqit",)), ("masjidbox", ("masjidbox",)), ("mylocalmasjid", ("mylocalmasjid", "my-local-masjid", "my-masjid", "mymasjid")))


def provider_hint(url: Column) -> Column:
    """The first provider of embedded timetables that a URL names, else null."""
    u, chain = F.lower(url), F
    for name, marks in PROVIDERS:
        chain = chain.when(reduce(lambda a, b: a | b, (F.contains(u, F.lit(m)) for m in marks)), name)
    return chain
