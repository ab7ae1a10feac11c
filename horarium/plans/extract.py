"""Slot cells of tables, by layout: (key, seq, day, slot, kind, time, offset, base_slot).

A layout table (from `operators.schema`, or written by hand) has key, table_no,
layout, date_col, label_col and columns (array of col_no, slot, kind,
value_kind, header and, optionally, time_index).  The long cells are joined to
the layouts of their tables once, and rows get their day or slot in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pyudfs import with_slots
from ..functions.readings import date_readings, readings, with_dates, with_readings
from ..functions.scalars import DAILY, day_of, given, parse_date, parse_offset, parse_time, parse_times, year_for_month
from ..operators.schema import LABELLED, MULTIDAY, SINGLE_DAY, TRANSPOSED

LAYOUTS = (MULTIDAY, TRANSPOSED, SINGLE_DAY, LABELLED)
_OUT = ["seq", "day", "slot", "kind", "time", "offset", "base_slot"]


def _columns(layout: DataFrame) -> Column:
    """The configured columns, with the same fields for every layout."""
    has_index = "time_index" in layout.schema["columns"].dataType.elementType.names
    return F.transform("columns", lambda c: F.struct(c["col_no"].cast("int").alias("col_no"), c["slot"].alias("slot"), c["kind"].alias("kind"), c["value_kind"].alias("value_kind"), (c["time_index"] if has_index else F.lit(None)).cast("int").alias("time_index")))


def read_values(cells: DataFrame) -> DataFrame:
    """What the distinct texts of cells say: the first time in the morning and after it, all of them in both, and an offset."""
    text, half = F.col("text"), {"early": F.lit(False), "late": F.lit(True)}
    one, all_ = {f"__{n}": parse_time(text, pm) for n, pm in half.items()}, {f"__all_{n}": F.nullif(parse_times(text, pm), F.array().cast("array<string>")) for n, pm in half.items()}
    return readings(cells, **one, **all_, __offset=parse_offset(text))


def with_values(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """`cells` (text, slot, value_kind, time_index) with time and offset; those without either are left out. `known` is `read_values` of these or more cells."""
    read = with_readings(cells, read_values(cells) if known is None else known)
    of = lambda name: F.when(F.col("slot") == "fajr", F.col(f"{name}early")).otherwise(F.col(f"{name}late"))
    offset = F.col("value_kind").eqNullSafe("offset")
    time = F.when(F.col("time_index").isNotNull(), F.get(of("__all_"), F.col("time_index"))).otherwise(of("__"))
    read = read.select(*cells.columns, F.when(~offset, time).alias("time"), F.when(offset, F.col("__offset")).alias("offset"))
    return read.filter("time is not null or offset is not null")


def _made(cells: DataFrame, key: str, known: DataFrame | None) -> DataFrame:
    return _shaped(with_values(cells, known), key)


def _shaped(cells: DataFrame, key: str, of: tuple[str, ...] = ()) -> DataFrame:
    return cells.withColumn("seq", F.struct("table_no", "row_no", "col_no")).withColumn("base_slot", F.col("slot")).select(key, *of, *_OUT)


def read_dates(cells: DataFrame, today: str, documents: DataFrame | None) -> DataFrame:
    """The days that the distinct texts of cells are, by month of `documents`; without these in the year of `today`, as `date`."""
    if documents is not None:
        return date_readings(cells, documents)
    return readings(cells, date=parse_date(F.col("text"), F.year(F.lit(today).cast("date"))))


_ANCHOR = {MULTIDAY: "date_col", TRANSPOSED: "date_col", LABELLED: "label_col"}


def _placed(cells: DataFrame, layout: DataFrame, key: str, documents: DataFrame | None, of: list[str]) -> DataFrame:
    """The cells that layouts read, each with the layout of its table: columns (those that it is in) and anchor (whether it gives its row a day or a slot).

    Cells meet their tables once, whatever the layout; those of a transposed
    table change rows for columns.  The configured columns stay on the side of
    the tables: only what a cell is in goes on.
    """
    anchor = F.coalesce(*[F.when(F.col("layout") == name, F.col(column).cast("int")) for name, column in _ANCHOR.items() if column in layout.columns], F.lit(None).cast("int"))
    tables = layout.select(key, "table_no", *of, "layout", anchor.alias("__anchor"), _columns(layout).alias("columns"))
    if documents is not None:
        tables = tables.join(documents.select(key, "year", "month", F.lit(True).alias("__known")), key, "left")
        tables = tables.filter(F.col("__known") | ~F.col("layout").isin(MULTIDAY, TRANSPOSED)).drop("__known")
    both, turned = cells.join(tables, [key, "table_no"]), F.col("layout") == TRANSPOSED
    row, col = F.when(turned, F.col("col_no")).otherwise(F.col("row_no")), F.when(turned, F.col("row_no")).otherwise(F.col("col_no"))
    both = both.withColumns({"row_no": row, "col_no": col})
    both = both.withColumns({"columns": F.filter("columns", lambda c: c["col_no"] == F.col("col_no")), "anchor": F.coalesce(F.col("col_no") == F.col("__anchor"), F.lit(False))})
    return both.filter(F.col("anchor") | (F.size("columns") > 0))


def _read(cells: DataFrame, layout: DataFrame, key: str, today: str, documents: DataFrame | None, known: DataFrame | None, dates: DataFrame | None, which: tuple[str, ...], of: tuple[str, ...] = ()) -> DataFrame:
    """Slot cells of the tables of `layout`, all of which are of the layouts `which`."""
    known = read_values(cells) if known is None else known
    at = _placed(cells, layout, key, documents, list(of))
    dated, kind = F.col("layout").isin(MULTIDAY, TRANSPOSED), F.col("layout")
    row = Window.partitionBy(key, "table_no", *of, "layout", "__anchor", "row_no")
    at = at.withColumns({"__date": F.lit(None).cast("date"), "__slot": F.lit(None).cast("string")})
    if MULTIDAY in which or TRANSPOSED in which:
        dates = read_dates(cells, today, documents) if dates is None else dates
        read = (with_readings(at, dates) if documents is None else with_dates(at, dates)).drop("__date")
        at = read.withColumnRenamed("date", "__date")
    if LABELLED in which:
        at = with_slots(at.drop("__slot"), "text").withColumnRenamed("slot", "__slot")
    # a row has the day of its date cell and the slot of its label
    at = at.withColumn("row_date", F.max(F.when(F.col("anchor") & dated, F.col("__date"))).over(row)).withColumn("row_slot", F.max(F.when(F.col("anchor") & (kind == LABELLED) & F.col("__slot").isin(*DAILY), F.col("__slot"))).over(row))
    day = F.when(dated, F.col("row_date")).otherwise(F.lit(today).cast("date"))
    each = at.select(key, "table_no", *of, "layout", "row_no", "col_no", "text", day.alias("day"), "row_slot", F.explode("columns").alias("c"))
    slot = F.when(kind == LABELLED, F.col("row_slot")).otherwise(F.col("c.slot"))
    each = each.select(key, "table_no", *of, "layout", "row_no", "col_no", "text", "day", slot.alias("slot"), "c.kind", "c.value_kind", "c.time_index").filter("slot is not null and day is not null")
    if SINGLE_DAY not in which:
        return _made(each, key, known)  # of one layout, without further columns
    # a table of a single day gives its first row that has anything
    made = with_values(each, known)
    first = F.min("row_no").over(Window.partitionBy(key, "table_no", *of, "layout"))
    made = made.withColumn("first", first).filter((kind != SINGLE_DAY) | (F.col("row_no") == F.col("first")))
    return _shaped(made, key, of)


def multiday(cells: DataFrame, layout: DataFrame, key: str, today: str, documents: DataFrame | None = None, known: DataFrame | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Days down the side; `documents` (key, year, month) say what a bare day belongs to, else it is today's year and no month."""
    return _read(cells, layout.withColumn("layout", F.lit(MULTIDAY)), key, today, documents, known, dates, (MULTIDAY,))


def single_day(cells: DataFrame, layout: DataFrame, key: str, today: str, known: DataFrame | None = None) -> DataFrame:
    """No dates: the first row that gives anything, on the day of the run."""
    return _read(cells, layout.withColumn("layout", F.lit(SINGLE_DAY)), key, today, None, known, None, (SINGLE_DAY,))


def labelled(cells: DataFrame, layout: DataFrame, key: str, today: str, known: DataFrame | None = None) -> DataFrame:
    """Slots down a label column, kinds in the others, on the day of the run."""
    return _read(cells, layout.withColumn("layout", F.lit(LABELLED)), key, today, None, known, None, (LABELLED,))


def month_sections(sections: DataFrame, layout: DataFrame, key: str, today: str) -> DataFrame:
    """Day rows below month names (`grids.month_sections`); a month that has passed is next year's. `layout` has key, date_col, columns."""
    day = sections.join(layout.select(key, "date_col"), key).filter("col_no = date_col")
    year = year_for_month(F.col("month"), F.lit(today).cast("date"))
    day = day.select(key, "table_no", "row_no", given(parse_date(F.col("text"), year, F.col("month"))).alias("day"))
    column = layout.select(key, F.explode(_columns(layout)).alias("c")).select(key, "c.*")
    return _made(sections.join(day, [key, "table_no", "row_no"]).join(column, [key, "col_no"]).filter("slot is not null"), key, read_values(sections))


def extract(cells: DataFrame, layout: DataFrame, key: str, today: str, documents: DataFrame | None = None, of: tuple[str, ...] = ()) -> DataFrame:
    """Every table by its layout; an unknown layout is an error. `of` names columns of `layout` that its cells keep: a table may have several layouts that differ in these."""
    known = F.when(F.col("layout").isin(*LAYOUTS), F.col("layout")).otherwise(F.raise_error(F.format_string("unknown layout: %s", "layout")))
    layout = layout.withColumn("layout", known)
    return _read(cells, layout, key, today, documents, None, None, LAYOUTS, of)


# Fields of two providers' calendars. The first lists a day's times, with or without sunrise second.
CALENDAR = "struct<calendar:array<map<string,array<string>>>,iqamaCalendar:array<map<string,array<string>>>>"
_DAY_FIELDS = {"fajr": ("fajr", "iqamah_Fajr"), "dhuhr": ("zuhr", "iqamah_Zuhr"), "asr": ("asr", "iqamah_Asr"), "maghrib": ("maghrib", "iqamah_Maghrib"), "isha": ("isha", "iqamah_Isha")}
TIMINGS = (
    "struct<model:struct<salahTimings:array<struct<day:string,month:string," + ",".join(f"{x}:string" for pair in _DAY_FIELDS.values() for x in pair) + ">>,"
    "jumahSalahIqamahTimings:array<struct<time:string,iqamahTime:string,isPrimary:boolean>>>>"
)


def calendar_cells(payload: DataFrame, key: str, year: int, month: int) -> DataFrame:
    """Cells of month calendars in a JSON object (`payload`: key, json): a map of days to lists of times or offsets for each month."""
    read = payload.select(key, F.from_json("json", CALENDAR).alias("c"))
    kinds = F.array(F.struct(F.lit("begin").alias("kind"), F.get("c.calendar", F.lit(month - 1)).alias("days")), F.struct(F.lit("jamaah").alias("kind"), F.get("c.iqamaCalendar", F.lit(month - 1)).alias("days")))
    day = read.select(key, F.explode(kinds).alias("__k")).select(key, "__k.kind", F.explode("__k.days").alias("day_of_month", "times"))
    five = F.when(F.size("times") >= 6, F.transform(F.array(*map(F.lit, (0, 2, 3, 4, 5))), lambda k: F.get("times", k))).otherwise(F.slice("times", 1, 5))
    slot = F.get(F.array(*map(F.lit, DAILY)), F.col("i"))
    cell = day.select(key, "kind", F.expr("try_cast(day_of_month as int)").alias("d"), F.posexplode(five).alias("i", "text")).filter("d is not null").withColumn("slot", slot)
    pm = F.col("slot") != "fajr"
    value = F.struct(parse_time(F.col("text"), pm).alias("time"), parse_offset(F.col("text")).alias("offset"))
    cell = cell.select("*", F.explode(F.filter(F.array(value), lambda v: v["time"].isNotNull() | v["offset"].isNotNull())).alias("__v"))
    cell = cell.select("*", F.col("__v.time").alias("time"), F.when(F.col("__v.time").isNull(), F.col("__v.offset")).alias("offset"))
    cell = cell.withColumn("day", day_of(F.lit(year), F.lit(month), F.col("d"))).filter("day is not null")
    return cell.select(key, F.struct("d", "i").alias("seq"), "day", "slot", "kind", "time", "offset", F.when(F.col("offset").isNotNull(), F.col("slot")).alias("base_slot"))


def timings_cells(payload: DataFrame, key: str, year: int) -> DataFrame:
    """Cells of a year of day rows in a JSON object, and the primary weekly session on every Friday of the months seen."""
    model = payload.select(key, F.from_json("json", TIMINGS).alias("j")).select(key, "j.model.*")
    rows = model.select(key, F.posexplode("salahTimings").alias("n", "r")).select(key, "n", "r.*")
    number = lambda c: F.expr(f"try_cast({c} as int)")  # noqa: E731  numbers also come as strings
    rows = rows.withColumn("day_of", day_of(F.lit(year), number("month"), number("day"))).filter("day_of is not null")
    pairs = [F.struct(F.lit(s).alias("slot"), F.lit(k).alias("kind"), F.col(f).alias("text")) for s, fields in _DAY_FIELDS.items() for k, f in zip(("begin", "jamaah"), fields, strict=True)]
    daily = rows.select(key, F.col("day_of").alias("day"), "n", F.posexplode(F.array(*pairs)).alias("i", "p")).select(key, F.struct("n", "i").alias("seq"), "day", "p.slot", "p.kind", "p.text")
    primary = F.coalesce(F.get(F.filter("jumahSalahIqamahTimings", lambda s: s["isPrimary"]), F.lit(0)), F.get("jumahSalahIqamahTimings", F.lit(0)))
    week = rows.select(key, F.month("day_of").alias("m")).distinct().join(model.select(key, primary.alias("s")).filter("s is not null"), key)
    first = F.make_date(F.lit(year), F.col("m"), F.lit(1))
    fridays = week.select(key, "s", F.explode(F.sequence(first, F.last_day(first))).alias("day")).filter(F.weekday("day") == 4)
    both = F.array(F.struct(F.lit("begin").alias("kind"), F.col("s.time").alias("text")), F.struct(F.lit("jamaah").alias("kind"), F.col("s.iqamahTime").alias("text")))
    weekly = fridays.select(key, "day", F.posexplode(both).alias("i", "p")).select(key, F.struct(F.dayofyear("day").alias("n"), "i").alias("seq"), "day", F.lit("jumuah").alias("slot"), "p.kind", "p.text")
    cells = daily.unionByName(weekly).select("*", given(parse_time(F.col("text"), F.col("slot") != "fajr")).alias("time"))
    return cells.select(key, "seq", "day", "slot", "kind", "time", F.lit(None).cast("int").alias("offset"), F.lit(None).cast("string").alias("base_slot"))
