"""Timetables that are no tables: record streams, repeated elements and grids of other elements.

All three start from the element relation (`sources.elements`), are judged by what
the elements say and how they nest, and give what `plans.extract` gives: slot cells
(key, seq, day, slot, kind, time, offset, base_slot), or table cells that the
layouts of `operators.schema` read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pyudfs import few, normalise_token, resolve_tokens
from ..functions.readings import readings, with_readings
from ..functions.scalars import DAILY, WEEKDAYS, given, minutes, parse_date, parse_time
from ..sources.elements import first_inside, inside, leaves, select
from ..sources.scratch import stored

# Roles of cells, and the least rows, columns and clock times of a grid.
CELL_ROLES = ("cell", "gridcell", "columnheader", "rowheader")
LEAST_ROWS, LEAST_COLUMNS, LEAST_CHILDREN, LEAST_TIMES = 2, 2, 3, 5


def _timed(text: Column) -> Column:
    return parse_time(text, F.lit(True)).isNotNull()


def _named(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with name, fuzzy (the slot that a text names) and plain; distinct texts go through Python once."""
    known = resolve_tokens(rows.select(column).distinct(), column).withColumn("plain", normalise_token(column)).select(F.col(column).alias("__text"), "name", "fuzzy", "plain")
    known = known.filter(F.col("name").isNotNull() | F.col("plain").isin(*WEEKDAYS))
    return rows.join(known, F.col(column) == F.col("__text"), "left").drop("__text")


def date_texts(texts: DataFrame) -> DataFrame:
    """(__text, maybe) of the distinct `texts` (text) that are a day in some month: no weekday, no clock time and no slot is one."""
    some = readings(texts, __day=F.when(~_timed(F.col("text")), parse_date(F.col("text"), F.lit(2024), F.lit(1)))).select(F.col("__text").alias("text"))
    named = _named(some, "text").filter(F.col("name").isNull() & ~F.coalesce(F.col("plain").isin(*WEEKDAYS), F.lit(False)))
    return few(named.select(F.col("text").alias("__text"), F.lit(True).alias("maybe")))


def date_leaves(leaf: DataFrame, maybe: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, el, path, date) of the leaves (key, el, path, text) that are a day; `maybe` as `date_texts` gives it.

    `documents` (key, year, month) say what a bare day belongs to.
    """
    dated = with_readings(leaf, maybe).filter("maybe").join(documents.select(key, "year", "month"), key)
    return dated.select(key, "el", "path", given(parse_date(F.col("text"), F.col("year"), F.col("month"))).alias("date"))


def word_kinds(texts: DataFrame) -> DataFrame:
    """(__text, label, late, early) of the distinct words of `texts` that are a slot (its number of the day, from 1) or a time (minutes, after noon and before)."""
    words = texts.select(F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("text")).distinct()
    timed = readings(words, late=minutes(parse_time(F.col("text"), F.lit(True))), early=minutes(parse_time(F.col("text"), F.lit(False))))
    named = _named(with_readings(words, timed).filter("late is null").select("text"), "text")
    slot = F.when(F.col("name").isin(*DAILY) & ~F.col("fuzzy") & ~F.col("plain").isin(*WEEKDAYS), F.array_position(F.array(*map(F.lit, DAILY)), F.col("name")).cast("int"))
    none = F.lit(None).cast("int")
    slots = named.select(F.col("text").alias("__text"), slot.alias("label"), none.alias("late"), none.alias("early")).filter("label is not null")
    return few(slots.unionByName(timed.select("__text", none.alias("label"), "late", "early")))


def common_ancestor(chosen: DataFrame, key: str) -> DataFrame:
    """(key, el): the innermost element around all chosen ones (key, el, path)."""
    around = chosen.select(key, F.explode("path").alias("of"), F.size("path").alias("depth")).groupBy(key, "of").agg(F.count("*").alias("n"))
    total = chosen.groupBy(key).agg(F.count("*").alias("total"))
    return around.join(total, key).filter("n = total").groupBy(key).agg(F.max("of").alias("el"))


def record_tokens(elements: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, el, word, date, label, late, early): the typed tokens of the region of each page, in order.

    The region is the innermost element around all dates, if there are two, else
    the body.  A leaf that is a date is one token; of others every word is a time
    (late and early, its minutes after noon and before), a slot (label, its number
    from 1) or another label (0).  Texts and words are read once each.
    """
    leaf = leaves(elements).filter("text is not null").select(key, "el", "path", "tag", "text")
    texts = stored(leaf.select("text").distinct(), "record-texts")
    maybe, known = date_texts(texts), word_kinds(texts)
    dates = stored(date_leaves(leaf, maybe, documents, key), "record-dates")
    several = dates.groupBy(key).agg(F.count("*").alias("dates")).filter("dates >= 2").select(key)
    region = common_ancestor(dates.join(several, key, "left_semi"), key)
    body = elements.filter("tag = 'body'").groupBy(key).agg(F.min("el").alias("body"))
    scope = documents.select(key, "year", "month").join(region, key, "left").join(body, key, "left").select(key, "year", "month", F.coalesce("el", "body").alias("scope"))
    inner = with_readings(leaf, maybe).join(scope, key).filter(F.col("scope").isNull() & (F.col("tag") != "title") | F.array_contains("path", F.col("scope")))
    whole = inner.select(key, "el", F.when(F.col("maybe"), parse_date(F.col("text"), F.col("year"), F.col("month"))).alias("date"), "text")
    parts = F.when(F.col("date").isNotNull(), F.array("text")).otherwise(F.filter(F.split("text", " "), lambda w: w != ""))
    words = with_readings(whole.select(key, "el", "date", F.posexplode(parts).alias("word", "text")), known)
    none = F.col("date").isNotNull()
    label = F.when(~none & F.col("late").isNull(), F.coalesce("label", F.lit(0)))
    return words.select(key, "el", "word", "date", label.alias("label"), F.when(~none, F.col("late")).alias("late"), F.when(~none, F.col("early")).alias("early"))


def record_cells(tokens: DataFrame, key: str, today: str) -> DataFrame:
    """Slot cells of a stream of tokens: cut into days at dates, and within a day into groups at labels.

    What precedes the first date is dropped; without any date all is the day of
    the run.  The times of a group belong to its label; of several, the earliest
    is the beginning and the latest the congregation.  A label that is no slot
    takes its times with it.
    """
    so_far = Window.partitionBy(key).orderBy("el", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = tokens.withColumn("block", F.count("date").over(so_far)).withColumn("dated", F.last("date", ignorenulls=True).over(so_far)).withColumn("part", F.count("label").over(so_far)).withColumn("some", F.count("date").over(Window.partitionBy(key)))
    cut = cut.filter("date is null and (block > 0 or some = 0)").withColumn("day", F.coalesce("dated", F.lit(today).cast("date")))
    # a part that began in another block has no label in this one
    group = cut.groupBy(key, "block", "day", "part").agg(F.max("label").alias("label"), *[f(c).alias(f"{n}_{c}") for c in ("late", "early") for n, f in (("first", F.min), ("last", F.max))]).filter("label > 0")
    slot = F.get(F.array(*map(F.lit, DAILY)), F.col("label") - 1)
    of = lambda n: F.when(F.col("label") == 1, F.col(f"{n}_early")).otherwise(F.col(f"{n}_late"))  # noqa: E731  the first slot of the day is before noon
    timed = group.select(key, "block", "part", "day", slot.alias("slot"), of("first").alias("first"), of("last").alias("last")).filter("last is not null")
    both = F.array(F.struct(F.lit("jamaah").alias("kind"), F.col("last").alias("at")), F.struct(F.lit("begin").alias("kind"), F.when(F.col("first") < F.col("last"), F.col("first")).alias("at")))
    cell = timed.select(key, "day", "slot", "block", "part", F.posexplode(both).alias("i", "c")).filter("c.at is not null")
    time = F.format_string("%02d:%02d", F.floor(F.col("c.at") / 60), F.col("c.at") % 60)
    return _as_cells(cell.select(key, F.struct("block", "part", "i").alias("seq"), "day", "slot", "c.kind", time.alias("time")), key)


def _as_cells(cell: DataFrame, key: str) -> DataFrame:
    return cell.select(key, "seq", "day", "slot", "kind", "time", F.lit(None).cast("int").alias("offset"), F.lit(None).cast("string").alias("base_slot"))


def dom_records(elements: DataFrame, documents: DataFrame, key: str, today: str) -> DataFrame:
    """Slot cells of pages whose days are blocks in a stream of elements."""
    return record_cells(record_tokens(elements, documents, key), key, today)


def repeated_cells(elements: DataFrame, layout: DataFrame, documents: DataFrame, key: str, today: str) -> DataFrame:
    """Slot cells of pages whose days are repeated elements, found by selectors.

    `layout` has key, row_selector, date_selector, single_day and columns (array of
    selector, slot, kind).  Within an item the first element counts; an item
    without a date gives nothing, unless its layout is of a single day.
    """
    column = layout.select(key, F.posexplode("columns").alias("i", "c")).select(key, "i", "c.*").filter("slot is not null and trim(selector) <> ''")
    named = layout.select(key, F.lit(-2).alias("name"), F.col("row_selector").alias("selector")).unionByName(layout.select(key, F.lit(-1).alias("name"), F.col("date_selector").alias("selector")))
    found = select(elements, named.unionByName(column.select(key, F.col("i").alias("name"), "selector")), key)
    items = found.filter("name = -2").select(key, "el")
    inner = first_inside(found.filter("name >= -1"), items, key)
    date = inner.filter("name = -1").select(key, "item", F.col("text").alias("date_text"))
    at = items.withColumnRenamed("el", "item").join(layout.select(key, "single_day"), key).join(date, [key, "item"], "left").join(documents.select(key, "year", "month"), key)
    at = at.withColumn("day", F.coalesce(parse_date(F.col("date_text"), F.col("year"), F.col("month")), F.when(F.col("single_day"), F.lit(today).cast("date")))).filter("day is not null")
    cell = inner.join(at.select(key, "item", "day"), [key, "item"]).join(column.select(key, F.col("i").alias("name"), "slot", "kind"), [key, "name"])
    cell = cell.withColumn("time", parse_time(F.col("text"), F.col("slot") != "fajr")).filter("time is not null")
    return _as_cells(cell.select(key, F.struct(F.col("item").alias("row_no"), F.col("name").alias("col_no")).alias("seq"), "day", "slot", "kind", "time"), key)


def _numbered(cells: DataFrame, key: str) -> DataFrame:
    """Dense table cells of (key, row, el, text): rows and columns counted from 0, short rows padded with blanks."""
    at = cells.withColumn("row_no", F.dense_rank().over(Window.partitionBy(key).orderBy("row")) - 1).withColumn("col_no", F.row_number().over(Window.partitionBy(key, "row").orderBy("el")) - 1)
    per = at.groupBy(key, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("texts"), F.count("*").alias("n"))
    per = per.withColumn("width", F.max("n").over(Window.partitionBy(key)))
    return per.select(key, F.lit(0).alias("table_no"), "row_no", "texts", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)).alias("col_no")).select(
        key, "table_no", "row_no", "col_no", F.coalesce(F.try_element_at("texts", F.col("col_no")), F.lit("")).alias("text")
    )


def aria_cells(elements: DataFrame, key: str) -> DataFrame:
    """Table cells of pages with rows and cells by role: two rows of cells and two columns at least."""
    role = F.try_element_at("attrs", F.lit("role"))
    rows = elements.filter(role == "row").select(key, "el")
    cells = inside(elements.filter(role.isin(*CELL_ROLES)), rows, key).select(key, F.col("item").alias("row"), "el", F.coalesce("text", F.lit("")).alias("text"))
    wide = cells.groupBy(key, "row").agg(F.count("*").alias("n")).groupBy(key).agg(F.count("*").alias("rows"), F.max("n").alias("width")).filter((F.col("rows") >= LEAST_ROWS) & (F.col("width") >= LEAST_COLUMNS))
    return _numbered(cells.join(wide, key, "left_semi"), key)


def sibling_cells(elements: DataFrame, key: str) -> DataFrame:
    """Table cells of pages with an element whose children are all rows of equally many children with words.

    Of several such elements the one with the most clock times counts, five at
    least; the first of equals.
    """
    pair = elements.filter("stop > start").select(key, F.col("parent").alias("row"), "el", "text")
    width = pair.groupBy(key, "row").agg(F.count("*").alias("width"))
    children = elements.filter("parent >= 0").select(key, "parent", F.col("el").alias("row")).join(width, [key, "row"], "left")
    shape = children.groupBy(key, "parent").agg(F.count("*").alias("rows"), F.min(F.coalesce("width", F.lit(0))).alias("least"), F.max(F.coalesce("width", F.lit(0))).alias("most"))
    fit = shape.filter((F.col("rows") >= LEAST_CHILDREN) & (F.col("least") >= LEAST_COLUMNS) & (F.col("least") == F.col("most"))).select(key, "parent")
    # texts are read only where the shape fits: those of whole rows and pages are long, and no two are alike
    rows = children.join(fit, [key, "parent"]).select(key, "parent", "row")
    cells = stored(pair.join(rows, [key, "row"]), "sibling-cells")
    times = with_readings(cells, readings(cells, timed=F.when(_timed(F.col("text")), True))).groupBy(key, "parent").agg(F.count("timed").alias("times")).filter(F.col("times") >= LEAST_TIMES)
    best = times.groupBy(key).agg(F.max_by("parent", F.struct("times", -F.col("parent"))).alias("parent"))
    return _numbered(cells.join(best, [key, "parent"], "left_semi").select(key, "row", "el", "text"), key)


def dom_matrix(elements: DataFrame, key: str) -> DataFrame:
    """Table cells (key, table_no 0, row_no, col_no, text) of pages with a grid that is no table: by role, else by equal siblings."""
    aria = aria_cells(elements, key)
    rest = sibling_cells(elements.join(aria.select(key).distinct(), key, "left_anti"), key)
    return aria.unionByName(rest)
