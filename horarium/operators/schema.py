"""Inference of a table's layout from its header and the first rows of its body.

Tables are long: `header` has (key, table_no, col_no, header), `body` has (key,
table_no, row_no from 0, col_no, text).  Names are resolved in Arrow batches;
everything else is counted and ranked natively.  `cells` and `depth` are read
several times: keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pyudfs import few, names_of, once, with_slots
from ..functions.readings import readings, with_readings
from ..functions.scalars import DAILY, parse_date, parse_offset, parse_time
from ..sources.scratch import stored
from .grids import combined_header, leading_run, placed_body, placed_header, transpose

# Rows that are sampled, the least share of them, the least number of slots, and the layouts' names.
SAMPLE, SHARE, SLOTS = 12, 0.5, 3
MULTIDAY, TRANSPOSED, SINGLE_DAY, LABELLED = "horizontal_multiday", "transpose_multiday", "horizontal_single_day", "prayer_rows"
DATE_WORDS = ("date", "day")
COLUMN = "struct<col_no:int,slot:string,kind:string,value_kind:string,header:string>"


def _share(hit: Column) -> Column:
    return F.avg(hit.isNotNull().cast("double"))


def read_cells(cells: DataFrame, today: str) -> DataFrame:
    """What the distinct texts of cells say: __time, __offset, __date."""
    day, text = F.lit(today).cast("date"), F.col("text")
    return readings(cells, __time=parse_time(text), __offset=parse_offset(text), __date=parse_date(text, F.year(day), F.month(day)))


def profile(body: DataFrame, key: str) -> DataFrame:
    """(key, table_no, col_no, times, offsets, dates): shares among the first SAMPLE cells of each column; `body` has what `read_cells` gives."""
    head = body.filter(F.col("row_no") < SAMPLE)
    return head.groupBy(key, "table_no", "col_no").agg(_share(F.col("__time")).alias("times"), _share(F.col("__offset")).alias("offsets"), _share(F.col("__date")).alias("dates"))


def _names(headers: DataFrame) -> DataFrame:
    """(__header, slot, fuzzy, kind_name, plain) of the distinct `header` that name a slot, a kind or the date."""
    some = lambda n: n["slot"].isNotNull() | n["kind"].isNotNull() | n["plain"].isin(*DATE_WORDS)
    known = once(headers.select(F.col("header").alias("__header")), names_of("__header"), some, "__n")
    return few(known.select("__header", "__n.slot", "__n.fuzzy", F.col("__n.kind").alias("kind_name"), "__n.plain"))


def _named(header: DataFrame) -> DataFrame:
    """`header` with slot, fuzzy, kind_name and plain, null where it names nothing."""
    return header.join(_names(header), F.col("header") == F.col("__header"), "left").drop("__header")


def _offset(kind: Column) -> Column:
    return (kind == "jamaah") & (F.col("offsets") >= SHARE) & (F.col("offsets") >= F.col("times"))


def detect_columns(named: DataFrame, key: str) -> DataFrame:
    """`named` with slot_column, value_kind: the columns whose header names a daily slot.

    `named` is a header with names and the shares of its columns.  A close
    spelling counts if half of the sampled cells are times or offsets; a column
    of offsets needs a begin column of its slot; the first column of a slot and
    kind wins.
    """
    at = Window.partitionBy(key, "table_no", "slot")
    sure = F.col("slot").isin(*DAILY) & (~F.col("fuzzy") | (F.greatest("times", "offsets") >= SHARE))
    both = named.withColumn("kind", F.coalesce("kind_name", F.lit("jamaah"))).withColumn("sure", F.coalesce(sure, F.lit(False)))
    both = both.withColumn("is_offset", _offset(F.col("kind"))).withColumn("has_begin", F.bool_or(F.col("sure") & (F.col("kind") == "begin")).over(at))
    both = both.withColumn("fit", F.col("sure") & (~F.col("is_offset") | F.col("has_begin")))
    first = F.min(F.when(F.col("fit"), F.col("col_no"))).over(Window.partitionBy(key, "table_no", "slot", "kind"))
    return both.withColumn("slot_column", F.coalesce(F.col("fit") & (F.col("col_no") == first), F.lit(False))).withColumn("value_kind", F.when(F.col("is_offset"), "offset"))


def _grid(header: DataFrame, body: DataFrame, key: str) -> DataFrame:
    """(key, table_no, columns, date_col) of tables with at least SLOTS slot columns.

    The date column is the free one with the largest share of dates, at least
    half, else the first whose header says so.
    """
    named = _named(header).join(profile(body, key), [key, "table_no", "col_no"], "left").fillna(0.0, ["times", "offsets", "dates"])
    found = detect_columns(named, key)
    column = F.struct("col_no", "slot", "kind", "value_kind", "header").cast(COLUMN)
    free = ~F.col("slot_column")
    per = found.groupBy(key, "table_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("slot_column"), column))).alias("columns"), F.max(F.when(free, F.struct("dates", (-F.col("col_no")).alias("at")))).alias("m"),
        F.min(F.when(free & F.col("plain").isin(*DATE_WORDS), F.col("col_no"))).alias("said"),
    ).filter(F.size("columns") >= SLOTS)
    return per.select(key, "table_no", "columns", F.when(F.col("m.dates") >= SHARE, -F.col("m.at")).otherwise(F.col("said")).alias("date_col"))


def label_rows(daily: DataFrame, key: str) -> DataFrame:
    """(key, table_no, label_col, label_rows) of tables with the slots down one column: its first SAMPLE rows that name one.

    `daily` (key, table_no, row_no, col_no, slot) are the cells of the bodies that name a daily slot exactly.
    """
    best = daily.filter(F.col("row_no") < SAMPLE).groupBy(key, "table_no", "col_no").agg(F.count_distinct("slot").alias("slots"))
    best = best.groupBy(key, "table_no").agg(F.max(F.struct("slots", (-F.col("col_no")).alias("at"))).alias("m")).filter(F.col("m.slots") >= SLOTS).select(key, "table_no", (-F.col("m.at")).alias("label_col"))
    found = daily.join(best, [key, "table_no"]).filter("col_no = label_col").withColumn("__k", F.row_number().over(Window.partitionBy(key, "table_no").orderBy("row_no"))).filter(F.col("__k") <= SAMPLE)
    return found.groupBy(key, "table_no", "label_col").agg(F.collect_list("row_no").alias("label_rows"))


def detect_labels(header: DataFrame, body: DataFrame, key: str) -> DataFrame:
    """(key, table_no, label_col, columns) of tables with the slots down one column and kinds in the others; `body` has label_col and label_rows."""
    beside = body.filter("col_no <> label_col").filter(F.array_contains("label_rows", F.col("row_no")))
    per = beside.groupBy(key, "table_no", "label_col", "col_no").agg(_share(F.col("__time")).alias("times"), _share(F.col("__offset")).alias("offsets"))
    per = per.filter(F.greatest("times", "offsets") >= SHARE)
    named = per.join(_named(header).select(key, "table_no", "col_no", "header", "kind_name"), [key, "table_no", "col_no"], "left").withColumn("kind", F.coalesce("kind_name", F.lit("jamaah")))
    column = F.struct("col_no", F.lit(None).cast("string").alias("slot"), "kind", F.when(_offset(F.col("kind")), "offset").alias("value_kind"), F.nullif("header", F.lit("")).alias("header")).cast(COLUMN)
    return named.groupBy(key, "table_no", "label_col").agg(F.array_sort(F.collect_list(column)).alias("columns"))


def placed(cells: DataFrame, depth: DataFrame, key: str, today: str) -> DataFrame:
    """Cells with what their text says and what decides their table, stored: (__time, __offset, __date, depth, flips, label_col, label_rows).

    Cells are many and are joined to their tables here only; what follows
    filters and counts them.  A table and its transpose, headed by its first
    column, are judged together: one without slots down that column has none.
    """
    shape = cells.groupBy(key, "table_no").agg(F.max("row_no").alias("r"), F.max("col_no").alias("c"))
    side = cells.filter("col_no = 0").select(key, "table_no", F.coalesce("text", F.lit("")).alias("header"))
    sides = side.join(_names(side).filter(F.col("slot").isin(*DAILY)), F.col("header") == F.col("__header")).groupBy(key, "table_no").agg(F.count("*").alias("sides"))
    daily = placed_body(with_slots(cells, "text").filter(F.col("slot").isin(*DAILY)).join(depth, [key, "table_no"]))
    tables = shape.join(depth, [key, "table_no"], "left").join(sides, [key, "table_no"], "left").join(label_rows(daily, key), [key, "table_no"], "left")
    flips = F.coalesce((F.col("r") >= 1) & (F.col("c") >= 1) & (F.col("sides") >= SLOTS), F.lit(False))
    tables = stored(tables.select(key, "table_no", "depth", flips.alias("flips"), "label_col", "label_rows"), "layout-tables")
    return stored(with_readings(cells, read_cells(cells, today)).join(tables, [key, "table_no"]), "layout-cells")


def table_layouts(cells: DataFrame, depth: DataFrame, key: str, today: str) -> DataFrame:
    """(key, table_no, layout, date_col, label_col, columns): the first layout that fits each table.

    Days down the side; days across the top; one row of times and no days; slots
    down a column.
    """
    at = placed(cells, depth, key, today)
    header, body, turned = stored(placed_header(at, key), "layout-headers"), placed_body(at), at.filter("flips")
    turned_header = turned.filter("col_no = 0").select(key, "table_no", F.col("row_no").alias("col_no"), F.coalesce("text", F.lit("")).alias("header"))
    turned_body = transpose(turned.withColumn("col_no", F.col("col_no") - 1)).filter("row_no >= 0")
    as_seen = lambda df, turned: df.withColumn("table_no", F.struct("table_no", F.lit(turned).alias("turned")))
    both = _grid(as_seen(header, False).unionByName(as_seen(turned_header, True)), as_seen(body, False).unionByName(as_seen(turned_body, True)), key)
    both = stored(both.select(key, "table_no.table_no", "table_no.turned", "columns", "date_col"), "layout-grids")
    across, down = both.filter("not turned"), both.filter("turned and date_col is not null")
    used = across.filter("date_col is null").select(key, "table_no", F.explode("columns").alias("c")).select(key, "table_no", F.col("c.col_no").alias("col_no"))
    # one row of times: the first and the last of all columns are the same
    spans = body.filter("__time is not null").groupBy(key, "table_no", "col_no").agg(F.min("row_no").alias("first"), F.max("row_no").alias("last"))
    timed = spans.join(used, [key, "table_no", "col_no"]).groupBy(key, "table_no").agg((F.min("first") == F.max("last")).alias("once"))
    labels = detect_labels(header, body, key)
    null = F.lit(None).cast("int")
    fit = lambda df, rank, name, date, label: df.select(key, "table_no", F.lit(rank).alias("rank"), F.lit(name).alias("layout"), date.alias("date_col"), label.alias("label_col"), "columns")
    found = fit(across.filter("date_col is not null"), 1, MULTIDAY, F.col("date_col").cast("int"), null)
    found = found.unionByName(fit(down, 2, TRANSPOSED, F.col("date_col").cast("int"), null))
    found = found.unionByName(fit(across.filter("date_col is null").join(timed.filter("once"), [key, "table_no"], "left_semi"), 3, SINGLE_DAY, null, null))
    found = found.unionByName(fit(labels, 4, LABELLED, null, F.col("label_col").cast("int")))
    best = found.groupBy(key, "table_no").agg(F.min_by(F.struct("layout", "date_col", "label_col", "columns"), "rank").alias("b"))
    return best.select(key, "table_no", "b.*")


def section_layouts(sections: DataFrame, key: str, today: str) -> DataFrame:
    """(key, date_col, columns) of pages whose day rows stand below month names, two months at least.

    `sections` comes from `grids.month_sections`; the first section with slot
    and date columns decides.
    """
    months = sections.groupBy(key).agg(F.count_distinct("month").alias("months")).filter("months >= 2").select(key)
    base = sections.join(months, key, "left_semi")
    first = F.min("row_no").over(Window.partitionBy(key, "table_no", "section"))
    # a section is a table of its own
    cells = base.withColumn("row_no", F.col("row_no") - first).select(key, F.struct("table_no", "section").alias("table_no"), "row_no", "col_no", "text")
    depth = leading_run(cells, key).filter("timeless > 0 and timeless < rows").select(key, "table_no", F.col("timeless").alias("depth"))
    from .grids import body as body_of

    grids = _grid(combined_header(cells, depth, key), with_readings(body_of(cells, depth, key), read_cells(base, today)), key).filter("date_col is not null")
    return grids.groupBy(key).agg(F.min_by(F.struct("date_col", "columns"), "table_no").alias("g")).select(key, "g.*")


def table_evidence(cells: DataFrame, depth: DataFrame, key: str, year: int) -> DataFrame:
    """(key, table_no, prayers, times, date_columns): distinct slots named in first-seen order, clock times in the body, columns of which half are dates."""
    spot = F.when(F.col("row_no") < F.col("depth"), 0).otherwise(1)
    known = readings(cells, __time=parse_time(F.col("text")), __date=parse_date(F.col("text"), F.lit(year), F.lit(1)))
    # the header is read column by column, the body row by row; few cells name a slot, and only these are sorted
    named = with_slots(cells, "text").filter("slot is not null").withColumnRenamed("slot", "name").join(depth, [key, "table_no"])
    order = F.when(spot == 0, F.struct(spot.alias("p"), F.col("col_no").alias("x"), F.col("row_no").alias("y"))).otherwise(F.struct(spot.alias("p"), F.col("row_no").alias("x"), F.col("col_no").alias("y")))
    per_slot = named.groupBy(key, "table_no", "name").agg(F.min(order).alias("seen"))
    prayers = per_slot.groupBy(key, "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "name"))), lambda x: x["name"]).alias("prayers"))
    # all others meet their table once, and are counted by column
    told = (spot == 1) & (F.trim("text") != "")
    columns = with_readings(cells, known).select(key, "table_no", "row_no", "col_no", "text", "__time", "__date").join(depth, [key, "table_no"]).groupBy(key, "table_no", "col_no").agg(
        F.count_if(told).alias("told"), F.count_if(told & F.col("__date").isNotNull()).alias("dates"), F.count_if((spot == 1) & F.col("__time").isNotNull()).alias("timed")
    )
    date = F.when((F.col("told") > 0) & (F.col("dates") * 2 >= F.col("told")), F.col("col_no"))
    times = columns.groupBy(key, "table_no").agg(F.sum("timed").alias("times"), F.array_sort(F.collect_list(date)).alias("date_columns"))
    both = times.join(prayers, [key, "table_no"], "left")
    return both.select(key, "table_no", F.coalesce("prayers", F.array().cast("array<string>")).alias("prayers"), "times", "date_columns")
