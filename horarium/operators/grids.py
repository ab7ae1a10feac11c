"""Geometry of tables in long form: one row a cell (key, table_no, row_no, col_no, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.readings import readings, with_readings
from ..functions.scalars import month_from_text, parse_time


def leading_run(cells: DataFrame, key: str) -> DataFrame:
    """(key, table_no, rows, timeless): a table's rows and how many of them lead without a clock time (all, if none has one)."""
    read = with_readings(cells, readings(cells, __time=parse_time(F.col("text"))))
    per = read.groupBy(key, "table_no").agg((F.max("row_no") + 1).alias("rows"), F.min(F.when(F.col("__time").isNotNull(), F.col("row_no"))).alias("first"))
    return per.select(key, "table_no", "rows", F.coalesce("first", "rows").alias("timeless"))


def header_depth(tables: DataFrame, rows: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """(key, table_no, depth): rows of the first thead, else leading rows of headings, else leading rows without a clock time; 1 at least.

    `tables` has thead_rows, `rows` row_no and heading (all cells are headings).
    """
    lead = rows.groupBy(key, "table_no").agg((F.max("row_no") + 1).alias("n"), F.min(F.when(~F.col("heading"), F.col("row_no"))).alias("first")).select(key, "table_no", F.coalesce("first", "n").alias("headings"))
    both = tables.select(key, "table_no", "thead_rows").join(lead, [key, "table_no"], "left").join(leading_run(cells, key), [key, "table_no"], "left")
    depth = F.when(F.col("thead_rows") > 0, F.col("thead_rows")).when(F.col("headings") > 0, F.col("headings")).otherwise(F.greatest(F.coalesce("timeless", F.lit(0)), F.lit(1)))
    return both.select(key, "table_no", depth.cast("int").alias("depth"))


def combined_header(cells: DataFrame, depth: DataFrame, key: str) -> DataFrame:
    """(key, table_no, col_no, header) of every column: the texts of its header rows, equal neighbours once."""
    return placed_header(cells.join(depth, [key, "table_no"]), key)


def placed_header(cells: DataFrame, key: str) -> DataFrame:
    """`combined_header` of cells that have the depth of their table."""
    top = cells.filter(F.col("row_no") < F.col("depth"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("row_no", "text")))), lambda p: p["text"])
    per = top.groupBy(key, "table_no", "col_no").agg(parts.alias("parts"))
    kept = F.expr("transform(filter(transform(parts, (x, k) -> struct(x, k)), p -> p.k = 0 or p.x <> parts[p.k - 1]), p -> p.x)")
    return per.select(key, "table_no", "col_no", F.array_join(kept, " ").alias("header"))


def body(cells: DataFrame, depth: DataFrame, key: str) -> DataFrame:
    """The cells below the header, their rows counted from 0."""
    return placed_body(cells.join(depth, [key, "table_no"])).select(cells.columns)


def placed_body(cells: DataFrame) -> DataFrame:
    """`body` of cells that have the depth of their table."""
    return cells.filter(F.col("row_no") >= F.col("depth")).withColumn("row_no", F.col("row_no") - F.col("depth"))


def with_bare_headers(cells: DataFrame, bare: DataFrame, depth: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(cells, depth) in which the headers that no row holds are the rows above the others."""
    heads = bare.groupBy(key, "table_no").agg((F.max("row_no") + 1).alias("heads"))
    moved = cells.join(heads, [key, "table_no"], "left").withColumn("row_no", F.col("row_no") + F.coalesce("heads", F.lit(0))).select(cells.columns)
    width = cells.groupBy(key, "table_no").agg((F.max("col_no") + 1).alias("width"))
    return moved.unionByName(bare.join(width, [key, "table_no"], "left_semi")), depth.join(heads, [key, "table_no"], "left").select(key, "table_no", F.coalesce("heads", "depth").alias("depth"))


def row_months(cells: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_no, month) of rows whose cells that are not blank are all one month's name."""
    text = F.when(F.trim("text") != "", F.col("text"))
    per = cells.groupBy(key, "table_no", "row_no").agg(F.min(text).alias("least"), F.max(text).alias("most"))
    return per.filter("least = most").select(key, "table_no", "row_no", month_from_text(F.col("least")).alias("month")).filter("month is not null")


def month_sections(cells: DataFrame, captions: DataFrame, key: str) -> DataFrame:
    """Cells with section and month: a table starts with the month of its caption, if any, and each month row opens a section.

    `captions` has table_no and caption.  Month rows themselves and rows before any month are left out.
    """
    rows = cells.select(key, "table_no", "row_no").distinct().join(row_months(cells, key), [key, "table_no", "row_no"], "left")
    so_far = Window.partitionBy(key, "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = captions.select(key, "table_no", month_from_text(F.col("caption")).alias("start"))
    carried = rows.withColumn("section", F.count("month").over(so_far)).withColumn("carried", F.last("month", ignorenulls=True).over(so_far))
    carried = carried.join(start, [key, "table_no"], "left").withColumn("carried", F.coalesce("carried", "start"))
    carried = carried.filter("month is null and carried is not null").select(key, "table_no", "row_no", "section", F.col("carried").alias("month"))
    return cells.join(carried, [key, "table_no", "row_no"])


def transpose(cells: DataFrame) -> DataFrame:
    swap = {"row_no": F.col("col_no").alias("row_no"), "col_no": F.col("row_no").alias("col_no")}
    return cells.select(*[swap.get(c, F.col(c)) for c in cells.columns])
