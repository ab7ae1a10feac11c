"""The evidence of a page as one nested record, as it is kept and handed on.

Matrices are clipped, which is the feature: a record shows what a table looks like.
Every list is put together by an aggregation of its own and joined once a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pyudfs import absolute_url
from ..functions.scalars import content_hash, provider_hint
from ..sources.html import cells_of
from ..sources.scratch import stored
from .evidence import APP_MARKS, media_links, page_evidence, phrases_in, widget_hints
from .grids import combined_header, header_depth
from .regions import month_controls
from .schema import table_evidence

# Rows and columns of a matrix that a record shows, body rows, and characters of the text.
ROWS, COLUMNS, BODY, SAMPLE = 16, 24, 6, 600


def _in_order(*fields: str | Column, by: str) -> Column:
    """The list of a group's structs, in order of a column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("__by"), F.struct(*fields).alias("v")))), lambda x: x["v"])


def clipped(cells: DataFrame, key: str) -> DataFrame:
    """(key, table_no, matrix): the first rows and columns of every table as lists of texts."""
    part = cells.filter((F.col("row_no") < ROWS) & (F.col("col_no") < COLUMNS))
    line = part.groupBy(key, "table_no", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"]).alias("texts"))
    return line.groupBy(key, "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "texts"))), lambda x: x["texts"]).alias("matrix"))


def table_records(items: DataFrame, key: str, year: int) -> DataFrame:
    """(key, tables): what is known of each table of a page, in order."""
    cells = cells_of(items, key)
    tables = items.filter("kind = 'table'").select(key, F.col("n").alias("table_no"), F.col("row").alias("thead_rows"), F.col("text").alias("caption"), F.col("link").alias("selector"))
    rows = items.filter("kind = 'row'").select(key, F.col("n").alias("table_no"), F.col("row").alias("row_no"), F.col("flag").alias("heading"))
    depth = stored(header_depth(tables, rows, cells, key), "bundle-headers")
    header = combined_header(cells.filter(F.col("col_no") < COLUMNS), depth, key).groupBy(key, "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "header"))), lambda x: x["header"]).alias("header"))
    both = tables.join(depth, [key, "table_no"], "left")
    for part in (clipped(cells, key), header, table_evidence(cells, depth, key, year)):
        both = both.join(part, [key, "table_no"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    matrix = none("matrix", "array<array<string>>")
    fields = (
        F.concat(F.lit("table_"), "table_no").alias("table_id"), "selector", "caption", matrix.alias("matrix"), F.col("depth").alias("header_depth"), none("header", "array<string>").alias("header"),
        F.slice(matrix, F.coalesce("depth", F.lit(1)) + 1, F.lit(BODY)).alias("body_sample"), none("prayers", "array<string>").alias("prayers"), F.coalesce("times", F.lit(0)).alias("times"), none("date_columns", "array<int>").alias("date_columns"),
    )
    return both.groupBy(key).agg(_in_order(*fields, by="table_no").alias("tables"))


def evidence_records(pages: DataFrame, items: DataFrame, elements: DataFrame, key: str, year: int) -> DataFrame:
    """One record a page (`pages`: key, url, html), nested: tables, media, frames, widgets, navigation, marks.

    `items` and `elements` are the page's, where the caller keeps them.
    """
    flat = page_evidence(pages, key, year, items).select(key, "url", "title", "score", "page_class", "terminal_hints", F.left("text", F.lit(SAMPLE)).alias("sample"))
    frame = items.filter("kind = 'iframe'").join(pages.select(key, F.col("url").alias("base")), key).withColumn("target", absolute_url("base", "link"))
    frames = frame.groupBy(key).agg(_in_order(F.col("target").alias("url"), "text", provider_hint(F.col("target")).alias("provider"), by="n").alias("frames"))
    media = media_links(items, pages, key).groupBy(key).agg(_in_order("url", "media", "text", "score", by="ordinal").alias("media"))
    widgets = widget_hints(items, pages, key).groupBy(key).agg(_in_order("provider", "url", "confidence", by="provider").alias("widgets"))
    navs = month_controls(elements, key).groupBy(key).agg(_in_order("kind", "selector", by="kind").alias("navs"))
    marks = pages.select(key, phrases_in(F.coalesce(F.lower("html"), F.lit("")), APP_MARKS).alias("app_marks"), content_hash(F.col("html")).alias("html_hash"))
    out = flat
    lists = {"tables": table_records(items, key, year), "media": media, "frames": frames, "widgets": widgets, "navs": navs}
    for name, part in lists.items():
        out = out.join(part, key, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out.join(marks, key)
