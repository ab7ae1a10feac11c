"""Choosing a layout by trying: every candidate of every source goes through one evaluation, and the best that passes stays.

Nothing is written.  A candidate is what the evidence of a page suggests: a table
read in the way that fits it, an image or document that looks like a timetable, or
what a provider's plug-in makes of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import table_confidence
from ..operators.evidence import MEDIA_SCORE, capped
from ..operators.lookups import GENERIC, LANES
from ..operators.schema import LABELLED, MULTIDAY, SINGLE_DAY, TRANSPOSED
from ..sources.scratch import stored
from .evaluate import MEDIA, gate
from .extract import extract
from .materialize import grid_rows

# How many tables and media links of a page are tried.
MOST_TABLES, MOST_MEDIA = 6, 4
_NAMES = {MULTIDAY: "table_horizontal_multiday", TRANSPOSED: "table_transpose_multiday", SINGLE_DAY: "table_horizontal_single_day", LABELLED: "table_vertical_single_day"}


def table_candidates(layouts: DataFrame, evidence: DataFrame) -> DataFrame:
    """A candidate for each of the first tables of a page that a layout fits.

    `layouts` (source_id, table_no, layout, ...); `evidence` (source_id, table_no,
    prayers, times) as `schema.table_evidence` gives it.
    """
    first = capped(evidence, ["source_id"], ["table_no"], MOST_TABLES).select("source_id", "table_no", F.size("prayers").alias("slots"), "times")
    both = layouts.join(first, ["source_id", "table_no"])
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    place = F.struct(F.lit(0).alias("kind"), F.col("table_no").alias("at"))
    return both.select("source_id", place.alias("place"), F.concat(F.lit("enumerator:"), names[F.col("layout")]).alias("origin"), F.lit("html_table").alias("shape"), "table_no", F.lit(None).cast("string").alias("url"), table_confidence(F.col("slots"), F.col("times") > 0).alias("confidence"))


def media_candidates(media: DataFrame) -> DataFrame:
    """A candidate for each of the first media links that look like a timetable; `media` (source_id, url, ordinal, media, score)."""
    good = capped(media.filter(F.col("score") >= MEDIA_SCORE), ["source_id"], ["ordinal", "url"], MOST_MEDIA)
    later = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal", "url")).cast("int")
    place = F.struct(F.lit(1).alias("kind"), later.alias("at"))
    return good.select("source_id", place.alias("place"), F.concat(F.lit("enumerator:media_"), "media").alias("origin"), F.col("media").alias("shape"), F.lit(None).cast("int").alias("table_no"), "url", F.least(F.lit(1.0), F.col("score") / 4).alias("confidence"))


def provider_candidates(matches: DataFrame) -> DataFrame:
    """A candidate for each page that a plug-in knows; `matches` (source_id, platform, shape, url, confidence)."""
    place = F.struct(F.lit(2).alias("kind"), F.lit(0).alias("at"))
    return matches.select("source_id", place.alias("place"), F.concat(F.lit("platform:"), "platform").alias("origin"), "shape", F.lit(None).cast("int").alias("table_no"), "url", "confidence")


def specific(origin: Column) -> Column:
    """2 for what a plug-in for one provider made, else 1."""
    return F.when(F.startswith(origin, F.lit("platform:")) & ~F.regexp_replace(origin, "^platform:", "").isin(*GENERIC), 2).otherwise(1)


def verify(candidates: DataFrame, cells: DataFrame, layouts: DataFrame, values: DataFrame, documents: DataFrame, today: str, days: int, provided: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts) of all candidates at once, keyed by source_id and place.

    `cells` (source_id, table_no, row_no, col_no, text) and `layouts` are the pages'
    tables, stored; cells are joined to the candidates that read their table.  `values`
    (source_id, values) are the clock times of the pages' texts, found once a
    page; `documents` (source_id, year, month) say what a bare day belongs to;
    `provided` (source_id, seq, day, slot, kind, time, offset, base_slot) are the
    cells that plug-ins read.
    """
    candidates = candidates.withColumn("key", F.struct("source_id", "place"))
    tables = candidates.filter("table_no is not null").select("source_id", "table_no", "key")
    layout = stored(layouts.join(tables, ["source_id", "table_no"]), "candidate-layouts")
    cell = extract(cells, layout, "source_id", today, documents, ("key",)).drop("source_id")
    rows = grid_rows(cell.withColumnRenamed("key", "source_id"), today, days)
    if provided is not None:
        made = provided.join(candidates.filter("place.kind = 2").select("source_id", "key"), "source_id").drop("source_id")
        rows = rows.unionByName(grid_rows(made.withColumnRenamed("key", "source_id"), today, days))
    rows = stored(rows, "candidate-rows")
    text = candidates.join(values, "source_id", "left").select(F.col("key").alias("source_id"), "values", F.lit(1).alias("documents"))
    return rows, stored(gate(candidates.select(F.col("key").alias("source_id"), "shape"), rows, text, today, days), "candidate-verdicts")


def best(candidates: DataFrame, rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The best candidate of each source that passes: (source_id, place, origin, shape, table_no, url, lane, rows).

    Lane, then a plug-in for one provider before anything general, then rows,
    structure before media, confidence, and the earlier candidate.
    """
    counted = rows.groupBy("source_id").agg(F.count("*").alias("rows"))
    lanes = F.create_map(*[F.lit(x) for pair in LANES.items() for x in pair])
    passed = verdicts.filter(F.col("lane").isin(*LANES)).select("source_id", "lane").join(counted, "source_id", "left").select("source_id.*", "lane", F.coalesce("rows", F.lit(0)).alias("rows"))
    both = candidates.join(passed, ["source_id", "place"])
    media = F.col("shape").isin(*MEDIA)
    rank = F.struct(lanes[F.col("lane")], specific(F.col("origin")), "rows", (~media).cast("int"), "confidence", -F.col("place.kind"), -F.col("place.at"))
    top = both.groupBy("source_id").agg(F.max_by(F.struct("place", "origin", "shape", "table_no", "url", "lane", "rows"), rank).alias("b"))
    return top.select("source_id", "b.*")
