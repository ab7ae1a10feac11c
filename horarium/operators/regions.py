"""Regions and controls of a page, from its elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pyudfs import normalise_token, resolve_tokens
from ..functions.scalars import DAILY, month_from_text
from ..sources.elements import best_of, inside, leaves, with_text
from .evidence import CLOCK, NEXT, SELECT_MONTHS

WORD = r"[A-Za-zÀ-ɏ']+"
# The least slots and clock times that make a table a timetable.
REGION_SLOTS, REGION_TIMES = 2, 1


def table_richness(tables: DataFrame, key: str) -> DataFrame:
    """`tables` (key, el, text) with slots (distinct daily slots that words name exactly) and times (clock times)."""
    words = tables.select(key, "el", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    named = resolve_tokens(words, "word").filter(F.col("name").isin(*DAILY) & ~F.col("fuzzy"))
    slots = named.groupBy(key, "el").agg(F.count_distinct("name").alias("slots"))
    return tables.join(slots, [key, "el"], "left").withColumn("slots", F.coalesce("slots", F.lit(0))).withColumn("times", F.regexp_count("text", F.lit(CLOCK)))


def richest_region(elements: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """The element of each page that shows its timetable, with text: (key, el, begin, end, tag, text).

    The table that names most slots and then has most clock times, if it names two
    and has one; else the first table; else the body; else, if there is none, the
    first element.  `texts` has (key, text) of the pages.
    """
    tables = table_richness(with_text(elements.filter("tag = 'table'"), texts, key), key)
    good = (F.col("slots") >= REGION_SLOTS) & (F.col("times") >= REGION_TIMES)
    rank = F.struct(F.lit(3).alias("kind"), good.alias("good"), F.when(good, F.col("slots")).otherwise(0).alias("slots"), F.when(good, F.col("times")).otherwise(0).alias("times"))
    columns = [key, "el", "begin", "end", "tag", "text"]
    other = elements.filter("tag = 'body' or el = 0")
    other = with_text(other, texts, key).withColumn("rank", F.struct(F.when(F.col("tag") == "body", 2).otherwise(1).alias("kind"), F.lit(False).alias("good"), F.lit(0).cast("long").alias("slots"), F.lit(0).alias("times")))
    both = tables.withColumn("rank", rank).select(*columns, "rank").unionByName(other.select(*columns, "rank"))
    return best_of(both, key, F.col("rank")).select(columns)


def _named(tag: str) -> Column:
    """A selector of an element by id, form name or first class."""
    at = lambda a: F.nullif(F.try_element_at("attrs", F.lit(a)), F.lit(""))
    return F.coalesce(F.concat(F.lit(f"{tag}#"), at("id")), F.concat(F.lit(f"{tag}[name='"), at("name"), F.lit("']")), F.concat(F.lit(f"{tag}."), F.get("classes", F.lit(0))), F.lit(tag))


def month_controls(elements: DataFrame, key: str) -> DataFrame:
    """(key, kind, selector) of pages that show one month and how to reach the others.

    The first select with the months of a year, else the first forward control by
    its words; only on pages where a leaf is the name of a month.
    """
    leaf = leaves(elements).filter("text is not null")
    captions = leaf.filter(month_from_text(F.col("text")).isNotNull()).select(key).distinct()
    months = elements.filter("tag = 'option'").filter(month_from_text(F.col("text")).isNotNull())
    selects = elements.filter("tag = 'select'")
    full = inside(months, selects, key).groupBy(key, F.col("item").alias("el")).agg(F.count("*").alias("months")).filter(F.col("months") >= SELECT_MONTHS)
    listed = selects.join(full, [key, "el"]).select(key, F.lit(1).alias("rank"), "el", F.lit("select").alias("kind"), _named("select").alias("selector"))
    forward = leaf.filter(F.col("text").isin(*NEXT) | normalise_token("text").isin(*NEXT)).select(key, F.lit(2).alias("rank"), "el", F.lit("next").alias("kind"), F.concat(F.lit("text="), "text").alias("selector"))
    both = listed.unionByName(forward).join(captions, key, "left_semi")
    return both.groupBy(key).agg(F.min_by(F.struct("kind", "selector"), F.struct("rank", "el")).alias("c")).select(key, "c.*")
