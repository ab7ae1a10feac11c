"""What texts say, read once for each distinct text: cells and words repeat, and reading one costs more than joining it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pyudfs import few
from .scalars import parse_date


def _valued(rows: DataFrame, **values: Column) -> DataFrame:
    """`rows` with values; those without any go. Generated, so that no filter moves the reading to where texts are not distinct."""
    value = F.struct(*[c.alias(n) for n, c in values.items()])
    some = lambda v: reduce(lambda a, b: a | b, (v[n].isNotNull() for n in values))
    return rows.select("*", F.explode(F.filter(F.array(value), some)).alias("__v")).select(*rows.columns, "__v.*")


def readings(rows: DataFrame, **values: Column) -> DataFrame:
    """(__text, values) of the distinct `text` of `rows` that have any value; values are columns of `text`."""
    return few(_valued(rows.select("text").distinct(), **values).withColumnRenamed("text", "__text"))


def with_readings(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (text, ...) with the values of `known`, null where a text has none."""
    return rows.join(known, F.col("text") == F.col("__text"), "left").drop("__text")


def date_readings(rows: DataFrame, months: DataFrame) -> DataFrame:
    """(__text, __year, __month, date) of the distinct `text` of `rows` that are a day in any of `months` (year, month)."""
    # a text that is a day in any month is one in the first of a leap year
    maybe = _valued(rows.select("text").distinct(), __day=parse_date(F.col("text"), F.lit(2024), F.lit(1))).select(F.col("text"))
    asked = few(months.select("year", "month").distinct())
    both = _valued(few(maybe).crossJoin(asked), date=parse_date(F.col("text"), F.col("year"), F.col("month")))
    return few(both.select(F.col("text").alias("__text"), F.col("year").alias("__year"), F.col("month").alias("__month"), "date"))


def with_dates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (text, year, month, ...) with the date of each, null where there is none."""
    at = (F.col("text") == F.col("__text")) & F.col("year").eqNullSafe(F.col("__year")) & F.col("month").eqNullSafe(F.col("__month"))
    return rows.join(known, at, "left").drop("__text", "__year", "__month")
