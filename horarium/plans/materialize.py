"""Cells, rules and weekly sessions to occurrence rows over a horizon.

cell (source_id, seq, day, slot, kind, time, offset, base_slot): `seq` is the
document order, by which the last value wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.readings import readings
from ..functions.scalars import apply_offset, given, horizon_days, is_friday, parse_time, season

ROW = ("source_id", "day", "slot", "session", "time", "begin", "label", "derived")


def last_value(value: str, when) -> F.Column:
    """The value of the greatest seq among the rows where it is given."""
    ok = when & F.col(value).isNotNull()
    return F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col("seq")))


def grid_rows(cell: DataFrame, today: str, days: int) -> DataFrame:
    """Rows of scraped cells: a time beats an offset, an offset counts from its base slot's begin."""
    start = F.lit(today).cast("date")
    cell = cell.filter(F.col("day").between(start, F.date_add(start, days)))
    main = F.col("kind") == "jamaah"
    # a day's cells stay together: its slots are grouped, and find each other's begins, after one shuffle
    slots = cell.repartition("source_id", "day").groupBy("source_id", "day", "slot").agg(
        last_value("time", F.col("kind") == "begin").alias("begin"), last_value("time", main).alias("time"),
        last_value("offset", main).alias("offset"), last_value("base_slot", main & F.col("offset").isNotNull()).alias("base_slot"),
    )
    begins = F.collect_list(F.struct("slot", "begin")).over(Window.partitionBy("source_id", "day"))
    both = slots.withColumn("base_slot", F.coalesce("base_slot", "slot")).withColumn("__begins", begins)
    both = both.withColumn("base_begin", F.get(F.filter("__begins", lambda b: b["slot"] == F.col("base_slot")), F.lit(0))["begin"])
    time = F.coalesce("time", apply_offset(F.col("base_begin"), F.col("offset")))
    out = both.select("source_id", "day", "slot", F.lit(0).alias("session"), given(time).alias("__time"), "begin", F.lit(None).cast("string").alias("label"), F.col("time").isNull().alias("derived"))
    return out.withColumnRenamed("__time", "time").select(*ROW)


def weekly_rows(session: DataFrame, today: str, days: int) -> DataFrame:
    """Every Friday of the horizon with its sessions; `session` has source_id, idx (from 1), label, text, season?.

    A text without a time gives no row, but its number stays taken.
    """
    friday = F.filter(horizon_days(F.lit(today).cast("date"), days), is_friday)
    out = session.withColumn("day", F.explode(friday)).filter(F.col("season").isNull() | (F.col("season") == season(F.col("day"))))
    row = out.select("source_id", "day", F.lit("jumuah").alias("slot"), F.col("idx").alias("session"), given(parse_time(F.col("text"))).alias("time"), F.lit(None).cast("string").alias("begin"), "label", F.lit(True).alias("derived"))
    return row


def _by_day(begins: DataFrame) -> DataFrame:
    """(source_id, slot, __begins): the begins of each day of a slot, at most a horizon's."""
    per = begins.groupBy("source_id", "slot").agg(F.collect_list(F.struct("day", "begin")).alias("l"))
    day = F.array_distinct(F.transform("l", lambda x: x["day"]))
    once = F.transform("l", lambda x: F.struct(x["day"].alias("day"), F.array(x["begin"]).alias("begins")))
    several = F.transform(day, lambda d: F.struct(d.alias("day"), F.transform(F.filter("l", lambda x: x["day"] == d), lambda x: x["begin"]).alias("begins")))
    return per.select("source_id", "slot", F.map_from_entries(F.when(F.size(day) == F.size("l"), once).otherwise(several)).alias("__begins"))


def rule_rows(rule: DataFrame, today: str, days: int, begins: DataFrame | None = None) -> DataFrame:
    """Every day of the horizon with each rule: a fixed time, or an offset from the slot's begin.

    `rule` has source_id, slot, fixed, offset; `begins` has source_id, day, slot, begin.
    """
    start = F.lit(today).cast("date")
    text = F.col("text")
    known = readings(rule.select(F.col("fixed").alias("text")), __early=parse_time(text, F.lit(False)), __late=parse_time(text, F.lit(True)), __plain=parse_time(text))
    out = rule.join(known, F.col("fixed") == F.col("__text"), "left").withColumn("__fixed", F.when(F.col("slot") == "fajr", F.col("__early")).when(F.col("slot") != "fajr", F.col("__late")).otherwise(F.col("__plain")))
    if begins is None:
        out = out.withColumn("day", F.explode(horizon_days(start, days))).withColumn("begin", F.lit(None).cast("string"))
    else:
        # rules meet the begins of their slot before they are repeated for every day
        out = out.join(_by_day(begins.filter(F.col("day").between(start, F.date_add(start, days)))), ["source_id", "slot"], "left")
        out = out.withColumn("day", F.explode(horizon_days(start, days))).withColumn("begin", F.explode_outer(F.try_element_at("__begins", F.col("day"))))
    time = F.coalesce("__fixed", apply_offset(F.col("begin"), F.col("offset")))
    return out.select("source_id", "day", "slot", F.lit(0).alias("session"), given(time).alias("time"), "begin", F.lit(None).cast("string").alias("label"), F.lit(True).alias("derived"))


def expand_pages(source: DataFrame, fetched: DataFrame, today: str, days: int) -> DataFrame:
    """One document a source and month of the horizon, from a URL template; ok is false without the current month.

    `source` has source_id and template with {year} and {month:02d}; `fetched` url, html.
    """
    from ..functions.scalars import horizon_months

    months = source.select("*", F.posexplode(horizon_months(F.lit(today).cast("date"), days)).alias("idx", "month_start"))
    y, m = F.year("month_start"), F.month("month_start")
    url = F.replace(F.replace(F.replace("template", F.lit("{year}"), y.cast("string")), F.lit("{month:02d}"), F.format_string("%02d", m)), F.lit("{month}"), m.cast("string"))
    pages = months.select("source_id", "idx", y.alias("year"), m.alias("month"), url.alias("url")).join(fetched, "url", "left")
    current = pages.filter("idx = 0").select("source_id", F.col("html").isNotNull().alias("ok"))
    return pages.join(current, "source_id")
