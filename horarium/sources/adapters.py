"""Logical tables of the engine over a star schema of customers, events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship_code
from ..operators.ranking import last_wins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue_id, name, city, lat, lng: customers and their nations."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("venue_id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.expr("50D + cast(c_custkey * 37 % 800 as double) / 100D").alias("lat"), F.expr("-6D + cast(c_custkey * 53 % 800 as double) / 100D").alias("lng"))


def occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue_id, day, slot, session, time, begin: the last event of each user, day and type."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and ts is not null")
    slot = F.expr("case event_type when 'view' then 'fajr' when 'click' then 'dhuhr' when 'signup' then 'asr' when 'purchase' then 'maghrib' when 'error' then 'isha' end")
    rows = e.select(F.col("user_id").alias("venue_id"), F.col("ts").cast("date").alias("day"), slot.alias("slot"), F.lit(0).alias("session"), F.date_format("ts", "HH:mm").alias("time"), F.lit(None).cast("string").alias("begin"), "ts", "event_id")
    return last_wins(rows, ["venue_id", "day", "slot"], "ts", "event_id").drop("ts", "event_id")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue_id, day: the days of `occurrence`; every event is of one, so that the last of each need not be found."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and ts is not null")
    return e.select(F.col("user_id").alias("venue_id"), F.col("ts").cast("date").alias("day")).distinct()


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, venue_id, status, url, flags: orders."""
    status = F.expr("case o_orderstatus when 'F' then 'authored' when 'O' then 'candidate' else 'review' end")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("venue_id"), status.alias("status"),
        F.expr("case when o_orderkey % 5 = 0 then null else concat('https://host', o_orderkey % 97, '.example/', o_orderkey) end").alias("url"),
        F.expr("case when o_orderkey % 7 = 0 then '[\"jumuah_missing\"]' when o_orderkey % 7 = 1 then '[\"partial_horizon\",\"jumuah_missing\"]' when o_orderkey % 7 = 2 then '[]' end").alias("flags"),
        F.lit(None).cast("string").alias("review_reason"),
    )
