"""Captured pages, candidate bundles and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE = "venue_id long, url string, pages array<struct<url:string,html:string,score:double>>, evidence array<string>"


def cached_scan(request: DataFrame, page: DataFrame) -> DataFrame:
    """`request` (url, requires_js, ...) with the html of captured pages; scripts ask for a fetch of their own, as does a URL that was not captured."""
    known = page.groupBy("url").agg(F.max("html").alias("__html"))
    both = request.join(known, "url", "left").withColumn("html", F.when(~F.coalesce("requires_js", F.lit(False)), F.col("__html"))).drop("__html")
    return both.withColumn("to_fetch", F.col("html").isNull())


def save_bundles(bundle: DataFrame, path: str) -> None:
    """One folder a venue, JSON lines."""
    bundle.write.partitionBy("venue_id").mode("overwrite").json(path)


def load_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundles of any age: what an older one lacks is null, its evidence empty."""
    rows = spark.read.schema(BUNDLE).json(path)
    return rows.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def append_runs(run: DataFrame, path: str) -> None:
    """Add rows to the run log."""
    run.write.mode("append").parquet(path)
