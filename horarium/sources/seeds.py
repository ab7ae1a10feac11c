"""Readers of seed files and host lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Hosts that never carry a venue's own timetable.
BLOCKED_HOSTS = (
    "facebook.com", "fb.com", "fb.me", "instagram.com", "twitter.com", "x.com", "tiktok.com", "linkedin.com", "pinterest.com",
    "youtube.com", "youtu.be", "linktr.ee", "bit.ly", "tinyurl.com", "google.com", "goo.gl", "g.page", "maps.apple.com",
    "whatsapp.com", "wa.me", "t.me", "telegram.me", "eventbrite.com", "eventbrite.co.uk", "web.archive.org",
    "mosques.muslimsinbritain.org", "heritage.ismaili.net", "huddersfieldstudent.com", "bradfordhospitals.nhs.uk",
)

SEED = "id string, name string, aliases array<string>, address string, city string, postcode string, country string, lat double, lng double, website_url string"


def clean_export(raw: DataFrame) -> DataFrame:
    """Seed rows of a raw export's records: ids and coordinates renamed, address lines joined, defaults set."""
    lines = F.filter(F.array("address_line1", "address_line2"), lambda x: x.isNotNull() & (x != ""))
    return raw.select(
        F.col("external_id").alias("id"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.nullif(F.array_join(lines, ", "), F.lit("")).alias("address"), "city", "postcode", F.coalesce("country", F.lit("GB")).alias("country"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lng"),
    )


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Records of a raw export: one JSON object with an array of venues under its first array field."""
    whole = spark.read.option("multiLine", True).json(path)
    field = next(f.name for f in whole.schema if f.dataType.typeName() == "array")
    return clean_export(whole.select(F.explode(field).alias("r")).select("r.*"))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A seed, either one JSON array a file or one record a line (as `write_seed` writes).

    A record without id, name, lat or lng is an error that names its place in
    its file, whichever columns are read later.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    text = text.withColumn("value", F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.concat(F.lit("["), F.regexp_replace("value", r"\}\s*\n\s*\{", "},\n{"), F.lit("]"))))
    records = text.select("file", F.posexplode(F.from_json("value", f"array<struct<{SEED.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})).alias("k", "r"))
    lacks = F.filter(F.array(*[F.when(F.col("r")[c].isNull(), c) for c in ("id", "name", "lat", "lng")]), lambda x: x.isNotNull())
    why = F.format_string("%s: record %d has no %s", "file", "k", F.array_join(lacks, ", "))
    # the check is part of every column, so none can be read around it
    return records.select(F.when(F.size(lacks) > 0, F.raise_error(why)).otherwise(F.col("r")).alias("r")).select("r.*")


def write_seed(rows: DataFrame, path: str) -> None:
    """One JSON record a line; non-ASCII characters are kept."""
    rows.write.json(path)


def read_hosts(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Blocked hosts: the fixed ones and a file's lines, without blanks and comments."""
    hosts = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string")
    if path is None:
        return hosts
    own = spark.read.text(path).select(F.lower(F.trim("value")).alias("host")).filter("host <> '' and not startswith(host, '#')")
    return hosts.unionByName(own).distinct()
