"""A table of rows by source in versions: a batch replaces the rows of its sources, and a manifest switches to them.

The table is dealt into buckets by source; a version is a file that names the
folder of every bucket.  A batch rewrites the buckets that its sources are in,
into folders that no version names yet, and then adds its manifest under the next
number, which can be done once.  A batch that fails before leaves folders that
nobody reads; one that is repeated finds its number among the writer's and
changes nothing.  Any file system that Spark writes to will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import replace_by_source

BUCKETS = 64
_DIGITS = 12


class VersionConflict(RuntimeError):
    """Another batch took the number of this one's version."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def manifest(spark: SparkSession, root: str) -> dict:
    """The last version: number, schema, bucket count, folder of each bucket, last batch of each writer."""
    names = [n for n in _children(spark, f"{root}/versions") if n.endswith(".json") and n[:_DIGITS].isdigit()]
    if not names:
        return {"number": 0, "schema": None, "count": BUCKETS, "buckets": {}, "writers": {}}
    return json.loads(spark.read.text(f"{root}/versions/{names[-1]}", wholetext=True).first()[0])


def _switch(spark: SparkSession, root: str, version: dict) -> None:
    """Add a manifest; a number that is taken is an error."""
    fs, at = _fs(spark, f"{root}/versions/{version['number']:0{_DIGITS}d}.json")
    _, draft = _fs(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(version, sort_keys=True).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise VersionConflict(f"version {version['number']} of {root} was written by another batch")


def _bucket(count: int):
    return F.pmod(F.xxhash64(F.col("source_id")), F.lit(count)).cast("int")


def _read(spark: SparkSession, root: str, version: dict, buckets: list[str]) -> DataFrame:
    paths = [f"{root}/{version['buckets'][b]}" for b in buckets if b in version["buckets"]]
    return spark.read.schema(version["schema"]).parquet(*paths) if paths else spark.createDataFrame([], version["schema"])


def load(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last version."""
    version = manifest(spark, root)
    if version["schema"] is None:
        raise FileNotFoundError(f"{root} has no version")
    return _read(spark, root, version, list(version["buckets"]))


def replace_sources(rows: DataFrame, sources: DataFrame, root: str, writer: str, batch: int, buckets: int = BUCKETS) -> bool:
    """Replace all rows of `sources` (source_id) by `rows`; False if the writer's batch was taken in before.

    The number of buckets is that of the first version.
    """
    spark, version = rows.sparkSession, manifest(rows.sparkSession, root)
    if version["writers"].get(writer, -1) >= batch:
        return False
    if version["schema"] is None:
        version |= {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "count": buckets}
    count = version["count"]
    named = sources.select("source_id").unionByName(rows.select("source_id"))
    touched = sorted(str(r[0]) for r in named.select(_bucket(count)).distinct().collect())  # at most the buckets
    new = replace_by_source(_read(spark, root, version, touched), rows, named.distinct())
    folder = f"data/{version['number'] + 1:0{_DIGITS}d}-{uuid.uuid4().hex}"
    new.withColumn("bucket", _bucket(count)).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}")
    made = {n.removeprefix("bucket="): f"{folder}/{n}" for n in _children(spark, f"{root}/{folder}") if n.startswith("bucket=")}
    kept = {b: p for b, p in version["buckets"].items() if b not in touched}
    _switch(spark, root, version | {"number": version["number"] + 1, "buckets": kept | made, "writers": version["writers"] | {writer: batch}})
    return True
