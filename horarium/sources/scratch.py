"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..deploy import ship_code


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is named and the driver is the only executor (tests)."""
    ship_code(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="horarium-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: dict[str, list[str]] = {}  # by application: paths that were handed out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `clear` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this session: results that were read from them must have been written."""
    for name in _made.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back.

    Cuts the plan and the lineage: what is read several times is computed once,
    and a stage that loses an executor rereads the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`kept`, and joined by sorting, never by broadcast.

    Spark takes the size of a table's files for that of its rows.  Cells and
    elements repeat so much that files are a hundredth of their rows, and what
    looks small enough to broadcast fills the driver.
    """
    return kept(df, name).hint("merge")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt to all of them: parsing costs more than moving a small table.

    `scan` must be a plain read; larger tables stay as they are read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
