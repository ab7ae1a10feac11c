"""Line de-duplication against levelled sorted runs of line hashes.

Only DataFrame and SQL functions are used.

1. *Lines.*  A text is split at line feeds.  A line's key is the line without the
   blanks at both ends and with A-Z lower-cased; keys of fewer than ``SHORTEST``
   code points never go.  A key is kept as 128 bits of hash.
2. *Runs.*  The index is a family of tables, bucketed and sorted by hash, that lie
   in the shared folder: each key is in exactly one, with the documents that held
   it when it came and the largest of their ids.  A new batch of documents is
   merge-joined with the runs: keys that no run holds become a run of their own;
   keys that a run holds go to a small table of repeats, and so do new keys of
   several documents.  The runs are never shuffled again.
3. *Compaction.*  Two runs of one level are merged into one of the next, so a
   batch meets at most a logarithm of the number of batches.
4. *Decision.*  The repeats, summed by key, say which keys at least ``FEWEST``
   documents hold and which document keeps them.  Their lines are listed by
   document, and the texts are put together again from what lies between.

A line that is everywhere costs a row a document until it is counted, by partial
sums where the rows are; the join that lists lines has the repeats, one a key, on
its other side, so that Spark splits a hot key's partition.

Edge cases: a null or empty text is one empty line; rows of one doc_id are one
document, whose lines count once, and each of the rows is reported; a null doc_id
is a document that comes before all others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stash, scratch_path, stash

SHORTEST, FEWEST = 20, 3
BATCHES = 4
KEY = ["h1", "h2"]
_BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The key of a line."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity() -> list[Column]:
    """Names of a row: its document and 128 bits of its text; rows that share them are equal."""
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def line_keys(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, doc_id, t1, t2, line, h1, h2) of every line whose key is long enough."""
    one = docs.select(*_identity(), F.posexplode(_lines()).alias("line", "text"))
    one = one.select("doc_id", "t1", "t2", "line", key_of(F.col("text")).alias("key")).filter(F.length("key") >= SHORTEST)
    hashes = F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    return one.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "t1", "t2", "line", *hashes)


@dataclass
class LineRuns:
    """A family of sorted runs; `levels` has (level, table, files) from the oldest on."""

    spark: SparkSession
    buckets: int  # of every run, so that runs meet without a shuffle
    levels: list[tuple[int, str, str]] = field(default_factory=list)
    repeats: list[DataFrame] = field(default_factory=list)

    def _write(self, run: DataFrame) -> tuple[str, str]:
        """A sorted run as a bucketed table: one file a bucket."""
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        dealt = run.repartition(self.buckets, *KEY)
        dealt.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name, path

    def _forget(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def add(self, lines: DataFrame) -> None:
        """Take in a batch (doc_id, h1, h2) of documents that no earlier batch held."""
        own = lines.groupBy(*KEY).agg(F.count_distinct(F.struct("doc_id")).alias("docs"), F.max("doc_id").alias("owner"))
        met = own
        for n, (_, name, _) in enumerate(self.levels):
            run = self.spark.table(name).select(*KEY, F.col("docs").alias(f"docs{n}"), F.col("owner").alias(f"owner{n}"))
            met = met.join(run.hint("merge"), KEY, "left")
        held = F.coalesce(*[F.col(f"docs{n}") for n in range(len(self.levels))], F.lit(None).cast("long"))
        least = F.coalesce(*[F.col(f"owner{n}") for n in range(len(self.levels))], F.lit(None).cast(own.schema["owner"].dataType))
        met = stash(met.select(*KEY, "docs", "owner", held.alias("held"), least.alias("keeper")), "line-met")
        self.repeats.append(
            met.filter("held IS NOT NULL OR docs > 1")
            .select(*KEY, F.coalesce("held", "docs").alias("base"), F.when(F.col("held").isNull(), 0).otherwise(F.col("docs")).alias("more"), F.greatest("owner", "keeper").alias("owner"))
        )
        self.levels.append((0, *self._write(met.filter("held IS NULL").select(*KEY, "docs", "owner"))))
        self._compact()

    def _compact(self) -> None:
        """Merge runs of one level; no key is in both."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (level, a, a_files), (_, b, b_files) = self.levels[-2:]
            old, new = self.spark.table(a), self.spark.table(b).select(*KEY, F.col("docs").alias("docs1"), F.col("owner").alias("owner1"))
            both = old.join(new.hint("merge"), KEY, "full").select(*KEY, F.coalesce("docs", "docs1").alias("docs"), F.coalesce("owner", "owner1").alias("owner"))
            merged = self._write(both)
            self.levels[-2:] = [(level + 1, *merged)]
            self._forget(a, a_files)
            self._forget(b, b_files)

    def decisions(self, fewest: int = FEWEST) -> DataFrame:
        """(h1, h2, owner) of the keys that at least `fewest` documents hold; `owner` keeps its lines."""
        every = self.repeats[0]
        for more in self.repeats[1:]:
            every = every.unionByName(more)
        total = every.groupBy(*KEY).agg((F.max("base") + F.sum("more")).alias("docs"), F.max("owner").alias("owner"))
        return total.filter(F.col("docs") >= fewest).select(*KEY, "owner")

    def close(self) -> None:
        for _, name, path in self.levels:
            self._forget(name, path)
        for one in self.repeats:
            drop_stash(one)


def dropped_lines(docs: DataFrame, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """(doc_id, t1, t2, gone): the numbers of the lines that the rows of this name lose, in order."""
    keys = stash(line_keys(docs, batches), "line-keys")
    spark = docs.sparkSession
    runs = LineRuns(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(batches):
        runs.add(keys.filter(F.col("batch") == k))
    owners = stash(runs.decisions(), "line-owners")
    runs.close()
    lost = keys.join(owners, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    return lost.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def drop_lines(docs: DataFrame, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """doc_id, kept, n_lines and n_dropped of every row; `kept` is the text without its lost lines."""
    gone = dropped_lines(docs, batches, buckets).toDF("of", "u1", "u2", "gone")
    rows = docs.select(*_identity(), F.coalesce("text", F.lit("")).alias("text"))
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    lines = both.select("doc_id", "text", _lines().alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # what lies between two lost lines, as slices: linear in the lines
    between = F.expr("flatten(transform(sequence(0, size(gone)), i -> slice(lines, if(i = 0, 1, gone[i - 1] + 2), if(i = size(gone), size(lines), gone[i]) - if(i = 0, 0, gone[i - 1] + 1))))")
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(between, "\n"))
    return lines.select("doc_id", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))


def report(docs: DataFrame, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    return drop_lines(docs, batches, buckets).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.n, k.line, c.key IS NOT NULL AND k.doc_id <> c.owner AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
