"""What several operators share: shared-folder tables, held-out split, byte views.

Every operator takes ordinary DataFrames.  Text is handled as whole rows; the
numpy helpers work on the UTF-8 bytes of an Arrow column in blocks of a few
megabytes, so that a task's memory does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship_code
from ..sources.scratch import kept as stash
from ..sources.scratch import scratch_path, spread

__all__ = ["avalanche", "bitmap", "byte_view", "drop_stash", "held_out", "integer_ids", "load", "may_be_in", "pick", "row_blocks", "scratch_path", "span_hashes", "stash", "word_spans"]

BLOCK_BYTES = 4 << 20
_PAD = 16
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S32, _S29 = np.uint64(32), np.uint64(29)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_code(spark)
    scan = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(scan) if table == "documents" else scan


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stash that nothing will read again."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def integer_ids(docs: DataFrame) -> DataFrame:
    """`docs`, whose ids must have the order of numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be an integer column, not {kind}")
    return docs


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels may not be learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bitmap(marks: DataFrame, least: int = 20, most: int = 27) -> tuple[np.ndarray, int]:
    """(words, bits): a bitmap of the lower `bits` bits of the distinct longs in the one column of `marks`.

    It has about 16 bits a mark, at most 2**`most` (16 MB, whatever the corpus).
    Beyond some 90 million marks it lets more of the others through, which costs
    work and never a result.
    """
    marks = marks.toDF("mark")
    n = marks.agg(F.approx_count_distinct("mark")).first()[0]
    bits = min(most, max(least, (16 * n).bit_length()))
    low = F.pmod("mark", F.lit(1 << bits))
    words = marks.select(low.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64), bits


def bits_set(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Which bits of a bitmap are set."""
    b = bit.astype(np.uint64)
    return (table[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)) == 1


def may_be_in(column: Column, marks: DataFrame) -> Column:
    """Whether a long column is among `marks`; true for a few others too (see `bitmap`)."""
    table, bits = bitmap(marks)
    return in_bitmap(F.pmod(column, F.lit(1 << bits)), marks.sparkSession.sparkContext.broadcast(table))


def in_bitmap(bit: Column, shared) -> Column:
    """Whether a bit of a broadcast bitmap is set."""

    @F.pandas_udf("boolean")
    def wanted(b: pd.Series) -> pd.Series:
        return pd.Series(bits_set(shared.value, b.to_numpy()))

    return wanted(bit)


def pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is in `ids`, and a few others, without a shuffle."""
    return docs.filter(may_be_in(F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id"))))


def avalanche(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, element-wise."""
    h = (h ^ (h >> _S32)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S32)


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n, kind = len(col), np.int64 if wide else np.int32
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def row_blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, padded copy of their bytes, offsets from 0) in blocks of about `limit` bytes; one long row makes a block of its own."""
    data, offs = byte_view(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        buf = np.zeros(int(offs[hi] - offs[lo]) + _PAD, np.uint8)
        buf[: len(buf) - _PAD] = data[offs[lo] : offs[hi]]
        yield lo, hi, buf, offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes within each row; `in_word` has 256 flags."""
    n = int(offs[-1])
    mask = in_word[buf[:n]]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(mask[1:], mask[:-1], out=change[1:n])
    change[offs] = True
    cuts = np.flatnonzero(change)
    if len(cuts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = mask[cuts[:-1]]
    return cuts[:-1][keep], cuts[1:][keep]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; `buf` is padded by 16 bytes."""
    words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    size = ends - starts
    h = avalanche(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    low = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        left = np.minimum(size[todo] - at, 8)
        h[todo] = avalanche(h[todo] ^ (words[starts[todo] + at] & low[left]))
        at += 8
        todo = todo[size[todo] > at]
    return h
