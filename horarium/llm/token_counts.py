"""Token counts of documents in flat files that have no index.

A flat file is nothing but token ids (little-endian, 2 or 4 bytes) with an
end-of-document id after each document.  Blocks of a file are searched for that
id with numpy, each on its own; a block gives the lengths of the documents that
end in it, counted from its start, and what is left over.  A prefix scan over a
file's blocks (Spark windows over one row a block) then gives the number of
documents before each block and the length carried into its first one.

Edge cases: a document may span any number of blocks; ids after the last
separator form an unfinished document, reported with ``finished`` false; empty
documents (null and empty texts) count zero ids; repeated rows are counted one by
one and equal texts alike, also under one doc_id; other columns are ignored; ids
must fit the width (ValueError); an empty file or table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .bpe_tree import encoder
from .common import scratch_path, stash
from .shards import open_in, write_file

FILE_BYTES = 64 << 20
BLOCK_TOKENS = 1 << 20


def write_flat_files(docs: DataFrame, tokenizer: str, eod: int, width: int = 2) -> DataFrame:
    """Write every document's ids and `eod` to flat files; returns (uri, ordinal, doc_id), one row a document.

    Special-token strings in a text are plain text here, so that `eod` only
    stands after documents.  The names are joined by sorting: the files of the
    lengths are so much smaller than their rows that Spark would broadcast them.
    """
    if max(eod, encoder(tokenizer, specials=False).library.get_vocab_size(with_added_tokens=True) - 1) >> (8 * width):
        raise ValueError(f"ids of this vocabulary do not fit {width} bytes")
    folder, kind = scratch_path(docs.sparkSession, "flat"), docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, attempt, seq = encoder(tokenizer, False), TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        parts: list[bytes] = []
        named: list[pa.Array] = []
        n = size = 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/{part:06d}-{seq:06d}-{attempt}.ids"
            write_file(uri, b"".join(parts))
            ids = pa.chunked_array(named).combine_chunks()
            return pa.record_batch([pa.array([uri] * n, pa.string()), pa.array(np.arange(n)), ids], names=["uri", "ordinal", "doc_id"])

        for b in batches:
            for k, t in enumerate(b.column(1)):
                parts.append(np.array([*enc.encode(t.as_py()), eod], f"<u{width}").tobytes())
                named.append(b.column(0)[k : k + 1])
                n, size = n + 1, size + len(parts[-1])
                if size >= FILE_BYTES:
                    yield close()
                    parts, named, n, size, seq = [], [], 0, 0, seq + 1
        if n:
            yield close()

    return stored(docs.select("doc_id", "text").mapInArrow(write, f"uri string, ordinal long, doc_id {kind}"), "flat-names")


def count_tokens(files: DataFrame, eod: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(uri, ordinal, n_tokens, finished) of every document in the files; `files` has uri."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([open_in(u).size() // width for u in b.column(0).to_pylist()], pa.int64())], names=["uri", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails, ends, lengths = [], [], []
            for uri, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(open_in(uri).read_at(block_tokens * width, block * block_tokens * width), f"<u{width}")
                at = np.flatnonzero(ids == eod)
                lengths.append(np.diff(at, prepend=-1) - 1)
                ends.append(len(at))
                tails.append(len(ids) - (at[-1] + 1 if len(at) else 0))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ends, pa.int64()), pa.array(tails, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["uri", "block", "ends", "tail", "lengths"])

    blocks = files.mapInArrow(sizes, "uri string, ids long").filter("ids > 0")
    blocks = blocks.select("uri", F.explode(F.expr(f"sequence(0L, (ids - 1) div {block_tokens})")).alias("block")).repartition("uri", "block")
    scanned = stash(blocks.mapInArrow(scan, "uri string, block long, ends long, tail long, lengths array<long>"), "flat-blocks")
    order = Window.partitionBy("uri").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    scan_row = scanned.withColumn("ordinal", F.coalesce(F.sum("ends").over(before), zero)).withColumn("run", F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(before), zero)).withColumn("left", F.coalesce(F.lag("tail").over(order), zero))
    carried = scan_row.withColumn("carry", F.sum("left").over(Window.partitionBy("uri", "run").orderBy("block")))
    done = carried.select("uri", F.col("ordinal").alias("first"), "carry", F.posexplode("lengths").alias("k", "length"))
    done = done.select("uri", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("finished"))
    last = carried.withColumn("at", F.row_number().over(Window.partitionBy("uri").orderBy(F.desc("block")))).filter("at = 1")
    rest = F.col("tail") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)
    open_end = last.select("uri", (F.col("ordinal") + F.col("ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("finished")).filter("n_tokens > 0")
    return done.unionByName(open_end)


def document_counts(docs: DataFrame, tokenizer: str, eod: int, width: int = 2) -> DataFrame:
    """doc_id and n_tokens of every document, counted in the files alone."""
    names = write_flat_files(docs, tokenizer, eod, width)
    counts = count_tokens(names.select("uri").distinct(), eod, width).filter("finished")
    return names.join(counts, ["uri", "ordinal"]).select("doc_id", "n_tokens")
