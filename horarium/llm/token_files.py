"""Token-id files: one zstandard frame a document, a shared dictionary, an offset index.

A shard is one binary file::

    header   magic "HTOK1\\0\\0\\0", blake2b-128 of the dictionary, bytes per id (u32), padding
    frames   one zstandard frame a document, of its ids in 2 or 4 bytes each
    index    documents' ids, ends of their frames, numbers of ids (three i64 arrays)
    footer   number of documents, place of the index (two u64)

The dictionary is trained on the serialised ids of a bounded sample
(``sample_docs`` documents of least hash, the first ``sample_chars`` characters
of each); it only helps compression, every document is stored whole.  Documents
are in ascending doc_id across the shards.  A short document is read alone
(`read_document`): footer, index entry, one frame.

A shard's name is unique to the task attempt, and only the manifest, a table
that Spark commits, says which shards count; a lost executor leaves at most an
orphan.

Edge cases: null and empty texts hold the end id alone; repeated rows and equal
doc_ids are stored one after another (ordered by text); doc_id must be an
integer column (TypeError); null doc_ids come first and are stored as the least long; an empty table gives no shard; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import integer_ids, scratch_path, stash
from .shards import open_in, write_file
from .word_encoder import word_encoder

MAGIC = b"HTOK1\0\0\0"
HEADER = struct.Struct("<8s16sI4x")
FOOTER = struct.Struct("<QQQ")
END_ID = 2
SHARD_BYTES = 32 << 20
LEVEL = 3


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.blake2b(dictionary, digest_size=16).digest()


def train_dictionary(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """A dictionary for small arrays of ids; their plain bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


class ShardWriter:
    """Collects compressed documents and writes them as one file."""

    def __init__(self, dictionary: bytes, width: int) -> None:
        self.width = width
        self.head = HEADER.pack(MAGIC, dictionary_hash(dictionary), width)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        self.frames: list[bytes] = []
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        self.size = self.nulls = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """`ids`: little-endian unsigned 32-bit; documents without an id come first."""
        self.nulls += doc_id is None
        wide = np.frombuffer(ids, "<u4")
        frame = self.packer.compress(wide.astype(f"<u{self.width}").tobytes())
        self.frames.append(frame)
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.counts.append(len(wide))
        self.size += len(frame)

    def finish(self, uri: str) -> None:
        ends = np.cumsum([len(f) for f in self.frames])
        index = np.stack([np.array(self.doc_ids, "<i8"), ends.astype("<i8"), np.array(self.counts, "<i8")])
        write_file(uri, b"".join([self.head, *self.frames, index.tobytes(), FOOTER.pack(len(self.frames), HEADER.size + self.size, self.nulls)]))


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        self.file = open_in(uri)
        magic, mark, self.width = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC or mark != dictionary_hash(dictionary):
            raise ValueError(f"{uri}: not a shard of this dictionary")
        n, place, self.nulls = FOOTER.unpack(self.file.read_at(FOOTER.size, self.file.size() - FOOTER.size))
        self.doc_ids, ends, self.counts = np.frombuffer(self.file.read_at(24 * n, place), "<i8").reshape(3, n)
        self.ends = np.concatenate([[0], ends]) + HEADER.size
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        frame = self.file.read_at(int(self.ends[k + 1] - self.ends[k]), int(self.ends[k]))
        raw = self.unpacker.decompress(frame, max_output_size=max(1, int(self.counts[k]) * self.width))
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def read_document(uri: str, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    """Ids of one document of a shard, or None."""
    shard = ShardReader(uri, dictionary)
    k = shard.nulls + int(np.searchsorted(shard.doc_ids[shard.nulls :], doc_id))
    return shard.ids(k) if k < len(shard) and shard.doc_ids[k] == doc_id else None


def _sampled(docs: DataFrame, tokenizer: str, sample_docs: int, sample_chars: int) -> list[bytes]:
    least = docs.select("doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(sample_docs)
    rows = docs.join(F.broadcast(least.distinct()), "doc_id").select(F.substring("text", 1, sample_chars).alias("text")).limit(2 * sample_docs).collect()
    return [word_encoder(tokenizer).encode(r.text) for r in rows]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, sample_docs: int = 1000, sample_chars: int = 20_000) -> tuple[DataFrame, bytes]:
    """Encode and write all documents; returns the manifest (part, seq, uri, n_docs, n_tokens) and the dictionary."""
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "tokens")
    width = 2 if word_encoder(tokenizer).library.get_vocab_size(with_added_tokens=True) <= 65536 and end_id < 65536 else 4
    samples = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in _sampled(docs, tokenizer, sample_docs, sample_chars)]
    dictionary = train_dictionary([x for x in samples if x])
    write_file(f"{folder}/dictionary-{dictionary_hash(dictionary).hex()}", dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, rows = word_encoder(tokenizer), TaskContext.get().partitionId(), []
        end, attempt = end_id.to_bytes(4, "little"), uuid.uuid4().hex
        shard = ShardWriter(shared.value, width)

        def close() -> None:
            if shard.frames:
                uri = f"{folder}/{part:06d}-{len(rows):06d}-{attempt}.htok"
                shard.finish(uri)
                rows.append((part, len(rows), uri, len(shard.frames), sum(shard.counts)))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard.add(doc_id, enc.encode(text.as_py()) + end)
                if shard.size >= SHARD_BYTES:
                    close()
                    shard = ShardWriter(shared.value, width)
        close()
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "seq", "uri", "n_docs", "n_tokens"])

    ranged = integer_ids(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stash(ranged.mapInArrow(write, "part int, seq int, uri string, n_docs long, n_tokens long"), "tokens-manifest")
    return manifest, dictionary


def read_token_files(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(dictionary)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.select("uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = ShardReader(uri, shared.value)
                starts = start + np.concatenate([[0], np.cumsum(shard.counts)[:-1]]).astype(np.int64)
                crc = [zlib.crc32(shard.ids(k).tobytes()) for k in range(len(shard))]
                ids = pa.array(shard.doc_ids, pa.int64(), mask=np.arange(len(shard)) < shard.nulls)
                yield pa.record_batch([ids, pa.array(starts), pa.array(shard.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition("uri").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
