"""Document fingerprints: a canonical exact digest.

A text is normalised (NFKC), case-folded, its runs of white space become one
blank and its ends are stripped; the fingerprint is the 128-bit xxhash of the
result.  Texts with one digest form a bucket; inside a bucket of several texts
the canonical bytes are compared, and should different texts ever share a
digest, the later ones (in byte order) get a suffix, so equal fingerprints mean
equal canonical texts and the other way round.

A bucket holds one text only if the least and the greatest of its canonical
texts are equal bytes; both are pre-aggregated where the rows are, so a popular
text costs a row a task.  Only buckets that several rows share are compared.
Their rows and texts are picked out by bitmaps of bounded size, not by a join of
all.

Likeness of two fingerprints is 1.0 if they are equal, else 0.0: an exact
digest knows no degrees.

Edge cases: null and empty texts, and texts of white space alone, share the
fingerprint of the empty text; rows of one id are ordered by a hash of their
text, and each gets its own row; doc_id must be an integer column (TypeError), and rows without one
come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import integer_ids, may_be_in, stash

_BLANKS = re.compile(r"\s+")


def canonical(text: str | None) -> str:
    """NFKC, case-folded, white space folded."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return _BLANKS.sub(" ", text).strip()


def digest(text: str | None, digits: int = 32) -> str:
    """Hexadecimal digest; fewer digits are for tests of the byte comparison."""
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))[:digits]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the next text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


_NAME = ["t1", "t2"]  # of a text
_NEXT = ["n1", "n2"]  # of its successor
_DONE = "doc_id long, n_chars long, t1 long, t2 long, n1 long, n2 long, edited_sha256 string, digest string, edited_digest string, next_digest string"
_PAIRED = f"edge int, part int, text string, {_DONE}"


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def _done(doc_id, text: str, name: tuple, next_name: tuple, following: str, own: str, after: str, digits: int) -> tuple:
    new = edited(text, following)
    return doc_id, len(text), *name, *next_name, hashlib.sha256(new.encode()).hexdigest(), own, digest(new, digits), after


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _pair_up(digits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their successors, within a sorted partition.

    edge 0: done; edge 1: the partition's first document; edge 2: its last,
    whose successor is elsewhere.  Only edges carry their text.
    """
    part, last = TaskContext.get().partitionId(), None
    for b in batches:
        rows = []
        for doc_id, t, *name in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            text = t.as_py()
            own = digest(text, digits)
            if last is None:
                rows.append((1, part, text, doc_id, None, *name, *[None] * 6))
            else:
                rows.append((0, part, None, *_done(*last[:3], name, text, last[3], own, digits)))
            last = (doc_id, text, name, own)
        yield _batch(rows, _PAIRED)
    if last:
        yield _batch([(2, part, last[1], last[0], None, *last[2], *[None] * 6)], _PAIRED)


def successor_digests(docs: DataFrame, digits: int = 32) -> DataFrame:
    """Every document with its digest, that of its edited text and that of the next document by doc_id."""
    order = ["doc_id", *_NAME, "copy"]  # so that even a third of all rows under one id spreads
    ranged = _named(integer_ids(docs)).withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
    paired = stash(ranged.mapInArrow(lambda it: _pair_up(digits, it), _PAIRED), "fingerprint-pairs")
    firsts = paired.filter("edge = 1").select("part", F.col("t1").alias("n1"), F.col("t2").alias("n2"), F.col("text").alias("following"))
    by_part = Window.orderBy("part")  # one row a partition, without its text
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_part = firsts.select("part").select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(whole)).alias("next_part"))
    seams = paired.filter("edge = 2").select("part", "doc_id", "text", *_NAME).join(next_part, "part").drop("part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_done(d, t, (t1, t2), (n1, n2), f, digest(t, digits), digest(f, digits), digits) for d, t, t1, t2, f, n1, n2 in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield _batch(rows, _DONE)

    done = paired.filter("edge = 0").select(*[x.split()[0] for x in _DONE.split(", ")])
    return done.unionByName(seams.select("doc_id", "text", *_NAME, "following", *_NEXT).mapInArrow(close, _DONE))


def _variants(docs: DataFrame, pairs: DataFrame, digits: int) -> DataFrame:
    """(digest, t1, t2, n1, n2, canon) of the texts in buckets that several share, and a few others; `pairs` from successor_digests.

    n1 and n2 are 0 for a text as it is, else the name of the successor that edits it.
    """
    zero = F.lit(0).cast("long")
    own = pairs.select("digest", *_NAME, zero.alias("n1"), zero.alias("n2"), F.lit(False).alias("of_edited"))
    new = pairs.select(F.col("edited_digest").alias("digest"), *_NAME, *_NEXT, F.lit(True).alias("of_edited"))
    entries = stash(own.unionByName(new).distinct(), "fingerprint-entries")
    several = stash(entries.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select(F.xxhash64("digest")), "fingerprint-buckets")
    entries = entries.filter(may_be_in(F.xxhash64("digest"), several))
    names = stash(entries.select(F.xxhash64(*_NAME).alias("name")).unionByName(entries.filter("of_edited").select(F.xxhash64(*_NEXT).alias("name"))).distinct(), "fingerprint-names")
    texts = _named(docs).filter(may_be_in(F.xxhash64(*_NAME), names)).groupBy(*_NAME).agg(F.first("text").alias("text"))
    heads = texts.select(F.col("t1").alias("n1"), F.col("t2").alias("n2"), F.col("text").alias("following"))
    both = entries.filter("not of_edited").join(texts, _NAME).withColumn("following", F.lit(""))
    both = both.unionByName(entries.filter("of_edited").join(texts, _NAME).join(heads, _NEXT))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, *name, e, t, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = edited(t, f) if e else t
                if digest(t, digits) == d:
                    rows.append((d, *name, e, canonical(t)))
            yield _batch(rows, _VARIANT)

    return both.select("digest", *_NAME, *_NEXT, "of_edited", "text", "following").mapInArrow(fold, _VARIANT)


_VARIANT = "digest string, t1 long, t2 long, n1 long, n2 long, of_edited boolean, canon string"


def fingerprints(docs: DataFrame, digits: int = 32) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    pairs = stash(successor_digests(docs, digits), "fingerprint-digests")
    variants = _variants(docs, pairs, digits)
    clashes = variants.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("greatest")).filter("least <> greatest").select("digest")
    clashes = stash(clashes, "fingerprint-clashes")
    names = pairs.withColumn("fingerprint", F.col("digest")).withColumn("edited_fingerprint", F.col("edited_digest")).withColumn("next_fingerprint", F.col("next_digest"))
    if not clashes.isEmpty():
        order = F.dense_rank().over(Window.partitionBy("digest").orderBy("canon"))
        ranked = stash(variants.join(clashes, "digest").withColumn("k", order).select("digest", *_NAME, *_NEXT, "of_edited", "k"), "fingerprint-ranks")
        plain = ranked.filter("not of_edited").drop("n1", "n2", "of_edited")
        of_edited = ranked.filter("of_edited").drop("of_edited").withColumnRenamed("digest", "edited_digest")
        after = plain.toDF("next_digest", *_NEXT, "k")
        for name, mark, one, on in (("fingerprint", "digest", plain, _NAME), ("edited_fingerprint", "edited_digest", of_edited, [*_NAME, *_NEXT]), ("next_fingerprint", "next_digest", after, _NEXT)):
            names = names.join(one, [mark, *on], "left").withColumn(name, F.when(F.col("k") > 1, F.concat_ws("-", mark, "k")).otherwise(F.col(mark))).drop("k")
    same = lambda x: (F.col("fingerprint") == F.col(x)).cast("double")
    return names.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
