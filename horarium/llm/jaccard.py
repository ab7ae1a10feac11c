"""Exact n-gram Jaccard join by a blocked sparse product.

The document x shingle incidence matrix is multiplied with its transpose in
blocks of columns, and rows and pairs leave as soon as the sizes forbid a link.
A row of n shingles can link only if others hold at least ``ceil(t n)`` of them.

1. *Half of the columns.*  The columns in the lower half of the hash space meet
   in their blocks; each row learns how many of them another row holds.  It may
   miss ``n - ceil(t n)`` in all, so a row that misses more here leaves.
2. *All columns of the rows left.*  Each row learns which of its shingles others
   hold, and how many rows hold each.  It leaves if they are too few.
3. *Prefixes.*  With the columns in one global order, rare ones first, two rows
   that link share a column among the first ``n - ceil(t n) + 1`` of each, and at
   the first one that they share what is left of both still suffices.  Every
   row is paired with one *pivot* of each such column; overlaps are counted over
   the whole rows, and links become components.
4. *The rest.*  For completeness, rows of a column that lie in different
   components are paired where sizes and positions allow a link.  Within a
   component no further link is needed, so a group of copies costs a star, not a square.

Links are decided on whole sets of 64-bit shingle hashes; equal sets (by a
128-bit digest) are one row of the matrix.

Skew.  A task counts a column once for itself before anything travels, so a
frequent column reaches its block once a batch.  Joins on frequent columns are
dealt by a salt or left to adaptive splitting.

Edge cases: null, empty and wordless texts have no shingles and stay alone;
one to four words are one shingle; a row without a doc_id is returned with a
null component and links nothing; repeated rows are copies, and rows that share
a doc_id are told apart by their texts; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import avalanche, pick, row_blocks, span_hashes, stash, word_spans
from .components import connected_components

WORDS, NUM, DEN = 5, 75, 100
BATCH_ROWS = 2000  # rows of an Arrow batch, as texts may be long
BATCH_ENTRIES = 1_000_000  # entries of the matrix that a task gathers before it deals them out
BLOCK_ENTRIES = 1_000_000  # about as many entries meet in one block of columns
SPLIT = 4096  # rows of a frequent column that one task pairs with the rows outside its main component
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_HALF = np.uint64(1 << 63)
_CELL = "batch long, block long, kind int, cells binary"
#: of cells: unique columns of a batch, entries of columns that several of its rows hold, its rows
_COLUMNS, _ENTRIES, _ROWS = 0, 1, 2


def shingle_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, _, buf, offs in row_blocks(col):
        starts, ends = word_spans(buf, offs, _IN_WORD)
        words = span_hashes(_LOWER[buf], starts, ends)
        row = np.searchsorted(offs[1:], starts, side="right")
        first = np.searchsorted(row, np.arange(len(offs)))
        n = max(len(words) - WORDS + 1, 0)
        grams = np.zeros(n, np.uint64)
        for j in range(WORDS):
            grams = avalanche(grams ^ words[j : j + n])
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= WORDS:
                yield np.unique(grams[a : z - WORDS + 1])
            elif z > a:
                yield np.array([xxhash.xxh3_64_intdigest(words[a:z].tobytes(), seed=z - a)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed longs that equal sets share."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def prefix_length(n):
    return n - -(-NUM * n // DEN) + 1


def _dtype(whole: bool) -> np.dtype:
    """A column of a batch: what is left of it in its block, the rows of the batch that hold it, and the row if it is one."""
    return np.dtype([("col", "<u8" if whole else "<u4"), ("n", "<u2"), ("row", "<u2")])


class _Batch:
    """Gathers rows of the matrix and deals their columns out to blocks."""

    def __init__(self, blocks: int, whole: bool, limit: int) -> None:
        from pyspark import TaskContext

        self.blocks, self.whole, self.limit = blocks, whole, limit
        self.serial = TaskContext.get().partitionId() << 32  # of the batch: unique, and the same when a task is run again
        self.clear()

    def clear(self) -> None:
        self.sets: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.size = 0
        self.seen: dict[tuple[int, int], int] = {}

    def full(self) -> bool:
        return self.size >= self.limit or len(self.sets) >= 60_000 or len(self.rows) >= 120_000

    def place(self, digest: tuple[int, int], s: np.ndarray) -> int:
        """The row of a set in this batch; equal sets share one."""
        at = self.seen.setdefault(digest, len(self.sets))
        if at == len(self.sets):
            self.sets.append(s if self.whole else s[s < _HALF])
            self.size += len(self.sets[-1])
        return at

    def deal(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """The messages of the batch; `rows` is what the last step shall know of its rows."""
        batch, self.serial = self.serial, self.serial + 1
        cols = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        row = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets]).astype(np.uint16)
        order = np.argsort(cols, kind="stable")
        cols, row = cols[order], row[order]
        first = np.r_[True, cols[1:] != cols[:-1]] if len(cols) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        n = np.diff(np.r_[at, len(cols)])
        e = np.zeros(len(at), _dtype(self.whole))
        e["col"] = cols[at] if self.whole else cols[at] & np.uint64(0xFFFFFFFF)
        e["n"], e["row"] = n, row[at]
        block = ((cols[at] >> np.uint64(32)) % np.uint64(self.blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        e, block = e[order], block[order]
        cut = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(e)] if len(e) else np.zeros(1, np.int64)
        cells = [e[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        several = np.repeat(n > 1, n)
        held = np.zeros(int(several.sum()), np.dtype([("col", "<u8"), ("row", "<u2")]))
        held["col"], held["row"] = cols[several], row[several]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        own = xxhash.xxh3_64_intdigest(str(batch)) % self.blocks
        blocks = np.r_[block[cut[:-1]], own, own].astype(np.int64)
        kinds = np.r_[np.zeros(len(cells)), _ENTRIES, _ROWS].astype(np.int32)
        return pa.record_batch([pa.array(np.full(len(blocks), batch)), pa.array(blocks), pa.array(kinds), pa.array([*cells, held.tobytes(), sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "block", "kind", "cells"])


def _count(whole: bool):
    """The step of a block: columns that one row of the whole table holds are left out; the others learn how many rows do."""

    def count(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        at = np.flatnonzero(kind == _COLUMNS)
        parts = [np.frombuffer(c, _dtype(whole)) for c in t["cells"].take(pa.array(at)).to_pylist()]
        size = np.array([len(p) for p in parts], np.int64)
        e = np.concatenate([*parts, np.zeros(0, _dtype(whole))])
        _, which = np.unique(e["col"], return_inverse=True)
        total = np.bincount(which, weights=e["n"])[which].astype(np.uint32) if len(e) else np.zeros(0, np.uint32)
        # half of the columns: rows of the batch that hold the column alone there, all that is still to be known
        keep = total > 1 if whole else (total > 1) & (e["n"] == 1)
        ends = np.r_[0, np.cumsum(keep)][np.cumsum(size)] if len(size) else size
        if whole:
            out = np.zeros(int(keep.sum()), np.dtype([("col", "<u8"), ("n", "<u4"), ("row", "<u2"), ("local", "<u2")]))
            out["col"], out["n"], out["row"], out["local"] = e["col"][keep], total[keep], e["row"][keep], e["n"][keep]
        else:
            out = e["row"][keep]
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        cells = [out[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        other = pa.array(np.flatnonzero(kind != _COLUMNS))
        columns = pa.table([t["batch"].take(pa.array(at)), t["kind"].take(pa.array(at)), pa.array(cells, pa.binary())], names=["batch", "kind", "cells"])
        return pa.concat_tables([columns, t.select(["batch", "kind", "cells"]).take(other)])

    return count


def _of(t: pa.Table, kind: int) -> list[bytes]:
    return t["cells"].filter(pc.equal(t["kind"], kind)).to_pylist()


def _blocks(docs: DataFrame, share: float, entries: int) -> int:
    """Blocks of about so many entries, a word taken as six bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, int(size * share / 6 / entries))


def survey(docs: DataFrame, batch: int = BATCH_ENTRIES, block: int = BLOCK_ENTRIES) -> DataFrame:
    """(doc_id, text_hash, n, hi, lo, able) of every row: its set's size and digest, and whether half of the columns leave a link possible."""
    blocks, kind = _blocks(docs, 0.5, block), docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "n", "hi", "lo"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, ids = _Batch(blocks, False, batch), None
        for part in batches:
            ids = part.column(0).type
            for doc, mark, s in zip(part.column(0), part.column(2).to_pylist(), shingle_sets(part.column(1)), strict=True):
                d = _digest(s)
                b.rows.append((doc.as_py(), mark, len(s), *d, b.place(d, s) if len(s) and doc.is_valid else -1))
                if b.full():
                    yield dealt(b, ids)
        if b.rows:
            yield dealt(b, ids)

    def dealt(b: _Batch, ids: pa.DataType) -> pa.RecordBatch:
        kinds = [ids, *[pa.int64()] * 5]
        half = np.array([len(s) for s in b.sets] + [0], np.int64)
        columns = [pa.array(c, k) for c, k in zip(zip(*b.rows, strict=True), kinds, strict=True)]
        rows = pa.record_batch([*columns, pa.array(half[columns[5].to_numpy()])], names=[*names, "row", "half"])
        out = b.deal(rows)
        b.clear()
        return out

    def decide(t: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(_of(t, _ROWS)[0]).read_all()
        shared = np.frombuffer(b"".join(_of(t, _COLUMNS)), np.uint16)
        shared = np.r_[shared, np.frombuffer(_of(t, _ENTRIES)[0], np.dtype([("col", "<u8"), ("row", "<u2")]))["row"]]
        shared = np.bincount(shared.astype(np.int64), minlength=1 << 16)
        n, row, half = (rows[c].to_numpy() for c in ("n", "row", "half"))
        able = (row >= 0) & (half - shared[row] <= n - -(-NUM * n // DEN))
        return rows.select(names).append_column("able", pa.array(able))

    cells = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(emit, _CELL)
    met = cells.groupBy("block").applyInArrow(_count(False), "batch long, kind int, cells binary")
    return met.groupBy("batch").applyInArrow(decide, f"doc_id {kind}, text_hash long, n long, hi long, lo long, able boolean")


def able_rows(texts: DataFrame, batch: int = BATCH_ENTRIES, block: int = BLOCK_ENTRIES) -> DataFrame:
    """Of (row, text): (row, n, u, cells, prefix) of the rows that may link.

    `cells` are the u shingles that other rows hold, rare ones first; `prefix`
    those of them that lie in the row's prefix, behind its n - u own shingles.
    """
    blocks = _blocks(texts, 1.0, block)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _Batch(blocks, True, batch)
        for part in batches:
            for row, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1)), strict=True):
                at = b.place(_digest(s), s)
                if at == len(b.rows):  # a row that comes twice counts once
                    b.rows.append((row, len(s)))
                if b.full():
                    yield dealt(b)
        if b.rows:
            yield dealt(b)

    def dealt(b: _Batch) -> pa.RecordBatch:
        rows = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*b.rows, strict=True)], names=["row", "n"])
        out = b.deal(rows)
        b.clear()
        return out

    def decide(t: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(_of(t, _ROWS)[0]).read_all()
        ids, n = rows["row"].to_numpy(), rows["n"].to_numpy()
        e = np.frombuffer(b"".join(_of(t, _COLUMNS)), np.dtype([("col", "<u8"), ("n", "<u4"), ("row", "<u2"), ("local", "<u2")]))
        held = np.frombuffer(_of(t, _ENTRIES)[0], np.dtype([("col", "<u8"), ("row", "<u2")]))
        one, more = e[e["local"] == 1], e[e["local"] > 1]
        more = more[np.argsort(more["col"])]
        col, row = np.r_[one["col"], held["col"]], np.r_[one["row"], held["row"]]
        count = np.r_[one["n"], more["n"][np.searchsorted(more["col"], held["col"])]] if len(held) else one["n"]
        order = np.lexsort((col, count, row))
        col, row = col[order], row[order]
        u = np.bincount(row.astype(np.int64), minlength=len(ids))
        end = np.cumsum(u)
        keep = np.flatnonzero(DEN * u >= NUM * n)
        length = np.clip(prefix_length(n) - (n - u), 0, u)
        cells = [col[end[k] - u[k] : end[k]] for k in keep.tolist()]
        prefix = [c[:m].view(np.int64) for c, m in zip(cells, length[keep].tolist(), strict=True)]
        columns = [pa.array(ids[keep]), pa.array(n[keep]), pa.array(u[keep]), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
        return pa.table(columns, names=["row", "n", "u", "cells", "prefix"])

    met = texts.select("row", "text").mapInArrow(emit, _CELL).groupBy("block").applyInArrow(_count(True), "batch long, kind int, cells binary")
    return met.groupBy("batch").applyInArrow(decide, "row long, n long, u long, cells binary, prefix array<long>")


def _may_link(x: str, y: str):
    """Whether two entries of one column leave a link possible, if it is the first column that the rows share."""
    return F.expr(
        f"{x}.row <> {y}.row AND {DEN} * least({x}.n, {y}.n) >= {NUM} * greatest({x}.n, {y}.n) "
        f"AND {NUM + DEN} * least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {NUM} * ({x}.n + {y}.n)"
    )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for k, (n, m, x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
            common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            if DEN * common >= NUM * (n + m - common):
                keep.append(k)
        at = pa.array(keep, pa.int64())
        yield pa.record_batch([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])


def links(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; the row of `a` travels to that of `b`, which many pairs may share."""
    x = rows.select(F.col("row").alias("a"), "n", "cells")
    y = rows.select(F.col("row").alias("b"), F.col("n").alias("m"), F.col("cells").alias("other"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "cells", "other")
    return both.mapInArrow(_verified, "a long, b long")


def _components(rows: DataFrame, split: int) -> DataFrame:
    """(node, component) of the rows that link."""
    entries = rows.select("row", "n", (F.col("n") - F.col("u")).alias("own"), F.posexplode("prefix").alias("k", "col")).withColumn("pos", F.col("own") + F.col("k")).drop("k")
    entries = stash(entries, "jaccard-entries")
    central = entries.groupBy("col").agg(F.min(F.struct("own", "row", "n", "pos")).alias("p"), F.count("*").alias("rows")).filter("rows > 1")
    pivots = stash(central.select("col", "p.row", "p.n", "p.pos"), "jaccard-pivots")
    star = entries.alias("x").join(pivots.alias("p"), "col").filter(_may_link("x", "p")).select(F.col("x.row").alias("a"), F.col("p.row").alias("b"))
    star = stash(star.distinct(), "jaccard-star")
    found = stash(links(star, rows), "jaccard-links")
    first = stash(connected_components(found, "a", "b"), "jaccard-components")

    named = entries.join(first.withColumnRenamed("node", "row"), "row", "left").select("col", "row", "n", "pos", F.coalesce("component", "row").alias("c"))
    sizes = named.groupBy("col", "c").agg(F.count("*").alias("rows"))
    mixed = sizes.groupBy("col").agg(F.max(F.struct("rows", "c")).alias("top"), F.count("*").alias("cs"), F.sum("rows").alias("rows")).filter("cs > 1")
    mixed = stash(mixed.select("col", F.col("top.c").alias("main"), F.expr(f"cast(1 + rows div {split} as int)").alias("salts")), "jaccard-mixed")
    there = stash(named.join(mixed, "col"), "jaccard-open")
    x = there.filter("c <> main").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).alias("x")
    y = there.withColumn("salt", F.expr("cast(pmod(xxhash64(row), salts) as int)")).alias("y")
    pairs = x.join(y, F.expr("x.col = y.col AND x.salt = y.salt AND x.c <> y.c") & _may_link("x", "y"))
    pairs = pairs.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stash(links(stash(pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-more"), rows), "jaccard-links")
    if more.isEmpty():
        return first
    return stash(connected_components(more.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b"), "jaccard-components")


def link_groups(docs: DataFrame, batch: int = BATCH_ENTRIES, block: int = BLOCK_ENTRIES, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) for every row.

    `batch`, `block` and `split` size the work, never the result.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH_ROWS))
    try:
        return _link_groups(docs.select("doc_id", "text"), batch, block, split)
    finally:
        conf.set(name, before)


def _link_groups(docs: DataFrame, batch: int, block: int, split: int) -> DataFrame:
    base = stash(survey(docs, batch, block), "jaccard-survey")  # all that runs in Python is stored before this returns
    linkable = base.filter("n > 0 AND doc_id IS NOT NULL")
    one = linkable.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "text_hash")).alias("d"), F.max("able").alias("able"))
    sets = stash(one.select("hi", "lo", "d.doc_id", "d.text_hash", "able", F.monotonically_increasing_id().alias("row")), "jaccard-sets")
    able = sets.filter("able").select("doc_id", "text_hash", "row")
    texts = pick(docs, able).withColumn("text_hash", F.xxhash64("text")).join(able, ["doc_id", "text_hash"]).select("row", "text")
    rows = stash(able_rows(stash(texts, "jaccard-texts"), batch, block), "jaccard-rows")
    components = _components(rows, split).withColumnRenamed("node", "row")
    linked = sets.select("hi", "lo", "row", F.col("doc_id").alias("least")).join(components, "row", "left").withColumn("component", F.coalesce("component", "row"))
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stash(linked.join(names, "component").select("hi", "lo", "component_id"), "jaccard-named")
    n = F.col("n").alias("n_shingles")
    alone = base.filter("n = 0 OR doc_id IS NULL").select("doc_id", n, F.col("doc_id").alias("component_id"))
    return linkable.join(named, ["hi", "lo"]).select("doc_id", n, "component_id").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: of its smallest doc_id; columns unchanged.

    Rows that share a doc_id stay or go together, but of equal texts under one
    doc_id one row stays.  Rows without a doc_id stay.
    """
    kept = link_groups(docs).filter("doc_id = component_id").select("doc_id").distinct()
    text = F.xxhash64("text").alias("__text")
    rows = docs.filter("doc_id is not null").select("*", text).join(kept, "doc_id", "left_semi")
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy("__text"))).filter("__k = 1")
    return rows.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
