"""Exact substring de-duplication with a logarithmic family of suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
somewhere else.  Documents are byte strings; matches never cross them.

Rows are named by 128 bits of their doc_id and text; rows of one name are copies
and are hit alike.

1. *Anchors.*  Every window of LENGTH bytes owns the position of its least
   32-byte hash (leftmost on ties), so equal windows own equal anchors, and the
   windows of one anchor are consecutive: a *span*.  A key that occurs once in
   the corpus cannot hold a repeated window.  The keys that occur again are kept
   as a bitmap of fixed size; a false positive costs work, never a result.
2. *Index family.*  Spans with such keys are dealt by key.  In each task every
   arriving batch gets a suffix array over its window starts, is merge-scanned
   against the existing levels for matches of LENGTH bytes (bytes are
   compared), and equal-sized levels merge geometrically.  As only matches of
   LENGTH bytes count, an array is ordered by a fingerprint of that prefix.
   A family ends at a key once it holds ``FAMILY`` bytes, as no other key can
   match what it has: a task's memory is bounded whatever it is dealt.
3. *Hot keys.*  A key with ``HOT`` occurrences or more is dealt by key and
   document, and the distinct windows of its parts meet in a second exchange by
   128 bits of fingerprint, at most one a part, so no task gathers a popular
   passage.  Up to ``MOST_HOT`` hot keys are broadcast; more are joined.
4. The hit intervals go back to their documents; the texts of documents that have
   none (by a bitmap of their names) do not travel.

Edge cases: null and empty texts have no bytes; texts shorter than LENGTH lose
nothing; repeated rows are copies of each other, also with the same doc_id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import avalanche, bitmap, bits_set, drop_stash, in_bitmap, row_blocks, stash

LENGTH = 200
GRAM = 32
BITMAP_BITS = 26
HOT = 1000
MOST_HOT = 100_000
FAMILY = 8 << 20
PIECE = 1 << 20
_REACH = LENGTH - GRAM + 1  # positions of a gram within a window
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BASE = 0x5851F42D4C957F2D
_BASE2 = 0x2545F4914F6CDD1D
OCCURRENCE = np.dtype([("uid", "<i8"), ("uid2", "<i8"), ("start", "<i8")])
WINDOW_REF = np.dtype([("fp", "<u8"), ("fp2", "<u8"), ("uid", "<i8"), ("uid2", "<i8"), ("start", "<i8")])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, key) of every span of the rows in a padded buffer."""
    n = int(offs[-1])
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64)
    words = np.ndarray((n - 7,), "<u8", buf, strides=(1,))
    m = n - GRAM + 1
    h = np.zeros(m, np.uint64)
    for j in range(4):
        h = (h ^ words[8 * j : 8 * j + m]) * _MULT[j]
        h ^= h >> np.uint64(31)
    high = np.uint64(0xFFFFFFFF00000000)
    least = _sliding_least((h & high) | np.arange(m, dtype=np.uint64), _REACH) & np.uint64(0xFFFFFFFF)
    valid = np.ones(len(least), bool)
    for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        valid[max(a, z - LENGTH + 1) : z] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none.astype(np.uint64)
    anchor = least[at]
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = at[np.r_[0, cut]]
    last = at[np.r_[cut - 1, len(at) - 1]]
    return first, last, avalanche(h[anchor[np.r_[0, cut]].astype(np.int64)])


def column_spans(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start within the row, bytes of the block, first, last, keys) for pieces of a column.

    A long row is cut into pieces of windows that share LENGTH - 1 bytes.
    """
    for lo, hi, buf, offs in row_blocks(col, PIECE):
        n = int(offs[-1])
        if hi - lo > 1 or n <= 2 * PIECE:
            first, last, keys = spans(buf, offs)
            row = np.searchsorted(offs[1:], first, side="right")
            yield row + lo, first - offs[row], buf, first, last, keys
            continue
        for a in range(0, n - LENGTH + 1, PIECE):
            z = min(n, a + PIECE + LENGTH - 1)
            part = np.zeros(z - a + 16, np.uint8)
            part[: z - a] = buf[a:z]
            first, last, keys = spans(part, np.array([0, z - a]))
            yield np.full(len(first), lo), first + a, part, first, last, keys


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [k for *_, k in column_spans(b.column(0))]
        keys, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


_SPANS = "key long, salt long, part long, hot boolean, cells binary, occ binary"


def _emit_spans(bits: np.ndarray, hot: np.ndarray, parts: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans with a repeated key; equal spans of a batch share a row.  `hot` and `parts` are the hot keys in order, as far as they are known here."""
    for b in batches:
        uids, others = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        found: dict[bytes, list] = {}
        for row, start, buf, first, last, keys in column_spans(b.column(2)):
            bit = keys & np.uint64((1 << BITMAP_BITS) - 1)
            again = np.flatnonzero(bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
            raw = buf.tobytes()
            for k, a, z, r, s in zip(keys[again].view(np.int64).tolist(), first[again].tolist(), last[again].tolist(), row[again].tolist(), start[again].tolist(), strict=True):
                found.setdefault(raw[a : z + LENGTH], [k]).append((uids[r], others[r], s))
        keys = np.array([v[0] for v in found.values()], np.int64)
        salt = avalanche(np.array([v[1][0] for v in found.values()], np.int64).view(np.uint64)).view(np.int64)
        at = np.minimum(np.searchsorted(hot, keys), max(0, len(hot) - 1))
        is_hot = hot[at] == keys if len(hot) else np.zeros(len(keys), bool)
        part = np.where(is_hot, salt % parts[at], 0) if len(hot) else np.zeros(len(keys), np.int64)
        occ = [np.array(v[1:], OCCURRENCE).tobytes() for v in found.values()]
        yield pa.record_batch([pa.array(keys), pa.array(salt), pa.array(part), pa.array(is_hot), pa.array(list(found), pa.binary()), pa.array(occ, pa.binary())], names=["key", "salt", "part", "hot", "cells", "occ"])


def _dealt(docs: DataFrame, bits: np.ndarray, hot: DataFrame, per_part: int, most_hot: int) -> DataFrame:
    """The spans of all documents; those of a hot key (key, n) are dealt to so many parts that each has about `per_part`."""
    hot = hot.select("key", F.ceil(F.col("n") / per_part).alias("parts"))
    few = hot.count() <= most_hot
    listed = hot.orderBy("key").toPandas() if few else None
    known = (listed["key"].to_numpy(np.int64), listed["parts"].to_numpy(np.int64)) if few else (np.zeros(0, np.int64),) * 2
    shared = docs.sparkSession.sparkContext.broadcast((bits, *known))
    found = docs.select("uid", "uid2", "text").mapInArrow(lambda it: _emit_spans(*shared.value, it), _SPANS)
    if not few:
        part = F.coalesce(F.pmod("salt", "parts"), F.lit(0).cast("long"))
        found = found.drop("part", "hot").join(hot, "key", "left").select("key", part.alias("part"), F.col("parts").isNotNull().alias("hot"), "cells", "occ")
    return found.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "hot", "cells", "occ")


class LevelFamily:
    """Suffix arrays of geometrically growing size over one byte store."""

    def __init__(self) -> None:
        self.store = np.zeros(1 << 20, np.uint8)
        self.used = 0
        self.hit = np.zeros(1 << 20, bool)  # by store position: the window that starts here was matched
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (fingerprints in order, positions)

    def _append(self, raw: bytes) -> int:
        need = self.used + len(raw) + 16
        if need > len(self.store):
            size = max(need, 2 * len(self.store))
            self.store, self.hit = np.concatenate([self.store, np.zeros(size - len(self.store), np.uint8)]), np.concatenate([self.hit, np.zeros(size - len(self.hit), bool)])
        at = self.used
        self.store[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
        self.used += len(raw)
        return at

    def _fingerprints(self, at: int, n: int, base: int = _BASE) -> np.ndarray:
        """Of the LENGTH bytes from each of the store positions at .. at + n - LENGTH."""
        power = np.full(n, base, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.store[at : at + n].astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        back = np.full(n - LENGTH + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        return avalanche((total[LENGTH:] - total[: n - LENGTH + 1]) * np.cumprod(back))

    def _same(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of store positions start LENGTH equal bytes."""
        words = np.ndarray((len(self.store) - 7,), "<u8", self.store, strides=(1,))
        same = np.ones(len(x), bool)
        for j in range(0, LENGTH, 8):
            same &= words[x + j] == words[y + j]
        return same

    def add(self, raw: bytes, windows: np.ndarray) -> int:
        """Index a new batch: `windows` are the starts within `raw`; returns its store position."""
        at = self._append(raw)
        fp = self._fingerprints(at, len(raw))[windows]
        order = np.argsort(fp, kind="stable")
        fp, pos = fp[order], at + windows[order]
        twin = np.flatnonzero(fp[1:] == fp[:-1])
        twin = twin[self._same(pos[twin], pos[twin + 1])]
        self.hit[pos[twin]] = self.hit[pos[twin + 1]] = True
        lead = np.r_[True, fp[1:] != fp[:-1]]  # a window that repeats is indexed once
        group = np.cumsum(lead) - 1
        one, at_one = fp[lead], pos[lead]
        new = np.ones(len(one), bool)
        for level_fp, level_pos in self.levels:
            k = np.searchsorted(level_fp, one)
            m = np.flatnonzero((k < len(level_fp)) & (level_fp[np.minimum(k, len(level_fp) - 1)] == one))
            m = m[self._same(at_one[m], level_pos[k[m]])]
            self.hit[level_pos[k[m]]] = True
            matched = np.zeros(len(one), bool)
            matched[m] = True
            self.hit[pos[matched[group]]] = True
            new[m] = False
        level = one[new], at_one[new]
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            older = self.levels.pop()
            fp, pos = np.concatenate([older[0], level[0]]), np.concatenate([older[1], level[1]])
            order = np.argsort(fp, kind="stable")
            level = fp[order], pos[order]
        self.levels.append(level)
        return at


_FOUND = "uid long, uid2 long, start long, stop long, block long, cells binary"


def _found(uid=(), uid2=(), start=(), stop=(), block=(), cells=()) -> pa.RecordBatch:
    """Hit intervals, then packed windows of hot keys."""
    n, m = len(uid), len(block)
    column = lambda x, kind, before, after: pa.array([None] * before + list(x) + [None] * after, kind)
    numbers = [pa.concat_arrays([pa.array(np.asarray(x, np.int64)), pa.nulls(m, pa.int64())]) for x in (uid, uid2, start, stop)]
    return pa.record_batch([*numbers, column(block, pa.int64(), n, 0), column(cells, pa.binary(), n, 0)], names=["uid", "uid2", "start", "stop", "block", "cells"])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Task:
    """The spans of some keys, each key complete, in one level family."""

    def __init__(self) -> None:
        self.family = LevelFamily()
        self.known: dict[bytes, int] = {}  # digest of a span: its number
        self.place: list[int] = []  # store position, length and occurrences of each span
        self.size: list[int] = []
        self.occs: list[list[bytes]] = []
        self.is_hot: list[bool] = []
        self.fresh: list[bytes] = []
        self.waiting = 0

    def index(self) -> None:
        if self.fresh:
            at = np.cumsum([0, *map(len, self.fresh)])
            windows = np.concatenate([np.arange(a, z - LENGTH + 1) for a, z in zip(at[:-1], at[1:], strict=True)])
            base = self.family.add(b"".join(self.fresh), windows)
            self.place.extend((base + at[:-1]).tolist())
            self.fresh, self.waiting = [], 0

    def add(self, hot: bool, cells: bytes, occ: bytes) -> None:
        k = self.known.setdefault(xxhash.xxh3_128_digest(cells), len(self.size))
        if k < len(self.size):
            self.occs[k].append(occ)
            return
        self.size.append(len(cells))
        self.occs.append([occ])
        self.is_hot.append(hot)
        self.fresh.append(cells)
        self.waiting += len(cells)
        if self.waiting >= 1 << 20:
            self.index()

    def found(self, blocks: int) -> Iterator[pa.RecordBatch]:
        """Hit intervals and, of hot keys, the windows that other parts may have too."""
        self.index()
        hits: list[list] = [[], [], [], []]
        refs = []
        for k, (at, n) in enumerate(zip(self.place, self.size, strict=True)):
            o = np.frombuffer(b"".join(self.occs[k]), OCCURRENCE)
            flags = self.family.hit[at : at + n - LENGTH + 1]
            if len(o) > 1:
                flags[:] = True
            for s, e in zip(*(x.tolist() for x in _runs(flags)), strict=True):
                for into, x in zip(hits, (o["uid"], o["uid2"], o["start"] + s, o["start"] + e - 1 + LENGTH), strict=True):
                    into.append(x)
            if self.is_hot[k]:
                ref = np.zeros(len(flags), WINDOW_REF)
                ref["fp"], ref["fp2"] = self.family._fingerprints(at, n), self.family._fingerprints(at, n, _BASE2)
                ref["uid"], ref["uid2"], ref["start"] = o["uid"][0], o["uid2"][0], np.where(flags, -1, o["start"][0] + np.arange(len(flags)))
                refs.append(ref)
        if hits[0]:
            yield _found(*(np.concatenate(x) for x in hits))
        if refs:
            ref = np.concatenate(refs)
            ref = ref[np.lexsort((ref["start"] < 0, ref["fp2"], ref["fp"]))]  # one reference a window and part is enough
            ref = ref[np.r_[True, (ref["fp"][1:] != ref["fp"][:-1]) | (ref["fp2"][1:] != ref["fp2"][:-1])]]
            block = (ref["fp"] % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            ref, block = ref[order], block[order]
            cut = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(ref)]
            yield _found(block=block[cut[:-1]].tolist(), cells=[ref[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])


def _indexed(blocks: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feed a task's spans, sorted by key, to level families."""
    task, last = _Task(), None
    for b in batches:
        for key, h, c, o in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if key != last and task.family.used + task.waiting >= most:
                yield from task.found(blocks)
                task = _Task()
            last = key
            task.add(h, c, o)
    yield from task.found(blocks)


def _meet(t: pa.Table) -> pa.Table:
    """Windows of hot keys that more than one part holds: intervals of those not yet hit."""
    ref = np.frombuffer(b"".join(t["cells"].to_pylist()), WINDOW_REF)
    ref = ref[np.lexsort((ref["fp2"], ref["fp"]))]
    same = (ref["fp"][1:] == ref["fp"][:-1]) & (ref["fp2"][1:] == ref["fp2"][:-1])
    hit = ref[(np.r_[same, False] | np.r_[False, same]) & (ref["start"] >= 0)]
    hit = hit[np.lexsort((hit["start"], hit["uid2"], hit["uid"]))]
    cut = np.flatnonzero((np.diff(hit["start"]) != 1) | (np.diff(hit["uid"]) != 0) | (np.diff(hit["uid2"]) != 0)) + 1
    first, last = (np.r_[0, cut], np.r_[cut - 1, len(hit) - 1]) if len(hit) else (np.zeros(0, int),) * 2
    return pa.Table.from_arrays([pa.array(hit["uid"][first]), pa.array(hit["uid2"][first]), pa.array(hit["start"][first]), pa.array(hit["start"][last] + LENGTH)], names=["uid", "uid2", "start", "stop"])


def repeated_intervals(docs: DataFrame, hot: int = HOT, most_hot: int = MOST_HOT, family: int = FAMILY) -> DataFrame:
    """(uid, uid2, start, stop) byte intervals covered by repeated strings; `docs` has uid, uid2 and text."""
    spark = docs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.select("text").mapInArrow(_key_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = stash(counts, "suffix-keys")
    bit = F.pmod("key", F.lit(1 << BITMAP_BITS))
    words = counts.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toPandas()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    dealt = _dealt(docs, bits.view(np.uint64), counts.filter(F.col("n") >= hot), hot, most_hot)
    out = stash(dealt.mapInArrow(lambda it: _indexed(blocks, family, it), _FOUND), "suffix-found")
    met = out.filter("block is not null").groupBy("block").applyInArrow(_meet, "uid long, uid2 long, start long, stop long")
    drop_stash(counts)
    return out.filter("block is null").select("uid", "uid2", "start", "stop").unionByName(met)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_bytes, removed, n_spans, digests, kept = [], [], [], [], []
        for t, iv in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            raw, out, at, runs, gone = (t.as_py() or "").encode(), [], 0, 0, 0
            last = -1
            for x in sorted((i["start"], i["stop"]) for i in iv or []):
                a, z = max(x[0], at), x[1]
                if z <= at:
                    continue
                if x[0] > last:
                    runs += 1
                    out.append(raw[at : x[0]])
                gone += z - a
                at = last = z
            out.append(raw[at:])
            rest = b"".join(out)
            n_bytes.append(len(raw))
            removed.append(gone)
            n_spans.append(runs)
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        arrays = [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
        yield pa.record_batch(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, hot: int = HOT, most_hot: int = MOST_HOT, family: int = FAMILY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"), F.xxhash64(F.lit(1), "doc_id", "text").alias("uid2"))
    found = repeated_intervals(docs, hot, most_hot, family).groupBy("uid", "uid2").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    found = stash(found, "suffix-intervals")
    table, bits = bitmap(found.select(F.xxhash64("uid", "uid2")))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    bit = F.pmod(F.xxhash64("uid", "uid2"), F.lit(1 << bits))
    out = f"doc_id {ids}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose bit is not set; one Python worker a task does both."""
        return _cut(b.filter(pa.array(~bits_set(shared.value, b.column(3).to_numpy()))) for b in batches)

    none = F.lit(None).cast(found.schema["found"].dataType).alias("found")
    hit = docs.filter(in_bitmap(bit, shared)).join(found, ["uid", "uid2"], "left").select("doc_id", "text", "found").mapInArrow(_cut, out)
    return hit.unionByName(docs.select("doc_id", "text", none, bit.alias("bit")).mapInArrow(untouched, out))
