"""Periodic runs of words, found over tiles of one period octave each.

A run is a maximal stretch of words with smallest period q and a length of at
least ``max(LEAST, TIMES * q)``.  Write e_q(i) for "words i and i + q are equal": a
run is a maximal stretch of e_q of ``length - q`` positions.

1. *Tiles.*  Periods 2**k .. 2**(k+1) - 1 form octave k.  A long document is
   exploded into overlapping tiles for each octave whose size is a fixed multiple
   of 2**k, so that every stretch lies in one tile or overlaps its neighbour's
   part by more than a block.  Short documents are one tile each and share an
   array, longest first and parted by unique marks, so that an octave looks at a
   prefix of it.
2. *Boundaries.*  Within a tile, boundaries stand every 2**k words.  Hashes of
   2**k words give, for a boundary and all periods of the octave at once, where
   the block behind the boundary occurs again; two adjacent boundaries must agree.
   The Z-values of a boundary, how far a match goes to either side, come from
   halving blocks.  An octave costs time in proportion to the words.
3. *Stitching.*  Fragments of long documents are shuffled by document and period,
   and those that touch become one.  A stretch that a smaller period explains has
   the same ends as that period's, and the smallest period stays.

Every run is compared word for word before it counts, so that a hash collision
cannot make one.  Words are numbered exactly within their document.

Edge cases: null and empty texts have no words and no runs; a null doc_id plants
nothing; repeated rows are reported one by one; ties of the strongest run go to
the smallest start, then period; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import avalanche, stash

LEAST, TIMES = 6, 4
LONG_CHARS = 50_000  # longer documents are exploded into tiles
GROUP_WORDS = 1 << 18  # words of short documents that share an array
SHARED_OCTAVES = 10  # the lowest octaves share their tiles
SPREAD = 8  # a tile advances by so many blocks and overlaps the next by as many
KEPT_LEVELS = 16 << 20  # hashes of all block sizes that a tile may keep
_MIX = np.uint64(0x9E3779B97F4A7C15)

REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(text: str | None, doc_id: int | None = None, plant: bool = False) -> list[bytes]:
    """The words of a text; with `plant`, one id in ten repeats a part of it to its end."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if plant and n and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        unit = words[a : a + p]
        words = words[:a] + (unit * (-(-(n - a) // p)))[: n - a]
    return words


def number(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


class _Blocks:
    """Hashes of the blocks of 2**k words at every position, for rising k over shrinking prefixes."""

    def __init__(self, ids: np.ndarray) -> None:
        self.base = avalanche(ids.view(np.uint64) + _MIX)
        self.kept = [self.base]

    def _double(self, low: np.ndarray, k: int, end: int) -> np.ndarray:
        size = 1 << k
        n = max(0, end - 2 * size + 1)
        return avalanche(low[:n] * _MIX ^ low[size : size + n])

    def rise(self, k: int, end: int) -> np.ndarray:
        """Level k over the first `end` words; levels are asked for in rising order."""
        if k == 0:
            return self.base[:end]
        top = self._double(self.level(k - 1), k - 1, end)
        if sum(map(len, self.kept)) + len(top) <= KEPT_LEVELS:
            self.kept.append(top)
        else:
            self.last = k, top
        return top

    def level(self, k: int) -> np.ndarray:
        if k < len(self.kept):
            return self.kept[k]
        if getattr(self, "last", (-1,))[0] == k:
            return self.last[1]
        at, low = len(self.kept) - 1, self.kept[-1]
        while at < k:
            low, at = self._double(low, at, len(self.base)), at + 1
        return low


def stretches(ids: np.ndarray, ends: list[int], first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, start, stop) of the stretches of e_q for octaves first, first + 1, ...

    Octave k looks at the first ends[k - first] words.  Every maximal stretch of
    at least 3 * 2**k positions is found, and some shorter ones.
    """
    blocks, found = _Blocks(ids), []
    for k in range(first):
        blocks.rise(k, len(ids))
    for k, end in enumerate(ends, first):
        size = 1 << k
        h = blocks.rise(k, end)
        rows = -(-len(h) // size)
        if rows < 2:
            break
        padded = np.zeros((rows + 2) * size, np.uint64)
        padded[: len(h)] = h
        again = padded[size : (rows + 1) * size].reshape(rows, size) == padded[: rows * size : size, None]
        row, q = np.nonzero(again[:-1] & again[1:])
        if not len(row):
            continue
        order = np.lexsort((row, q))
        row, q = row[order], q[order]
        cut = np.flatnonzero((np.diff(q) != 0) | (np.diff(row) != 1)) + 1
        head, tail = np.r_[0, cut], np.r_[cut - 1, len(row) - 1]
        q = q[head] + size
        start, stop = row[head] * size, (row[tail] + 2) * size
        for j in range(k - 1, -1, -1):  # Z-values beyond the outermost matching blocks
            step, low = 1 << j, blocks.level(j)
            most = len(low) - 1
            ok = stop + q + step <= end
            ok &= low[np.minimum(stop, most)] == low[np.minimum(stop + q, most)]
            stop = stop + step * ok
            ok = start >= step
            before = np.maximum(start - step, 0)
            ok &= low[before] == low[np.minimum(before + q, most)]
            start = start - step * ok
        found.append(np.stack([q, start, stop]))
    q, start, stop = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return q, start, stop


def octaves(n: int) -> int:
    """How many octaves of periods a document of n words can hold runs of."""
    return max(0, (n // TIMES).bit_length())


def settle(ids: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among the stretches (period, start, stop) of one document, by start and period."""
    least: dict[tuple[int, int], int] = {}
    for q, a, z in sorted(found):
        if z - a + q < max(LEAST, TIMES * q) or (a, z + q) in least:
            continue
        if np.array_equal(ids[a:z], ids[a + q : z + q]):
            least[a, z + q] = q
            continue
        edge = np.diff(np.r_[0, (ids[:-q] == ids[q:]).view(np.int8), 0])
        for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if y - x + q >= max(LEAST, TIMES * q):
                least.setdefault((x, y + q), q)
    return sorted((a, e - a, q) for (a, e), q in least.items())


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of several documents given as words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    order = [d for d in order if len(documents[d]) >= LEAST]
    if not order:
        return out
    own = [number(documents[d]) for d in order]
    sizes = np.array([len(x) for x in own])
    starts = np.r_[0, np.cumsum(sizes + 1)]
    ids = np.concatenate([x for n, one in enumerate(own) for x in (one, np.array([-1 - n]))])
    ends = [int(starts[np.count_nonzero(sizes >= max(LEAST, TIMES << k))]) for k in range(octaves(int(sizes[0])))]
    q, a, z = stretches(ids, [e for e in ends if e])
    keep = z - a + q >= np.maximum(LEAST, TIMES * q)
    per: dict[int, list] = {}
    for d, *one in zip((np.searchsorted(starts, a[keep], side="right") - 1).tolist(), q[keep].tolist(), a[keep].tolist(), z[keep].tolist(), strict=True):
        per.setdefault(d, []).append((one[0], one[1] - int(starts[d]), one[2] - int(starts[d])))
    for d, found in per.items():
        out[order[d]] = settle(own[d], found)
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for a, n, q in runs:
        depth[a + q] += 1
        depth[a + n] -= 1
    keep = np.cumsum(depth[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _report(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = None
    for a, n, q in runs:  # by start, then period: the first of equals stays
        if best is None or n * best[2] > best[1] * q:
            best = (a, n, q)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *one, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()


def _reports(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.record_batch([doc_ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *[x.split()[0] for x in REPORT.split(", ")]])


def _short(plant: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lo, held, size = 0, [], 0
        for at, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True), 1):
            held.append(words_of(t.as_py(), d, plant))
            size += len(held[-1])
            if size >= GROUP_WORDS or at == b.num_rows:
                yield _reports(b.column(0).slice(lo, at - lo), [_report(w, r) for w, r in zip(held, runs_of(held), strict=True)])
                lo, held, size = at, [], 0


def tiles(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(first octave, octaves, start, stop) of the tiles of a document of n words."""
    top, first = octaves(n), 0
    while first < top:
        upto = max(SHARED_OCTAVES, first + 1)
        step = SPREAD << (upto - 1)
        for a in range(0, max(1, n - step), step):
            yield first, min(upto, top) - first, a, min(n, a + 2 * step)
        first = upto


_TILE = "row long, first int, n int, start long, ids binary"
_FRAGMENT = "row long, period long, start long, stop long"


def _explode(plant: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            ids = number(words_of(t.as_py(), d, plant)).astype("<i4")
            for first, n, a, z in tiles(len(ids)):
                yield pa.record_batch([pa.array([row]), pa.array([first], pa.int32()), pa.array([n], pa.int32()), pa.array([a]), pa.array([ids[a:z].tobytes()])], names=["row", "first", "n", "start", "ids"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, first, n, at, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids = np.frombuffer(raw, "<i4").astype(np.int64)
            q, a, z = stretches(ids, [len(ids)] * n, first)
            yield pa.record_batch([pa.array(np.full(len(q), row)), pa.array(q), pa.array(a + at), pa.array(z + at)], names=["row", "period", "start", "stop"])


def stitch(fragments: DataFrame) -> DataFrame:
    """(row, period, start, stop): fragments of a row and period that touch are one."""
    by = Window.partitionBy("row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by)
    pieces = fragments.withColumn("reach", reach).withColumn("island", island)
    return pieces.groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def _close(plant: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, t, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            words = words_of(t.as_py(), d, plant)
            rows.append(_report(words, settle(number(words), [(x["period"], x["start"], x["stop"]) for x in found or []])))
        yield _reports(b.column(0), rows)


def tiled_stretches(long: DataFrame, plant: bool = False) -> DataFrame:
    """(row, period, start, stop) of the long stretches of documents (row, doc_id, text), solved tile by tile."""
    dealt = long.mapInArrow(lambda it: _explode(plant, it), _TILE).repartition("row", "first", "start")
    whole = stitch(dealt.mapInArrow(_solve, _FRAGMENT))
    runs = whole.filter(F.col("stop") - F.col("start") + F.col("period") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    return runs.groupBy("row", "start", (F.col("stop") + F.col("period")).alias("end")).agg(F.min("period").alias("period")).select("row", "period", "start", (F.col("end") - F.col("period")).alias("stop"))


def report(docs: DataFrame, plant: bool = False, long_chars: int = LONG_CHARS) -> DataFrame:
    """doc_id, n_runs, the strongest run and the digests of all runs and of the collapsed text of every row."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    docs, out = docs.select("doc_id", "text"), f"doc_id {ids}, {REPORT}"
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    short = docs.filter(~is_long).mapInArrow(lambda it: _short(plant, it), out)
    long = stash(docs.filter(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "periodic-long")
    found = tiled_stretches(long, plant).groupBy("row").agg(F.collect_list(F.struct("period", "start", "stop")).alias("found"))
    joined = long.join(found, "row", "left").select("doc_id", "text", "found")
    return short.unionByName(joined.mapInArrow(lambda it: _close(plant, it), out))
