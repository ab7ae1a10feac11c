"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are fed into one suffix automaton over word ids.
Training texts are streamed through it; the automaton's current match length
says how many of the last words form a piece of some item.  A position whose
length reaches the window (13 words) ends an occurrence of a window; an item of
fewer words is one window and is recognised by marks on the suffix links.

A vectorised screen decides which stretches of a text are streamed at all: a
match of at least ``k`` words needs every k-gram in it to occur in the items, so
only runs of such k-grams, long enough for a window, reach the automaton.  The
screen drops nothing that the automaton could report.

Size bound: items are broadcast in blocks of about ``block_chars`` characters (an
automaton takes some hundred bytes a character: 200 MB at most).
One block is the usual case; with more, the texts pass once through each block
and the findings are carried along in two columns, with no shuffle.

Edge cases: null or empty texts have no words and are clean; items without
words, and items with a null id, match nothing; items that share an id count
once; repeated documents are judged one by one; other columns of the documents
pass through `decontaminate` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..deploy import ship_code
from .common import avalanche, row_blocks, span_hashes, stash, word_spans

WINDOW = 13
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True  # before lower-casing
NO_ITEMS = hashlib.sha256(b"").hexdigest()


def text_words(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each word, word hashes, starts, ends, row offsets) by blocks of rows."""
    for lo, hi, buf, offs in row_blocks(col):
        starts, ends = word_spans(buf, offs, IN_WORD)
        hashes = span_hashes(_LOWER[buf], starts, ends)
        yield lo, np.searchsorted(offs[1:], starts, side="right"), hashes, starts, ends, offs


class ItemAutomaton:
    """Generalised suffix automaton of word-id sequences with window marks."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        """`items`: (item id, word hashes in order)."""
        self.window = window
        items = [(str(k), w) for k, w in items if len(w)]
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.least = min((min(len(w), window) for _, w in items), default=0)
        self.k = min(self.least, 6)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: list[set[str]] = [set()]
        self.short: dict[int, dict[int, set[str]]] = {}  # state: {length: items that are this string}
        grams = []
        for name, hashes in items:
            ids = np.searchsorted(self.vocabulary, hashes)
            grams.append(self._grams(ids))
            self._add(name, ids.tolist())
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self._found: dict[int, tuple[frozenset[str], tuple]] = {}

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.k + 1
        g = np.zeros(max(n, 0), np.uint64)
        for j in range(self.k if n > 0 else 0):
            g = avalanche(g ^ (ids[j : j + n].astype(np.uint64) + np.uint64(j + 1)))
        return g

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.owners.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string followed by c, made if q is longer."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone], self.owners[clone] = dict(self.next[q]), self.link[q], set(self.owners[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, name: str, ids: list[int]) -> None:
        last = 0
        for c in ids:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            cur, p = self._new(self.length[last] + 1), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            self.link[cur] = 0 if p < 0 else self._split(p, c)
            last = cur
        state = 0
        for c in ids:  # the strings that end here belong to this item
            state = self.next[state][c]
            up = state
            while up > 0 and name not in self.owners[up]:
                self.owners[up].add(name)
                up = self.link[up]
        if len(ids) < self.window:
            self.short.setdefault(state, {}).setdefault(len(ids), set()).add(name)

    def _ends_here(self, state: int) -> tuple[frozenset[str], tuple]:
        """(items with the window that ends in `state`, ((length, items) of short items) on its suffix links)."""
        got = self._found.get(state)
        if got is None:
            up, owners, short = state, frozenset(), []
            while up > 0:
                if self.length[self.link[up]] < self.window <= self.length[up]:
                    owners = frozenset(self.owners[up])
                short += self.short.get(up, {}).items()
                up = self.link[up]
            got = self._found[state] = (owners, tuple(short))
        return got

    def stream(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        """Run word ids through the automaton; adds window occurrences (word numbers from `at`) and their items."""
        state = size = 0
        for e, c in enumerate(ids, at + 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            if size < self.least:
                continue
            owners, short = self._ends_here(state)
            if size >= self.window:
                spans.append((e - self.window, e))
                found |= owners
            for length, names in short:
                if length <= size:
                    spans.append((e - length, e))
                    found |= names

    def search(self, hashes: np.ndarray, row: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """{row: (occurrences as word numbers of this block, items)} for the rows with any."""
        out: dict[int, tuple[list, set]] = {}
        if not self.k or len(hashes) < self.k:
            return out
        ids = np.searchsorted(self.vocabulary, hashes)
        known = ids < len(self.vocabulary)
        known[known] = self.vocabulary[ids[known]] == hashes[known]
        n = len(ids) - self.k + 1
        alive = row[:n] == row[self.k - 1 :]
        for j in range(self.k):
            alive &= known[j : j + n]
        at = np.flatnonzero(alive)
        grams = np.zeros(len(at), np.uint64)
        for j in range(self.k):
            grams = avalanche(grams ^ (ids[at + j].astype(np.uint64) + np.uint64(j + 1)))
        pos = np.searchsorted(self.grams, grams)
        at = at[(pos < len(self.grams)) & (self.grams[np.minimum(pos, len(self.grams) - 1)] == grams)]
        if not len(at):
            return out
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
        first, last = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]] + self.k
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= self.least:
                spans, found = out.setdefault(int(row[a]), ([], set()))
                self.stream(ids[a:b].tolist(), a, spans, found)
        return {k: x for k, x in out.items() if x[0]}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[Row]]:
    """The items in blocks of bounded size, each small enough to broadcast."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    if blocks == 1:
        yield items.collect()
        return
    blocks *= 2  # hashing is uneven
    for k in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()


def _hash_items(items: list[Row]) -> list[tuple[str, np.ndarray]]:
    col = pa.array([r.text for r in items], pa.string())
    out = []
    for lo, row, hashes, _, _, offs in text_words(col):
        out += [(items[lo + k].item_id, hashes[row == k]) for k in range(len(offs) - 1)]
    return out


_FOUND = "n_words long, runs array<long>, byte_runs array<long>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = 2 << 20) -> DataFrame:
    """(row, text, n_words, runs, byte_runs, items): `row` is a struct of the input's other columns.

    runs and byte_runs are flat lists of starts and ends of the maximal hit
    runs, in words and in UTF-8 bytes; items are the ids with occurring windows.
    """
    ship_code(docs.sparkSession)
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"))
    state = state.selectExpr("row", "text", "0L AS n_words", "array(cast(null as long)) AS runs", "array(cast(null as long)) AS byte_runs", "array('') AS items")
    schema = f"row {state.schema['row'].dataType.simpleString()}, text string, {_FOUND}"
    for k, block in enumerate(_item_blocks(benchmark, block_chars)):
        if k:
            state = stash(state, "decontaminate")
        shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(_hash_items(block), window))

        def matched(batches: Iterator[pa.RecordBatch], shared=shared, first=not k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col, n = b.column(1), b.num_rows
                words = np.zeros(n, np.int64)
                runs: list[list[int]] = [[]] * n if first else b.column(3).to_pylist()
                byte_runs: list[list[int]] = [[]] * n if first else b.column(4).to_pylist()
                items: list[list[str]] = [[]] * n if first else b.column(5).to_pylist()
                for lo, row, hashes, starts, ends, offs in text_words(col):
                    words[lo : lo + len(offs) - 1] = np.bincount(row, minlength=len(offs) - 1)
                    for r, (spans, found) in shared.value.search(hashes, row).items():
                        w0 = int(np.searchsorted(row, r))
                        both = _merged(spans + [(a + w0, z + w0) for a, z in zip(runs[lo + r][::2], runs[lo + r][1::2], strict=True)])
                        runs[lo + r] = [int(x) - w0 for s in both for x in s]
                        byte_runs[lo + r] = [int(x) for a, z in both for x in (starts[a] - offs[r], ends[z - 1] - offs[r])]
                        items[lo + r] = sorted(found.union(items[lo + r]))
                arrays = [b.column(0), col, pa.array(words), pa.array(runs, pa.list_(pa.int64())), pa.array(byte_runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                yield pa.record_batch(arrays, names=["row", "text", "n_words", "runs", "byte_runs", "items"])

        state = state.mapInArrow(matched, schema)
    return state


def _n_hit():
    return F.expr("aggregate(sequence(0, size(runs) div 2 - 1), 0L, (s, i) -> s + runs[2 * i + 1] - runs[2 * i])")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`."""
    found = scan(docs.select("doc_id", "text"), benchmark, window).drop("text")
    found = found.select("row.doc_id", "n_words", F.when(F.size("runs") > 0, _n_hit()).otherwise(F.lit(0).cast("long")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def _columns(docs: DataFrame) -> list:
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for t, runs in zip(b.column(1), b.column(2), strict=True):
            raw, out, at = t.as_py().encode(), [], 0
            ends = runs.as_py()
            for a, z in zip(ends[::2], ends[1::2], strict=True):
                out.append(raw[at:a])
                at = z
            texts.append(b"".join([*out, raw[at:]]).decode())
        yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, longest: int = 50) -> DataFrame:
    """`docs` without hit spans: all those of a text in which they cover at least one word in `one_in`, elsewhere runs of more than `longest` words."""
    found = scan(docs, benchmark, window)
    over = (F.size("runs") > 0) & (one_in * _n_hit() >= F.col("n_words"))
    long = F.expr(f"flatten(transform(filter(sequence(0, size(runs) div 2 - 1), i -> runs[2 * i + 1] - runs[2 * i] > {longest}), i -> array(byte_runs[2 * i], byte_runs[2 * i + 1])))")
    found = found.withColumn("cut", F.when(over, F.col("byte_runs")).when(F.size("runs") > 0, long).otherwise(F.array().cast("array<long>")))
    clean = found.filter(F.size("cut") == 0).select(*_columns(docs))
    cut = found.filter(F.size("cut") > 0).select("row", "text", "cut")
    kept = cut.mapInArrow(_without, f"row {cut.schema['row'].dataType.simpleString()}, text string")
    return clean.union(kept.select(*_columns(docs)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """The rows of `docs` in which hit words are less than one in `one_in`, unchanged."""
    found = scan(docs, benchmark, window)
    over = (F.size("runs") > 0) & (one_in * _n_hit() >= F.col("n_words"))
    return found.filter(~over).select(*_columns(docs))
