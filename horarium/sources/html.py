"""HTML to one relation: a page is parsed once into a stream of tagged flat rows.

Only the geometry is Python (spans, implied end tags, nesting); what follows is
native.  Rows leave in Arrow batches of bounded size.  Malformed markup is
closed the way browsers close cells and rows.

kind      n        row, col        text                      link         flag
text      0                        visible text
title     0                        text of the title
anchor    ordinal                  text                      href
image     ordinal                  alternative text          src
iframe    ordinal                  title, else text          src
script    ordinal                                            src
option    select                   text of an option
leaf      ordinal                  text of an element without elements, at most LEAF characters
table     table    header rows in its first thead, -         caption   selector
row       table    row, cells                                             all cells are headings
cell      table    row, column     text, spans repeated
bare      table    row, column     text of a thead without rows
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "kind string, n int, row int, col int, text string, link string, flag boolean"
BATCH_ITEMS = 20_000
LEAF = 40
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"script", "style", "noscript", "template"}
_WIDEST, _TALLEST = 1000, 65_534  # the largest spans that HTML allows


def _join(parts: list[str]) -> str:
    return " ".join(parts)


class _Table:
    """A table under construction: finished rows of cells [words, columns, rows, heading], and its bare headers."""

    def __init__(self, selector: str | None) -> None:
        self.selector = selector
        self.caption: list[str] | None = None
        self.rows: list[list[list]] = []
        self.heads: list[dict] = []  # theads: number of rows, cells that no row holds
        self.row = self.cell = self.head = None  # open


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.words: list[str] = []
        self.items: list[tuple] = []
        self.tables: list[_Table] = []
        self.open: list[_Table] = []
        self.sinks: list[tuple[str, list[str]]] = []  # open title, anchors, iframes, options and captions
        self.elements: list[list] = []  # open: tag, words, whether it holds an element
        self.count = dict.fromkeys(("anchor", "image", "iframe", "script", "select", "leaf"), 0)
        self.hidden = 0

    def _add(self, kind: str, words: list[str], link: str | None) -> None:
        self.items.append((kind, self.count[kind], None, None, words, link, None))
        self.count[kind] += 1

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.elements:
            self.elements[-1][2] = True
        if tag not in _VOID:
            self.elements.append([tag, [], False])
        if tag == "script" and a.get("src"):
            self._add("script", [], a["src"])
        if tag in _SKIP:
            self.hidden += 1
        elif tag == "a" and a.get("href"):
            self.sinks = [s for s in self.sinks if s[0] != "a"] + [("a", [])]
            self._add("anchor", self.sinks[-1][1], a["href"])
        elif tag == "img" and a.get("src"):
            self._add("image", (a.get("alt") or "").split(), a["src"])
        elif tag == "iframe" and a.get("src"):
            self.sinks.append(("iframe", (a.get("title") or "").split()))
            self._add("iframe", self.sinks[-1][1] if not a.get("title") else list(self.sinks[-1][1]), a["src"])
        elif tag == "title":
            self.sinks.append(("title", []))
            self.items.append(("title", 0, None, None, self.sinks[-1][1], None, None))
        elif tag == "select":
            self.count["select"] += 1
        elif tag == "option":
            self.sinks = [s for s in self.sinks if s[0] != "option"] + [("option", [])]
            self.items.append(("option", self.count["select"] - 1, None, None, self.sinks[-1][1], None, None))
        elif tag == "table":
            names = (a.get("class") or "").split()
            self.open.append(_Table(f"table#{a['id']}" if a.get("id") else f"table.{names[0]}" if names else None))
            self.tables.append(self.open[-1])
        elif self.open:
            self._in_table(tag, a)

    def _in_table(self, tag: str, a: dict) -> None:
        table = self.open[-1]
        if tag == "caption" and table.caption is None:
            table.caption = []
            self.sinks.append(("caption", table.caption))
        elif tag in ("thead", "tbody", "tfoot"):
            table.row = table.cell = None
            table.head = {"rows": 0, "cells": []} if tag == "thead" else None
            if tag == "thead":
                table.heads.append(table.head)
        elif tag == "tr":
            table.row, table.cell = [], None
            for t in self.open:  # the rows of a nested table are rows of the outer ones too
                t.rows.append(table.row)
                if t.head is not None:
                    t.head["rows"] += 1
        elif tag in ("td", "th"):
            span = [self._span(a.get("colspan"), _WIDEST), self._span(a.get("rowspan"), _TALLEST)]
            table.cell = [[], *span, tag == "th"]
            if table.row is None and table.head is not None:
                table.head["cells"].append(table.cell)
            for t in self.open:
                if t.row is not None:
                    t.row.append(table.cell)

    @staticmethod
    def _span(value: str | None, most: int) -> int:
        try:
            return min(max(int(value or 1), 1), most)
        except ValueError:
            return 1

    def _close(self, tag: str) -> None:
        """Close elements up to the last open one of this tag."""
        if any(e[0] == tag for e in self.elements):
            while self.elements:
                name, words, holds = self.elements.pop()
                if words and not holds and sum(map(len, words)) + len(words) - 1 <= LEAF:
                    self._add("leaf", words, None)
                if name == tag:
                    break

    def handle_endtag(self, tag):
        self._close(tag)
        if tag in _SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("a", "iframe", "title", "option", "caption"):
            self.sinks = [s for s in self.sinks if s[0] != tag]
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag == "thead" and self.open:
            self.open[-1].head = None
        elif tag in ("td", "th", "tr") and self.open:
            self.open[-1].cell = None
            if tag == "tr":
                self.open[-1].row = None

    def handle_data(self, data):
        if self.hidden:
            return
        words = data.split()
        self.words += words
        if self.elements:
            self.elements[-1][1].extend(words)
        for _, sink in self.sinks:
            sink += words
        for t in self.open:
            if t.cell is not None:
                t.cell[0] += words


def dense(rows: list[list[list]]) -> list[list[str]]:
    """A dense matrix: spans repeat their text to the right and downwards, rows are padded."""
    out: list[list[str]] = []
    carried: dict[int, tuple[int, str]] = {}  # column: rows left, text
    width = 0
    for row in rows:
        line = {c: text for c, (_, text) in carried.items()}
        carried = {c: (left - 1, text) for c, (left, text) in carried.items() if left > 1}
        at = 0
        for words, columns, down, _ in row:
            while at in line:
                at += 1
            for c in range(at, at + columns):
                line[c] = _join(words)
                if down > 1:
                    carried[c] = (down - 1, line[c])
            at += columns
            width = max(width, at)
        out.append(line)
    return [[line.get(c, "") for c in range(width)] for line in out]


def items_of(html: str | None) -> Iterator[tuple]:
    """The rows (ITEM) of one page."""
    page = _Reader()
    page.feed(html or "")
    page.close()
    yield "text", 0, None, None, _join(page.words), None, None
    for kind, n, row, col, words, link, flag in page.items:
        yield kind, n, row, col, _join(words), link, flag
    for n, table in enumerate(page.tables):
        yield "table", n, table.heads[0]["rows"] if table.heads else 0, None, None if table.caption is None else _join(table.caption), table.selector, None
        for r, cells in enumerate(table.rows):
            yield "row", n, r, len(cells), None, None, bool(cells) and all(c[3] for c in cells)
        for r, line in enumerate(dense(table.rows)):
            for c, text in enumerate(line):
                yield "cell", n, r, c, text, None, None
        bare = [[_join(words) for words, columns, *_ in head["cells"] for _ in range(columns)] for head in table.heads if head["cells"] and not head["rows"]]
        for r, line in enumerate(bare):
            for c, text in enumerate(line):
                yield "bare", n, r, c, text, None, None


def page_items(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, kind, n, row, col, text, link, flag) of all pages: one pass of the parser."""
    names = [key, *(x.split()[0] for x in ITEM.split(", "))]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                return pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)  # noqa: B023

            for k, page in enumerate(b.column(1)):
                for item in items_of(page.as_py()):
                    at.append(k)
                    rows.append(item)
                    if len(rows) >= BATCH_ITEMS:
                        yield out()
                        at, rows = [], []
            yield out()

    return pages.select(key, html).mapInArrow(each, f"{key} {pages.schema[key].dataType.simpleString()}, {ITEM}")


def table_cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_no, row_no, col_no, text) of every cell of every table, densely."""
    return cells_of(page_items(pages, key, html), key)


def cells_of(items: DataFrame, key: str, kind: str = "cell") -> DataFrame:
    return items.filter(F.col("kind") == kind).select(key, F.col("n").alias("table_no"), F.col("row").alias("row_no"), F.col("col").alias("col_no"), "text")


def anchors(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, ordinal, href, text) of every link in order."""
    return page_items(pages, key, html).filter("kind = 'anchor'").select(key, F.col("n").alias("ordinal"), F.col("link").alias("href"), "text")


def visible_text(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, text): the page's words without scripts and styles."""
    return page_items(pages, key, html).filter("kind = 'text'").select(key, "text")
