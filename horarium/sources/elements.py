"""HTML as a relation of elements, and what selectors and regions make of it.

A page is parsed once into one row an element:

el, parent, last   number in document order, its parent's (-1: none), the last number inside it
path               the numbers of all elements around it, outermost first
tag, attrs         lower-case name; attributes by name (an attribute without a value has '')
classes            the words of its class
kids               elements directly inside
start, stop        the words of the page's visible text that it holds, from 0, `stop` exclusive
text               these words, if they are at most `LONGEST` characters; `with_text` adds longer ones
begin, end         where it stands in the page's source, in code points, `end` exclusive

Only nesting is Python.  Ancestors are a column, so that "inside" is an equality
join on an exploded path, never a join of ranges.  End tags that HTML lets authors
leave out are supplied; an end tag without an open element is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html import _SKIP, _VOID, BATCH_ITEMS
from .scratch import stored

LONGEST = 1000
ELEMENT = (
    "el int, parent int, last int, path array<int>, tag string, attrs map<string,string>, classes array<string>, kids int, start int, stop int, text string, begin int, end int"
)
_KINDS = [
    pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(),
]
# Which open elements a start tag ends, and the elements beyond which it ends nothing.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_ENDS |= {t: ({"p"}, {"div", "section", "table", "td", "th", "li"}) for t in ("p", "div", "ul", "ol", "dl", "table", "section", "article", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "main")}


class _Open:
    """An element that has not ended."""

    __slots__ = ("at", "parent", "path", "tag", "attrs", "kids", "start", "begin")

    def __init__(self, at: int, around: _Open | None, tag: str, attrs: dict[str, str], start: int, begin: int) -> None:
        self.at, self.tag, self.attrs, self.start, self.begin, self.kids = at, tag, attrs, start, begin, 0
        self.parent = around.at if around else -1
        self.path = (*around.path, around.at) if around else ()


class _Tree(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.source, self.words, self.open, self.done, self.count, self.hidden = source, [], [], [], 0, 0
        self.lines = [0, *(i + 1 for i, c in enumerate(source) if c == "\n")]

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def read(self) -> None:
        self.feed(self.source)
        self.close()
        while self.open:
            self._end(self.open.pop(), len(self.source))

    def _end(self, e: _Open, end: int) -> None:
        names = {k: "" if v is None else v for k, v in e.attrs.items()}
        self.done.append((e.at, e.parent, self.count - 1, list(e.path), e.tag, list(names.items()), names.get("class", "").split(), e.kids, e.start, len(self.words), e.begin, end))

    def handle_starttag(self, tag, attrs):
        here = self._here()
        ends, beyond = _ENDS.get(tag, (set(), set()))
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag in beyond:
                break
            if self.open[k].tag in ends:
                while len(self.open) > k:
                    self._end(self.open.pop(), here)
                break
        if self.open:
            self.open[-1].kids += 1
        e = _Open(self.count, self.open[-1] if self.open else None, tag, dict(reversed(attrs)), len(self.words), here)
        self.count += 1
        if tag in _VOID:
            self._end(e, here + len(self.get_starttag_text() or ""))
            return
        self.open.append(e)
        self.hidden += tag in _SKIP

    handle_startendtag = handle_starttag  # a slash ends nothing in HTML

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag == tag), None)
        if at is None:
            return
        here = self._here()
        after = self.source.find(">", here) + 1 or len(self.source)
        while len(self.open) > at:
            e = self.open.pop()
            self.hidden -= e.tag in _SKIP
            self._end(e, after if len(self.open) == at else here)

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


# a tag without surprises: its values hold no bracket, and no slash ends it
_PLAIN_TAG = re.compile(r"""(</[a-zA-Z][a-zA-Z0-9]*>|<[a-zA-Z][a-zA-Z0-9]*(?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_:.-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+))?)*[ \t\n]*>)""")
_RAW = _SKIP | {"textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext", "svg", "math"}


class _OneTag(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, attrs, self.get_starttag_text()))

    handle_startendtag = handle_starttag

    def handle_data(self, data):
        self.seen.append(())


@lru_cache(maxsize=8192)
def _plain(text: str) -> tuple | None:
    """Name, attributes, classes and what it ends of a start tag that the parser reads as one; null for others."""
    one = _OneTag()
    one.feed(text)
    one.close()
    if len(one.seen) != 1 or len(one.seen[0]) != 3 or one.seen[0][2] != text or one.seen[0][0] in _RAW - {"title"}:
        return None
    tag, attrs, _ = one.seen[0]
    names = {k: "" if v is None else v for k, v in dict(reversed(attrs)).items()}
    return tag, list(names.items()), names.get("class", "").split(), tag in _VOID, *_ENDS.get(tag, (None, None))


def _quick(source: str) -> tuple[list[str], list[tuple]] | None:
    """(words, rows) as `_Tree` has them, of a page of plain tags only; null for others."""
    parts = _PLAIN_TAG.split(source)
    if source.count("<") != len(parts) // 2:
        return None
    words: list[str] = []
    open_: list[list] = []  # number, parent, path, path of what is inside, name, attributes, classes, children, first word, begin
    done: list[tuple] = []
    count, here, titled = 0, 0, False
    for k, part in enumerate(parts):
        if not k % 2:
            if part:
                if titled and "&" in part:
                    return None
                words += (unescape(part) if "&" in part else part).split()
                here += len(part)
            continue
        if part[1] == "/":
            tag = part[2:-1].lower()
            if titled and tag != "title":
                return None
            titled = False
            at = len(open_) - 1
            while at >= 0 and open_[at][4] != tag:
                at -= 1
            if at >= 0:
                after, last, stop = here + len(part), count - 1, len(words)
                while len(open_) > at:
                    e = open_.pop()
                    done.append((e[0], e[1], last, e[2], e[4], e[5], e[6], e[7], e[8], stop, e[9], after if len(open_) == at else here))
            here += len(part)
            continue
        read = _plain(part)
        if read is None or titled:
            return None
        tag, attrs, classes, void, ends, beyond = read
        titled = tag == "title"
        if ends:
            for j in range(len(open_) - 1, -1, -1):
                if open_[j][4] in beyond:
                    break
                if open_[j][4] in ends:
                    while len(open_) > j:
                        e = open_.pop()
                        done.append((e[0], e[1], count - 1, e[2], e[4], e[5], e[6], e[7], e[8], len(words), e[9], here))
                    break
        if open_:
            around = open_[-1]
            around[7] += 1
            parent, path = around[0], around[3]
        else:
            parent, path = -1, []
        if void:
            done.append((count, parent, count, path, tag, attrs, classes, 0, len(words), len(words), here, here + len(part)))
        else:
            open_.append([count, parent, path, [*path, count], tag, attrs, classes, 0, len(words), here])
        count += 1
        here += len(part)
    if titled:
        return None
    while open_:
        e = open_.pop()
        done.append((e[0], e[1], count - 1, e[2], e[4], e[5], e[6], e[7], e[8], len(words), e[9], len(source)))
    return words, done


def elements_of(html: str | None) -> Iterator[tuple]:
    """The rows (ELEMENT) of one page, in the order in which elements end; pages of plain tags need no parser."""
    quick = _quick(html or "")
    if quick is None:
        tree = _Tree(html or "")
        tree.read()
        quick = tree.words, tree.done
    return _with_texts(*quick)


def _with_texts(words: list[str], done: list[tuple]) -> Iterator[tuple]:
    sizes = [0, *accumulate(len(w) + 1 for w in words)]
    for *first, start, stop, begin, end in done:
        short = sizes[stop] - sizes[start] <= LONGEST + 1
        yield *first, start, stop, " ".join(words[start:stop]) if short else None, begin, end


def page_elements(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, ELEMENT) of all pages: one pass of the parser, in batches of bounded size."""
    names = [key, *(x.split()[0] for x in ELEMENT.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
                return pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], names=names)  # noqa: B023

            for k, page in enumerate(b.column(1)):
                for element in elements_of(page.as_py()):
                    at.append(k)
                    rows.append(element)
                    if len(rows) >= BATCH_ITEMS:
                        yield out()
                        at, rows = [], []
            yield out()

    return pages.select(key, html).mapInArrow(each, f"{key} {pages.schema[key].dataType.simpleString()}, {ELEMENT}")


def with_text(chosen: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """`chosen` elements with the text of the long ones too; `texts` has (key, text) of the pages that need it."""
    short = chosen.filter("text is not null")
    page = texts.select(key, F.split("text", " ").alias("__words"))
    words = F.slice("__words", F.col("start") + 1, F.col("stop") - F.col("start"))
    long = chosen.filter("text is null").join(page, key).withColumn("text", F.array_join(words, " ")).select(chosen.columns)
    return short.unionByName(long)


# one compound of a selector: a name, ids, classes and attributes
_COMPOUND = r"(?:\*|[A-Za-z][A-Za-z0-9-]*)?(?:#[\w-]+|\.[\w-]+|\[[^\]]*\])*"
_ATTRIBUTE = r"""\[\s*([\w-]+)\s*(?:=\s*["']?([^"'\]]*)["']?\s*)?\]"""


def steps_of(selector: Column) -> Column:
    """The compounds of a selector from left to right: child (directly inside the one before), tag, ids, classes, attrs.

    Names, `*`, `#id`, `.class`, `[name]` and `[name=value]`, parted by blanks or
    `>`.  Anything else is an error.
    """
    marked = F.trim(F.regexp_replace(F.regexp_replace(selector, r"\s*>\s*", " >"), r"\s+(?=[^\[\]]*(?:\[|$))", "\n"))
    parts = F.filter(F.split(marked, "\n"), lambda s: s != "")

    def step(s: Column) -> Column:
        bare = F.regexp_replace(s, "^>", "")
        open_part = F.regexp_replace(bare, r"\[[^\]]*\]", "")
        bad = ~bare.rlike(f"^{_COMPOUND}$") | (bare == "")
        checked = F.when(bad, F.raise_error(F.concat(F.lit("selector not understood: "), s))).otherwise(F.lower(F.regexp_extract(bare, r"^(\*|[A-Za-z][A-Za-z0-9-]*)", 1)))
        names, values = F.regexp_extract_all(bare, F.lit(_ATTRIBUTE), F.lit(1)), F.regexp_extract_all(bare, F.lit(_ATTRIBUTE), F.lit(2))
        return F.struct(
            F.startswith(s, F.lit(">")).alias("child"), F.nullif(F.nullif(checked, F.lit("")), F.lit("*")).alias("tag"), F.regexp_extract_all(open_part, F.lit(r"#([\w-]+)"), F.lit(1)).alias("ids"),
            F.regexp_extract_all(open_part, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"), F.arrays_zip(names.alias("name"), values.alias("value")).alias("attrs"),
        )

    return F.transform(parts, step)


def _fits(step: str) -> Column:
    """Whether an element has what a compound asks for."""
    s, attrs = F.col(step), F.col("attrs")
    ids = F.forall(s["ids"], lambda x: F.coalesce(F.element_at(attrs, "id") == x, F.lit(False)))
    classes = F.forall(s["classes"], lambda x: F.array_contains("classes", x))
    others = F.forall(s["attrs"], lambda a: F.coalesce(F.when(a["value"] == "", F.map_contains_key(attrs, a["name"])).otherwise(F.try_element_at(attrs, a["name"]) == a["value"]), F.lit(False)))
    return (s["tag"].isNull() | (s["tag"] == F.col("tag"))) & ids & classes & others


MOST_STEPS = 12


def select(elements: DataFrame, selectors: DataFrame, key: str) -> DataFrame:
    """The elements that selectors match: (key, name, ELEMENT), `selectors` has (key, name, selector).

    Every page may have selectors of its own.  Compounds are matched where the
    elements are; each combinator is one equality join with the elements around.
    """
    asked = selectors.filter("selector is not null and trim(selector) <> ''").select(key, "name", steps_of(F.col("selector")).alias("steps")).filter("size(steps) > 0")
    depth = asked.agg(F.max(F.size("steps"))).first()[0] or 1
    if depth > MOST_STEPS:
        raise ValueError(f"a selector of {depth} steps; {MOST_STEPS} at most")
    columns = [c for c in elements.columns if c != key]
    step = asked.select(key, "name", F.size("steps").alias("__n"), F.posexplode("steps").alias("__step", "step"))
    # compounds with a name meet the elements of that name only; the rest of a compound is tested on these
    named = elements.join(step.filter("step.tag is not null").withColumn("tag", F.col("step.tag")), [key, "tag"]).select(*elements.columns, "name", "__n", "__step", "step")
    hit = named.unionByName(elements.join(step.filter("step.tag is null"), key).select(named.columns)).filter(_fits("step")).select(key, "el", "path", "name", "__n", "__step", "step")
    hit = stored(hit, "selector-hits")
    so_far = hit.filter("__step = 0").select(key, "name", "__n", F.col("el").alias("at"), F.lit(0).alias("__step"))
    for k in range(1, depth):
        inner = hit.filter(F.col("__step") == k).select(key, "name", "__n", "el", F.explode(F.when(F.col("step.child"), F.slice("path", -1, 1)).otherwise(F.col("path"))).alias("at"))
        inner = inner.join(so_far.filter(F.col("__step") == k - 1).select(key, "name", "at"), [key, "name", "at"], "left_semi").select(key, "name", "__n", F.col("el").alias("at"), F.lit(k).alias("__step")).distinct()
        so_far = so_far.unionByName(inner)
    done = so_far.filter("__step = __n - 1").select(key, "name", F.col("at").alias("el"))
    return elements.join(done, [key, "el"]).select(key, "name", *columns)


def inside(chosen: DataFrame, around: DataFrame, key: str) -> DataFrame:
    """`chosen` elements with `item`, the elements of `around` (key, el) that they stand in; one row each."""
    up = chosen.withColumn("item", F.explode("path"))
    return up.join(around.select(key, F.col("el").alias("item")), [key, "item"], "left_semi")


def first_inside(chosen: DataFrame, around: DataFrame, key: str) -> DataFrame:
    """The first element of each name in every item: (key, item, name, el, text)."""
    both = inside(chosen, around, key)
    return both.groupBy(key, "item", "name").agg(F.min_by(F.struct("el", "text"), "el").alias("f")).select(key, "item", "name", "f.*")


def leaves(elements: DataFrame) -> DataFrame:
    """Elements with words and without elements."""
    return elements.filter("kids = 0 and stop > start")


def region(pages: DataFrame, chosen: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, region): the source of one chosen element (key, begin, end) of each page, a slice of the page."""
    part = F.substring(F.col(html), F.col("begin") + 1, F.col("end") - F.col("begin"))
    return pages.select(key, html).join(chosen.select(key, "begin", "end"), key).select(key, part.alias("region"))


def best_of(chosen: DataFrame, key: str, rank: Column) -> DataFrame:
    """The chosen element of the greatest rank of each page; the first of equals."""
    first = Window.partitionBy(key).orderBy(rank.desc(), "el")
    return chosen.withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")
