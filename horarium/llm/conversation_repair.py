"""Repair of the turn structure of conversations by a survivor-coalescence Viterbi.

The rows of a conversation are edited at least cost so that the initials of its
roles read ``(s?(ua)+)?``.  Row by row, the decoder keeps one survivor for each
state (nothing yet, after s, after u, after a): its cost and its place in a tree of
edits that point back.  Nodes count their references; a survivor that no state
continues is released with what only it held, and once all survivors share an
ancestor, the edits up to it are emitted.  Ties are decided by comparing the
complete edits of both paths since they parted, so the answer is the least audit
string among all of least cost.

A survivor goes when another can imitate every continuation of it at a lower
cost: ``_bridges`` computes, from the costs alone, by how much a completion from one
state can exceed that from another.  So the tree is as deep as the undecided
suffix.  No text is held: each survivor carries the state of its SHA-256.

Inserted rows belong before the row that follows them, or to the end; then two
paths that part spell strings of which none begins the other.

One conversation's audit and digest are functions of its rows in order, so its
rows are sorted (Spark spills) and pass through one task one by one.  What takes
memory there is the undecided suffix and the audit itself.

Edge cases: null roles and texts are one blank; a null conv_id names one
conversation; null turns come first and are no turns to count; rows of one turn
are ordered by role, then text; repeated rows are duplicates of each other; a
conversation without rows has zeros, an empty audit and the digest of nothing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
NONE, BLANK, DUPLICATE, CUT = range(4)
_STATES = range(4)
_FAR = 1 << 60


@cache
def _inserts(state: int) -> list[tuple[int, int, tuple[str, ...]]]:
    """(state, cost, initials) that inserting rows reaches from a state, without circles."""
    out, seen = [(state, 0, ())], {state}
    for at, cost, put in out:
        for c in "ua":
            if (to := NEXT.get((at, c))) is not None and to not in seen:
                seen.add(to)
                out.append((to, cost + INSERT, (*put, c)))
    return out


@cache
def moves(initial: str, fault: int) -> list[tuple[int, int, int, str, tuple[str, ...], str]]:
    """(from, to, cost, edits, inserted initials, initial of the row or '' if it goes) over one row."""
    best: dict[tuple[int, int], tuple] = {}
    for p in _STATES:
        for at, cost, put in _inserts(p):
            steps = [(at, DELETE, "D", "")]
            if fault in (NONE, CUT):
                extra = TRUNCATED if fault == CUT else 0
                if (to := NEXT.get((at, initial))) is not None:
                    steps.append((to, extra, "K", initial))
                steps += [(NEXT[at, c], extra + REROLE, "R", c) for c in "ua" if (at, c) in NEXT]
            for to, more, op, role in steps:
                one = (cost + more, "I" * len(put) + op, put, role)
                if (p, to) not in best or one[:2] < best[p, to][:2]:
                    best[p, to] = one
    return [(p, to, *one) for (p, to), one in best.items()]


@cache
def _endings() -> list[tuple[int, int, tuple[str, ...]]]:
    """For every state (cost, inserts) of the cheapest end."""
    return [min((cost, len(put), put) for at, cost, put in _inserts(p) if at in ENDS) for p in _STATES]


@cache
def _bridges() -> list[list[int]]:
    """[p][q]: by how much the best completion from q can exceed that from p, whatever rows follow."""
    kinds = [moves(c, f) for c in ("s", "u", "a", "") for f in (NONE, BLANK, CUT)]
    end = [e[0] for e in _endings()]
    most = [[end[q] - end[p] for q in _STATES] for p in _STATES]
    while True:
        now = [[most[p][q] for q in _STATES] for p in _STATES]
        for p in _STATES:
            for q in _STATES:
                for kind in kinds:
                    for a, to, cost, *_ in (m for m in kind if m[0] == p):
                        answer = min(c + most[to][t] for b, t, c, *_ in kind if b == q)
                        now[p][q] = max(now[p][q], answer - cost)
        if now == most:
            return most
        most = now


class _Node:
    __slots__ = ("parent", "edits", "refs", "kids")

    def __init__(self, parent: _Node | None, edits: str) -> None:
        self.parent, self.edits, self.refs, self.kids = parent, edits, 0, []
        if parent is not None:
            parent.refs += 1
            parent.kids.append(self)


def _release(node: _Node) -> None:
    """Drop a reference, and whatever nobody else refers to."""
    node.refs -= 1
    while not node.refs and node.parent is not None:
        parent = node.parent
        parent.kids.remove(node)
        parent.refs -= 1
        node = parent


def _less(a: _Node, x: str, b: _Node, y: str) -> bool:
    """Whether the path to `a` and then edits `x` spell less than `b` and `y`; both are equally deep."""
    left, right = [x], [y]
    while a is not b:
        left.append(a.edits)
        right.append(b.edits)
        a, b = a.parent, b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class Decoder:
    """Feed rows in order with `step`; `emitted` grows with the edits that are settled; `finish` gives (cost, digest)."""

    def __init__(self) -> None:
        self.root = _Node(None, "")
        self.root.refs = 1
        self.survivors: dict[int, tuple[int, _Node, object, bool]] = {0: (0, self.root, hashlib.sha256(), False)}
        self.emitted: list[str] = []

    def step(self, initial: str, fault: int, role: str, text: str) -> None:
        best: dict[int, tuple] = {}
        for p, to, cost, edits, put, kept in moves(initial, fault):
            if p not in self.survivors:
                continue
            total = self.survivors[p][0] + cost
            old = best.get(to)
            if old is None or total < old[0] or total == old[0] and _less(self.survivors[p][1], edits, self.survivors[old[1]][1], old[2]):
                best[to] = (total, p, edits, put, kept)
        bridge = _bridges()
        live = {to: b for to, b in best.items() if not any(b[0] > other[0] + bridge[to][at] for at, other in best.items() if at != to)}
        after = {}
        for to, (total, p, edits, put, kept) in live.items():
            _, node, digest, some = self.survivors[p]
            if put or kept:
                digest = digest.copy()
                for c in put:
                    digest.update(("\n" * some + ROLES[c] + ":").encode())
                    some = True
                if kept:
                    name = role if edits[-1] == "K" else ROLES[kept]
                    digest.update(("\n" * some + name + ":" + text).encode("utf-8", "surrogatepass"))
                    some = True
            after[to] = (total, _Node(node, edits), digest, some)
        for _, node, *_ in after.values():
            node.refs += 1
        for _, node, *_ in self.survivors.values():
            _release(node)
        self.survivors = after
        while self.root.refs == 1 and self.root.kids:  # everybody's ancestor
            self.root = self.root.kids[0]
            self.root.parent = None
            self.emitted.append(self.root.edits)

    @property
    def undecided(self) -> int:
        """How many rows the deepest survivor is away from what is settled."""
        node, n = next(iter(self.survivors.values()))[1], 0
        while node is not self.root:
            node, n = node.parent, n + 1
        return n

    def finish(self) -> tuple[int, str]:
        best = None
        for p, (cost, node, *_) in self.survivors.items():
            more, n, put = _endings()[p]
            if best is None or cost + more < best[0] or cost + more == best[0] and _less(node, "I" * n, best[2], "I" * best[3]):
                best = (cost + more, p, node, n, put)
        total, p, node, n, put = best
        _, _, digest, some = self.survivors[p]
        for c in put:
            digest.update(("\n" * some + ROLES[c] + ":").encode())
            some = True
        tail = ["I" * n]
        while node is not self.root:
            tail.append(node.edits)
            node = node.parent
        self.emitted.extend(reversed(tail))
        return total, digest.hexdigest()


_INK = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
REPORT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def fault_of(text: str, seen: bool) -> int:
    """The first fault of a row; `seen`: an earlier row has its role and text."""
    if not _INK.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return NONE if text.rstrip(_BLANKS)[-1] in ".!?" else CUT


def repair(rows: Iterable[tuple[int | None, str, str, bool, int]]) -> tuple:
    """The values of REPORT for one conversation's rows (turn, role, text, seen earlier, copies), in order."""
    decoder, faults = Decoder(), [0] * 4
    first = last = None
    distinct = illegal = 0
    before = None
    for turn, role, text, seen, copies in rows:
        if turn is not None:
            first = turn if first is None else first
            distinct += turn != last
            last = turn
        initial = role[:1]
        for k in range(copies):
            fault = fault_of(text, seen or k > 0)
            faults[fault] += 1
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            decoder.step(initial if initial in ("s", "u", "a") else "", fault, role, text)
    cost, digest = decoder.finish()
    gaps = 0 if first is None else last - first + 1 - distinct
    return gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, cost, "".join(decoder.emitted), digest


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): `rows` with faults planted by the crc32 of `conv_id:turn`; dropped rows have no copies."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(code == 4, "user").otherwise(blank("role"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.when(code == 0, "").otherwise(text).alias("text"), copies.alias("copies"))


def intact(rows: DataFrame) -> DataFrame:
    """`rows` in the form of `damage`, with nothing planted."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), F.lit(1).alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation in order, with whether their role and text were seen; one shuffle serves both sorts."""
    turn: Column = F.col("turn").asc_nulls_first()
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", F.col("copies") == 0).orderBy(turn)) > 1
    dealt = rows.repartition("conv_id").withColumn("seen", seen)
    return dealt.sortWithinPartitions("conv_id", turn, "role", "text", "seen")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) of sorted batches; rows are read as they are asked for."""
    rows = ((b.column(0)[i], *(c[i].as_py() for c in b.columns[1:])) for b in batches for i in range(b.num_rows))
    ahead = next(rows, None)

    def one(name) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[0] == name:
            row, ahead = ahead[1:], next(rows, None)
            if row[-1]:
                yield row

    while ahead is not None:
        name = ahead[0]
        yield name, one(name)


def _repaired(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        names, values = [h[0] for h in held], list(zip(*(h[1] for h in held), strict=True)) or [[]] * len(REPORT)
        arrays = [pa.array(v, pa.int64() if t == "long" else pa.string()) for v, t in zip(values, REPORT.values(), strict=True)]
        return pa.record_batch([pa.array(names, kind), *arrays], names=["conv_id", *REPORT])

    for name, rows in _conversations(batches):
        held.append((name.as_py(), repair(rows)))
        size += len(held[-1][1][6]) + 200
        if size > 1 << 20:
            yield flush()
            held, size = [], 0
    yield flush()


def report(rows: DataFrame) -> DataFrame:
    """The values of REPORT for every conv_id of rows in the form of `damage` or `intact`."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = rows.schema["conv_id"]
    kind = to_arrow_type(field.dataType)
    schema = ", ".join([f"conv_id {field.dataType.simpleString()}", *(f"{k} {v}" for k, v in REPORT.items())])
    ordered = _ordered(rows).select("conv_id", "turn", "role", "text", "seen", "copies")
    return ordered.mapInArrow(lambda it: _repaired(kind, it), schema)
