"""Byte-level BPE encoding by tree concatenation, and decoding.

Long text is halved down to leaves; leaves are encoded on their own and joined
pairwise.  At a join a window around the seam is encoded again and grows until
both sides agree, which makes the result exactly that of the whole text:

* A cut at ``p`` is certain where a visible ASCII character is followed by a
  blank: no pre-token of the pattern crosses it, whatever stands around.
* Inside a run of letters (five on the near side, so that no contraction ends
  there) the pre-token is one merge problem.  A token sequence is its encoding
  if every adjacent pair is; so it is enough that the window's outermost token
  is the one that the side already has at ``p``.
* Otherwise the window grows, at last to the whole of both sides.

Very long texts are cut into pieces that different tasks encode; only the
pieces of one text meet again, for the joins.  Plain Latin text without special
tokens is encoded by a rank-based encoder made from the same vocabulary, all
else by the tokenizers library itself.

Edge cases: null and empty texts have no ids; special-token strings in a text
become their ids, as in the library; repeated rows are encoded one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..deploy import ship_code

LEAF = 8192  # characters that are encoded in one go
PIECE = 65_536  # characters of a very long text that one task encodes
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TreeEncoder:
    """Encoder and decoder of one byte-level vocabulary file (without normaliser)."""

    def __init__(self, path: str, leaf: int = LEAF, specials: bool = True) -> None:
        """`specials`: special-token strings in a text become their ids; else they are plain text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.leaf = leaf
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not specials
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): k for token, k in spec["model"]["vocab"].items()}
        self.ranks = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        names = {k: t["content"].encode() for t in spec["added_tokens"] for k in [t["id"]]} | {k: b for b, k in ranks.items()}
        self.token_bytes = [names.get(k, b"") for k in range(max(names, default=-1) + 1)]
        self.token_length = np.array([len(b) for b in self.token_bytes], np.int64)
        self.decimal = [b"%d" % k for k in range(len(self.token_bytes))]

    def _base(self, text: str) -> list[int]:
        if _LATIN.search(text) or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        text = text or ""
        if len(text) <= self.leaf:
            return self._base(text) if text else []
        half = len(text) // 2
        return self.join(text[:half].encode(), self.encode(text[:half]), text[half:].encode(), self.encode(text[half:]))

    def join(self, a: bytes, ids_a: list[int], b: bytes, ids_b: list[int]) -> list[int]:
        """The ids of a + b from those of a and of b."""
        if not a or not b:
            return ids_a + ids_b
        size = 64
        while True:
            kp, p, sure_p = self._left_cut(a, ids_a, size)
            kq, q, sure_q = self._right_cut(b, ids_b, size)
            window = self._base((a[p:] + b[:q]).decode())
            if (sure_p or window[0] == ids_a[kp]) and (sure_q or window[-1] == ids_b[kq - 1]):
                return ids_a[:kp] + window + ids_b[kq:]
            size *= 4

    def _left_cut(self, a: bytes, ids: list[int], size: int) -> tuple[int, int, bool]:
        """(token, byte, certain): the farthest usable cut within `size` bytes of the end of a."""
        tail = self.token_length[ids[-size:]]
        at = len(a) - np.cumsum(tail[::-1])[::-1]
        first = len(ids) - len(tail)
        least = 2 if size >= len(a) else 1
        for k in np.flatnonzero((at >= len(a) - size) & (at <= len(a) - 16)).tolist():
            if (kind := _cut_kind(a, int(at[k]))) >= least:
                return first + k, int(at[k]), kind == 2
        return (0, 0, True) if least == 2 else self._left_cut(a, ids, size * 4)

    def _right_cut(self, b: bytes, ids: list[int], size: int) -> tuple[int, int, bool]:
        at = np.cumsum(self.token_length[ids[:size]])
        least = 2 if size >= len(b) else 1
        for k in np.flatnonzero((at <= size) & (at >= 16) & (at < len(b)))[::-1].tolist():
            if (kind := _cut_kind(b, int(at[k]))) >= least:
                return k + 1, int(at[k]), kind == 2
        return (len(ids), len(b), True) if least == 2 else self._right_cut(b, ids, size * 4)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def _cut_kind(text: bytes, p: int) -> int:
    """2: a pre-token surely ends at p; 1: p is inside a run of letters; 0: neither is known."""
    if 0 < p < len(text) and text[p] in b" \n\t\r" and 0x21 <= text[p - 1] <= 0x7E:
        return 2
    if text[p] & 0xC0 == 0x80:
        return 0
    before = text[max(0, p - 24) : p].decode("utf-8", "ignore")[-5:]
    around = before + text[p : p + 4].decode("utf-8", "ignore")[:1]
    return int(len(before) == 5 and len(around) == 6 and all(unicodedata.category(c)[0] == "L" for c in around))


@lru_cache(maxsize=4)
def encoder(path: str, specials: bool = True, leaf: int = LEAF) -> TreeEncoder:
    """One encoder a worker process."""
    return TreeEncoder(path, leaf, specials)


_OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _report(enc: TreeEncoder, doc_ids: pa.Array, all_ids: Iterator[list[int]]) -> pa.RecordBatch:
    n, digests, decoded = [], [], []
    for ids in all_ids:
        n.append(len(ids))
        digests.append(hashlib.sha256(b",".join(map(enc.decimal.__getitem__, ids))).hexdigest())
        decoded.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
    return pa.record_batch([doc_ids, pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _map_texts(docs: DataFrame, path: str, finish, schema: str, leaf: int, size: int) -> DataFrame:
    """finish(encoder, doc_ids, ids of each row) over all rows, very long texts in pieces."""
    ship_code(docs.sparkSession)
    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= size)
    long = docs.filter(F.length("text") > size)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf=leaf)
        for b in batches:
            yield finish(enc, b.column(0), (enc.encode(t.as_py()) for t in b.column(1)))

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf=leaf)
        for b in batches:
            ids = [np.array(enc.encode(t.as_py()), np.int32).tobytes() for t in b.column(3)]
            yield pa.record_batch([*b.columns, pa.array(ids, pa.binary())], names=["row", "doc_id", "k", "part", "ids"])

    def joined(t: pa.Table) -> pa.Table:
        enc = encoder(path, leaf=leaf)
        parts = sorted(zip(t["k"].to_pylist(), t["part"].to_pylist(), t["ids"].to_pylist(), strict=True))
        nodes = [(p.encode(), np.frombuffer(i, np.int32).tolist()) for _, p, i in parts]
        while len(nodes) > 1:
            pairs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
            nodes = [(x[0][0] + x[1][0], enc.join(*x[0], *x[1])) if len(x) == 2 else x[0] for x in pairs]
        return pa.Table.from_batches([finish(enc, t["doc_id"].combine_chunks()[:1], iter([nodes[0][1]]))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = long.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # before the texts are cut
    cut = numbered.select("row", "doc_id", "text", F.explode(F.expr(f"sequence(0, cast((length(text) - 1) div {size} as int))")).alias("k"))
    cut = cut.select("row", "doc_id", "k", F.expr(f"substring(text, k * {size} + 1, {size})").alias("part")).repartition("row", "k")
    encoded = cut.mapInArrow(piece, f"row long, doc_id {kind}, k int, part string, ids binary")
    return short.select("doc_id", "text").mapInArrow(whole, schema).unionByName(encoded.groupBy("row").applyInArrow(joined, schema))


def round_trip(docs: DataFrame, tokenizer: str, leaf: int = LEAF, piece: int = PIECE) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, for every row; `leaf` and `piece` size the work only."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _map_texts(docs.select("doc_id", "text"), tokenizer, _report, f"doc_id {kind}, {_OUT}", leaf, piece)


def encode(docs: DataFrame, tokenizer: str, leaf: int = LEAF, piece: int = PIECE) -> DataFrame:
    """doc_id and the array of ids of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def listed(enc: TreeEncoder, doc_ids: pa.Array, all_ids: Iterator[list[int]]) -> pa.RecordBatch:
        return pa.record_batch([doc_ids, pa.array(list(all_ids), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _map_texts(docs.select("doc_id", "text"), tokenizer, listed, f"doc_id {kind}, ids array<int>", leaf, piece)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text from doc_id and the array of ids."""
    ship_code(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([enc.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, text string")
