"""Encoder of a lower-casing word vocabulary with a cache of encoded words.

Plain Latin text is normalised and split here by the vocabulary's own rules
(lower case, the pattern below, white space dropped) and each distinct word is
encoded once by the library's own merge model; every other text goes to the
library whole.  Both give the library's ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

from tokenizers import Tokenizer

from .bpe_tree import byte_alphabet

CACHE_WORDS = 500_000
_LIMIT = 0x250  # below: letters, and nothing that composes or folds in context
_ODD = re.compile("[^\x00-ɏ]|İ|<\\|")
_PLAIN = re.compile("[!-~]*")  # bytes that stand for themselves; controls have stand-ins too


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LIMIT) if unicodedata.category(chr(c))[0] == kind)


_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_SPACE}{_class('L')}{_class('N')}]+")


class WordEncoder(dict):
    """Maps a word to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return b"".join(k.to_bytes(4, "little") for k in self.library.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:  # words in use move back from the older half one by one
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            plain = word if _PLAIN.fullmatch(word) else "".join(map(self.stand_in.__getitem__, word.encode()))
            ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(plain))
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        lower = text.lower()
        if _ODD.search(text) or (not text.isascii() and _ODD.search(lower)):  # some capitals below the limit have their small letter above it
            return self._ids(text)
        return b"".join(map(self.__getitem__, WORD.findall(lower)))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path)
