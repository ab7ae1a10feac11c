"""The cached word encoder gives the library's ids for every text."""

import random

import public_tokenizers

from horarium.llm.word_encoder import WordEncoder

SPECIAL = ["<|endoftext|>", "<|", "👩‍👩‍👧", "é", "ſ", "K", "日本", "　", "'s", "'LL", "İ", "Ⱥ"]


def test_every_character_below_the_limit():
    enc = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for c in map(chr, range(1, 0x250)):
        for text in (c, f"a{c}b", f"{c} 1{c}", f"x {c}{c}"):
            assert enc.encode(text) == enc._ids(text), ascii(text)


def test_random_strings():
    enc, r = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    plain = [chr(c) for c in range(1, 0x250)]
    for k in range(5000):
        text = "".join(r.choice(plain) if r.random() < 0.7 else r.choice("abcDE 's12.") if k % 2 else r.choice(SPECIAL) for _ in range(r.randint(0, 14)))
        assert enc.encode(text) == enc._ids(text), ascii(text)
