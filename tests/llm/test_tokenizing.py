"""Ids from byte arrays equal those of the library, text by text."""

import numpy as np
import pytest
from lodestrata.llm.tokenizing import Tokens, tokenizer_path

TEXTS = ["<|endoftext|>Foo <|STARTOFTEXT|> a", "Straße.ÀB", "it's. IT'S!! don't*** 12.5% (x). áb. §a §", "İx ſ. Σας", "...", "\x85a\xa0b\x1cc.", "x" * 3000 + ".", "50%. 5.", "ab¡. ²., ½,", "", None]
#: Characters of every kind that the cuts depend on, and some whose lower case or composed form is another character.
ALPHABET = [*"aAbzZ'stremvlld019.,;!?#%&)(<|>/\\_-\"`~", *" \t\n\r\x0b\x0c", *"àÀßÿ×÷ªºµ²³¼½¾¹éÉ", "\x00", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", "\xad", "İ", "ı", "Σ", "ς", "ſ", "K", "\u0301", "\u0331", "\u0307", "H", "ẖ", "Ж", "中", "\u2028", "\u3000", "١", "Ⅷ", "ﬁ", "\U0001f600", "<|endoftext|>", "<|", "the", "'ll"]


def as_list(got):
    ids, before = got
    return [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])]


def library(t, texts):
    return [x.tolist() for x in t.whole([x or "" for x in texts])]


@pytest.mark.parametrize("most, most_bytes", [(50, 1 << 20), (500_000, 1 << 20), (8, 100)])
def test_listed(most, most_bytes):
    t = Tokens(tokenizer_path(), most, most_bytes)
    want = library(t, TEXTS * 3)
    assert as_list(t.encode(TEXTS * 3)) == want == as_list(t.encode(TEXTS * 3))
    assert as_list(t.encode(TEXTS * 3, 2)) == [[*x, 2] for x in want]


def test_no_rows():
    ids, before = Tokens(tokenizer_path()).encode([], 2)
    assert len(ids) == 0 and before.tolist() == [0]


def test_fuzz():
    """20,000 random texts; and with few words held, so that they are forgotten."""
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(ALPHABET, rng.integers(0, 14))) for _ in range(20_000)]
    t = Tokens(tokenizer_path())
    want = library(t, texts)
    assert as_list(t.encode(texts)) == want
    few = Tokens(tokenizer_path(), 200)
    for at in range(0, 4000, 100):
        assert as_list(few.encode(texts[at : at + 100], 1)) == [[*x, 1] for x in want[at : at + 100]]


def test_every_character():
    """Each character up to U+2FFF, alone and within words."""
    texts = [f"{chr(c)} a{chr(c)}b {chr(c)}. A{chr(c)}; 1{chr(c)}2" for c in range(0x3000)]
    t = Tokens(tokenizer_path())
    assert as_list(t.encode(texts)) == library(t, texts)
