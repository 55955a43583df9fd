"""The faster of the two encoders against the one that defines the ids."""

import random

import pytest

from quillspark.llm import packing


def test_both_encoders_agree_over_all_admitted_characters():
    """Random strings over every character that the faster encoder may meet, and typical runs."""
    path = pytest.importorskip("public_tokenizers").path
    exact, both = packing._encoder(path("byte_bpe_50k.json"), None), packing._encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    admitted = [c for c in map(chr, range(0x20B0)) if not packing.UNUSUAL.search(c)]
    assert len(admitted) > 590
    rng = random.Random(6)
    blanks, words = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", "\xa0", "\x0b", "\x85"], ["it's", "WE'LL", "don't'", "3.14", "ſ", "über", "naïve", "'s", "x" * 300, "0" * 50]
    for k in range(4000):
        parts = [rng.choice(admitted) if rng.random() < 0.7 else rng.choice(blanks + words) for _ in range(rng.randint(1, 60))]
        text = "".join(parts)
        assert exact(text).tolist() == both(text).tolist(), ascii(text)
    for c in admitted:
        for text in (c, c * 3, f"a{c}b", f" {c} ", f"1{c}2"):
            assert exact(text).tolist() == both(text).tolist(), ascii(text)
