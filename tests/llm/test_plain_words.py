"""Words of letters and marks need only the tokenizer's model; their ids are the tokenizer's."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import packing

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
WORDS = packing.Words(TOKENIZER)


def wanted(text):
    return WORDS.tokenizer.encode(text, add_special_tokens=False).ids


def got(text):
    return np.frombuffer(next(WORDS.ids([text.encode()])), "<u4").tolist()


def test_only_odd_words_are_encoded_whole(monkeypatch):
    seen = []
    words = packing.Words(TOKENIZER)
    encode = words._encode
    monkeypatch.setattr(words, "_encode", lambda w: (seen.extend(w), encode(w)))
    text = "Ndedti, vié&&& Ébrasé. rehathhe,### ... Straße don't 12 x=y"
    assert np.frombuffer(next(words.ids([text.encode()])), "<u4").tolist() == wanted(text)
    assert {w for w in seen if w} == {b"don't", b"12", b"x=y"}


def test_every_letter_under_u0250_with_every_mark():
    for c in map(chr, range(33, 0x250)):
        if not c.isspace():
            text = " ".join([c, f"a{c}", f"{c}a", f"{c}.", f"Z{c}'", f"'{c}", f"{c}s&&", f"a'{c}", f"&{c}&"])
            assert got(text) == wanted(text), hex(ord(c))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZsStTdlLEéÉÿßªµº×÷ŸİıſÅ̊́'&<|>._-1²­‍"), min_size=1, max_size=9), max_size=10))
def test_ids_of_mixed_words(words):
    text = " ".join(words)
    assert got(text) == wanted(text)


def test_two_generations(monkeypatch):
    monkeypatch.setattr(packing.Words, "LIMIT", 3)
    words = packing.Words(TOKENIZER)
    for text in ("alpha beta, gamma", "delta beta. epsilon", "alpha epsilon! beta", "beta é12 alpha"):
        assert np.frombuffer(next(words.ids([text.encode()])), "<u4").tolist() == wanted(text)
