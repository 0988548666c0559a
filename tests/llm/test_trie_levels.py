"""The trie made level by level gives each word what its own dynamic programming gives."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import token_counts as tc

SMALL = {tc.MARK: -2.0, "a": -1.5, "b": -2.5, "ab": -4.0, tc.MARK + "a": -3.5, "ba": -4.0, "abab": -8.0, "bab": -6.5, "北": -3.0, "🎉b": -9.0, "a" * 16: -20.0, "b" * 17: -1.0}


def alone(word, vocabulary):
    """(tokens, score) of one word, in a trie of its own."""
    trie = tc.Trie(vocabulary)
    node = trie.add(tc.MARK + word.decode("utf-8", "replace"))
    return trie.count[node], trie.best[node]


def test_words_of_a_batch_never_meet_the_trie_one_by_one(monkeypatch):
    words = [b"abab", b"ba", b"bbb", "é北".encode(), b"a" * 40]
    wanted = [alone(w, SMALL) for w in words]
    monkeypatch.setattr(tc.Trie, "add", None)
    counter = tc.Counter(SMALL)
    counter.learn(set(words))
    assert [counter[w] for w in words] == wanted


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text("abé北🎉\0" + tc.MARK, min_size=1, max_size=80).map(str.encode), st.binary(min_size=1, max_size=12)), max_size=30))
def test_levels_are_the_words_alone(texts):
    words = {w for t in texts for w in t.split()}
    counter = tc.Counter(SMALL)
    counter.learn(words)
    for w in words:
        assert counter[w] == alone(w, SMALL)


def test_unsorted_and_empty():
    pieces = tc.Pieces(SMALL)
    text = np.array([ord(c) for c in "baabba"], np.int64)
    tokens, scores = tc.scored(text, np.array([0, 2, 0, 4]), np.array([2, 3, 2, 2]), pieces, -19.0)
    assert tokens[0] == tokens[2] and scores[0] == scores[2]
    assert tc.scored(text, np.zeros(0, int), np.zeros(0, int), pieces, -19.0)[0].size == 0
    counter = tc.Counter({})
    counter.learn({b"ab", "é".encode()})
    assert counter[b"ab"] == alone(b"ab", {}) and counter["é".encode()] == alone("é".encode(), {})


def test_counts_start_anew(monkeypatch):
    monkeypatch.setattr(tc, "WORDS", 2)
    counter = tc.Counter(SMALL)
    for words in ({b"a", b"ab", b"b"}, {b"ab", b"ba"}, {b"bab"}):
        counter.learn(words)
        assert all(counter[w] == alone(w, SMALL) for w in words)
    assert len(counter) < 6


def test_runs_of_texts(monkeypatch):
    monkeypatch.setattr(tc, "TOGETHER", 4)
    texts = [b"", b"abc", b"d", b"efghij", b"k"]
    assert [t for run in tc.together(texts) for t in run] == texts and max(map(len, tc.together(texts))) < 5


def test_public_vocabulary():
    vocabulary = tc.pieces(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    counter = tc.Counter(vocabulary)
    words = {w.encode() for w in "the The cat, naïve 北京 🎉 x=1 https://a.b/c internationalisation don't ˈwɜːd Straße".split()}
    counter.learn(words)
    assert len(counter) == len(words) and all(counter[w] == alone(w, vocabulary) for w in words)
