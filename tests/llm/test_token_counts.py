"""Token counts against dynamic programming for each word alone."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import queries
from tidemark.llm import token_counts as tc

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
SMALL = {tc.MARK: -2.0, "a": -1.5, "b": -2.5, "ab": -3.0, tc.MARK + "a": -2.2, "ba": -3.1, "abab": -5.0}


def alone(word, vocabulary):
    byte = min(vocabulary.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + vocabulary[word[s:end]], best[s][1] + 1) for s in range(max(0, end - tc.LONGEST), end) if word[s:end] in vocabulary]
        if word[end - 1] not in vocabulary:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * byte, best[end - 1][1] + n))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé", max_size=12), max_size=20))
def test_shared_prefixes_change_nothing(words):
    counter = tc.Counter(SMALL)
    for w in words:
        score, n = alone(tc.MARK + w, SMALL)
        got = counter[w.encode()]
        assert got[0] == n and math.isclose(got[1], score)


def test_documents_and_edge_cases(spark):
    vocabulary = tc.pieces(MODEL)
    texts = [None, "", " \n", "the cat", "the cat", "w" * 4000, "naïve 北京 🎉 the"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, score int")
    rows = tc.counted(df, vocabulary).collect()
    assert all(r.score_in == 1 for r in rows)
    for r in rows:
        own = [alone(tc.MARK + w, vocabulary) for w in (r.text or "").split()]
        assert (r.n_words, r.n_tokens) == (len(own), sum(n for _, n in own)) and math.isclose(r.score, sum(s for s, _ in own), abs_tol=1e-6)
    assert tc.counted(df.limit(0), vocabulary).count() == 0
    texts = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    seen = {}
    for r in queries.op4_token_counts(spark, "/root/testdata/sf0.001").collect():
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        assert r.n_tokens == sum(seen.setdefault(w, alone(tc.MARK + w, vocabulary))[1] for w in words)


def test_bounded_trie(monkeypatch):
    monkeypatch.setattr(tc, "NODES", 5)
    counter = tc.Counter(SMALL)
    assert [counter[w][0] for w in (b"abab", b"ba", b"abab", b"bbb")] == [alone(tc.MARK + w, SMALL)[1] for w in ("abab", "ba", "abab", "bbb")]
