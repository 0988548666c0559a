"""Packing: an exact round trip of ids, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import packing, queries

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
TEXTS = [None, "", "a b", "it's  don't x y \u0085 éclair İstanbul ΣΣ ᴬ", "<|endoftext|> x<|startoftext|>y", "w" * 9000, "\n\t \x0b\x0c\r", "The Cat 12 345! " * 3000, "same", "same", "Word, WORD. word ... 9., é. <|STARTOFTEXT|>. don'T. áb Å", "\x1cfoo\x1dbar z"]


def check(rows, texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER).encode
    ids = {k: np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, own in ids.items():
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at and 0 < length <= packing.SIZE
            at += length
        assert at == len(own)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    total, used = len(sequences) * packing.SIZE, sum(map(len, ids.values()))
    return 1 - used / total


def test_edge_cases(spark):
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, length int")
    check(packing.packed(df, TOKENIZER).collect(), dict(enumerate(TEXTS)))
    assert packing.packed(df.limit(0), TOKENIZER).count() == 0


def test_documents(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert check(queries.op5_packing(spark, "/root/testdata/sf0.001").collect(), texts) < 0.02


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    used = defaultdict(int)
    for combo, repeats in packing.plan(histogram, 64):
        assert sum(combo) <= 64 and repeats > 0
        for n in combo:
            used[n] += repeats
    assert used == histogram


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZHJTWYhÅ9.,'é\u0301\u0331\u030c\u0308\u030aİ<|>-\u00a0\u2028 "), max_size=12), min_size=1, max_size=8))
def test_ids_are_the_tokenizers(texts):
    from tokenizers import Tokenizer

    words, one = packing.Words(TOKENIZER) if not KEPT else KEPT[0], Tokenizer.from_file(TOKENIZER) if not KEPT else KEPT[1]
    KEPT[:] = [words, one]
    for text, ids in zip(texts, words.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == one.encode(text, add_special_tokens=False).ids, text


KEPT = []
