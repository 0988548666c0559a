"""Every operator on tables whose other columns have the names that it adds or uses inside: the user's values come back."""

import pytest
from tidemark.llm import decontaminate, line_dedup, matroska, near_dedup, packing, pitman_yor, queries, secrets, token_counts, toxicity, warc
from tidemark.llm.common import own_columns, stored

NAMES = (
    "score n_words n_tokens hit_spans n_hit items contaminated n_lines n_dropped spans_assign spans_access spans_hex spans_entropy raw _raw _bytes _all doc part h last n key c0 c1 "
    "_doc _part shard error value kind held bucket sketch fp rep id y f page digest payload length url first copies of by score_in Items_in"
).split()
ROWS = [(0, "a secret = abcdefgh12 here"), (1, None), (2, "just four words here\na line that is long enough to count"), (2, "just four words here\na line that is long enough to count"), (None, ""), (5, "x" * 200_000)]


def table(spark):
    """Each other column has its own values; one sort of column each: numbers, strings, arrays."""
    sort = {0: ("bigint", lambda k, r: k * 1000 + r), 1: ("string", lambda k, r: f"{k}:{r}"), 2: ("array<int>", lambda k, r: [k, r])}
    kinds = [sort[k % 3] for k in range(len(NAMES))]
    rows = [(*(f(k, r) if r % 2 else None for k, (_, f) in enumerate(kinds)), *row) for r, row in enumerate(ROWS)]
    return spark.createDataFrame(rows, ", ".join([*(f"`{n}` {t}" for n, (t, _) in zip(NAMES, kinds, strict=True)), "doc_id bigint", "text string"]))


def model():
    import numpy as np

    return toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0)


def items(spark):
    return spark.createDataFrame([(1, "just four words here", 3)], "item_id bigint, text string, n_words int")


CARRYING = {
    "toxicity": (lambda s, df: toxicity.scored(df, model()), ["score"]),
    "token_counts": (lambda s, df: token_counts.counted(df, {"▁a": -1.0}), ["n_words", "n_tokens", "score"]),
    "line_dedup": (lambda s, df: line_dedup.dedup_lines(df), ["n_lines", "n_dropped"]),
    "decontaminate": (lambda s, df: decontaminate.contamination(df, items(s)), ["n_words", "hit_spans", "n_hit", "items", "contaminated"]),
    "cut": (lambda s, df: decontaminate.without_spans(decontaminate.contamination(df, items(s))), ["n_words", "hit_spans", "n_hit", "items", "contaminated"]),
    "secrets": (lambda s, df: secrets.scan(df), ["spans_assign", "spans_access", "spans_hex", "spans_entropy"]),
    "redacted": (lambda s, df: secrets.redacted(secrets.scan(df)), ["spans_assign", "spans_access", "spans_hex", "spans_entropy"]),
}


@pytest.mark.parametrize("name", CARRYING)
def test_values_come_back(spark, name):
    run, added = CARRYING[name]
    df = table(spark)
    out = stored(run(spark, df), "clash")  # Parquet refuses names that are there twice
    width = len(df.columns)
    assert out.columns[width:] == added and all(a == b or (b in added and a.startswith(f"{b}_in")) for a, b in zip(out.columns, df.columns, strict=False))
    mine = lambda d: sorted(map(repr, (tuple(r)[: len(NAMES) + 1] for r in d.collect())))  # noqa: E731  all but the text, which some change
    assert mine(own_columns(out, df)) == mine(df)
    plain = run(spark, df.select("doc_id", "text"))
    tail = lambda d: sorted(map(repr, (tuple(r)[-len(added) :] for r in d.collect())))
    assert tail(out) == tail(plain)
    assert run(spark, df.limit(0)).count() == 0


READING = {
    "pitman_yor": lambda df: pitman_yor.scored(df, toxicity.fold(folds=7) == 2),
    "matroska": lambda df: matroska.read_back(matroska.stored_media(df)),
    "packing": lambda df: packing.packed(df, queries.tokenizer("word_bpe_49k.json")),
    "near_dedup": near_dedup.deduplicated,
    "warc": lambda df: warc.read_archives(warc.write_archives(df.drop("url", "page").withColumnRenamed("digest", "url"), "doc_id", "url", "text")),
}


@pytest.mark.parametrize("name", READING)
def test_other_columns_are_not_read(spark, name):
    run, df = READING[name], table(spark)
    plain = df.select("doc_id", "text") if name != "warc" else df.select("doc_id", "text", "digest")
    assert sorted(map(repr, run(df).collect())) == sorted(map(repr, run(plain).collect()))


def test_a_text_column_of_an_added_name(spark):
    df = table(spark).select("doc_id", "text").withColumnRenamed("text", "Score")
    out = toxicity.scored(df, model(), text="Score")
    assert out.columns == ["doc_id", "Score_in", "score"] and out.count() == len(ROWS)
