"""Pitman-Yor: exact conditionals, probabilities that sum to one, scores against a plain version, held-out perplexity."""

import math
import zlib
from collections import Counter

import numpy as np
from tidemark.llm import pitman_yor as py
from tidemark.llm import queries


def test_stirling_and_lgamma():
    d = 0.3
    s = np.exp(py.stirling(d, 5))
    assert np.allclose(s[3, 1:4], [(1 - d) * (2 - d), 3 * (1 - d), 1])
    x = np.array([0.2, 1.0, 5.5, 40.0, 1e6])
    assert np.allclose(py.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-8)


def exact(c, x, d):
    """Weights S(c, t) x**t, t = 1..c, scaled."""
    logit = py.stirling(d, c)[c, 1:] + np.arange(1, c + 1) * np.log(x)
    chance = np.exp(logit - logit.max())
    return chance / chance.sum()


def test_drawn_tables_follow_their_weights():
    """By inversion and by Metropolis-Hastings, from far-off seats, at the query's discounts: mean, spread and each number's share."""
    n = 20_000
    for d in py.DISCOUNT[:6]:
        for c in (3, 12, 40, 41, 400, 1500):
            for x in (0.05, 2.0, 60.0):
                rng = np.random.default_rng(c)
                seats, t = py.Seats(d) if c < 4 else py.seats_of(d), np.full(n, 1 if x > 1 else c)
                for _ in range(1 if c <= py.EXACT else 12):
                    t = seats.drawn(np.full(n, c), t, np.full(n, x), rng)
                want = exact(c, x, d)
                mean = (np.arange(1, c + 1) * want).sum()
                sd = ((np.arange(1, c + 1) - mean) ** 2 @ want) ** 0.5
                assert t.min() >= 1 and t.max() <= c and abs(t.mean() - mean) < 0.05 * sd + 0.02, (d, c, x)
                assert abs(t.std() - sd) < 0.05 * sd + 0.02 and np.abs(np.bincount(t, minlength=c + 1)[1:] / n - want).max() < 0.025, (d, c, x)


def test_dishes_of_a_restaurant_are_drawn_jointly():
    """The sum of tables over 30 dishes of 4 customers has its exact mean and spread, parents fixed: dishes see each other."""
    for d, p in ((0.4, 0.1), (0.8, 0.03)):
        one = np.exp(py.stirling(d, 4)[4, 1:])
        ways = np.array([1.0])  # by total: products over dishes of S(4, t) p**t
        for _ in range(30):
            ways = np.convolve(ways, one * p ** np.arange(1, 5))
        totals = np.arange(30, 121)
        logit = np.log(ways) + np.array([np.log(1 + d * np.arange(t)).sum() for t in totals])
        want = np.exp(logit - logit.max())
        want /= want.sum()
        mean = (totals * want).sum()
        sd = ((totals - mean) ** 2 @ want) ** 0.5
        restaurants = 400
        keys = (np.arange(restaurants, dtype=np.uint64)[:, None] << np.uint64(8) | np.arange(30, dtype=np.uint64)).reshape(-1)
        old = py.DISCOUNT
        try:
            py.DISCOUNT = (d,) * 8
            level, rng, seen = py.Level(keys, 1), np.random.default_rng(0), []
            level.customers(np.full(len(keys), 4))
            for k in range(150):
                level.seat(np.full(len(keys), p), rng)
                if k >= 30:
                    seen.append(np.bincount(level.context, level.t))
        finally:
            py.DISCOUNT = old
        seen = np.concatenate(seen)
        assert abs(seen.mean() - mean) < 0.1 * sd and abs(seen.std() / sd - 1) < 0.03


def test_probabilities_sum_to_one(spark):
    texts = [b"the cat sat on the mat", b"the dog sat", b"a cat and a dog", b""]
    keys, n = py.counted(py.windows([py.sequence(t) for t in texts], 3)[0])
    contexts = np.unique(keys >> np.uint64(8))
    every = np.unique((contexts[:, None] << np.uint64(8) | np.arange(255, dtype=np.uint64)).reshape(-1))
    counts = dict(zip(keys.tolist(), n.tolist(), strict=True))
    df = spark.createDataFrame([(int(k), counts.get(int(k), 0)) for k in every], "key bigint, n bigint")
    total = Counter()
    for r in py.probabilities(df, 3).collect():
        total[r.key >> 8] += 10**r.value
    assert all(abs(v - 1) < 1e-9 for v in total.values()) and len(total) == len(contexts)


def test_windows():
    texts = [py.sequence(t) for t in (b"ab", b"", b"\tX  y")]
    assert texts == [b"ab\xfe", b"\xfe", b"x y\xfe"]
    keys, begin = py.windows(texts, 2)
    want = [(p + t)[k : k + 3] for p, t in ((b"\xff\xff", t) for t in texts) for k in range(len(t))]
    assert [int(k).to_bytes(3, "big") for k in keys] == want and begin.tolist() == [0, 3, 4]


def plain_base(rows):
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}


def test_edge_cases(spark):
    rows = [(0, None), (1, ""), (2, "a b A"), (3, "a b a"), (4, "x" * 50_000), (5, "new words\n here"), (6, "a b"), (9, "zzz")]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id bigint, text string, part string, raw int")
    got = {r.doc_id: r for r in py.scored(df, queries.toxicity.fold(folds=7) == 2).collect()}
    for d, (held, size, known, n, base) in plain_base(rows).items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, size, known, n) and math.isclose(r.base_score, base) and r.score < 0
    assert got[0].score == got[1].score and got[2].score == got[3].score
    assert py.scored(df.limit(0), queries.toxicity.fold(folds=7) == 2).count() == 0


def test_query_has_the_base_and_held_texts_do_not_teach(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, d, "documents").collect()]
    got = {r.doc_id: r for r in queries.op1_pitman_yor(spark, d).collect()}
    for doc, (held, size, known, n, base) in plain_base(rows).items():
        r = got[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, size, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9)
    changed = spark.createDataFrame([(k, "other text" if got[k].held_out else t) for k, t in rows], "doc_id bigint, text string")
    again = {r.doc_id: r.score for r in py.scored(changed, queries.toxicity.fold(folds=7) == 2).collect()}
    assert all(math.isclose(again[k], r.score, rel_tol=1e-12) for k, r in got.items() if not r.held_out)


def walked(tree, gram, context):
    """The averaged model's probability of one n-gram, level by level with dicts."""
    p = 1 / py.SYMBOLS
    for level, (own, share) in zip(reversed(tree.levels), reversed(tree.mean), strict=True):
        key = gram & ((1 << 8 * (level.length + 1)) - 1)
        dish, room = dict(zip(level.keys.tolist(), own, strict=True)), dict(zip(level.contexts.tolist(), share, strict=True))
        p = dish.get(key, 0.0) + room.get(key >> 8, 1.0) * p
    return p


def test_chances_of_any_ngrams_and_the_customers_of_each_level():
    texts = [py.sequence(t) for t in (b"the cat sat on the mat", b"the dog sat", b"a cat and a dog", b"")]
    keys, n = py.counted(py.windows(texts, 4)[0])
    tree = py.Subtree(keys, n, 0, 4)
    tree.sampled(np.full(len(tree.top()), 1 / py.SYMBOLS), 1)
    other = np.concatenate([keys, py.windows([py.sequence(b"the zebra sat dog")], 4)[0]])
    assert np.allclose(tree.chances(other, np.full(len(other), 1 / py.SYMBOLS)), [walked(tree, int(k), 4) for k in other], rtol=1e-12)
    for below, level, up in zip(tree.levels, tree.levels[1:], tree.up, strict=False):  # tables are the parent's customers
        assert np.array_equal(np.bincount(up, below.t), level.c) and (level.t >= 1).all() and (level.t <= level.c).all()


def test_rows_that_repeat_and_null_ids(spark):
    rows = [(None, "one two"), (None, "one two"), (None, None), (3, "one two"), (3, "one two"), (3, "three")]
    df = spark.createDataFrame([(*r, 1.5, "x", True) for r in rows], "doc_id bigint, text string, score double, key string, held boolean")
    got = py.scored(df, queries.toxicity.fold(folds=7) == 2).collect()
    assert len(got) == 6 and len({r.score for r in got if r.n_tokens == 3}) == 1 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 2, 3, 3, 3, 3]


def held_bits(train, held, context):
    """log10 probability of the held texts after the training texts, by one tree."""
    k, n = py.counted(py.windows(train, context)[0])
    h, m = py.counted(py.windows(held, context)[0])
    tree = py.Subtree(k, n, 0, context)
    tree.sampled(np.full(len(tree.top()), 1 / py.SYMBOLS), 5)
    return float(np.log10(tree.chances(h, np.full(len(h), 1 / py.SYMBOLS))) @ m)


def test_held_out_texts_beat_the_base_on_the_larger_table():
    """sf0.1: log10 probability a token over all held-out texts."""
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.1/documents.parquet'").fetchall()
    base = plain_base(rows)
    part = lambda want: [py.sequence((t or "").encode()) for d, t in rows if base[d][0] == want]
    tokens, plain = (sum(v[k] for v in base.values() if v[0]) for k in (1, 4))
    assert held_bits(part(False), part(True), py.CONTEXT) / tokens > plain / tokens + 0.1


def test_held_out_perplexity_falls_with_context():
    """On held texts of words made of syllables, longer contexts predict better, and close to the source's own entropy."""
    rng = np.random.default_rng(0)
    syllables = ["ka", "tor", "mi", "shen", "lo", "bra", "ti", "un"]
    text = lambda: " ".join("".join(rng.choice(syllables, rng.integers(1, 7))) for _ in range(80)).encode()
    rows = [py.sequence(text()) for _ in range(600)]
    by_context = [held_bits(rows[:500], rows[500:], k) for k in (0, 1, 3, 5)]
    assert by_context == sorted(by_context)
    source = 8000 * (math.log10(6) + 3.5 * math.log10(8))  # a length and its syllables, for each word
    assert -by_context[-1] < 1.15 * source


def test_seating_is_carried_on_and_settles():
    """A chain in two parts goes on where it stopped; held-out score and tables hardly move beyond the query's sweeps."""
    rng = np.random.default_rng(1)
    syllables = ["ka", "tor", "mi", "shen", "lo", "bra", "ti", "un"]
    text = lambda: " ".join("".join(rng.choice(syllables, rng.integers(1, 7))) for _ in range(80)).encode()
    k, n = py.counted(py.windows([py.sequence(text()) for _ in range(400)], 5)[0])
    above = lambda tree: np.full(len(tree.top()), 1 / py.SYMBOLS)
    tree, again = py.Subtree(k, n, 0, 5), py.Subtree(k, n, 0, 5)
    total = py.BURN + (py.ROUNDS - 1) * py.AGAIN
    tree.sampled(above(tree), 0, total - 1, 1)
    again.seated(tree.seats())
    assert all(np.array_equal(a.t, b.t) and np.array_equal(a.c, b.c) for a, b in zip(tree.levels, again.levels, strict=True))
    again.sampled(above(again), 1, py.AGAIN, py.SAMPLES, tree.seats())
    after = again.seats()
    fit = lambda tree: np.log10(tree.chances(k, np.full(len(k), 1 / py.SYMBOLS))) @ n
    score = fit(again)

    def tables(seed):
        """Mean tables of each level over 20 sweeps: those of the shortest contexts are few, and one draw of them is noise."""
        rng, seen = np.random.default_rng(seed), []
        for _ in range(20):
            again.sweep(above(again), rng)
            seen.append([int(x.t.sum()) for x in again.levels])
        return np.mean(seen, 0)

    before = tables(7)
    again.sampled(above(again), 2, 30, py.SAMPLES, after)
    assert abs(fit(again) / score - 1) < 2e-3
    assert (np.abs(tables(8) / before - 1) < 0.15).all(), (before, tables(9))
