import math
import time
import zlib
from collections import Counter

import numpy as np

from hemaspark.llm import lm


def brute(docs):
    split = [(i, (t or "").encode().lower().split() + [b""]) for i, t in docs]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in split if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((repr(i), out(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in split)


def got(rows):
    return sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def test_query_equals_brute_force_and_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = lm.query(spark, sf).collect()
    assert got(rows) == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def test_small_dictionary_joins_the_rest(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r.doc_id: r for r in lm.scored(df).collect()}
    b = {r.doc_id: r for r in lm.scored(df, dictionary=1100).collect()}
    for i, r in a.items():
        assert abs(r.base_score - b[i].base_score) < 1e-6 and r.n_known == b[i].n_known and abs(r.score - b[i].score) < 1e-3


def test_odd_rows(odd_docs, empty_docs):
    assert got(lm.scored(odd_docs).collect()) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert lm.scored(empty_docs).count() == 0


def test_more_frequent_words_than_ends(spark):
    """One very long text: 1,500 words are each oftener than the end."""
    docs = [(0, " ".join(f"w{i % 1500}" for i in range(6000))), (1, "w1 w2 other")]
    rows = lm.scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert got(rows) == brute(docs) and all(math.isfinite(r.score) and r.score < 0 for r in rows)


def small():
    m = lm.GatedModel(10, 0, hidden=5, size=4, seed=1)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    return m


def test_probabilities_sum_to_one():
    m = small()
    h = np.random.default_rng(0).normal(size=(1, 5))
    total = sum(math.exp(m.log_probs(h, np.array([i]))[0][0]) for i in range(11))
    assert abs(total - 1) < 1e-6


def test_gradients():
    m = small()
    ids = np.array([[3, 7, 0, 10, 2], [1, 1, 9, -1, -1]])

    def loss(grads=None):
        states, saved, _ = m.forward(np.zeros((2, 5)), ids.T)
        logp, dh = m.log_probs(states.reshape(-1, 5), ids.T.ravel(), grads)
        if grads is not None:
            rows, gates = m.backward(saved, ids.T, dh.reshape(states.shape), grads)
            grads["gates"][rows] += gates
        return -logp.sum()

    g = {k: np.zeros_like(v) for k, v in m.p.items()}
    loss(g)
    rng = np.random.default_rng(3)
    for k, v in m.p.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if v[at] < -1e8:
                continue
            old = v[at]
            v[at] = old + 1e-5
            up = loss()
            v[at] = old - 1e-5
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-2 * (1 + abs(g[k][at]))


def test_state_is_carried_and_lanes_do_not_matter():
    m = lm.GatedModel(10, 0, seed=2)
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(1, 11, n), 0) for n in (0, 1, 5, 200, 63, 64, 65, 700)]
    one = np.array([m.score([d], lanes=1, steps=10**6)[0] for d in docs])
    for lanes, steps in ((1, 7), (3, 64), (256, 16)):
        assert np.allclose(m.score(docs, lanes, steps), one, rtol=1e-4)


def test_learns_a_pattern():
    docs = [np.array([1, 2, 3, 4] * 20 + [0]) for _ in range(60)]
    m = lm.GatedModel(6, 0, hidden=16, size=3, seed=0)
    losses = [loss / n for loss, n in (m.fit(docs, lanes=4, steps=16, width=64, rate=0.1) for _ in range(8))]
    assert losses[-1] < 0.12 < losses[0]


def test_every_word_of_a_stream_is_learnt_from():
    rng = np.random.default_rng(4)
    for sizes in ((1,), (3, 5), (5000,), (10, 2000, 1, 300), (64,) * 100):
        docs = [np.append(rng.integers(1, 11, n - 1), 0) for n in sizes]
        assert lm.GatedModel(10, 0).fit(iter(docs), lanes=8, steps=16, width=32)[1] == sum(sizes)


def sentences(rng, n):
    """Pairs of words that belong together, which single words' counts don't tell."""
    return " ".join(f"a{k} b{k}" for k in rng.integers(0, 40, n // 2))


def test_few_and_long_documents(spark):
    """Long texts only, some far beyond what a grid holds: the model learns from them and beats the base on those held out."""
    rng = np.random.default_rng(7)
    docs = [(i, sentences(rng, 30_000 if i % 3 else 90_000)) for i in range(12)]
    rows = lm.scored(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert got(rows) == brute(docs)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_averaged_weights(spark):
    rows = [(i, i % 7 + 1, np.full(5, i, np.float32).tobytes()) for i in range(100)]
    got = lm._averaged(spark.createDataFrame(rows, lm.MODELS).repartition(9), 100)
    assert np.allclose(got, sum(i * n for i, n, _ in rows) / sum(n for _, n, _ in rows), rtol=1e-5)
    assert lm._averaged(spark.createDataFrame([], lm.MODELS), 0) is None


def plain(m, h, ids):
    """The recurrence as it is written down: states before each word, one product for all gates."""
    k, states = m.hidden, []
    for row in ids:
        states.append(h)
        a, x = h @ m.p["u"], m.p["gates"][np.maximum(row, 0)]
        zr = 1 / (1 + np.exp(-np.maximum(x[:, : 2 * k] + a[:, : 2 * k], -80)))
        n = 2 / (1 + np.exp(-2 * (x[:, 2 * k :] + zr[:, k:] * a[:, 2 * k :]))) - 1
        h = ((h - n) * zr[:, :k] + n) * (row != m.end)[:, None].astype(h.dtype)
    return np.array(states), h


def test_states_are_those_of_the_plain_recurrence_in_less_time():
    m, rng = lm.GatedModel(1024, 0), np.random.default_rng(5)
    ids, h = rng.integers(-1, 1025, (24, 512)), rng.normal(size=(512, 32)).astype(np.float32) * 0.3
    times, tables, room = [[], []], m.tables(), {}
    for _ in range(25):
        for took, f in zip(times, (lambda: plain(m, h, ids), lambda: m.forward(h, ids, tables, keep=False, room=room)[::2]), strict=True):
            start = time.thread_time()
            got_ = f()
            took.append(time.thread_time() - start)
            if len(took) == 1:
                want = got_ if took is times[0] else want
                assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(got_, want, strict=True))
    assert min(times[1]) < 0.75 * min(times[0])


def test_gates_gradients_are_summed_by_word():
    rng = np.random.default_rng(6)
    ids = np.sort(np.append(rng.integers(0, 400, 3000), [7] * 500 + [9] * lm.OFTEN + [11] * (lm.OFTEN + 1)))
    at, d = rng.permutation(3 * len(ids)).reshape(3, -1), rng.normal(size=(3 * len(ids), 4))
    for part in (ids, ids[:0], ids[:1], np.full(len(ids), 3)):
        rows, sums = lm.GatedModel._summed(part, at[:, : len(part)], d)
        assert sorted(rows) == sorted(set(part.tolist()))
        for i, word in enumerate(rows):
            assert np.allclose(sums[:, i], d[at[:, : len(part)][:, part == word]].sum(axis=1))


def test_rare_words_that_repeat_in_a_text(spark):
    """Words beyond the dictionary, oftener than once in a text and in several, reach their join by document and word, not by way of scoring."""
    docs = [(i, " ".join(f"a{k % 3} r{k % (5 + i)} R{k % 2}" for k in range(10 * i))) for i in range(12)] + [(12, None), (13, "new new once")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for dictionary in (1, 4, 9):
        rows = lm.scored(df, dictionary=dictionary, classes=1).collect()
        assert got(rows) == brute(docs) and all(math.isfinite(r.score) for r in rows)
