import math

import numpy as np

from hemaspark.llm import embeddings


def brute(rows, cosine=0.9):
    fine = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    n = len(rows)
    near = [set() for _ in range(n)]
    vecs = [np.array(v, float) if fine(v) else None for _, v in rows]
    for i in range(n):
        for j in range(n):
            if i != j and vecs[i] is not None and vecs[j] is not None and len(vecs[i]) == len(vecs[j]):
                if vecs[i] @ vecs[j] / (np.linalg.norm(vecs[i]) * np.linalg.norm(vecs[j])) >= cosine:
                    near[i].add(j)
    seen = {}
    for i in range(n):
        if i not in seen:
            part, stack = {i}, [i]
            while stack:
                for b in near[stack.pop()] - part:
                    part.add(b)
                    stack.append(b)
            ids = [rows[k][0] for k in part if rows[k][0] is not None]
            seen |= dict.fromkeys(part, min(ids) if ids else None)
    return sorted((repr(rows[i][0]), len(near[i]), repr(seen[i]), rows[i][0] == seen[i]) for i in range(n))


def got(df):
    return sorted((repr(r[0]), r.n_links, repr(r.component_id), r.kept) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(embeddings.query(spark, sf)) == brute(rows)


def test_odd_vectors_and_hot_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    rows = [(i, (base[i % 40] + 0.1 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, base[0].tolist()) for i in range(50)]  # copies
    rows += [(5, base[0].tolist()), (5, base[0].tolist()), (None, base[1].tolist()), (None, None), (2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [float("inf")] * 16), (2004, [None] + [1.0] * 15), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [-0.0] * 15 + [1.0]), (2009, [0.0] * 15 + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (4096, 30, 7):
        assert got(embeddings.near_duplicates(df, block=block)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, n long, node string")
    assert got(embeddings.near_duplicates(df)) == []


def test_recall_at_the_threshold(spark):
    """Pairs made at cosines just above the threshold, among many other vectors: recall against brute force."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    c = rng.uniform(0.901, 0.93, size=(3000, 1))
    y = c * x + np.sqrt(1 - c * c) * g
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sum(r.n_links > 0 for r in embeddings.near_duplicates(df, lists=64).collect())
    assert found / 6000 > 0.98


def test_recall_of_low_rank_vectors(spark):
    """Vectors of 256 components that vary in 12 directions only, in many lists: partners differ where lists are cut."""
    rng = np.random.default_rng(6)
    frame = np.linalg.qr(rng.normal(size=(256, 12)))[0]
    z = rng.normal(size=(6000, 12))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    x = z @ frame.T
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, lists=200).collect()}
    assert all(found[i] <= n for i, n in enumerate(want.tolist())) and sum(found.values()) > 0.97 * want.sum()


def test_many_lists_in_two_levels():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coarse, books = embeddings.train(x, 1500)
    assert 1300 < len(coarse) < 1700 and len(books) == 8
    assert np.linalg.norm(x - coarse[embeddings._nearest(x, coarse)], axis=1).mean() < 0.75 * np.linalg.norm(x - x[rng.integers(9000, size=9000)], axis=1).mean()


def test_dense_vectors_are_planned_in_bounded_time_and_memory():
    """All of a sample's vectors are near each other: 33 million pairs, of which a few for each vector are looked at."""
    import time
    import tracemalloc

    rng = np.random.default_rng(8)
    x = rng.normal(size=16) + 0.05 * rng.normal(size=(16384, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coarse = x[rng.choice(len(x), 200, replace=False)]
    tracemalloc.start()
    began = time.time()
    found = embeddings.sufficient(x, coarse, 0.9)
    assert 100 < found <= 200 and time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
