import math

import numpy as np
import pytest

from hemaspark.llm import neighbours as nb

ASKS = "vec_id % 20 = 0"


def ordered(v, w):
    total = 0.0
    for x, y in zip(v, w, strict=True):
        total += float(x) * float(y)
    return total


def brute(rows, k, every):
    fine = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    rows = [(i, v) for i, v in rows if fine(v)]
    out = []
    for a, (q, v) in enumerate(rows):
        if q is not None and q % every == 0:
            found = sorted((-ordered(v, w), i is None, i or 0, i) for b, (i, w) in enumerate(rows) if b != a and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(found)]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def recall(found, x, ids, k):
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        mine = sorted(by[ids[i]])
        assert [n for n, _, _ in mine] == list(range(1, k + 1)) and len({v for _, v, _ in mine}) == k
        assert all(s == ordered(x[i], x[v]) for _, v, s in mine[:2]) and mine == sorted(mine, key=lambda r: (-r[2], r[1]))
        hits += len({v for _, v, _ in mine} & set(ids[np.lexsort((ids, -score))[:k]].tolist()))
        total += k
    return hits / total


@pytest.mark.parametrize("kind", ["sphere", "lengths", "clusters"])
def test_recall_against_brute_force(spark, kind):
    """At least 0.96 of the true neighbours, where the search is cut (several cells and blocks), for vectors of one length and of many."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    if kind == "sphere":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "lengths":
        x *= rng.lognormal(0, 1, size=(6000, 1))
    else:
        x = x * 0.1 + rng.normal(size=(40, 32))[rng.integers(40, size=6000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(nb.nearest(df, ASKS, block=700, asked=90).collect(), x, np.arange(6000), 20) > 0.96


def test_the_test_stops_the_search(spark):
    """Clustered vectors: only a small part of all points is verified."""
    rng = np.random.default_rng(5)
    x = 0.05 * rng.normal(size=(3000, 24)) + rng.normal(size=(60, 24))[rng.integers(60, size=3000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    way, limit = nb.directions(24, nb.DIRECTIONS), nb.stop_ratio(nb.CERTAIN, nb.DIRECTIONS)
    p, q = nb.project(x, 1.0, way), nb.project(x[:50], None, way)
    kth = np.sort(x[:50] @ x.T, axis=1)[:, -21]
    reach = limit * nb.squared(kth, np.ones(50), 1.0)
    parts = nb.leaves(p)
    assert sorted(np.concatenate(parts).tolist()) == list(range(3000)) and max(map(len, parts)) <= nb.LEAF
    far = nb.to_box(q, [p[i].min(0) for i in parts], [p[i].max(0) for i in parts])
    assert (far <= reach[:, None]).mean() < 0.4


def test_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-2, 3, size=(60, 6))
    rows = [(i, [float(x) for x in base[i % 60]]) for i in range(240)]  # copies, many equal scores
    rows += [(1000 + 20 * i, [1.0, 0.0, 0.0, 2.0, 0.0, 1.0]) for i in range(60)]
    rows += [(40, [1.0] * 6), (40, [1.0] * 6), (None, [2.0] * 6), (None, None), (2000, None), (2020, [0.0] * 6), (2040, [float("nan")] + [1.0] * 5), (2060, [float("inf")] * 6), (2080, [None] + [1.0] * 5), (2100, []), (2120, [1.0, 2.0]), (2121, [2.0, 4.0]), (2140, [-0.0] * 5 + [1.0]), (2160, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "vec_id long, embedding array<double>, score int, row string, q int")
    assert got(nb.nearest(df, ASKS, k=7, certain=1 - 1e-12, block=40, asked=7)) == brute(rows, 7, 20)


def test_fewer_than_k_and_large_numbers(spark):
    rows = [(20 * i, [10.0 ** (150 + 4 * i), 1.0]) for i in range(3)] + [(7, [1e-300, 0.0])]
    assert got(nb.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ASKS)) == brute(rows, 20, 20)


def test_empty(spark):
    for rows in ([], [(1, [1.0]), (2, [1.0])], [(20, None)]):
        assert nb.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ASKS).collect() == []


def test_chi_square():
    assert abs(nb.chi_square(nb.stop_ratio(0.95, 2), 2) - 0.95) < 1e-9 and abs(nb.stop_ratio(0.95, 2) + 2 * math.log(0.05)) < 1e-9
    sample = (np.random.default_rng(1).normal(size=(40000, 12)) ** 2).sum(1)
    assert abs((sample <= nb.stop_ratio(0.9, 12)).mean() - 0.9) < 0.01


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    assert recall(nb.query(spark, sf).collect(), x, np.array([r.vec_id for r in rows]), 20) > 0.97
