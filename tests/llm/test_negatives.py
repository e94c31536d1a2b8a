import math

import numpy as np
import pytest

from hemaspark.llm import negatives as ng

ANCHORS = "vec_id % 10 = 0"


def brute(rows, every=10, positives=5, negatives=3, scale=256, limit=2**62):
    fine = lambda v, label: label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if fine(v, label)]
    rows = [r for r in rows if sum(x * x for x in r[1]) < limit]
    out = []
    for a, (anchor, v, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i is None, i or 0, i, other) for b, (i, w, other) in enumerate(rows) if b != a and len(w) == len(v))
        for s, _, _, positive, other in [r for r in found if r[4] == label][:positives]:
            hits = [(n, i) for n, _, _, i, other in found if other != label and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(anchor, positive, k + 1, i, -s, -n) for k, (n, i) in enumerate(hits)]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, score int, row string, q int")


@pytest.mark.parametrize("kind", ["even", "clusters", "negative"])
def test_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 10)) * 0.3
    if kind != "even":
        x = 0.3 * x + rng.normal(size=(12, 10))[rng.integers(12, size=900)]
    if kind == "negative":
        x = np.where(np.arange(900)[:, None] % 10 == 0, -np.abs(x), np.abs(x))  # anchors' scores with others are negative
    rows = [(i, v.tolist(), int(rng.integers(4))) for i, v in enumerate(x)]
    want = brute(rows)
    for block, asked, lists in {"even": [(4096, 2048, None), (60, 13, 40)], "clusters": [(60, 13, 40)], "negative": [(400, 2048, 7)]}[kind]:
        assert got(ng.hard_negatives(frame(spark, rows), ANCHORS, block=block, asked=asked, lists=lists)) == want


def test_odd_rows_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 3, size=(30, 5))
    rows = [(i, [float(x) for x in base[i % 30]], int(i // 30 % 3)) for i in range(180)]  # copies with several labels, many equal scores
    rows += [(1000 + i, [1.0, 0.0, 2.0, 0.0, 1.0], 7) for i in range(80)]
    rows += [(50, [1.0] * 5, 1), (50, [1.0] * 5, 1), (None, [1.0] * 5, 1), (None, [1.0] * 5, 2), (2000, None, 1), (2010, [1.0] * 5, None), (2020, [float("nan")] * 5, 1), (2030, [float("-inf")] * 5, 1), (2040, [None] * 5, 1)]
    rows += [(2050, [], 1), (2060, [], 1), (2070, [], 2), (2080, [0.0] * 5, 1), (2090, [1.0, 2.0], 1), (2100, [2.0, 1.0], 1), (2110, [1.0, 1.0], 2), (2120, [1e300] * 5, 1), (2130, [-0.3] * 5, -4)]
    want = brute(rows)
    assert got(ng.hard_negatives(frame(spark, rows), ANCHORS, block=25, asked=6, lists=9)) == want


def test_scores_beyond_doubles(spark):
    """Products of 2^53 and more are exact as well."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(2**28, 2**29, size=4) / 256).tolist(), i % 2) for i in range(60)]
    assert got(ng.hard_negatives(frame(spark, rows), ANCHORS)) == brute(rows)


def test_window():
    for p in range(-450, 451):
        low, high = (int(x[0]) for x in ng.window(np.array([p])))
        assert [s for s in range(-500, 501) if 50 * p <= 100 * s <= 95 * p] == list(range(low, high + 1))


def test_lists_are_skipped(spark, monkeypatch):
    """Clustered vectors: bounds rule most lists out, and what is left suffices."""
    rng = np.random.default_rng(9)
    x = np.repeat(np.eye(20) * 4, 50, axis=0) + 0.02 * rng.normal(size=(1000, 20))
    radius = max(np.linalg.norm(x[50 * j : 50 * j + 50] - 4 * np.eye(20)[j], axis=1).max() for j in range(20))
    q = x[:5]
    most = q @ (4 * np.eye(20)) + np.linalg.norm(q, axis=1)[:, None] * radius
    kth = np.sort(q @ x.T, axis=1)[:, -6]
    assert ((most >= kth[:, None]).sum(1) == 1).all()
    order = np.argsort(-most, axis=1)
    seen = [(part, tuple(ask)) for part, ask in ng.visits(order, lambda i, j: most[i, j] >= kth[i])]
    assert seen == [(0, (0, 1, 2, 3, 4))]


def test_empty(spark):
    for rows in ([], [(10, [1.0], 1)], [(10, None, 1)], [(10, [1.0], 1), (11, [1.0], 1)]):
        assert ng.hard_negatives(frame(spark, rows), ANCHORS).collect() == []


def test_query_equals_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = ng.query(spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(ng.SQL).project(", ".join(found.columns)).fetchall())
