import numpy as np
from pyspark.sql import functions as F

from hemaspark import queries
from hemaspark.operators import encoder, gmm, stats


def test_distances_take_all_rows(spark, sf):
    df = queries.scaled(spark, sf)
    a, b = df.where("label < 5"), df.where("label >= 5")
    assert queries.transport_distance(spark, sf).first().wasserstein_2 > 0
    row = queries.distribution_distances(spark, sf).first()
    assert abs(row.sliced_wasserstein - stats.sliced_wasserstein(a, b, ["x", "y"])) < 1e-6


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 2)), rng.normal(0.5, 1.2, size=(40, 2))
    a, b = (spark.createDataFrame([(float(p), float(q)) for p, q in m], "x double, y double") for m in (x, y))
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(axis=2) / 200).mean()
    assert abs(stats.mmd(a, b, ["x", "y"]) - (k(x, x) + k(y, y) - 2 * k(x, y))) < 1e-9
    near, bound = stats.mmd_with_bound(a, b, ["x", "y"], exact=10)  # by random directions
    assert 0 < abs(near - (k(x, x) + k(y, y) - 2 * k(x, y))) < bound
    d = np.random.default_rng(0).normal(size=(30, 2))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    want = np.mean([np.abs(np.sort(x @ v) - np.sort(y @ v)).mean() for v in d])
    assert abs(stats.sliced_wasserstein(a, b, ["x", "y"]) - want) < 1e-9


def test_exact_transport_against_all_assignments(spark):
    from itertools import permutations

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(6, 2)), rng.normal(1, 2, size=(6, 2))
    a, b = (spark.createDataFrame([(float(p), float(q)) for p, q in m], "x double, y double") for m in (x, y))
    cost = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    want = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(6))) / 6
    assert abs(stats.exact_transport_distance(a, b, ["x", "y"]) - want**0.5) < 1e-9


def test_transport_plans_of_uneven_weights():
    """Marginals hold, and no other plan costs less: there are potentials under which what is used costs nothing and nothing costs less."""
    rng = np.random.default_rng(4)
    for n, m in ((1, 7), (9, 4), (30, 31), (60, 40)):
        a, b, cost = rng.random(n), rng.random(m), rng.random((n, m))
        plan = gmm.transport_plan(a, b, cost)
        assert np.allclose(plan.sum(axis=1), a / a.sum()) and np.allclose(plan.sum(axis=0), b / b.sum())
        used = np.argwhere(plan > 1e-12)
        # Shortest distances over residual edges: a negative cycle would keep lowering them.
        u, v = np.zeros(n), np.zeros(m)
        for _ in range(n + m + 1):
            v = np.minimum(v, (u[:, None] + cost).min(axis=0))
            np.minimum.at(u, used[:, 0], v[used[:, 1]] - cost[used[:, 0], used[:, 1]])
        assert (u[:, None] + cost - v >= -1e-9).all() and np.allclose((u[:, None] + cost - v)[plan > 1e-12], 0)


def test_logistic_accuracy(spark):
    rows = [([float(i % 2) * 4 - 2 + (i % 5) / 10, (i % 3) / 3], "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "code array<double>, label string")
    assert encoder.logistic_accuracy(df, "code", "label") == 1.0
    mixed = spark.createDataFrame([([1.0, 1.0], "ab"[i % 4 == 0]) for i in range(40)], "code array<double>, label string")
    assert encoder.logistic_accuracy(mixed, "code", "label") == 0.75


def test_distance_of_mixtures(spark):
    """Two clouds moved by a known vector: the distance is its length; of a cloud to itself it is zero."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal([0, 0], 1, (3000, 2)), rng.normal([30, 10], 2, (2000, 2))])
    frame = lambda m: spark.createDataFrame([(float(p), float(q)) for p, q in m], "`a.1` double, b double")
    a, b = frame(x), frame(x + [3.0, 4.0])
    assert abs(stats.mixture_distance(a, b, ["a.1", "b"], 2, tol=1e-8) - 5) < 0.01
    assert stats.mixture_distance(a, a, ["a.1", "b"], 2) < 1e-3


def test_discrepancy_of_many_rows(spark):
    """Beyond the rows that are compared pair by pair: within the bound of a value known in closed form."""
    df = spark.range(60_000).select(F.randn(1).alias("x"), (F.randn(2) + 1.0).alias("y"))
    a, b = df.select(F.col("x").alias("v")), df.select(F.col("y").alias("v"))
    near, bound = stats.mmd_with_bound(a, b, ["v"], bandwidth=1.0)
    want = 2 / 3**0.5 * (1 - np.exp(-1 / 6))
    assert abs(near - want) < bound + 0.01
