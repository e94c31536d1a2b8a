import json

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemaspark.functions.columns import digest_uniform
from hemaspark.operators import gmm, mixtures, transport
from hemaspark.plans.api import EventAligner

NAMES = ["x", "y.1", "z"]


def cloud(n, seed=0):
    rng = np.random.default_rng(seed)
    parts = [rng.normal([60, 80, 30], [12, 9, 4], (n // 3, 3)), rng.normal([150, 90, 60], [9, 20, 10], (n // 3, 3)), rng.multivariate_normal([160, 150, 90], [[200, 80, 0], [80, 150, 20], [0, 20, 50]], n - 2 * (n // 3))]
    return rng.permutation(np.concatenate(parts))


@pytest.fixture(scope="module")
def big(spark):
    x = cloud(100_000)
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *NAMES]).repartition(7).cache()


def start(x, k=3):
    return gmm.Mixture(np.full(k, 1 / k), x[:k] + 0.0, np.repeat(np.cov(x.T)[None], k, axis=0))


def test_one_round_equals_numpy(spark):
    x = cloud(3000, 4)
    w = np.random.default_rng(1).random(3000)
    m = start(x)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, w, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)], [*NAMES, "w"]).repartition(5)
    a = m.log_densities(x) + np.log(m.weights)
    norm = np.log(np.exp(a).sum(axis=1))
    want = gmm._estimate(x, w, np.exp(a - norm[:, None]), np.eye(3), "full", 1e-6)
    for centre in (np.zeros(3), x.mean(axis=0)):
        found = {r.component: np.array(r.sums) for r in mixtures.expectation(df, NAMES, [m], centre, "w").collect()}
        assert np.allclose(found[-1], [w @ norm, w.sum()])
        got = mixtures.maximisation(np.array([found[k] for k in range(3)]), centre, np.eye(3))
        assert np.allclose(got.weights, want.weights) and np.allclose(got.means, want.means) and np.allclose(got.covariances, want.covariances, atol=1e-6)


def test_same_likelihood_as_in_memory(big):
    x, df = big
    first = gmm.fit(x[:2000], 3, n_init=2)
    found = mixtures.fit(df, NAMES, [first], max_iter=100, tol=1e-5)
    want = gmm.fit(x, 3, start=first, max_iter=100, tol=1e-5)
    assert abs(found.score(x).mean() - want.score(x).mean()) < 1e-6
    assert found.score(x).mean() > first.score(x).mean()


@pytest.mark.parametrize("kind", ["diag", "tied", "spherical"])
def test_covariances_and_the_best_of_several_starts(big, kind):
    x, df = big
    bad = gmm.Mixture(np.full(3, 1 / 3), np.repeat(x.mean(axis=0)[None], 3, axis=0), np.repeat(np.eye(3)[None] * 1e4, 3, axis=0))
    good = gmm.fit(x[:1500], 3, covariance=kind)
    found = mixtures.fit(df, NAMES, [bad, good], kind, max_iter=6, tol=1e-4)
    assert found.score(x).mean() >= good.score(x).mean() - 1e-6


def test_saved_rounds_are_taken_up(big, tmp_path):
    x, df = big
    folder = f"file://{tmp_path}/rounds"
    m = start(x)
    mixtures.fit(df, NAMES, [m], max_iter=3, tol=0, folder=folder)
    again = mixtures.fit(df, NAMES, [m], max_iter=5, tol=0, folder=folder)
    whole = mixtures.fit(df, NAMES, [m], max_iter=5, tol=0)
    assert np.allclose(again.means, whole.means) and np.allclose(again.covariances, whole.covariances)
    states = [json.loads(r.state) for r in df.sparkSession.read.schema("round int, state string").json(folder).collect()]
    assert sorted(s["round"] for s in states) == [1, 2, 3, 4, 5]


def test_empty_components_and_tables(spark):
    x = cloud(300, 2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], NAMES)
    far = gmm.Mixture(np.array([0.5, 0.5]), np.array([x.mean(axis=0), [9e5, 9e5, 9e5]]), np.repeat(np.cov(x.T)[None], 2, axis=0))
    found = mixtures.fit(df, NAMES, [far], max_iter=3)
    assert np.isfinite(found.score(x)).all()
    with pytest.raises(ValueError):
        mixtures.fit(df.where("x is null"), NAMES, [far])


def test_aligner_fits_all_events_without_collecting_them(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = lambda shift: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(np.clip(rng.normal([90 + shift, 120], [20, 25], (30_000, 2)), 1, 254))], "id long, SFL double, FSC double")
    s, t = rows(0), rows(30)
    seen, plain = [], DataFrame.toPandas
    for kind in {DataFrame, type(s)}:
        monkeypatch.setattr(kind, "toPandas", lambda self, f=getattr(type(s), "toPandas", plain): (seen.append(len(p := f(self))), p)[1])
    model = EventAligner("RET", 2, use_gates=False, start_samples=500).fit(s, t)
    assert seen == [500, 500]
    assert abs(model.transport.source.weights @ model.transport.source.means - np.array(s.agg(F.avg("SFL"), F.avg("FSC")).first())).max() < 0.2


def test_random_transport_equals_numpy(spark):
    x = np.clip(cloud(900, 7)[:, :2], 1, 254)
    t = gmm.transport_between(gmm.fit(x, 4, n_init=2), gmm.fit(x * 0.8 + 20, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    u = np.array([r.u for r in df.select("id", digest_uniform(F.col("id"), seed=5).alias("u")).orderBy("id").collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05
    for method, rare in (("rand", 0.01), ("weight", 1e-4)):
        out = transport.transport_events(df, ["a", "b"], t, method, rare=rare, keys=["id"], seed=5)
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
        got = np.array([[r.a, r.b] for r in out.orderBy("id").collect()])
        assert np.abs(got - t.apply(x, method, u, rare=rare)).max() < 1e-6
    odd = spark.createDataFrame([(1, None, 3.0), (2, 300.0, -5.0), (3, float("nan"), 1.0)], "id long, a double, b double")
    assert [r.a is None for r in transport.transport_events(odd, ["a", "b"], t, keys=["id"]).orderBy("id").collect()] == [True, False, True]
