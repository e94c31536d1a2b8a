import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hemaspark.functions import columns as X
from hemaspark.operators import gating, profile, sampling, stats, transport
from hemaspark.plans.api import TableAligner


def frame(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def test_mad_golden(spark):
    p = stats.mad_parameters(frame(spark, [1, 2, 3, 4, 5, 100]), ["x"])["x"]
    assert (p["median"], p["mad"]) == (3.5, 1.5)
    assert sorted(r[0] for r in stats.mad_band(frame(spark, [1, 2, 3, 4, 100]), "x", 2.0).collect()) == [2, 3, 4]


def test_alignment_golden(spark):
    s, t = frame(spark, [1, 2, 3, 4, 5]), frame(spark, [10, 14, 18, 22, 26])
    model = TableAligner(["x"]).fit(s, t)
    assert sorted(r[0] for r in model.transform(s).collect()) == [10, 14, 18, 22, 26]
    again = TableAligner.from_json(model.to_json())
    assert again.transform(s).collect() == model.transform(s).collect()
    flat = TableAligner(["x"]).fit(frame(spark, [3, 3, 3]), t)
    assert [r[0] for r in flat.transform(frame(spark, [3])).collect()] == [18]
    text = spark.createDataFrame([("2",), ("abc",)], "x string")
    assert [r[0] for r in model.transform(text).collect()] == [14.0, None]
    assert [r[0] for r in model.transform(text, passthrough=True).collect()] == ["14.0", "abc"]


def distances(a, b):
    xs = np.unique(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(np.sort(a), xs, "right") / len(a) - np.searchsorted(np.sort(b), xs, "right") / len(b))
    return float((gap[:-1] * np.diff(xs)).sum()), float(gap.max())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(st.floats(-100, 100, width=32), min_size=1, max_size=60), b=st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_ecdf_distances(spark, a, b):
    r = stats.ecdf_distances(frame(spark, a), frame(spark, b), ["x"]).first()
    w, ks = distances(np.array(a, float), np.array(b, float))
    assert math.isclose(r.wasserstein, w, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.ks, ks, abs_tol=1e-12)


def test_ecdf_of_many_values(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=3000), rng.normal(0.3, 1.2, size=2000)
    r = stats.ecdf_distances(frame(spark, a), frame(spark, b), ["x"]).first()
    w, ks = distances(a, b)
    assert math.isclose(r.wasserstein, w, rel_tol=1e-9) and math.isclose(r.ks, ks, rel_tol=1e-9)


def test_rebin_golden(spark):
    got = {r["bin"]: r["n"] for r in transport.rebin(frame(spark, [-0.6, -0.5, 0.49, 0.5, 127.4, 127.5, 127.6]), "x").collect()}
    assert got == {0: 2, 1: 1, 127: 2}


def test_gates(spark):
    square, tri = [[0, 0], [10, 0], [10, 10], [0, 10]], [[5, 5], [15, 5], [5, 15]]
    df = spark.createDataFrame([(1.0, 1.0), (6.0, 6.0), (7.0, 7.5), (20.0, 20.0), (None, 1.0), (0.0, 0.0), (10.0, 5.0)], "x double, y double")
    gates = {"a": square, "b": tri, "none": [[0, 0], [1, 1]]}
    first = [r.gate for r in gating.label_gates(df, gates, "x", "y").collect()]
    last = [r.gate for r in gating.label_gates(df, gates, "x", "y", "last").collect()]
    assert first == ["a", "a", "a", None, None, "a", "b"] and last == [0, 1, 1, -1, -1, 0, 1]


def test_sampling(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") < 4500, 0).when(F.col("id") < 4900, 1).otherwise(-1))
    q = sampling.quotas({0: 4500, 1: 400, -1: 100}, 300, 120)
    assert q[1] == 120 and q[0] == int(300 * math.sqrt(4500) / (math.sqrt(4500) + 20 + 10)) and q[-1] == int(300 * 10 / (math.sqrt(4500) + 30))
    out = sampling.stratified_sample(df, F.col("k"), 300, 120)
    assert {r.k: r["count"] for r in out.groupBy("k").count().collect()} == q and out.distinct().count() == sum(q.values())
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in sampling.stratified_sample(df.repartition(7), F.col("k"), 300, 120).collect())
    assert sampling.exact_sample(df, 100).distinct().count() == 100
    train, test = sampling.stratified_split(df, ["k"], 0.2)
    assert {r.k: r["count"] for r in test.groupBy("k").count().collect()} == {0: 900, 1: 80, -1: 20} and train.count() == 4000
    ranks = sampling.global_rank(df.repartition(5), [F.col("id").desc()])
    assert all(r._rank == 4999 - r.id for r in ranks.collect())
    with pytest.raises(ValueError):
        sampling.quotas({1: 2}, 3, 1, "other")


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 2, 1.0), ("a", 1, None)], "s string, i int, d double").toDF("s.x", "i", "d")
    got = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert (got["s.x"].distinct, got["s.x"].top, got["d"].missing, got["d"].missing_pct, got["i"].type) == (2, ["a", "b"], 3, 75.0, "int")
    assert tuple(profile.profile_table(df).first()) == (4, 3, 1, 25.0)
    assert profile.inferred_type(spark.createDataFrame([(str(i),) for i in range(95)] + [("x",)] * 5, "v string"), "v") == "numeric"


def test_correlations_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 1e4
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double, e double").toDF("a.1", "b", "c", "d", "e")
    one = {(r.anchor, r.feature): r.r for r in profile.corr_with(df, df.columns, df.columns).collect()}
    two = {(r.anchor, r.feature): r.r for r in profile.corr_matrix(df, df.columns, df.columns).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_binning_and_round_trips(spark):
    df = frame(spark, [0, 5, 10, 10.0001, 100])
    assert [r[0] for r in df.select(X.bucket(F.col("x"), 0, 100, 10)).collect()] == [0, 0, 0, 1, 9]
    p = frame(spark, [0.0, 0.25, 1.0])
    got = [r[0] for r in p.select(X.inverse(X.forward(F.col("x"), "logit"), "logit")).collect()]
    assert abs(got[1] - 0.25) < 1e-6 and got[2] is None
    scaled, params = stats.standardise(df, ["x"])
    back, _ = stats.standardise(scaled, ["x"], params)
    assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(back.collect(), df.collect(), strict=True))
    with pytest.raises(ValueError):
        stats.group_offsets(df.withColumn("g", F.lit("a")), "g", "x", "b")
    thirds = stats.split_thirds(spark.range(10), ["id"])
    assert sorted(r.part for r in thirds.collect()) == [0] * 4 + [1] * 3 + [2] * 3


def test_quantiles_by_ranks(spark):
    rng = np.random.default_rng(3)
    rows = [(g, None if i % 11 == 0 else float(v), float(v) if g else None) for g in (0, 1, None) for i, v in enumerate(np.round(rng.normal(size=500), 2))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    qs = [0.0, 0.001, 0.25, 0.5, 0.77, 1.0]
    got = {(r["_k0"], r["column"]): r["q"] for r in stats.quantiles(df, ["x", "y"], qs, ["g"]).collect()}
    for g in (0, 1, None):
        for k, n in ((1, "x"), (2, "y")):
            v = [r[k] for r in rows if r[0] == g and r[k] is not None]
            assert np.allclose(got[g, n], np.quantile(v, qs)) if v else (g, n) not in got
    for r in stats.median_mad(df, ["x"], ["g"]).collect():
        v = np.array([x[1] for x in rows if x[0] == r.g and x[1] is not None])
        assert math.isclose(r["median"], np.median(v)) and math.isclose(r["mad"], np.median(np.abs(v - np.median(v))))
    assert stats.quantiles(df.where("false"), ["x"], [0.5]).count() == 0


def test_exact_quantiles_by_pivots(spark, monkeypatch):
    """Large columns, groups and ties: equal to numpy's, by windows and by ranges, and where sketches were off."""
    rng = np.random.default_rng(12)
    n = 30_000
    a, b, g = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.integers(0, 3, n)
    b[rng.random(n) < 0.1] = np.nan
    df = spark.createDataFrame([(int(k) or None, float(x), None if np.isnan(y) else float(y), None) for k, x, y in zip(g, a, b, strict=True)], "`k.1` int, `a.b` double, b double, none double").repartition(6)
    qs = [0.0, 0.01, 0.5, 0.9, 1.0]

    def check():
        for by in (None, ["k.1"]):
            rows = {(r["_k0"] if by else None, r["column"]): r["q"] for r in stats.quantiles(df, ["a.b", "b", "none"], qs, by).collect()}
            parts = {None: np.ones(n, bool)} if not by else {int(k) or None: g == k for k in range(3)}
            assert len(rows) == 2 * len(parts)
            for k, at in parts.items():
                assert np.allclose(rows[k, "a.b"], np.quantile(a[at], qs)) and np.allclose(rows[k, "b"], np.nanquantile(b[at], qs))
        mads = {(r["k.1"], r["column"]): (r["median"], r["mad"]) for r in stats.median_mad(df, ["a.b", "b"], ["k.1"]).collect()}
        for k in range(3):
            m = np.median(a[g == k])
            assert np.allclose(mads[int(k) or None, "a.b"], (m, np.median(np.abs(a[g == k] - m))))

    check()
    monkeypatch.setattr(stats, "SMALL", 3)
    check()
    monkeypatch.setattr(stats, "OFF", -0.3)  # pivots that miss every rank
    check()
    plan = stats._pivoted(stats._wide(df, ["a.b"], None), [], 1, [0.5])
    assert plan.count() < 3000


def test_quantiles_of_infinite_and_no_values(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),), (2.0,), (3.0,)], "x double")
    assert stats.quantiles(df, ["x"], [0.0, 0.5, 1.0]).first()["q"] == [float("-inf"), 2.0, float("inf")]
    assert stats.quantiles(df.where("x > 9 and x < 10"), ["x"], [0.5]).count() == 0
    assert stats.median_mad(df.where("x = 1"), ["x"]).first()["mad"] == 0


def test_quality_reads_each_table_once(spark, monkeypatch):
    """Medians and MADs of a report come from the value counts that its distances need, and equal those of the rows."""
    rng = np.random.default_rng(11)
    rows = [(float(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(zip(rng.normal(5, 2, 4001), rng.integers(0, 7, 4001), strict=True))]
    s = spark.createDataFrame(rows, "x double, `y.z` double")
    t = s.select((F.col("x") * 1.5 + 3).alias("x"), (F.col("`y.z`") + 1).alias("y.z")).limit(3000)
    want = {k: stats.mad_parameters(df, ["x", "y.z"]) for k, df in (("s", s), ("t", t))}
    monkeypatch.setattr(stats, "_selected", lambda *a: pytest.fail("rows were gone through again"))
    for r in stats.alignment_quality(s, t, s, ["x", "y.z"]).collect():
        a, b = want["s"][r["column"]], want["t"][r["column"]]
        assert r.med_before == r.med_after == abs(a["median"] - b["median"]) and r.mad_before == r.mad_after == abs(a["mad"] - b["mad"])
