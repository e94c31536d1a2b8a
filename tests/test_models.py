import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemaspark.operators import encoder, gam, gmm, stats, transport
from hemaspark.plans.api import CovariateCorrector, DomainEncoder, EventAligner, HistogramAligner


def cloud(seed, n, shift=0.0):
    rng = np.random.default_rng(seed)
    a = rng.normal([60 + shift, 80], [12, 9], (n // 2, 2))
    b = rng.multivariate_normal([160, 150 + shift], [[200, 80], [80, 150]], n - n // 2)
    return np.clip(np.concatenate([a, b]), 1, 254)


def test_mixture_recovers_components():
    x = cloud(0, 4000)
    m = gmm.fit(x, 2, n_init=3)
    order = np.argsort(m.means[:, 0])
    assert np.allclose(m.means[order], [[60, 80], [160, 150]], atol=2) and np.allclose(m.weights, 0.5, atol=0.03)
    assert np.allclose(gmm.Mixture.from_json(m.to_json()).score(x), m.score(x))
    for kind in ("diag", "tied", "spherical"):
        assert gmm.fit(x, 2, covariance=kind).covariances.shape == (2, 2, 2)
    w = gmm.fit(np.arange(10.0)[:, None], 1, sample_weight=np.arange(10.0))
    assert abs(w.means[0, 0] - (np.arange(10) ** 2).sum() / 45) < 1e-9


def test_transport_plan_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 4), (12, 9), (40, 40)):
        a, b, cost = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(m)), rng.random((n, m))
        p = gmm.transport_plan(a, b, cost)
        assert np.allclose(p.sum(1), a, atol=1e-9) and np.allclose(p.sum(0), b, atol=1e-9)
        # dual feasibility: with no negative cycle in the residual graph the plan is optimal
        big = np.full((n + m, n + m), np.inf)
        big[:n, n:] = cost
        big[n:, :n] = np.where(p.T > 1e-12, -cost.T, np.inf)
        for k in range(n + m):
            big = np.minimum(big, big[:, [k]] + big[[k]])
        assert np.diag(big).min() > -1e-9


def test_gaussian_map():
    s, t = np.array([[4.0, 1.0], [1.0, 3.0]]), np.array([[2.0, -0.5], [-0.5, 5.0]])
    a = gmm.gaussian_map(s, t)
    assert np.allclose(a @ s @ a.T, t) and np.allclose(a, a.T)
    m = gmm.Mixture(np.array([1.0]), np.zeros((1, 2)), s[None])
    assert abs(gmm.component_costs(m, m)[0, 0]) < 1e-9 and gmm.component_costs(m, m, "added")[0, 0] > 0
    with pytest.raises(ValueError):
        gmm.root(np.array([[1.0, 0], [0, -1]]))


def test_allocation():
    assert gmm.allocate({-1: 10, 0: 100, 1: 1000}, 10) == {-1: 4, 0: 3, 1: 3}
    assert sum(gmm.allocate({-1: 10, 0: 100, 1: 1000}, 10, "sqrt").values()) == 10
    x = np.arange(20.0).reshape(10, 2)
    assert gmm.means_by_label(x, np.array([0] * 5 + [1] * 5), 4).shape == (4, 2)


def events(spark, seed, n, shift=0.0):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cloud(seed, n, shift))], "id long, SFL double, FSC double")


@pytest.mark.parametrize("method", ["rand", "max", "weight"])
def test_event_alignment(spark, method):
    s, t = events(spark, 1, 3000), events(spark, 2, 3000, 25.0)
    model = EventAligner("RET", 2, use_gates=False, n_init=2, method=method).fit(s, t)
    out = model.transform(s, ["id"])
    assert out.count() == 3000 and out.columns == s.columns
    low, high = out.agg(F.min(F.least("SFL", "FSC")), F.max(F.greatest("SFL", "FSC"))).first()
    assert low >= 0 and high <= 255
    before = {r["column"]: r.wasserstein for r in stats.ecdf_distances(s, t, ["SFL", "FSC"]).collect()}
    after = {r["column"]: r.wasserstein for r in stats.ecdf_distances(out, t, ["SFL", "FSC"]).collect()}
    assert all(after[k] < 0.25 * before[k] for k in before)
    again = EventAligner.from_json(model.to_json()).transform(s.repartition(5), ["id"])
    key = lambda r: r.id
    assert all(abs(a.SFL - b.SFL) < 1e-9 for a, b in zip(sorted(again.collect(), key=key), sorted(out.collect(), key=key), strict=True))
    report = model.validate(s, t, out)
    assert report["likelihood_improvement"] > 0 and len(report["wasserstein_source_target"]) == 2


def test_catalyst_and_arrow_agree(spark):
    t = gmm.transport_between(gmm.fit(cloud(1, 500), 2), gmm.fit(cloud(2, 500, 20), 2))
    df = events(spark, 3, 400)
    x = np.array([[r.SFL, r.FSC] for r in df.orderBy("id").collect()])
    for method, out in (("max", transport.transport_max(df, ["SFL", "FSC"], t)), ("weight", transport.transport_weight(df, ["SFL", "FSC"], t))):
        want = t.apply(x, method, preserve_rare=False)
        assert np.allclose([[r.SFL, r.FSC] for r in out.orderBy("id").collect()], want)
    odd = spark.createDataFrame([(1, None, 3.0), (2, 300.0, -5.0)], "id long, SFL double, FSC double")
    assert transport.transport_events(odd, ["SFL", "FSC"], t).count() == 2


def test_histogram_alignment(spark):
    rng = np.random.default_rng(0)

    def rows(shift):
        out = []
        for i in range(20):
            rbc = np.histogram(rng.normal(60 + shift, 12, 3000), np.arange(-0.5, 128.5))[0]
            plt = np.histogram(np.exp(rng.normal(2.8 + shift / 40, 0.4, 800)), np.arange(-0.5, 128.5))[0]
            out.append((f"s{i}", *map(float, rbc), *map(float, plt)))
        return out

    names = ["Sample No.", *[f"RBC_RAW_{i:03d}" for i in range(128)], *[f"PLT_RAW_{i:03d}" for i in range(128)]]
    make = lambda shift: spark.createDataFrame(rows(shift), ", ".join(["a string", *[f"c{i} double" for i in range(256)]])).toDF(*names)
    s, t = make(0), make(8)
    s = s.unionByName(s.limit(1).select(F.lit("zero").alias("Sample No."), *[F.lit(0.0).alias(n) for n in names[1:]]))
    model = HistogramAligner(20000).fit(s, t)
    out = HistogramAligner.from_json(model.to_json()).transform(s)
    assert out.columns == names and out.count() == 21
    for prefix in ("RBC", "PLT"):
        mean = {}
        for k, df in (("s", s), ("t", t), ("m", out)):
            c = np.array([r["count"] for r in transport.histogram_sum(df, prefix).orderBy("bin").collect()])
            mean[k] = (c * np.arange(128)).sum() / c.sum()
        assert abs(mean["m"] - mean["t"]) < 0.25 * abs(mean["s"] - mean["t"])
    zero = out.where("`Sample No.` = 'zero'").first()
    assert sum(zero[n] for n in names[1:]) == 0
    assert (transport.rounded_bins(np.array([7000.0, 0, 3.0]), 10, np.array([0.0, 0.5, 0.99])) == [10, 0, 0]).all()


def covariates(spark, n=4000):
    rng = np.random.default_rng(5)
    delay, time = rng.uniform(0, 36, n), rng.uniform(0, 500, n)
    group = rng.integers(0, 2, n)
    y = np.sin(delay / 6) * 3 + 0.004 * time + group * 2 + rng.normal(0, 0.3, n)
    z = rng.normal(10, 1, n)
    rows = [(int(i), f"m{g}", float(d), float(t), float(a), None if i % 10 == 0 else float(b)) for i, (g, d, t, a, b) in enumerate(zip(group, delay, time, y, z, strict=True))]
    return spark.createDataFrame(rows, "id long, machine string, delay double, time double, y double, z double").withColumnRenamed("z", "z.1")


def test_splines_take_effects_off(spark):
    df = covariates(spark)
    model = CovariateCorrector(["delay", "time"], ["y", "z.1"], group="machine", normalise_groups=True)
    out = model.fit_transform(df)
    r = out.agg(F.corr("y", "time"), F.corr("y", F.sin(F.col("delay") / 6)), F.stddev_samp("y"), F.count("`z.1`")).first()
    assert abs(r[0]) < 0.02 and abs(r[1]) < 0.02 and r[2] < 0.33 and r[3] == 3600
    again = CovariateCorrector.from_json(model.to_json()).transform(df)
    assert max(abs(a.y - b.y) for a, b in zip(out.orderBy("id").collect(), again.orderBy("id").collect(), strict=True)) < 1e-10
    pd = model.partial_dependence("y", "delay", "m0")
    truth = np.sin(pd["grid"] / 6) * 3
    assert np.corrcoef(pd["effect"], truth)[0, 1] > 0.995 and (pd["low"] <= pd["high"]).all()


def test_terms(spark):
    df = covariates(spark, 800).withColumn("k", (F.col("id") % 3).cast("double"))
    for terms, covs in (([("te", "delay", "time")], ["delay", "time"]), ([("s", "delay"), ("f", "k")], ["delay", "k"])):
        out = CovariateCorrector(covs, ["y"], terms=terms, n_splines=8).fit_transform(df)
        assert out.agg(F.stddev_samp("y")).first()[0] < df.agg(F.stddev_samp("y")).first()[0]
    cyc = gam.Axis("cp", 0, 24, 8)
    assert np.allclose(cyc.basis(np.array([0.0])), cyc.basis(np.array([24.0]))) and np.allclose(cyc.basis(np.linspace(0, 24, 50)).sum(1), 1)
    assert np.allclose(gam.Axis("ps", 0, 1, 10).basis(np.linspace(-1, 2, 50)).sum(1), 1)
    for bad in ([("x", "delay")], [("s", "delay", "time")], [("te", "delay")], [("s", "delay")], [("s", "other"), ("s", "delay")]):
        with pytest.raises(ValueError):
            gam.check_terms(bad, ["delay", "time"])
    few = CovariateCorrector(["delay"], ["y"]).fit_transform(df.limit(5))
    assert few.count() == 5
    auto = CovariateCorrector(["delay"], ["A%"], transforms="auto").fit(df.withColumn("A%", F.col("delay") / 40))
    assert auto.kinds == {"A%": "logit"}
    ref = CovariateCorrector(["delay"], ["y"], reference_condition={"delay": F.col("delay") < 6}, centralise=3.5).fit(df)
    want = df.where("delay < 6").agg(F.avg("y")).first()[0]
    assert abs(ref.references[0] - want) < 1e-9


def test_encoder_gradients():
    rng = np.random.default_rng(0)
    net = encoder.Encoder(6, 4, num_tasks=(2, 3), num_domains=(3,), hidden_dims=(7, 5), random_state=1)
    x, t, d = rng.normal(size=(8, 6)), np.column_stack([rng.integers(0, 2, 8), rng.integers(0, 3, 8)]), rng.integers(0, 3, (8, 1))
    for which, key, nets in (("generator", "gen_loss", net.generator), ("discriminator", "disc_loss", net.discriminators)):
        net.losses(x, t, d, which)
        grads = [[g.copy() for g in n.g] for n in nets]
        for n, gs in zip(nets, grads, strict=True):
            for p, g in zip(n.parameters(), gs, strict=True):
                at = tuple(rng.integers(0, k) for k in p.shape)
                old = p[at]
                p[at] = old + 1e-6
                up = net.losses(x, t, d, which)[key]
                p[at] = old - 1e-6
                down = net.losses(x, t, d, which)[key]
                p[at] = old
                assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_early_stopping():
    stop = encoder.EarlyStopping(2)
    assert [stop(v) for v in (3.0, 2.0, 2.0, 2.5, 2.0, 2.1, 2.2)] == [False] * 6 + [True]


def test_domain_encoder(spark, tmp_path):
    rng = np.random.default_rng(3)
    y, d = rng.integers(0, 2, 600), rng.integers(0, 3, 600)
    x = rng.normal(size=(600, 6)) * 0.3
    x[:, 0] += 2 * y
    x[:, 1] += 2 * d
    rows = [(int(i), *map(float, v), f"t{a}", f"d{b}") for i, (v, a, b) in enumerate(zip(x, y, d, strict=True))]
    df = spark.createDataFrame(rows + [(999, None, 0.0, 0.0, 0.0, 0.0, 0.0, "t0", "d0")], "id long, a double, b double, c double, d double, e double, f double, task string, dom string")
    model = DomainEncoder(list("abcdef"), ["task"], ["dom"], latent_dim=8, hidden_dims=(16, 8), adversarial_weight=0.2).fit(df, df, max_epochs=30, patience=20)
    out = {r.id: r for r in model.transform(df).collect()}
    hit = np.mean([model.levels["task"][out[i].tasks[0]] == f"t{a}" for i, a in enumerate(y)])
    assert hit > 0.9 and out[999].shared is None and len(out[0].shared) == 4
    model.save(f"{tmp_path}/m")
    again = {r.id: r for r in DomainEncoder.load(f"{tmp_path}/m").transform(df).collect()}
    assert np.allclose(again[5].shared, out[5].shared) and json.loads((tmp_path / "m.json").read_text())["tasks"] == ["task"]
    with pytest.raises(ValueError):
        encoder.Encoder(4, shared_dim=2, private_dim=3)


def test_fit_channels(spark):
    from hemaspark.plans.api import fit_channels

    s, t = events(spark, 1, 400), events(spark, 2, 400, 20.0)
    first = fit_channels({"RET": s}, {"RET": t}, n_components=2, use_gates=False)
    again = fit_channels({"RET": s, "WNR": s}, {"RET": t, "WNR": t}, first, n_components=2, use_gates=False, columns=["SFL", "FSC"])
    assert again["RET"] is first["RET"] and again["WNR"].transport.source.k == 2 and again["WNR"].omega == 0.05


def jobs(spark, run):
    """How many jobs run() starts."""
    group = f"count-{np.random.default_rng().integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_more_features_take_no_more_jobs(spark):
    df = covariates(spark, 300).select("machine", "delay", *[(F.col("y") * (i + 1)).alias(f"y{i}") for i in range(50)])
    fit = lambda n: CovariateCorrector(["delay"], [f"y{i}" for i in range(n)], group="machine", n_splines=5, normalise_groups=True).fit(df)
    few, many = jobs(spark, lambda: fit(1)), jobs(spark, lambda: fit(50))
    assert many <= few + 1


def test_many_groups_are_solved_and_joined_on_the_cluster(spark):
    """Two thousand groups with a line of their own; corrections equal numpy's, no Python runs in them, nothing but a row of counts reaches the driver."""
    n = 2000
    df = spark.range(n * 30).select("id", (F.col("id") % n).cast("string").alias("g"), (F.rand(1) * 10).alias("x"), F.randn(2).alias("e")).select("id", "g", "x", (F.col("g").cast("int") + F.col("x") * (F.col("g").cast("int") % 7) + 0.1 * F.col("e")).alias("y.z"))
    df = df.union(spark.createDataFrame([(-1, None, 1.0, 2.0), (-2, "0", None, 3.0), (-3, "unseen", 1.0, 4.0), (-4, "0", 1.0, None)], "id long, g string, x double, `y.z` double")).cache()
    model = CovariateCorrector(["x"], ["y.z"], group="g", n_splines=4, lam=0.1).fit(df.where("g <> 'unseen'"))
    out = model.transform(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    found = {r.id: r["y.z"] for r in out.collect()}
    assert [found[i] for i in (-1, -2, -3, -4)] == [2.0, 3.0, 4.0, None]
    rows = df.where("g = '17'").orderBy("id").collect()
    x, y = np.array([r.x for r in rows]), np.array([r["y.z"] for r in rows])
    b = model.design.matrix(x[:, None])
    coef = np.linalg.pinv(b.T @ b + model.design.penalty(), rcond=gam.CUTOFF, hermitian=True) @ b.T @ y
    assert np.allclose([found[r.id] for r in rows], y - b @ coef + y.mean())
    assert np.allclose(model.fit_of("y.z", "17").coef, coef) and model.fits.count() == n


def test_catalyst_basis_equals_numpy(spark):
    rng = np.random.default_rng(8)
    axes = {"a": gam.Axis("ps", -1.0, 4.0, 7), "b": gam.Axis("cp", 0.0, 24.0, 6), "k": gam.Axis("f", levels=[0.0, 1.0, 5.0])}
    design = gam.Design(["a", "b", "k"], [("s", "a"), ("s", "b"), ("f", "k"), ("te", "a", "b")], axes)
    x = np.column_stack([rng.uniform(-3, 6, 300), rng.uniform(-30, 60, 300), rng.choice([0.0, 1.0, 5.0, 7.0], 300)])
    coef = rng.normal(size=1 + sum(design.sizes()))
    df = spark.createDataFrame([(i, *map(float, r), float(i)) for i, r in enumerate(x)], "id long, a double, b double, k double, y double")
    for products in (gam.PRODUCTS, 0):  # as arithmetic, and over arrays
        gam.PRODUCTS, before = products, gam.PRODUCTS
        try:
            out = gam.apply_corrections(df, ["y"], design, gam.fits_of(df, ["y"], {("y", None): (coef, 3.0)}), None).orderBy("id").collect()
        finally:
            gam.PRODUCTS = before
        assert np.allclose([r.y for r in out], np.arange(300.0) - design.matrix(x) @ coef + 3)


def test_corrections_are_compiled(spark, capsys):
    """Generated methods of 8,000 bytes and more are interpreted by the JVM, those of 64 KB can't be generated at all."""
    axes = {"a": gam.Axis("ps", 0.0, 4.0, 8), "b": gam.Axis("cp", 0.0, 24.0, 6)}
    df = spark.range(10).select("id", *[F.when(F.col("id") > i, F.col("id").cast("double")).alias(n) for i, n in enumerate("aby")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else only what has run has code
    try:
        for terms in ([("s", "a"), ("s", "b")], [("te", "a", "b")]):
            design = gam.Design(["a", "b"], terms, axes)
            coef = np.zeros(1 + sum(design.sizes()))
            gam.apply_corrections(df, ["y"], design, gam.fits_of(df, ["y"], {("y", None): (coef, 3.0)}), None).explain("codegen")
            text = capsys.readouterr().out
            sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and 0 < max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
