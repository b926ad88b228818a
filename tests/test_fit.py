import itertools
import math
import warnings

import numpy as np
import pytest
from helpers import DIR, small

from arcweave.diag.gof import gof
from arcweave.diag.panels import degree_counts, distances, geodesics, shared_partner_counts
from arcweave.diag.traces import autocorrelation, geweke_z, geyer_ess, lagged, mcmc_diagnostics, numbered
from arcweave.fit.mcmle import bridge_loglik, mcmle
from arcweave.fit.model import ERGMFormula, ERGMModel, fit_metadata
from arcweave.fit.mple import compressed, fit_ergm, mple, spark_derivatives
from arcweave.fit.newton import logistic_derivatives, newton_fit
from arcweave.functions.special import TINY, chi2_quantile, f_sf, two_sided_p
from arcweave.mcmc.sample import mh_sample, sample_networks, simulate_ergm, split
from arcweave.network import Network
from arcweave.operators.base import PairTerm
from arcweave.operators.nodal import EdgeCov, NodeCov, NodeMatch
from arcweave.operators.structural import GWESP, Edges, Mutual, Triangle
from arcweave.plans.design import compute_all, mple_design
from arcweave.sources.datasets import load_dataset, read_network, write_network


@pytest.fixture(scope="module")
def flo(spark):
    return load_dataset(spark, "florentine_marriage")


def test_florentine_counts(flo):
    assert (flo.n, flo.n_edges, flo.n_dyads) == (16, 20, 120)
    assert np.allclose(compute_all(flo, [Edges(), NodeCov("wealth"), GWESP(0.5), Triangle()]), [20, 2168, 8.3934693402873677, 3], atol=1e-9)


def test_pseudolikelihood_matches_published_values(spark, flo):
    fit = fit_ergm(flo, [Edges(), NodeCov("wealth")])
    assert np.allclose(fit.coefficients, [-2.5949290317864602, 0.010545912833824604], atol=1e-6)
    assert np.allclose(fit.std_errors, [0.53605603993959339, 0.0046742550755461409], atol=1e-6)
    assert abs(fit.loglik + 51.554286195409944) < 1e-6 and abs(fit.aic - 107.10857239081989) < 1e-6
    assert (fit.nobs, fit.dof, fit.converged, fit.is_exact) == (120, 2, True, True)
    one = fit_ergm(flo, [Edges()])
    assert abs(one.coefficients[0] + 1.609438) < 1e-3 and abs(one.std_errors[0] - 0.244949) < 1e-2
    assert [r.term for r in fit.coef_table(spark).collect()] == ["edges", "nodecov.wealth"]


def test_a_design_left_in_spark_gives_the_same_fit(flo):
    model = ERGMModel([Edges(), NodeCov("wealth"), Triangle()], flo)
    near, far = mple(model), mple(model, driver_rows=0)
    assert np.allclose(near.coefficients, far.coefficients, atol=1e-8) and np.allclose(near.vcov, far.vcov, atol=1e-8)
    design = mple_design(flo, model.terms)
    x, n, y = compressed(design, model.names)
    beta = np.array([-1.0, 0.01, 0.2])
    for a, b in zip(spark_derivatives(design, model.names)(beta), logistic_derivatives(x, y, weight=n)(beta)):
        assert np.allclose(a, b)


@pytest.mark.parametrize("directed, n", [(False, 45), (True, 90)])
def test_ring_has_the_analytic_estimate(spark, directed, n):
    net = Network.from_edges(spark, 10, [(i, i % 10 + 1) for i in range(1, 11)], directed)
    assert abs(fit_ergm(net, [Edges()]).coefficients[0] - math.log(10 / (n - 10))) < 1e-4


def test_result_text_and_metadata(flo):
    plain, dependent = fit_ergm(flo, [Edges(), NodeCov("wealth")]), fit_ergm(flo, [Edges(), GWESP(0.5)])
    assert "pseudolikelihood" not in str(plain) and "anticonservative" in str(dependent) and "Std.Error" in str(plain)
    a, b = fit_metadata(plain), fit_metadata(dependent)
    assert a["is_exact"] and a["approximations"] == [] and a["tie_method"] == "not_applicable" and a["se_method"] == "hessian"
    assert not b["is_exact"] and any("anticonservative" in x for x in b["approximations"])
    with pytest.raises(ValueError, match="method"):
        fit_ergm(flo, [Edges()], method="bayes")
    with pytest.raises(ValueError, match="mple.*mcmle"):
        mcmc_diagnostics(plain)


def test_newton():
    a, t = np.array([[2, 0.5], [0.5, 1]]), np.array([1, -0.5])
    fit = newton_fit(lambda x: (-0.5 * (x - t) @ a @ (x - t), -a @ (x - t), -a), [5.0, 5.0])
    assert np.allclose(fit.theta, t) and fit.converged
    fit = newton_fit(lambda x: (7 * x[0] - np.exp(x[0]), np.array([7 - np.exp(x[0])]), np.array([[-np.exp(x[0])]])), [8.0])
    assert abs(fit.theta[0] - math.log(7)) < 1e-6 and abs(fit.se[0] - 1 / math.sqrt(7)) < 1e-4
    with pytest.raises(ValueError):
        logistic_derivatives(np.ones((3, 1)), [1, 0])
    with pytest.raises(ValueError):
        logistic_derivatives(np.ones((3, 1)), [1, 0, 1], offset=[0.0])
    assert logistic_derivatives(np.zeros((0, 2)), [])(np.zeros(2))[0] == 0


def test_distribution_functions(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for p, df in ((0.95, 1), (0.95, 2), (0.95, 7), (0.5, 3)):
        assert abs(chi2_quantile(p, df) - jvm.ChiSquaredDistribution(float(df)).inverseCumulativeProbability(p)) < 1e-6
    for x, a, b in ((0.5, 2, 10), (3.2, 3, 40), (1.0, 1, 5), (9.0, 4, 996)):
        assert abs(f_sf(x, a, b) - (1 - jvm.FDistribution(float(a), float(b)).cumulativeProbability(x))) < 1e-9
    assert abs(two_sided_p(10) / 1.5239706048320995e-23 - 1) < 1e-9 and two_sided_p(40) == TINY and two_sided_p(math.inf) == 0 and math.isnan(two_sided_p(math.nan))


def test_chain_is_stationary_and_reproducible(flo):
    model = ERGMModel([Edges()], flo)
    one, _ = mh_sample(model, [-1.0], 400, 3000, 200, seed=3)
    two, _ = mh_sample(model, [-1.0], 400, 3000, 200, seed=3)
    x = one.toPandas()["edges"]
    assert (x == two.toPandas()["edges"]).all() and abs(x.mean() - 120 / (1 + math.e)) < 0.9
    with pytest.raises(ValueError, match="coefficients"):
        mh_sample(model, [1.0, 2.0])


def test_drawn_statistics_belong_to_drawn_networks(spark):
    net = small(spark, True)
    model = ERGMModel([Edges(), Mutual(), Triangle(), NodeMatch("group"), EdgeCov([[1.0] * 7] * 7)], net)
    draws, arcs = mh_sample(model, [-0.5, 0.2, 0.1, 0.3, 0.0], 3, 50, 20, seed=1, return_networks=True)
    for r in draws.collect():
        own = Network(net.vertices, arcs.filter(f"sim_id = {r.draw + 1}").select("i", "j"), True)
        assert np.allclose(compute_all(own, model.terms), list(r)[2:])


def test_simulated_networks(flo):
    fit = fit_ergm(flo, [Edges()])
    a = sorted(map(tuple, simulate_ergm(fit, 5, burnin=500, interval=50, seed=9, n_chains=2).collect()))
    assert a == sorted(map(tuple, simulate_ergm(fit, 5, burnin=500, interval=50, seed=9, n_chains=2).collect()))
    assert {x[0] for x in a} == {1, 2, 3, 4, 5} and all(i < j for _, i, j in a)
    assert sample_networks(fit.model, fit.coefficients, 0).count() == 0 and split(7, 3) == [3, 2, 2]


def test_unobserved_dyads(spark, flo):
    net = Network(flo.vertices, flo.arcs, False, spark.createDataFrame([(1, 9), (2, 3)], "i long, j long"))
    fit = fit_ergm(net, [Edges()])
    assert fit.nobs == 118 and fit.missing_method == "available_case" and abs(fit.coefficients[0] - math.log(19 / 99)) < 1e-6 and "2 masked" in str(fit)
    with pytest.raises(ValueError, match="2 masked dyads.*unobserved"):
        simulate_ergm(fit)
    with pytest.raises(ValueError, match="missing"):
        simulate_ergm(fit, missing="face")
    with pytest.warns(UserWarning, match="at their face value"):
        got = simulate_ergm(fit, 4, burnin=300, interval=100, seed=1, missing="condition_on_face").collect()
    for k in range(1, 5):
        own = {(r.i, r.j) for r in got if r.sim_id == k}
        assert (1, 9) in own and (2, 3) not in own


def test_bootstrap(flo):
    model = ERGMModel([Edges(), NodeCov("wealth")], flo)
    plain, boot = mple(model), mple(model, se="bootstrap", n_boot=40, boot_burnin=1500, boot_interval=200, seed=4)
    assert boot.se_method == "bootstrap" and (0.5 < boot.std_errors / plain.std_errors).all() and (boot.std_errors / plain.std_errors < 2).all()


def test_monte_carlo_fit(flo):
    fit = mcmle(ERGMModel([Edges(), GWESP(0.5)], flo), n_samples=2000, seed=20, bridge_rungs=None)
    assert np.allclose(fit.coefficients, [-1.7213977, 0.1048045], atol=0.08) and np.allclose(fit.std_errors, [0.366466, 0.262932], atol=0.06)
    assert not fit.is_exact and fit.objective == "mc_likelihood" and fit.se_method == "fisher" and math.isnan(fit.loglik)
    got = mcmc_diagnostics(fit)
    assert got["n_samples"] == 2000 and len(got["ess_geyer"]) == 2 and (got["geweke_p"] >= 0).all()
    plain = fit_ergm(flo, [Edges(), NodeCov("wealth")])
    assert np.allclose(mcmle(ERGMModel([Edges(), NodeCov("wealth")], flo), seed=2, bridge_rungs=None).coefficients, plain.coefficients, atol=0.3)


def test_bridge_meets_enumeration(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6)]
    net, theta = Network.from_edges(spark, 6, edges, False), np.array([-0.8, 0.4])
    pairs = list(itertools.combinations(range(6), 2))
    bits = (np.arange(1 << 15)[:, None] >> np.arange(15)) & 1
    at = {p: k for k, p in enumerate(pairs)}
    triangles = sum(bits[:, at[a, b]] * bits[:, at[b, c]] * bits[:, at[a, c]] for a, b, c in itertools.combinations(range(6), 3))
    logz = np.log(np.exp(theta[0] * bits.sum(1) + theta[1] * triangles).sum())
    model = ERGMModel([Edges(), Triangle()], net)
    assert abs(bridge_loglik(model, theta, 16, 1500, 1000, 20, seed=5) - (theta @ [6, 1] - logz)) < 0.3
    alone = ERGMModel([Edges()], net)
    assert abs(bridge_loglik(alone, [-0.8], 4) - (-0.8 * 6 - 15 * math.log1p(math.exp(-0.8)))) < 1e-10


def test_goodness_of_fit(spark):
    und = Network.from_edges(spark, 5, [(1, 2), (2, 3), (3, 4), (4, 5)], False)
    got = gof(fit_ergm(und, [Edges()]), n_sim=20, burnin=300, interval=30, seed=1)
    assert got.names == ["degree", "esp", "distance"]
    rows = got.panels.collect()
    assert all(0 < r.p_value <= 1 and r.sim_min <= r.sim_mean <= r.sim_max for r in rows)
    assert [r.observed for r in got.panel("degree").collect()] == [0, 2, 3, 0, 0]
    assert [r.observed for r in got.panel("distance").collect()][:4] == [8, 6, 4, 2]
    assert abs(sum(r.sim_mean for r in got.panel("degree").collect()) - 5) < 1e-9
    assert all(x in str(got) for x in ("Goodness-of-fit assessment: ERGM", "MC p-value", "Based on 20 simulated networks"))
    directed = fit_ergm(small(spark, True), [Edges()])
    both = gof(directed, n_sim=5, stats=["degree", "esp"], burnin=200, interval=20, seed=1, esp_type="union")
    assert both.names == ["idegree", "odegree", "esp"] and [r.observed for r in both.panel("idegree").collect()] == [1, 2, 4, 0, 0, 0, 0]
    with pytest.raises(ValueError, match="unknown"):
        gof(directed, stats=["triads"])


def test_panels(spark):
    arcs = spark.createDataFrame([(0, i, j) for i, j in [(1, 3), (3, 2), (1, 4), (4, 2), (1, 2)]], "sim_id int, i long, j long")
    esp = lambda kind: {r.label: r.c for r in shared_partner_counts(arcs, True, kind).collect()}
    assert esp("OTP") == {0: 4, 2: 1} and esp("union") == {1: 4, 2: 1}
    with pytest.raises(ValueError):
        shared_partner_counts(arcs, True, "XYZ")
    empty = arcs.filter("false")
    sims = spark.createDataFrame([(0,), (1,)], "sim_id int")
    assert sorted(map(tuple, degree_counts(empty, spark.range(1, 6).toDF("v"), False, "degree", sims).collect())) == [(0, 0, 5), (1, 0, 5)]
    net = small(spark, True)
    a, ids = net.matrix()
    assert [r.c for r in geodesics(net).orderBy("d").collect()] == distances(a).tolist() and len(ids) == 7 and int(a.sum()) == len(DIR)


def test_synthetic_traces(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=4000), np.zeros(4000)
    for t in range(1, 4000):
        y[t] = 0.9 * y[t - 1] + rng.normal()
    drift = np.linspace(0, 5, 2000) + 0.1 * rng.normal(size=2000)
    assert 2500 < geyer_ess(x) < 5500 and 50 < geyer_ess(y) < 800 and abs(geweke_z(x)) < 4 and abs(geweke_z(drift)) > 5
    assert geyer_ess(np.full(100, 3.0)) == 100 and geweke_z(np.full(100, 3.0)) == 0
    rows = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(y)], "stat string, k long, x double")
    trace = numbered(rows, "stat", ["k"])
    g = {r.lag: r.g for r in lagged(trace, "stat", "x", [0, 1]).collect()}
    assert abs(g[1] / g[0] - autocorrelation(y)) < 1e-9


def test_foreign_term(spark):
    class Far(PairTerm):
        name = "far"
        required_vertex_attributes = ("age",)

        def change_column(self, net):
            from pyspark.sql import functions as F

            return F.when(F.abs(F.col("age_i") - F.col("age_j")) > 10, 1.0).otherwise(0.0)

    fit = fit_ergm(small(spark, True), [Edges(), Far()])
    assert fit.model.names == ["edges", "far"] and fit.is_exact
    assert len(ERGMFormula([Edges()]).terms) == 1
    with pytest.raises(ValueError, match="age"):
        ERGMModel([Far()], Network.from_edges(spark, 3, [(1, 2)]))


def test_stored_networks(spark, tmp_path):
    net = small(spark, False, missing=[(1, 4)])
    write_network(net, str(tmp_path))
    back = read_network(spark, f"{tmp_path}/vertices", f"{tmp_path}/arcs", False, f"{tmp_path}/missing")
    assert (back.n, back.n_edges, back.n_missing) == (7, 8, 1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert fit_ergm(back, [Edges()]).nobs == 20


def test_long_runs_of_stored_traces(spark):
    """The diagnostics of traces in Spark are those of the driver's arrays: mixing fast, slowly, not at all, and short."""
    from arcweave.diag.traces import geweke_z, geyer_ess, trace_ess, trace_geweke

    rng = np.random.default_rng(3)
    slow = np.zeros(900)
    for k in range(1, 900):
        slow[k] = 0.95 * slow[k - 1] + rng.normal()
    traces = {"fast": rng.normal(size=700), "slow": slow, "flat": np.full(40, 2.5), "short": rng.normal(size=5)}
    rows = [(k, i + 1, len(x), float(v)) for k, x in traces.items() for i, v in enumerate(x)]
    trace = spark.createDataFrame(rows, "stat string, draw long, n long, x double").cache()
    ess = {r.stat: (r.n, r.ess) for r in trace_ess(trace, "stat", "x").collect()}
    z = {r.stat: r.z for r in trace_geweke(trace, "stat", "x").collect()}
    assert all(ess[k][0] == len(x) and np.isclose(ess[k][1], geyer_ess(x)) for k, x in traces.items())
    # two draws on either side have no variance but rounding
    assert np.allclose([z[k] for k in traces if k != "short"], [geweke_z(x) for k, x in traces.items() if k != "short"])


def test_all_lags_from_segments(spark):
    """Transforms of short segments, in one pass or two, give the autocovariances of the whole trace at every lag."""
    from arcweave.diag.traces import autocovariance, autocovariances, geyer_variance, long_runs

    rng = np.random.default_rng(6)
    slow = np.zeros(500)
    for k in range(1, 500):
        slow[k] = 0.97 * slow[k - 1] + rng.normal()
    traces = {"slow": slow, "fast": rng.normal(size=131), "odd": np.cumsum(rng.normal(size=33)), "one": np.array([1.0]), "flat": np.full(20, 2.0)}
    rows = [(k, i + 1, len(x), float(v)) for k, x in traces.items() for i, v in enumerate(x)]
    trace = spark.createDataFrame(rows, "stat string, draw long, n long, x double").repartition(3).cache()
    for size, segments in ((8, 63), (64, 8), (4096, 1)):
        got = {(r.stat, r.lag): r.g for r in autocovariances(trace, "stat", "x", size, segments).collect()}
        for k, x in traces.items():
            want = autocovariance(x)
            assert np.allclose([got[k, lag] for lag in range(len(x))], want, atol=1e-9) and (k, len(x)) not in got
    for size in (4, 4096):
        runs = long_runs(trace, "stat", "x", size)
        assert all(np.isclose(runs[k][3], geyer_variance(x)) and runs[k][0] == len(x) for k, x in traces.items() if len(x) > 1)


def test_row_numbers_without_a_window_on_a_key(spark):
    from arcweave.plans.scratch import with_row_numbers

    rng = np.random.default_rng(8)
    rows = [(None if k % 5 == 0 else "hot" if k % 3 else "rare", int(rng.integers(0, 40)), k) for k in range(600)]
    df = spark.createDataFrame(rows, "name string, at int, k int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = with_row_numbers(df, ["at", "k"], ["name"], total="n")
        assert got.columns == ["name", "at", "k", "row", "n"]
        made = {(r.name if isinstance(r.name, str) else r["name"], r.at, r.k): (r.row, r.n) for r in got.collect()}
        plain = {r.k: r.row for r in with_row_numbers(df, ["at", "k"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for name in ("hot", "rare", None):
        own = sorted(r for r in rows if r[0] == name) if name else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])
        assert [made[r] for r in own] == [(k, len(own)) for k in range(len(own))]
    order = sorted(rows, key=lambda r: r[1:])
    assert [plain[r[2]] for r in order] == list(range(600))
    assert with_row_numbers(df.filter("false"), ["at"], ["name"]).count() == 0


@pytest.mark.parametrize("directed", [True, False])
def test_distances_by_bits(spark, monkeypatch, directed):
    """More sources than a row has bits, in more than one batch; parts that nothing joins; a long path."""
    from arcweave.diag import panels

    rng = np.random.default_rng(11)
    n = 700
    edges = {(int(a), int(b)) for a, b in rng.integers(1, 640, (900, 2)) if a != b} | {(k, k + 1) for k in range(640, 648)}
    net = Network.from_edges(spark, n, sorted(edges), directed).cached()
    want = distances(net.matrix()[0]).tolist()
    monkeypatch.setattr(panels, "STATES", 1)
    assert [(r.d, r.c) for r in geodesics(net).orderBy("d").collect()] == list(enumerate(want, 1))
    assert [r.c for r in geodesics(net, depth=2).orderBy("d").collect()] == want[:2]
    assert geodesics(Network.from_edges(spark, 3, [], directed)).count() == 0


@pytest.mark.parametrize("directed", [True, False])
def test_fit_by_blocks_equals_listed_fit(spark, monkeypatch, directed):
    """A continuous attribute, degrees, shared partners and unobserved dyads: sums over pairs of blocks, no dyad listed."""
    from arcweave.operators.structural import GWESP, GWDegree, Mutual, TwoPath
    from arcweave.plans import blocks

    rng = np.random.default_rng(5)
    n = 60
    edges = sorted({(int(a), int(b)) if directed else (min(int(a), int(b)), max(int(a), int(b))) for a, b in rng.integers(1, n + 1, (160, 2)) if a != b})
    missing = sorted({(int(a), int(b)) for a, b in rng.integers(1, n + 1, (30, 2)) if a < b})
    net = Network.from_edges(spark, n, edges, directed, {"x": [float(v) for v in rng.normal(size=n)]}, missing).cached()
    terms = [Edges(), NodeCov("x"), GWESP(0.4), *([Mutual(), TwoPath()] if directed else [GWDegree(0.3)])]
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks.block_pairs, "__defaults__", (16,))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        model = ERGMModel(terms, net)
        one, two = mple(model, by_blocks=False), mple(model, by_blocks=True)
    assert np.allclose(one.coefficients, two.coefficients, atol=1e-6) and np.allclose(one.std_errors, two.std_errors, atol=1e-6)
    assert np.isclose(one.loglik, two.loglik) and one.converged and two.converged


def test_covariate_that_follows_the_dyad_is_listed(spark):
    net = small(spark, True)
    with pytest.raises(ValueError, match="listed"):
        mple(ERGMModel([Edges(), EdgeCov(lambda n, pairs: pairs.select("i", "j").withColumn("x", pairs.i * 0.1))], net), by_blocks=True)


@pytest.mark.parametrize("directed", [True, False])
def test_silent_vertices_are_a_list_of_dyads_that_is_never_made(spark, directed):
    from arcweave.fit.mcmle import present_missing
    from arcweave.operators.structural import Kstar

    rng = np.random.default_rng(9)
    n, gone = 26, [3, 8, 9, 20]
    edges = sorted({(int(a), int(b)) if directed else (min(int(a), int(b)), max(int(a), int(b))) for a, b in rng.integers(1, n + 1, (70, 2)) if a != b})
    listed = [(1, 2), (3, 5), (4, 8)]
    hidden = {(i, j) for i in gone for j in range(1, n + 1) if i != j} | set(listed)
    hidden = sorted(hidden if directed else {tuple(sorted(p)) for p in hidden})
    attributes = {"x": [float(k % 3) for k in range(n)]}
    whole = Network.from_edges(spark, n, edges, directed, attributes, hidden)
    base = Network.from_edges(spark, n, edges, directed, attributes, listed)
    rule = Network(base.vertices, base.arcs, directed, base.missing, spark.createDataFrame([(v,) for v in [*gone, 3, 999]], "v long"))
    assert rule.n_missing == len(hidden) == whole.n_missing and rule.n_dyads == whole.n_dyads == rule.dyads.count()
    assert {tuple(r) for r in rule.hidden().collect()} == set(hidden)
    assert {tuple(r) for r in present_missing(rule).collect()} == set(edges) & set(hidden)
    terms = [Edges(), NodeMatch("x"), Kstar(2)]
    want = sorted(map(tuple, mple_design(whole, terms, False).collect()))
    for sparse in (True, False):
        assert sorted(map(tuple, mple_design(rule, terms, sparse).collect())) == want
    model = [Edges(), NodeCov("x"), GWESP(0.5)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        one, two = mple(ERGMModel(model, whole)), mple(ERGMModel(model, rule), by_blocks=True)
    assert np.allclose(one.coefficients, two.coefficients, atol=1e-6) and one.nobs == two.nobs and np.isclose(one.loglik, two.loglik)


def test_many_silent_vertices(spark):
    """1,000 of 100,000 vertices say nothing: a hundred million dyads are hidden by their number."""
    n = 100_000
    arcs = spark.range(1, n).selectExpr("id AS i", "id + 1 AS j")
    vertices = spark.range(1, n + 1).selectExpr("id AS v", "id % 2 AS side")
    net = Network(vertices, arcs, True, None, spark.range(1, 1_001).toDF("v"))
    assert net.n_missing == 1_000 * (n - 1)
    rows = mple_design(net, [Edges(), NodeMatch("side")]).collect()
    assert sum(r.n_tot for r in rows) == net.n_dyads and sum(r.n_one for r in rows) == n - 1 - 1_000 and len(rows) == 2


@pytest.mark.parametrize("directed", [True, False])
def test_dyads_hidden_by_a_rule_are_a_list_that_is_never_made(spark, directed):
    from arcweave.fit.mcmle import present_missing
    from arcweave.operators.structural import Kstar

    rng = np.random.default_rng(9)
    n, listed = 26, [(1, 2), (3, 5), (4, 8)]
    edges = sorted({(int(a), int(b)) if directed else (min(int(a), int(b)), max(int(a), int(b))) for a, b in rng.integers(1, n + 1, (70, 2)) if a != b})
    hidden = sorted({(i, j) for i in range(1, n + 1) for j in range(1, n + 1) if (i < j or directed and i != j) and (i + j) % 5 in (0, 2)} | set(listed))
    attributes = {"x": [float(k % 3) for k in range(n)]}
    whole = Network.from_edges(spark, n, edges, directed, attributes, hidden)
    base = Network.from_edges(spark, n, edges, directed, attributes, listed)
    ruled = ("v % 5", "(i + j) % 5 in (0, 2)")
    with pytest.raises(ValueError, match="either"):
        Network(base.vertices, base.arcs, directed, None, base.vertices.select("v"), ruled)
    for rule in (Network(base.vertices, base.arcs, directed, base.missing, rule=ruled), Network(base.vertices, base.arcs, directed, rule=ruled)):
        own = set(hidden) if rule.missing is not None else set(hidden) - {p for p in listed if sum(p) % 5 not in (0, 2)}
        assert rule.n_missing == len(own) and rule.n_dyads == rule.dyads.count()
        assert {tuple(r) for r in rule.hidden().collect()} == own
        assert {tuple(r) for r in present_missing(rule).collect()} == set(edges) & own
        if rule.missing is not None:
            terms = [Edges(), NodeMatch("x"), Kstar(2)]
            want = sorted(map(tuple, mple_design(whole, terms, False).collect()))
            for sparse in (True, False):
                assert sorted(map(tuple, mple_design(rule, terms, sparse).collect())) == want
            one, two = mple(ERGMModel([Edges(), NodeCov("x")], whole)), mple(ERGMModel([Edges(), NodeCov("x")], rule), by_blocks=True)
            assert np.allclose(one.coefficients, two.coefficients, atol=1e-6) and one.nobs == two.nobs


def test_rule_that_hides_many_dyads(spark):
    """A seventeenth of the ten billion dyads of 100,000 vertices is hidden by their number."""
    n = 100_000
    arcs = spark.range(1, n).selectExpr("id AS i", "id + 1 AS j")
    net = Network(spark.range(1, n + 1).selectExpr("id AS v", "id % 2 AS side"), arcs, True, rule=("v % 17", "(i + j) % 17 = 0"))
    left = [n // 17 + (1 <= k <= n % 17) for k in range(17)]
    assert net.n_missing == sum(left[k] * left[-k % 17] for k in range(17)) - left[0]
    rows = mple_design(net, [Edges(), NodeMatch("side")]).collect()
    assert sum(r.n_tot for r in rows) == net.n_dyads and sum(r.n_one for r in rows) == sum((2 * k + 1) % 17 != 0 for k in range(1, n)) and len(rows) == 2


def test_rounds_of_distances_leave_no_shuffle_files(spark):
    """A path of 40 vertices takes 40 rounds; their shuffles go with them."""
    import time

    from arcweave.diag.panels import geodesics

    net = Network.from_edges(spark, 40, [(k, k + 1) for k in range(1, 40)], True).cached()
    net.n, net.n_edges  # noqa: B018
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    assert [tuple(r) for r in geodesics(net).collect()] == [(d, 40 - d) for d in range(1, 40)]
    for _ in range(20):  # files are removed behind the query's back
        if len(files() - before) < 6:
            break
        time.sleep(0.5)
    assert len(files() - before) < 6
