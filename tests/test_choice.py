"""Assembly, estimation, inference, simulation and spatial operators on small synthetic data."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkwing import ChoiceModel, ChoiceTable, ModelSpec, compute_inclusion_probs, hausman_test, iia_test, lm_error_test, lm_lag_test, lr_test, queries, sample_alternatives, wald_test
from larkwing.operators import distance as D
from larkwing.operators import graph as G
from larkwing.operators.sampling import inclusion_probability
from larkwing.sources import choice_table, dgp


@pytest.fixture(scope="module")
def data(spark):
    d = dgp.simulate_mnl(spark, 800, 5, {"cost": -0.5}, {"income_x_cost": 0.3}, seed=4)
    d.choosers = d.choosers.cache()
    return d


@pytest.fixture(scope="module")
def fitted(data):
    m = ChoiceModel(data.choice_table, data.formula)
    m.fit()
    return m


@pytest.fixture()
def tiny(spark):
    c = spark.createDataFrame([(1, 0.5, 11), (2, 1.5, 10), (3, 2.5, 13)], "obs_id long, obs_feature double, choice long")
    a = spark.createDataFrame([(10, 0.5), (11, 1.5), (12, 2.5), (13, 3.5)], "alt_id long, alt_feature double")
    return c, a


def test_census(tiny):
    t = ChoiceTable.from_tables(*tiny, "choice")
    assert len(t) == 12 and t.n_observations == 3 and t.n_alternatives == 4
    assert t.df.agg(F.sum("chosen")).first()[0] == 3


def test_pairwise_is_aligned_and_disjoint_pairs_are_an_error(spark, tiny):
    t = ChoiceTable.from_tables(*tiny, "choice")
    pairs = spark.createDataFrame([(o, a, float(o * 100 + a)) for o in (1, 2, 3) for a in (13, 12, 11, 10)], "o long, a long, v double")
    got = t.add_pairwise_variable("d", pairs).df
    assert got.filter(F.col("d") != F.col("obs_id") * 100 + F.col("alt_id")).count() == 0
    with pytest.raises(KeyError):
        t.add_pairwise_variable("d", spark.createDataFrame([(1, 99, 1.0)], "o long, a long, v double"))


def test_matrix_formats_agree(tiny):
    t = ChoiceTable.from_tables(*tiny, "choice")
    x = np.arange(12.0).reshape(3, 4)
    rows = lambda t: sorted((r["obs_id"], r["alt_id"], r["z"]) for r in t.df.select("obs_id", "alt_id", "z").collect())
    assert rows(t.add_matrix("z", x)) == rows(t.add_matrix("z", x.ravel()))
    assert {r[2] for r in rows(t.add_matrix("z", np.array([1.0, 2, 3, 4])))} == {1.0, 2, 3, 4}


def test_matrix_of_numbered_rows_and_of_slices(spark, monkeypatch):
    monkeypatch.setattr(choice_table, "SLICE_BYTES", 8 * 4 * 7)  # seven rows of four a slice
    r = np.random.default_rng(4)
    ids = r.permutation(200).tolist()
    t = ChoiceTable.from_tables(spark.createDataFrame([(i * 3, 0.5) for i in ids], "obs_id long, x double").repartition(9), spark.createDataFrame([(a, 1.0) for a in (13, 10, 12, 11)], "alt_id long, y double"))
    m = r.normal(size=(200, 4))
    want = {(3 * i, 10 + k): m[i, k] for i in range(200) for k in range(4)}
    rows = spark.createDataFrame([(i, m[i].tolist()) for i in ids], "i long, v array<double>").repartition(7)
    for given in (rows, m, m.ravel()):
        out = t.add_matrix("z", given).df
        assert {(x["obs_id"], x["alt_id"]): x["z"] for x in out.select("obs_id", "alt_id", "z").collect()} == want and out.count() == 800
    for bad in (rows.filter("i <> 5"), rows.withColumn("i", F.col("i") + 1), rows.withColumn("i", F.greatest("i", F.lit(1))), rows.withColumn("v", F.slice("v", 1, 3)), rows.filter("i < 199")):
        with pytest.raises(ValueError):
            t.add_matrix("z", bad)


def test_dense_gather_makes_no_matrix_on_the_driver(spark, monkeypatch):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(len(data)) or create(self, data, *a, **k))
    assert queries.matrix_dense_gather(spark, "/root/testdata/sf0.001").count() == 150 * 25 and max(made, default=0) < 150


def test_long_tables_are_validated(spark):
    ok = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "o long, a long, y int")
    assert ChoiceTable.from_long(ok, "o", "a", "y").n_alternatives == 2
    with pytest.raises(ValueError):
        ChoiceTable.from_long(ok.union(ok), "o", "a", "y")
    with pytest.raises(ValueError):
        ChoiceTable.from_long(ok.union(spark.createDataFrame([(2, 1, 1)], ok.schema)), "o", "a", "y")


def test_unknown_choice_and_missing_interaction_are_errors(spark, tiny):
    c, a = tiny
    with pytest.raises(ValueError):
        ChoiceTable.from_tables(c.withColumn("choice", F.lit(99)), a, "choice")
    t = ChoiceTable.from_tables(c, a.withColumn("alt_feature", F.when(F.col("alt_id") > 10, F.col("alt_feature"))), "choice")
    with pytest.raises(ValueError):
        t.add_interaction("x", "obs_feature", "alt_feature")


@pytest.mark.parametrize("replace", [True, False])
@pytest.mark.parametrize("weighted", [True, False])
def test_samples_hold_the_choice_once_and_repeat(spark, tiny, replace, weighted):
    c, a = tiny
    options = {"sample_size": 3, "seed": 1, "replace": replace, "weights": "alt_feature" if weighted else None}
    one, two = (ChoiceTable.from_tables(c, a, "choice", **options).df.select("obs_id", "alt_id", "alt_pos", "chosen", "pi") for _ in range(2))
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 9
    assert one.groupBy("obs_id").agg(F.sum("chosen").alias("k")).filter("k <> 1").count() == 0
    assert one.filter("chosen = 1 and pi <> 1").count() == 0


def test_large_universe_uses_distinct_draws(spark):
    s = sample_alternatives(spark, 50, 5000, 20, seed=2)
    assert s.count() == 1000 and s.select("chooser", "alt").distinct().count() == 1000
    counts = sample_alternatives(spark, 4000, 4, 1, weights=[1, 1, 1, 5], seed=3, replace=True).groupBy("alt").count().collect()
    assert abs({r["alt"]: r["count"] for r in counts}[3] / 4000 - 5 / 8) < 0.05


def test_inclusion_probabilities(spark):
    assert np.allclose(compute_inclusion_probs(2, 4, "SRSWOR"), 0.5) and np.allclose(compute_inclusion_probs(9, 4), 1)
    w = np.array([1.0, 3.0])
    assert np.allclose(compute_inclusion_probs(2, 2, "weighted_wr", w), 1 - (1 - w / 4) ** 2)
    assert spark.range(1).select(inclusion_probability("srswr", 2, 4)).first()[0] == pytest.approx(1 - 0.75**2)
    with pytest.raises(ValueError):
        compute_inclusion_probs(1, 2, "weighted_wor")


def test_fit_recovers_and_probabilities_give_the_likelihood(fitted, data):
    r = fitted.result
    for n, v in data.true_params.items():
        assert abs(r.coefficients[n] - v) < 4 * r.std_errors[n]
    p = fitted.probabilities()
    ll = p.join(data.choosers.select(F.col("oid").alias("obs"), F.col("choice").alias("alt")), ["obs", "alt"]).agg(F.sum(F.log("probability"))).first()[0]
    assert ll == pytest.approx(r.log_likelihood, abs=1e-8)
    assert r.log_likelihood_null == pytest.approx(-800 * np.log(5))
    assert "cost" in r.summary() and "tabular" in r.to_latex() and "<table>" in r.to_html()


def test_solvers_agree(data, fitted):
    r = ChoiceModel(data.choice_table, data.formula, solver="lbfgs").fit()
    assert np.allclose(r.coefficients, fitted.result.coefficients, atol=1e-4)
    with pytest.raises(ValueError):
        ChoiceModel(data.choice_table, spec=ModelSpec().bounded("cost", -1, 0).generic("income_x_cost"), solver="trust-ncg").fit()


def test_bounds_and_fixed_coefficients(data):
    r = ChoiceModel(data.choice_table, spec=ModelSpec().bounded("cost", -0.1, 0).fixed("income_x_cost", 0.3)).fit()
    assert r.coefficients["cost"] == pytest.approx(-0.1) and r.coefficients["income_x_cost"] == 0.3 and r.n_parameters == 1


def test_inference(fitted, data):
    s = fitted.observation_scores()
    assert np.allclose([s.agg(F.sum(c)).first()[0] for c in ("s_0", "s_1")], 0, atol=1e-3)
    robust = fitted.robust_standard_errors()
    assert (np.abs(robust / fitted.result.std_errors - 1) < 0.5).all()
    assert np.allclose(fitted.clustered_covariance("oid"), fitted.robust_covariance() * 800 / 799, rtol=1e-6)


def test_effects_are_derivatives(fitted, data):
    e = {(r["obs"], r["alt"]): r["effect"] for r in fitted.marginal_effect("cost").collect()}
    p = {(r["obs"], r["alt"]): r["probability"] for r in fitted.probabilities().collect()}
    b = fitted.result.coefficients["cost"]
    assert all(abs(e[k] - (1 - p[k]) * b) < 1e-12 for k in p)
    assert fitted.average_marginal_effect("cost", "alt").count() == 5
    with pytest.raises(KeyError):
        fitted.marginal_effect("nothing")


def test_diagnostics(fitted, data):
    small = ChoiceModel(data.choice_table, "cost")
    small.fit()
    lr, wald = lr_test(small.result, fitted.result), wald_test(fitted.result.coefficients, fitted.result.covariance_matrix, [[0, 1]])
    assert lr.df == 1 and lr.significant_at_05 and wald.significant_at_05
    ring = dgp.ring_adjacency(5)
    assert 0 <= lm_lag_test(fitted, ring).p_value <= 1 and 0 <= lm_error_test(fitted, ring).p_value <= 1
    assert hausman_test(fitted.result, fitted.result).df == 0
    assert iia_test(fitted, [0, 1, 2]).df >= 1
    w = fitted.result.wtp("income_x_cost", "cost")["wtp"][0]
    assert w == pytest.approx(-fitted.result.coefficients["income_x_cost"] / fitted.result.coefficients["cost"])


def test_simulation_and_capacity(fitted):
    one, two = (sorted(fitted.simulate(seed=3).select("obs", "alt").collect()) for _ in range(2))
    assert one == two and len(one) == 800
    out = fitted.simulate(seed=3, capacity={0: 50, 1: 60.7})
    counts = {r["alt"]: r["count"] for r in out.groupBy("alt").count().collect()}
    assert counts[0] <= 50 and counts[1] <= 60 and sum(counts.values()) == 800
    with pytest.warns(RuntimeWarning):
        full = fitted.simulate(seed=3, capacity=dict.fromkeys(range(5), 100))
    assert full.filter("alt is null and round = 0").count() == 300
    with pytest.raises(ValueError):
        fitted.simulate(capacity={0: -1})


def test_capacity_of_a_nested_model_recomputes_probabilities(spark):
    d = dgp.simulate_nested_logit(spark, 400, 5, {"cost": -0.3}, interaction_params={"income_x_cost": 0.4})
    m = ChoiceModel(d.choice_table, d.formula, nests={"a": [0, 1, 2], "b": [3, 4]})
    m.fit()
    out = m.simulate(seed=5, capacity={0: 20, 3: 30}, n_draws=2).collect()
    taken = Counter((r["draw"], r["alt"]) for r in out)
    assert len(out) == 800 and all(r["alt"] is not None for r in out) and all(taken[k, 0] == 20 and taken[k, 3] == 30 for k in (0, 1))
    lam, beta = {n: m.result.coefficients[f"lambda_{n}"] for n in "ab"}, m.result.coefficients
    v = {(r["obs"], r["alt"]): r["utility"] for r in m.utilities(beta=beta.values).collect()}
    nest = {0: "a", 1: "a", 2: "a", 3: "b", 4: "b"}
    room = {0: 20, 3: 30}
    assert max(r["round"] for r in out) > 1
    for r in (r for r in out if r["round"] > 1):
        gone = {a for a, n in room.items() if sum(x["alt"] == a and x["draw"] == r["draw"] and x["round"] < r["round"] for x in out) == n}
        total = {n: sum(math.exp(v[r["obs"], a] / lam[n]) for a in nest if nest[a] == n and a not in gone) for n in "ab"}
        whole = sum(total[n] ** lam[n] for n in "ab" if total[n])
        n = nest[r["alt"]]
        assert r["probability"] == pytest.approx(math.exp(v[r["obs"], r["alt"]] / lam[n]) * total[n] ** (lam[n] - 1) / whole, rel=1e-6)


def test_spatial_lag_effects_redistribute(spark):
    d = dgp.simulate_sar_mnl(spark, 600, 8, {"x": -0.5}, interaction_params={"income_x_x": 0.2}, k=2)
    m = ChoiceModel(d.choice_table, d.formula, graph=d.graph, lag=True)
    m.fit()
    assert abs(m.spatial_impacts("x")["total"]) < 1e-9
    gmm = ChoiceModel(d.choice_table, d.formula, graph=d.graph, lag=True, estimator="linearized_gmm").fit()
    assert abs(gmm.coefficients["income_x_x"] - m.result.coefficients["income_x_x"]) < 0.2


def test_nested_fit(spark):
    d = dgp.simulate_nested_logit(spark, 600, 4, {"cost": -0.3}, interaction_params={"income_x_cost": 0.4})
    m = ChoiceModel(d.choice_table, d.formula, nests=d.nests)
    r = m.fit()
    assert abs(m.probabilities().groupBy("obs").agg(F.sum("probability").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]) < 1e-9
    assert set(r.coefficients.index) == {"cost", "income_x_cost", "lambda_nest0", "lambda_nest1"}


def test_distances_and_graphs(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 6.0, 8.0)], "id long, x double, y double")
    e = {(r[0], r[1]): r[2] for r in D.distance_matrix(p, "euclidean").collect()}
    assert e[1, 2] == 5 and e[1, 3] == 10 and e[2, 2] == 0
    near = D.nearest_neighbors(p, p, 5, "euclidean").collect()
    assert len(near) == 9 and all(r["distance"] == 0 for r in near if r["rank"] == 1)
    bands = {(r["origin_id"], r["band"]): r["destinations"] for r in D.distance_bands(D.pairwise_distance(p, p, "euclidean"), [0, 5, 11]).collect()}
    assert bands[1, 0] == [1] and bands[1, 1] == [2, 3]
    with pytest.raises(NotImplementedError):
        D.distance_matrix(p, "network")
    g = G.knn_graph(p, 2)
    assert g.groupBy("focal").agg(F.sum("weight").alias("s")).filter("abs(s - 1) > 1e-12").count() == 0
    assert {(r["alt"], r["hops"]) for r in G.hop_distances(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "focal long, neighbor long, weight double"), [1], 4).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_streamed_scores(spark, tmp_path, tiny):
    from larkwing.streaming.scoring import score_choosers

    c, a = tiny
    c.select("obs_id", "obs_feature").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("obs_id long, obs_feature double").parquet(str(tmp_path / "in"))
    scored = score_choosers(stream, a, {"b": lambda alt: F.col("obs_feature") * alt["alt_feature"]}, {"b": 0.5}, "alt_id")
    q = scored.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("scored").collect()
    assert len(rows) == 3 and all(sum(x["probability"] for x in r["probabilities"]) == pytest.approx(1) for r in rows)
