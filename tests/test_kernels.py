"""Invariants of the probability kernels: sums, masks, special cases, derivatives."""

import numpy as np
import pytest

from larkwing.plans import kernels
from larkwing.functions.stats import chi2_ppf, chi2_sf, halton, norm_cdf, norm_ppf, realise
from larkwing.plans.kernels import Edges, Structure, mnl, mnl_derivatives, nested, nested_scl, sar_filter, scl, scores
from larkwing.plans.packing import Block
from larkwing.sources.dgp import ring_adjacency

R = np.random.default_rng(5)
N, J = 30, 6
V = R.normal(size=(N, J))
AV = np.ones((N, J), bool)
AV[:10, 2] = False


def total(logp, av=AV):
    return np.where(av, np.exp(logp), 0).sum(axis=1)


def test_mnl_sums_and_masks():
    p = np.exp(mnl(V, AV))
    assert np.allclose(p.sum(axis=1), 1) and (p[:10, 2] == 0).all()
    assert np.allclose(np.exp(mnl(V + 800, AV)), p)  # extreme utilities


def test_nested_is_mnl_at_one_and_sums():
    nest = np.broadcast_to(np.array([0, 0, 1, 1, 1, -1]), (N, J))
    assert np.allclose(nested(V, AV, nest, np.ones(2)), mnl(V, AV))
    assert np.allclose(total(nested(V, AV, nest, np.array([0.4, 0.8]))), 1)


def test_scl_is_mnl_at_one_with_an_isolated_alternative():
    w = ring_adjacency(J)
    w[5, :] = w[:, 5] = 0
    assert np.allclose(scl(V, AV, Edges.of(w), 1.0)[0][AV], mnl(V, AV)[AV])
    assert np.allclose(total(scl(V, AV, Edges.of(w), 0.4)[0]), 1)


def test_nested_scl_sums():
    parts = [Edges.of(ring_adjacency(J), [0, 1, 2]), Edges.of(ring_adjacency(J), [3, 4, 5])]
    assert np.allclose(total(nested_scl(V, AV, parts, np.array([0.5, 0.7]), np.array([0.6, 0.9]))), 1)


def test_sar_filter_at_zero_and_power_series():
    w = ring_adjacency(J) / 2
    assert np.allclose(sar_filter(w, 0.0), np.eye(J))
    series = sum(np.linalg.matrix_power(0.4 * w, k) for k in range(80))
    assert np.allclose(sar_filter(w, 0.4, False), series)


def block(x):
    n, j, _ = x.shape
    return Block(np.arange(n), np.arange(n), np.ones(n), R.integers(0, j, n), np.ones((n, j), bool), np.zeros((n, j)), x, [list(range(j))] * n, np.full(n, j))


KINDS = {
    "mnl": {}, "nested": {"nests": {"a": [0, 1, 2], "b": [3, 4]}}, "scl": {"graph": ring_adjacency(J), "alts": list(range(J))}, "sar": {"graph": ring_adjacency(J) / 2, "alts": list(range(J)), "lag": True},
    "reduced": {"graph": ring_adjacency(J) / 2, "alts": list(range(J)), "lag": True, "normalise": False}, "mixed": {"random": {"y": "normal"}, "n_draws": 8}, "lognormal": {"random": {"y": "lognormal"}, "n_draws": 8},
    "nested_scl": {"graph": ring_adjacency(J), "alts": list(range(J)), "nests": {"a": [0, 1, 2], "b": [3, 4, 5]}}, "mscl": {"graph": ring_adjacency(J), "alts": list(range(J)), "random": {"y": "uniform"}, "n_draws": 8},
    "mixed_nested": {"nests": {"a": [0, 1, 2], "b": [3, 4]}, "random": {"y": "triangular"}, "n_draws": 8}, "sar_mixed": {"graph": ring_adjacency(J) / 2, "alts": list(range(J)), "lag": True, "random": {"y": "normal"}, "n_draws": 8},
    "sar_nested": {"graph": ring_adjacency(J) / 2, "alts": list(range(J)), "lag": True, "nests": {"a": [0, 1, 2], "b": [3, 4]}}, "correlated": {"random": {"x": "normal", "y": "normal"}, "correlated": True, "n_draws": 8},
    "mnscl": {"graph": ring_adjacency(J), "alts": list(range(J)), "nests": {"a": [0, 1, 2], "b": [3, 4, 5]}, "random": {"y": "normal"}, "n_draws": 8},
    "sar_mixed_nested": {"graph": ring_adjacency(J) / 2, "alts": list(range(J)), "lag": True, "nests": {"a": [0, 1, 2], "b": [3, 4]}, "random": {"y": "normal"}, "n_draws": 8},
}


@pytest.mark.parametrize("kind", KINDS)
def test_families_sum_to_one_and_scores_are_derivatives(kind):
    s, b = Structure(["x", "y"], **KINDS[kind]), block(R.normal(size=(12, J, 2)))
    raw = R.normal(0, 0.3, len(s.param_names))
    assert np.allclose(np.exp(s.log_probabilities(b, s.natural(raw))).sum(axis=1), 1)
    got = scores(s, b, raw)
    for k in range(len(raw)):
        h = np.eye(len(raw))[k] * 1e-6
        slope = (s.contributions(b, s.natural(raw + h))[0] - s.contributions(b, s.natural(raw - h))[0]) / 2e-6
        assert np.allclose(got[:, k], slope, atol=1e-6)


def test_zero_spread_is_mnl():
    b = block(R.normal(size=(12, J, 2)))
    mixed, plain = Structure(["x", "y"], random={"y": "normal"}, n_draws=16), Structure(["x", "y"])
    assert np.allclose(mixed.log_probabilities(b, np.array([0.3, -0.2, 0.0])), plain.log_probabilities(b, np.array([0.3, -0.2])))


def test_panel_multiplies_within_person():
    b = block(R.normal(size=(12, J, 2)))
    b.person = np.repeat(np.arange(4), 3)
    s = Structure(["x", "y"], random={"y": "normal"}, n_draws=32, panel=True)
    ll, w = s.contributions(b, np.array([0.3, -0.2, 0.8]))
    each = s.log_probabilities(b, np.array([0.3, -0.2, 0.8]), chosen_only=True).reshape(4, 3, 32).sum(axis=1)
    assert len(ll) == 4 and np.allclose(ll, np.log(np.exp(each).mean(axis=1))) and (w == 1).all()


def test_analytic_mnl_derivatives():
    s, b = Structure(["x", "y"]), block(R.normal(size=(12, J, 2)))
    beta = np.array([0.2, -0.4])
    ll, g, h = mnl_derivatives(s, b, beta)
    assert np.allclose(g, scores(s, b, beta).sum(axis=0))
    e = np.eye(2) * 1e-6
    assert np.allclose(h, [(mnl_derivatives(s, b, beta + e[i])[1] - mnl_derivatives(s, b, beta - e[i])[1]) / 2e-6 for i in (0, 1)], atol=1e-5)


def test_statistics():
    assert np.allclose(norm_cdf(norm_ppf([1e-8, 0.1, 0.5, 0.999])), [1e-8, 0.1, 0.5, 0.999])
    assert abs(chi2_sf(chi2_ppf(0.95, 4), 4) - 0.05) < 1e-10
    assert np.allclose(halton(4, 3), [1 / 3, 2 / 3, 1 / 9, 4 / 9])
    z = R.normal(size=20_000)
    assert abs(realise("triangular", 1.0, 2.0, z).mean() - 1) < 0.05 and abs(np.ptp(realise("uniform", 0, 3.0, z)) - 6) < 0.1


@pytest.mark.parametrize("kind", ["mixed", "lognormal", "correlated"])
def test_mixed_derivatives_are_those_of_complex_steps(kind, monkeypatch):
    monkeypatch.setattr(kernels, "HELD", 3 * 8 * J)  # some observations at once
    s, b = Structure(["x", "y"], **KINDS[kind]), block(R.normal(size=(11, J, 2)))
    b.av = b.av & (R.random(b.av.shape) < 0.7)
    b.av[np.arange(11), b.chosen] = True
    raw = R.normal(0, 0.3, len(s.param_names))
    ll, g = kernels.mixed_derivatives(s, b, raw)
    assert np.allclose(ll, s.contributions(b, s.natural(raw))[0], atol=1e-12)
    assert np.allclose(g, kernels.stepped_scores(s, b, raw), atol=1e-12)
    b.av[0, b.chosen[0]] = False
    assert kernels.mixed_derivatives(s, b, raw) is None


def test_table_of_draws_outlives_a_structure(monkeypatch):
    want = Structure(["x"], random={"x": "normal"}, n_draws=8).draws(["a", "b"])
    monkeypatch.setattr(kernels, "norm_ppf", lambda *_: 1 / 0)  # not made again for the structure of another task
    assert (Structure(["x"], random={"x": "normal"}, n_draws=8).draws(["a", "b"]) == want).all()
