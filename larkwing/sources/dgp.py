"""Synthetic choice data from known parameters: everything is a function of (seed, ids), so any partitioning gives the same."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .choice_table import ChoiceTable


@dataclass
class Dataset:
    """choosers (oid, income, choice), alternatives (aid, attributes), true parameters on the display scale, the table."""

    choosers: DataFrame
    alternatives: DataFrame
    true_params: dict[str, float]
    formula: str
    choice_table: ChoiceTable
    nests: dict[str, list] = field(default_factory=dict)
    graph: np.ndarray | None = None
    true_rho: float | dict | None = None
    true_lambdas: dict[str, float] = field(default_factory=dict)


MNLDataset = NestedMNLDataset = MixedMNLDataset = SCLDataset = NestedSCLDataset = MSCLDataset = MNSCLDataset = MixedNestedMNLDataset = SARMNLDataset = Dataset


def ring_adjacency(n: int) -> np.ndarray:
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[i, (i - 1) % n] = 1
    return w if n > 2 else np.ones((n, n)) - np.eye(n)


def even_nests(n_alts: int, n_nests: int = 2) -> dict[str, list[int]]:
    return {f"nest{m}": [int(a) for a in part] for m, part in enumerate(np.array_split(np.arange(n_alts), n_nests))}


def _simulate(spark: SparkSession, n_obs: int, n_alts: int, alt_params: dict, interaction_params: dict | None, seed: int, nests=None, lambdas=None, graph=None, rho=None, lag=False, normalise=True, random: dict | None = None) -> Dataset:
    """Choices drawn by inverse distribution function from the model's own probabilities, in Arrow batches over choosers; with
    random = {variable: (kind, spread)} each chooser has own coefficients."""
    from ..plans.kernels import Structure
    from ..plans.packing import Block

    r = np.random.default_rng(seed)
    values = {k: r.uniform(1, 10, n_alts) for k in alt_params}
    interaction_params = interaction_params or {}
    names = [*alt_params, *interaction_params]
    random = random or {}
    structure = Structure(names, random={k: v[0] for k, v in random.items()}, nests=nests or {}, alts=list(range(n_alts)), graph=graph, lag=lag, normalise=normalise, n_draws=1, draw_type="random", seed=seed)
    beta = alt_params | interaction_params
    rhos = [] if rho is None else list(rho.values()) if isinstance(rho, dict) else [rho]
    theta = np.array([*(beta[n] for n in structure.beta_names), *rhos, *(lambdas or {}).values(), *(beta[n] for n in structure.random_names), *(random[n][1] for n in structure.random_names)])
    import pandas as pd

    def choose(parts):
        for part in parts:
            ids = part["oid"].to_numpy()
            gens = [np.random.default_rng([seed, 1, int(i)]) for i in ids]
            income, u = np.array([g.normal() for g in gens]), np.array([g.uniform() for g in gens])
            x = np.zeros((len(ids), n_alts, len(names)))
            for q, n in enumerate(names):
                x[:, :, q] = values[n][None, :] if n in alt_params else income[:, None] * values[n.split("_x_")[1]][None, :]
            block = Block(ids, ids, np.ones(len(ids)), np.zeros(len(ids), int), np.ones((len(ids), n_alts), bool), np.zeros((len(ids), n_alts)), x, [list(range(n_alts))] * len(ids), np.full(len(ids), n_alts))
            p = np.exp(structure.log_probabilities(block, theta))
            choice = np.minimum((p.cumsum(axis=1) <= (u * p.sum(axis=1))[:, None]).sum(axis=1), n_alts - 1)
            yield pd.DataFrame({"oid": ids, "income": income, "choice": choice})

    choosers = spark.range(n_obs).withColumnRenamed("id", "oid").mapInPandas(choose, "oid long, income double, choice long")
    alternatives = spark.createDataFrame([(a, *(float(values[k][a]) for k in alt_params)) for a in range(n_alts)], ", ".join(["aid long", *(f"{k} double" for k in alt_params)]))
    table = ChoiceTable.from_tables(choosers, alternatives, "choice")
    for n in interaction_params:
        table = table.add_interaction(n, "income", n.split("_x_")[1])
    true = dict(zip(structure.param_names, map(float, theta), strict=True))
    return Dataset(choosers, alternatives, true, " + ".join(names), table, nests or {}, graph, rho, lambdas or {})


def simulate_mnl(spark, n_obs=3000, n_alts=6, alt_params=None, interaction_params=None, seed=1234) -> Dataset:
    return _simulate(spark, n_obs, n_alts, alt_params or {"alt_feature": -0.65}, interaction_params, seed)


def simulate_nested_logit(spark, n_obs=10_000, n_alts=4, alt_params=None, nests=None, lambdas=None, interaction_params=None, seed=1234) -> Dataset:
    nests = nests or even_nests(n_alts)
    return _simulate(spark, n_obs, n_alts, alt_params or {"cost": -0.5, "time": -0.2}, interaction_params, seed, nests, lambdas or dict(zip(nests, [0.7, 0.8] * len(nests), strict=False)))


def simulate_scl(spark, n_obs=10_000, n_alts=12, alt_params=None, rho=0.7, graph=None, interaction_params=None, seed=1234) -> Dataset:
    return _simulate(spark, n_obs, n_alts, alt_params or {"cost": -0.5}, interaction_params, seed, graph=ring_adjacency(n_alts) if graph is None else graph, rho=rho)


def simulate_mixed_logit(spark, n_obs=10_000, n_alts=4, alt_params=None, random=None, interaction_params=None, seed=1234) -> Dataset:
    return _simulate(spark, n_obs, n_alts, alt_params or {"cost": -0.5, "time": -0.3}, interaction_params, seed, random=random or {"time": ("normal", 0.5)})


def simulate_mscl(spark, n_obs=10_000, n_alts=12, alt_params=None, random=None, rho=0.7, graph=None, interaction_params=None, seed=1234) -> Dataset:
    return _simulate(spark, n_obs, n_alts, alt_params or {"cost": -0.5, "time": -0.3}, interaction_params, seed, graph=ring_adjacency(n_alts) if graph is None else graph, rho=rho, random=random or {"time": ("normal", 0.5)})


def simulate_nested_scl(spark, n_obs=10_000, n_alts=12, alt_params=None, nests=None, lambdas=None, rhos=None, graph=None, interaction_params=None, seed=1234) -> Dataset:
    nests = nests or even_nests(n_alts)
    return _simulate(spark, n_obs, n_alts, alt_params or {"cost": -0.5}, interaction_params, seed, nests, lambdas or dict.fromkeys(nests, 0.7), ring_adjacency(n_alts) if graph is None else graph, rhos or dict.fromkeys(nests, 0.6))


def simulate_mnscl(spark, n_obs=5000, n_alts=12, alt_params=None, random=None, nests=None, lambdas=None, rhos=None, graph=None, interaction_params=None, seed=1234) -> Dataset:
    nests = nests or even_nests(n_alts)
    return _simulate(spark, n_obs, n_alts, alt_params or {"cost": -0.5, "time": -0.3}, interaction_params, seed, nests, lambdas or dict.fromkeys(nests, 0.7), ring_adjacency(n_alts) if graph is None else graph, rhos or dict.fromkeys(nests, 0.6), random=random or {"time": ("normal", 0.5)})


def simulate_mixed_nested_logit(spark, n_obs=10_000, n_alts=4, alt_params=None, random=None, nests=None, lambdas=None, interaction_params=None, seed=1234) -> Dataset:
    nests = nests or even_nests(n_alts)
    return _simulate(spark, n_obs, n_alts, alt_params or {"cost": -0.5, "time": -0.3}, interaction_params, seed, nests, lambdas or dict.fromkeys(nests, 0.7), random=random or {"time": ("normal", 0.5)})


def simulate_sar_mnl(spark, n_obs=5000, n_alts=50, alt_params=None, rho=0.3, k=7, normalize=True, interaction_params=None, seed=1234) -> Dataset:
    r = np.random.default_rng(seed)
    xy = r.uniform(0, 1, (n_alts, 2))
    d = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    w = np.zeros((n_alts, n_alts))
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, n_alts - 1)]
    np.put_along_axis(w, near, 1 / near.shape[1], axis=1)
    return _simulate(spark, n_obs, n_alts, alt_params or {"alt_feature": -0.5}, interaction_params, seed, graph=w, rho=rho, lag=True, normalise=normalize)
