"""ChoiceModel: one class for multinomial, nested, mixed, spatially correlated and spatial-lag logit and their combinations."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.stats import IDENTITY, SIGMOID, SOFTPLUS, TANH, safe_inverse
from ..operators import effects as E
from ..operators import simulation as M
from .kernels import Structure, lse, scores
from .objective import Objective, blocks
from .packing import pack
from .results import FitResult
from .solvers import get_solver

_TRANSFORM = {"identity": IDENTITY, "sigmoid": SIGMOID, "tanh": TANH, "softplus": SOFTPLUS}


@dataclass(frozen=True)
class NestSpec:
    name: str
    alt_ids: list
    alpha: float | None = None  # raw start of lambda


@dataclass(frozen=True)
class NestingTree:
    nests: list[NestSpec]

    def __post_init__(self):
        ids = [a for n in self.nests for a in n.alt_ids]
        if len(ids) != len(set(ids)):
            raise ValueError("an alternative is in at most one nest")
        if len({n.name for n in self.nests}) != len(self.nests):
            raise ValueError("nest names are unique")

    @classmethod
    def from_dict(cls, nests: dict[str, list]) -> NestingTree:
        return cls([NestSpec(k, list(v)) for k, v in nests.items()])


@dataclass(frozen=True)
class ParamDistribution:
    distribution: str = "normal"

    def __post_init__(self):
        if self.distribution not in ("normal", "lognormal", "uniform", "triangular"):
            raise ValueError(f"unknown distribution {self.distribution!r}")


class ChoiceModel:
    """data: a ChoiceTable. nests: a NestingTree or {name: ids}. random_params: {variable: ParamDistribution or its name}.
    graph: adjacency or weights, alternatives in the order of their ids; lag=True makes it a spatial lag of utilities, else
    correlation of pairs. estimator (spatial lag): auto or pml, reduced, linearized_gmm. panel: a column that names the person."""

    def __init__(self, data, formula=None, spec=None, nests=None, random_params=None, graph=None, lag=False, n_draws=None, draw_type=None, seed=42, weights=None, availability=None, solver="auto", solver_options=None, estimator="auto", warmstart=True, panel=None, correlated=False):
        if estimator not in ("auto", "pml", "reduced", "linearized_gmm"):
            raise ValueError(f"unknown estimator {estimator!r}")
        if (draw_type or "halton") not in ("halton", "scrambled_halton", "sobol", "qmc", "random"):
            raise ValueError(f"unknown draw type {draw_type!r}")
        if correlated and not random_params:
            raise ValueError("correlated needs random parameters")
        if spec is not None:
            data = spec.prepare_data(data)
        self.data, self.formula, self.spec, self.weights, self.availability, self.panel = data, formula, spec, weights, availability, panel
        self.estimator, self.warmstart, self.solver, self.solver_options = estimator, warmstart, solver, solver_options or {}
        tree = NestingTree.from_dict(nests) if isinstance(nests, dict) else nests
        self._arrays = pack(data, formula, spec, weights, availability, panel)
        design, alts = self._arrays.design, []
        random = {k: v.distribution if isinstance(v, ParamDistribution) else v for k, v in (random_params or {}).items()}
        if set(random) - set(design.names):
            raise KeyError(f"random parameters that the design lacks: {sorted(set(random) - set(design.names))}")
        if graph is not None:
            if data.sampling not in ("census", "long"):
                raise ValueError("a model with a graph needs all alternatives, not a sample")
            from ..operators.graph import resolve_spatial_weights

            alts = [r[0] for r in data.universe.select(data.alt_id).orderBy(data.alt_id).collect()]
            graph = resolve_spatial_weights(graph, alts) if lag else resolve_spatial_weights(graph, alts, row_standardize=False)
        elif lag:
            raise ValueError("lag needs a graph")
        nest_map = {n.name: list(n.alt_ids) for n in tree.nests} if tree else {}
        if tree:
            known = {r[0] for r in data.universe.select(data.alt_id).collect()}
            if set(a for ids in nest_map.values() for a in ids) - known:
                raise ValueError("a nest has an unknown alternative")
            if graph is not None and not lag and {a for ids in nest_map.values() for a in ids} != known:
                raise ValueError("with a graph of pairs every alternative is in a nest")
        self.structure = Structure(
            design.names, design.fixed, random, correlated, nest_map, alts, graph, lag, estimator != "reduced", (n_draws or 200) if random else 0, "random" if draw_type == "random" else "halton", seed,
            bool(panel and random), {n.name: n.alpha for n in tree.nests if n.alpha is not None} if tree else {},
        )
        self._objective, self._result, self._raw = Objective(self._arrays, self.structure), None, None
        if not data.has_chosen:
            raise ValueError("the table has no choices")

    # ---- estimation
    model_type = property(lambda self: " ".join(filter(None, ["Correlated" if self.structure.correlated else "", "Mixed" if self.structure.random else "", "SAR" if self.structure.lag else "SCL" if self.structure.graph is not None else "", "Nested" if self.structure.nests else "", "Logit" if self.structure.random or self.structure.nests or self.structure.graph is not None else "Multinomial Logit"])))

    def _start(self) -> tuple[np.ndarray, list, np.ndarray]:
        s, d = self.structure, self._arrays.design
        x0, bounds, fixed = np.zeros(len(s.param_names)), [(-np.inf, np.inf)] * len(s.param_names), np.zeros(len(s.param_names), bool)
        for i, n in enumerate(s.param_names):
            if n in s.beta_names:
                x0[i] = s.fixed.get(n, d.initial.get(n, 0.0))
                fixed[i] = n in s.fixed
                bounds[i] = d.bounds.get(n, bounds[i])
            elif n.startswith("lambda_"):
                x0[i] = s.lam_start.get(n[7:], 0.0)
            elif n.startswith(("sd_", "chol_")) and s.kinds[i] == "softplus":
                x0[i] = 0.1
        return x0, bounds, fixed

    def fit(self) -> FitResult:
        s = self.structure
        if self.estimator == "linearized_gmm":
            return self._gmm()
        x0, bounds, fixed = self._start()
        if s.lag and self.warmstart and not s.nests and not s.random:
            try:
                gmm = self._gmm_estimates()[0]
                if abs(gmm[-1]) < 0.95:
                    x0[s.param_names.index("rho")] = np.arctanh(gmm[-1])
            except np.linalg.LinAlgError:
                pass
        limits = any(np.isfinite(b).any() for b in bounds)
        name = ("newton" if self._objective.plain and not limits else "lbfgs") if self.solver == "auto" else self.solver
        found = get_solver(name, **self.solver_options).solve(self._objective, x0, s.param_names, bounds if limits else None, fixed)
        if not found.converged:
            warnings.warn(f"the solver did not converge: {found.message}", RuntimeWarning, stacklevel=2)
        self._raw, self._free = found.coefficients, ~fixed
        self._result = self._finish(found)
        return self._result

    def _finish(self, found) -> FitResult:
        s, raw = self.structure, found.coefficients
        self._hessian = self._objective.hessian(raw)
        cov = self._display(self._inverse_information())
        stats = self._counts()
        return FitResult.of(s.param_names, s.natural(raw), cov, found.log_likelihood, stats["null"], stats["n"], int(self._free.sum()), n_alts=self._arrays.n_alts, converged=found.converged, n_iterations=found.n_iterations, message=found.message, spec=self.spec or self.formula, model_type=self.model_type, solver_name=found.solver_name)

    def _counts(self) -> dict:
        r = self._objective.data.select(F.size(F.filter("av", lambda a: a)).alias("k")).agg(F.count("*").alias("n"), F.sum(-F.log("k")).alias("null")).first()
        return {"n": r["n"], "null": r["null"]}

    def null_log_likelihood(self) -> float:
        """- sum of ln (available alternatives); neither weights nor sampling count."""
        return self._counts()["null"]

    def _inverse_information(self) -> np.ndarray:
        free, out = self._free, np.zeros((len(self._raw),) * 2)
        info = -self._hessian[np.ix_(free, free)]
        if (np.linalg.eigvalsh((info + info.T) / 2) <= 0).any():
            warnings.warn("the information matrix is not positive definite", RuntimeWarning, stacklevel=3)
        out[np.ix_(free, free)] = safe_inverse(info)
        return out

    def _display(self, cov: np.ndarray) -> np.ndarray:
        slope = np.array([float(_TRANSFORM[k].slope(x)) for k, x in zip(self.structure.kinds, self._raw, strict=True)])
        return cov * np.outer(slope, slope)

    # ---- spatial lag: moments linearised at rho = 0
    def _gmm_estimates(self) -> tuple[np.ndarray, np.ndarray, float, int]:
        s = self.structure
        if not s.lag or s.nests or s.random:
            raise ValueError("linearised moments are for the spatial-lag multinomial logit")
        plain = Objective(self._arrays, Structure(s.names, s.fixed))
        start = get_solver("newton").solve(plain, np.zeros(len(s.names)))
        beta, w, k = start.coefficients, np.asarray(s.graph), len(s.names)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((2 * k + k + 2, 2 * k + k + 2)), 0
            for b in blocks(parts, k, False):
                s.check(b)
                v = b.x @ beta
                p = np.where(b.av, np.exp(v - lse(v, b.av)[:, None]), 0)
                y = (np.arange(p.shape[1]) == b.chosen[:, None]).astype(float)
                centre = lambda a, p=p: p[..., None] * (a - np.einsum("nj,njk->nk", p, a)[:, None, :])
                wx = np.einsum("jl,nlk->njk", w, b.x)
                g = np.concatenate([centre(b.x), centre((v @ w.T)[..., None])], axis=2)
                z = np.concatenate([b.x, wx], axis=2)
                all_ = np.concatenate([z, g, ((y - p) + np.einsum("njk,k->nj", g[..., :k], beta))[..., None]], axis=2).reshape(-1, 3 * k + 2)
                total += all_.T @ all_
                n += len(all_)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["sums", "n"])

        rows = self._objective.data.mapInArrow(run, "sums binary, n long").collect()
        gram = sum(np.frombuffer(r["sums"]).reshape(3 * k + 2, -1) for r in rows)
        n = sum(r["n"] for r in rows)
        zz, zg, zu, uu, gg, gu = gram[: 2 * k, : 2 * k], gram[: 2 * k, 2 * k : -1], gram[: 2 * k, -1], gram[-1, -1], gram[2 * k : -1, 2 * k : -1], gram[2 * k : -1, -1]
        keep = _independent(zz)
        zz, zg, zu = zz[np.ix_(keep, keep)], zg[keep], zu[keep]
        projected = zg.T @ np.linalg.solve(zz, zg)
        estimate = np.linalg.solve(projected, zg.T @ np.linalg.solve(zz, zu))
        rss = uu - 2 * estimate @ gu + estimate @ gg @ estimate
        return estimate, np.linalg.inv(projected) * rss / max(1, n - len(estimate)), start.log_likelihood, n

    def _gmm(self) -> FitResult:
        s = self.structure
        estimate, cov, _, _ = self._gmm_estimates()
        rho = float(np.clip(estimate[-1], -0.999, 0.999))
        self._raw, self._free = np.array([*estimate[:-1], np.arctanh(rho)]), np.ones(len(estimate), bool)
        ll = self._objective.evaluate([self._raw])[0]["ll"]
        stats = self._counts()
        self._hessian = None
        self._result = FitResult.of(s.param_names, np.array([*estimate[:-1], rho]), cov, ll, stats["null"], stats["n"], len(estimate), n_alts=self._arrays.n_alts, model_type="SAR Multinomial Logit (GMM)", solver_name="linearized_gmm", message="two-stage least squares")
        return self._result

    # ---- inference
    @property
    def result(self) -> FitResult:
        if self._result is None:
            raise RuntimeError("fit the model first")
        return self._result

    def _meat(self) -> np.ndarray:
        return self._objective.evaluate([self._raw], gradient=True, meat=True)[0]["matrix"] if not self._objective.plain else self._outer()

    def _outer(self, cluster: str | None = None) -> np.ndarray:
        s = self.observation_scores()
        names = [c for c in s.columns if c.startswith("s_")]
        if cluster:
            link = self.data.df.select(F.col(self.data.obs_id).alias("obs"), F.col(cluster).alias("cluster")).distinct()
            s = s.join(link, "obs").groupBy("cluster").agg(*(F.sum(c).alias(c) for c in names))
        sums = s.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i)).first()
        k = len(names)
        out = np.array([[sums[f"{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        if cluster:
            out *= sums["n"] / max(1, sums["n"] - 1)
        return out

    def observation_scores(self) -> DataFrame:
        """(obs, s_0, s_1, ...) on the raw scale, weighted; one row a person in a mixed panel."""
        structure, raw, k, panel = self.structure, self._raw, self._arrays.n_params, self.structure.panel

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(parts, k, panel):
                s = scores(structure, b, raw)
                ids, w = b.obs, b.w
                if panel:
                    uniq, where = np.unique([str(p) for p in b.person], return_inverse=True)
                    ids, w = np.array([b.obs[np.flatnonzero(where == i)[0]] for i in range(len(uniq))], dtype=object), np.array([w[where == i].max() for i in range(len(uniq))])
                yield pa.RecordBatch.from_arrays([pa.array(list(ids), kind), *(pa.array(c) for c in (s * w[:, None]).T)], names=["obs", *(f"s_{i}" for i in range(len(raw)))])

        kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16()}[self._arrays.obs_type]
        return self._objective.data.mapInArrow(run, ", ".join([f"obs {self._arrays.obs_type}", *(f"s_{i} double" for i in range(len(raw)))]))

    def robust_covariance(self) -> np.ndarray:
        bread = self._inverse_information()
        return self._display(bread @ self._outer() @ bread)

    def clustered_covariance(self, cluster: str) -> np.ndarray:
        """Clusters by a column that does not vary within an observation, nor within a person of a panel."""
        if not self.data.df.groupBy(self.data.obs_id).agg(F.countDistinct(cluster).alias("k")).filter("k > 1").limit(1).isEmpty():
            raise ValueError("clusters vary within an observation")
        bread = self._inverse_information()
        return self._display(bread @ self._outer(cluster) @ bread)

    def robust_standard_errors(self) -> pd.Series:
        return pd.Series(np.sqrt(np.diag(self.robust_covariance())), index=self.structure.param_names)

    def clustered_standard_errors(self, cluster: str) -> pd.Series:
        return pd.Series(np.sqrt(np.diag(self.clustered_covariance(cluster))), index=self.structure.param_names)

    def random_parameter_covariance(self) -> pd.DataFrame:
        s = self.structure
        parts, k = s.split(self.result.coefficients.values), len(s.random_names)
        low = np.zeros((k, k))
        if s.correlated:
            for (a, b), v in zip(s.lower, parts["spread"], strict=True):
                low[a, b] = v
        else:
            low = np.diag(parts["spread"])
        return pd.DataFrame(low @ low.T, index=s.random_names, columns=s.random_names)

    # ---- prediction
    def _display_vector(self, beta) -> np.ndarray:
        return self.result.coefficients.values if beta is None else np.asarray(beta, float)

    def probabilities(self, data=None, beta=None, available: str | None = None) -> DataFrame:
        """(obs, alt, probability): beta is a full vector on the display scale; available, one more availability column."""
        theta = self._display_vector(beta)
        arrays = self._arrays if data is None and available is None else pack(data or self.data, self.formula, self.spec, None, available, self.panel)
        return self._evaluated(self._objective.data if arrays is self._arrays else arrays.df, arrays, theta)

    def _evaluated(self, frame: DataFrame, arrays, theta: np.ndarray) -> DataFrame:
        """(obs, alt, probability) of packed observations; obs may be a struct that holds more than the id."""
        structure, k, obs = self.structure, arrays.n_params, frame.schema["obs"].dataType

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(parts, k, False):
                structure.check(b)
                p = np.where(b.av, np.exp(structure.log_probabilities(b, theta)), 0)
                rows = [r[:n] for r, n in zip(p, b.size, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(b.obs), kinds[0]), pa.array(b.alt, pa.list_(kinds[1])), pa.array(rows, pa.list_(pa.float64()))], names=["obs", "alts", "ps"])

        kinds = to_arrow_type(obs), to_arrow_type(frame.schema["alt"].dataType.elementType)
        out = frame.mapInArrow(run, f"obs {obs.simpleString()}, alts array<{arrays.alt_type}>, ps array<double>")
        return out.select("obs", F.explode(F.arrays_zip("alts", "ps")).alias("z"), ).select("obs", F.col("z.alts").alias("alt"), F.col("z.ps").alias("probability"))

    def predict(self, data=None) -> DataFrame:
        """(obs, alt): the likeliest alternative, the smallest id among equals."""
        return self.probabilities(data).groupBy("obs").agg(F.max_by("alt", F.struct("probability", -F.hash("alt"))).alias("alt"))

    def utilities(self, data=None, beta=None) -> DataFrame:
        """(obs, alt, utility): X beta + ln pi, coefficients by name, means for random ones, no spatial filter."""
        s, theta, table = self.structure, self._display_vector(beta), data or self.data
        value = dict(zip(s.param_names, theta, strict=True))
        from .spec import design_of

        v = F.log(F.greatest("pi", F.lit(1e-300)))
        for n, c in design_of(table, self.formula, self.spec).columns.items():
            v = v + F.lit(float(value[n] if n in value else value[f"mean_{n}"])) * c
        return table.df.select(F.col(table.obs_id).alias("obs"), F.col(table.alt_id).alias("alt"), v.alias("utility"))

    def simulate(self, data=None, n_draws: int = 1, seed: int = 0, capacity: dict | DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
        """(draw, obs, alt, probability[, round]): independent choices, or with capacity a lottery in rounds, whose
        probabilities are the model's among the alternatives that are still open."""
        p, s = self.probabilities(data), self.structure
        if capacity is None:
            return M.simulate(p, n_draws, seed)
        if not (s.nests or s.random or s.graph is not None):  # shares among open alternatives keep their proportions
            return M.capacity_lottery(p, capacity, n_draws, seed, max_rounds)
        arrays = self._arrays if data is None else pack(data, self.formula, self.spec, None, None, self.panel)
        theta = self._display_vector(None)

        def among_open(people: DataFrame, closed: DataFrame) -> DataFrame:
            open_ = F.zip_with("av", "alt", lambda v, a: v & ~F.coalesce(F.array_contains("closed", a), F.lit(False)))
            rows = people.join(arrays.df, "obs").join(closed, "draw", "left").withColumn("av", open_)
            out = self._evaluated(rows.withColumn("obs", F.struct("draw", "obs")).drop("draw", "closed"), arrays, theta)
            return out.select("obs.draw", F.col("obs.obs").alias("obs"), "alt", "probability")

        return M.capacity_lottery(p, capacity, n_draws, seed, max_rounds, among_open)

    # ---- effects
    def _effect_frame(self, variable: str, data=None) -> tuple[DataFrame, float]:
        s = self.structure
        if variable not in s.names:
            raise KeyError(f"not in the model: {variable}")
        if s.graph is not None or (s.random and s.nests):
            raise NotImplementedError("effects of spatial and mixed nested models: see spatial_effects and probabilities")
        table, theta = data or self.data, dict(zip(s.param_names, self.result.coefficients.values, strict=True))
        x = table.df.select(F.col(table.obs_id).alias("obs"), F.col(table.alt_id).alias("alt"), self._arrays.design.columns[variable].alias("x"))
        return self.probabilities(data).join(x, ["obs", "alt"]), theta

    def _simulated(self, variable: str) -> DataFrame:
        """(obs, alt, own, p): own is dP_j / dx_j of a mixed model."""
        s, theta, k = self.structure, self.result.coefficients.values, self._arrays.n_params

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = s.names.index(variable)
            for b in blocks(parts, k, False):
                own = np.zeros(b.av.shape)
                p = np.where(b.av, np.exp(s.log_probabilities(b, theta)), 0)
                for j in range(b.av.shape[1]):
                    bumped = b.x.astype(complex)
                    bumped[:, j, at] += 1j * 1e-30
                    shifted = type(b)(b.obs, b.person, b.w, b.chosen, b.av, b.lnpi, bumped, b.alt, b.size)
                    own[:, j] = np.where(b.av[:, j], np.exp(s.log_probabilities(shifted, theta)[:, j]).imag / 1e-30, 0)
                cut = lambda a, b=b: pa.array([r[:n] for r, n in zip(a, b.size, strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(b.obs), kinds[0]), pa.array(b.alt, pa.list_(kinds[1])), cut(own), cut(p)], names=["obs", "alts", "own", "p"])

        types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        kinds = types[self._arrays.obs_type], types[self._arrays.alt_type]
        out = self._objective.data.mapInArrow(run, f"obs {self._arrays.obs_type}, alts array<{self._arrays.alt_type}>, own array<double>, p array<double>")
        return out.select("obs", F.explode(F.arrays_zip("alts", "own", "p")).alias("z")).select("obs", F.col("z.alts").alias("alt"), F.col("z.own").alias("own"), F.col("z.p").alias("probability"))

    def marginal_effect(self, variable: str, data=None) -> DataFrame:
        """(obs, alt, effect): d ln P_i / d x_i, a semi-elasticity."""
        frame, theta = self._effect_frame(variable, data)
        if self.structure.random:
            return self._simulated(variable).select("obs", "alt", F.when(F.col("probability") > 0, F.col("own") / F.col("probability")).alias("effect"))
        return E.own_effect(frame, theta[variable], self._nest_lambda(frame.sparkSession, theta)).select("obs", "alt", "effect")

    def cross_marginal_effect(self, variable: str, data=None, within_nest: bool = True) -> DataFrame:
        """(obs, alt, effect): d ln P_j / d x_i for another alternative j, of the same nest or not."""
        frame, theta = self._effect_frame(variable, data)
        if self.structure.random:
            return self._simulated(variable).select("obs", "alt", F.when(F.col("probability") < 1, -F.col("own") / (1 - F.col("probability"))).alias("effect"))
        return E.cross_effect(frame, theta[variable], self._nest_lambda(frame.sparkSession, theta) if within_nest else None).select("obs", "alt", "effect")

    def _nest_lambda(self, spark, theta) -> DataFrame | None:
        s = self.structure
        if not s.nests:
            return None
        rows = [(a, m, float(theta[f"lambda_{m}"])) for m, ids in s.nests.items() for a in ids]
        return spark.createDataFrame(rows, f"alt {self._arrays.alt_type}, nest string, lambda double")

    def elasticity(self, variable: str, data=None) -> DataFrame:
        frame, _ = self._effect_frame(variable, data)
        return frame.join(self.marginal_effect(variable, data), ["obs", "alt"]).select("obs", "alt", (F.col("effect") * F.col("x")).alias("effect"))

    def cross_elasticity(self, variable: str, data=None, within_nest: bool = True) -> DataFrame:
        frame, _ = self._effect_frame(variable, data)
        return frame.join(self.cross_marginal_effect(variable, data, within_nest), ["obs", "alt"]).select("obs", "alt", (F.col("effect") * F.col("x")).alias("effect"))

    def average_marginal_effect(self, variable: str, by: str = "overall", data=None) -> DataFrame:
        return E.average(self.marginal_effect(variable, data), by)

    def average_cross_marginal_effect(self, variable: str, by: str = "overall", data=None) -> DataFrame:
        return E.average(self.cross_marginal_effect(variable, data), by)

    def average_elasticity(self, variable: str, by: str = "overall", data=None) -> DataFrame:
        return E.average(self.elasticity(variable, data), by)

    def spatial_impacts(self, variable: str, max_order: int = 4, n_sources: int | None = None, seed: int = 0) -> dict:
        """Of the spatial-lag multinomial logit: average direct and indirect effect on probabilities of a unit change of the
        variable at a source, the indirect one by hops from the source, and the share beyond neighbours; and per alternative."""
        s = self.structure
        if not s.lag or s.random or s.nests:
            raise NotImplementedError("impacts are those of the spatial-lag multinomial logit")
        theta = self.result.coefficients
        t, k, all_ = s.filter(theta["rho"]).real, self._arrays.n_params, s.alts
        raw = theta.values

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, outer, n = np.zeros(len(all_)), np.zeros((len(all_), len(all_))), 0
            for b in blocks(parts, k, False):
                p = np.where(b.av, np.exp(s.log_probabilities(b, raw)), 0)
                mean, outer, n = mean + p.sum(axis=0), outer + p.T @ p, n + len(p)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([mean, outer.ravel()]).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["s", "n"])

        rows = self._objective.data.mapInArrow(run, "s binary, n long").collect()
        total, n = sum(np.frombuffer(r["s"]) for r in rows), sum(r["n"] for r in rows)
        mean, outer = total[: len(all_)] / n, total[len(all_) :].reshape(len(all_), -1) / n
        effect = theta[variable] * (mean[:, None] * t - outer @ t)  # dP_j / dx_l
        sources = np.arange(len(all_)) if not n_sources or n_sources >= len(all_) else np.sort(np.random.default_rng(seed).choice(len(all_), n_sources, replace=False))
        linked = np.asarray(s.graph) > 0
        profile, weights = np.zeros(max_order + 1), []
        for l in sources:
            hop, seen, front = np.full(len(all_), -1), {int(l)}, {int(l)}
            hop[l] = 0
            for h in range(1, len(all_)):
                front = {int(x) for f in front for x in np.flatnonzero(linked[:, f] | linked[f])} - seen
                if not front:
                    break
                seen |= front
                hop[list(front)] = h
            for h in range(1, max_order + 1):
                profile[h] += effect[hop == h, l].sum() / len(sources)
            weights.append((effect[l, l], effect[:, l].sum() - effect[l, l], effect[(hop > 1) | (hop < 0), l].sum()))
        direct, indirect, beyond = np.mean(weights, axis=0)
        return {"direct": direct, "indirect": indirect, "total": direct + indirect, "profile": {h: profile[h] for h in range(1, max_order + 1)}, "share_beyond_neighbours": beyond / indirect if indirect else 0.0,
                "by_alternative": pd.DataFrame({"alt": [all_[l] for l in sources], "direct": [w[0] for w in weights], "indirect": [w[1] for w in weights], "total": [w[0] + w[1] for w in weights]})}


def _independent(gram: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Columns that are not combinations of those before, by the Cholesky factor of their Gram matrix."""
    keep: list[int] = []
    for i in range(len(gram)):
        if gram[i, i] <= 0:
            continue
        rest = gram[i, i]
        if keep:
            rest -= gram[i, keep] @ np.linalg.solve(gram[np.ix_(keep, keep)], gram[keep, i])
        if rest > tolerance * gram[i, i]:
            keep.append(i)
    return keep
