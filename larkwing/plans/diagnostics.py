"""Specification tests on fitted models."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions.stats import chi2_ppf, chi2_sf
from ..operators.graph import resolve_spatial_weights
from .kernels import Structure, lse
from .objective import blocks
from .results import FitResult


@dataclass(frozen=True)
class TestResult:
    statistic: float
    df: int
    name: str = "test"
    psd_warning: bool = False

    __test__ = False
    p_value = property(lambda self: chi2_sf(self.statistic, self.df))
    critical_value_05 = property(lambda self: chi2_ppf(0.95, self.df))
    significant_at_05 = property(lambda self: self.p_value < 0.05)

    def summary(self) -> str:
        return f"{self.name}: chi2({self.df}) = {self.statistic:.4f}, p = {self.p_value:.4f}"


class LikelihoodRatioTest(TestResult):
    pass


class WaldTest(TestResult):
    pass


class HausmanTest(TestResult):
    pass


class SpatialDiagnostic(TestResult):
    pass


def lr_test(restricted: FitResult, unrestricted: FitResult, df: int | None = None) -> LikelihoodRatioTest:
    return LikelihoodRatioTest(max(0.0, 2 * (unrestricted.log_likelihood - restricted.log_likelihood)), df or unrestricted.n_parameters - restricted.n_parameters, "Likelihood ratio")


def wald_test(coefficients, vcov, restrictions) -> WaldTest:
    """R b = 0."""
    b, v, r = np.asarray(coefficients, float), np.asarray(vcov, float), np.atleast_2d(np.asarray(restrictions, float))
    if r.shape[1] != len(b) or v.shape != (len(b), len(b)):
        raise ValueError("shapes of coefficients, covariance and restrictions do not fit")
    return WaldTest(float(r @ b @ np.linalg.solve(r @ v @ r.T, r @ b)), int(np.linalg.matrix_rank(r)), "Wald")


def hausman_test(efficient: FitResult, consistent: FitResult, params: list[str] | None = None, tol: float = 1e-10) -> HausmanTest:
    """On shared parameters; the difference of covariances is inverted on its positive eigenvalues, whose number is df."""
    params = params or [p for p in efficient.coefficients.index if p in consistent.coefficients.index]
    if not params:
        raise ValueError("no shared parameters")
    pick = lambda r: (r.coefficients[params].values, r._parameter_covariance(*params))
    (b0, v0), (b1, v1) = pick(efficient), pick(consistent)
    values, vectors = np.linalg.eigh(v1 - v0)
    keep = values > tol * max(1e-300, np.abs(values).max())
    z = vectors[:, keep].T @ (b1 - b0)
    return HausmanTest(float((z**2 / values[keep]).sum()), int(keep.sum()), "Hausman", bool((values < -tol * np.abs(values).max()).any()))


def _spatial(model, graph, sums) -> list[np.ndarray]:
    """Totals of sums(block, v, p, y, w) over the data of a fitted multinomial logit."""
    s = model.structure
    if s.random or s.nests or s.graph is not None:
        raise ValueError("the test is for a multinomial logit")
    alts = [r[0] for r in model.data.universe.select(model.data.alt_id).orderBy(model.data.alt_id).collect()]
    w = resolve_spatial_weights(graph, alts)
    check, beta, k = Structure(s.names, alts=alts, graph=w, lag=True), model.result.coefficients.values, len(s.names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in blocks(parts, k, False):
            check.check(b)
            v = b.x @ beta
            p = np.where(b.av, np.exp(v - lse(v, b.av)[:, None]), 0)
            y = (np.arange(p.shape[1]) == b.chosen[:, None]).astype(float)
            now = [np.asarray(x, float) for x in sums(b, v, p, y, w)]
            total = now if total is None else [a + c for a, c in zip(total, now, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in total]).tobytes()] if total else [], pa.binary())], names=["s"])

    rows = [np.frombuffer(r["s"]) for r in model._objective.data.mapInArrow(run, "s binary").collect()]
    return [k, np.sum(rows, axis=0)]


def _moments(p, a, x):
    """I_aa, I_ab, I_bb of the scores of an added variable a and the design x under multinomial covariance."""
    ma, mx = (p * a).sum(axis=1), np.einsum("nj,njk->nk", p, x)
    return (p * a * a).sum() - (ma**2).sum(), np.einsum("nj,nj,njk->k", p, a, x) - ma @ mx, np.einsum("nj,njk,njl->kl", p, x, x) - mx.T @ mx


def lm_lag_test(model, graph) -> SpatialDiagnostic:
    """Score test of a spatial lag of utilities."""
    def sums(b, v, p, y, w):
        a = v @ w.T
        return [((y - p) * a).sum(), *_moments(p, a, b.x)]

    k, total = _spatial(model, graph, sums)
    score, aa, ab, bb = total[0], total[1], total[2 : 2 + k], total[2 + k :].reshape(k, k)
    return SpatialDiagnostic(float(score**2 / (aa - ab @ np.linalg.solve(bb, ab))), 1, "LM lag")


def lm_error_test(model, graph) -> SpatialDiagnostic:
    """Test of spatial correlation of residuals: e'We centred by its mean, with the variance of the quadratic form under the
    multinomial null, less what estimating beta takes."""
    def sums(b, v, p, y, w):
        sym = (w + w.T) / 2
        e = y - p
        quad = np.einsum("nj,jl,nl->n", e, sym, e)
        # e = 1_c - p: the form is W_cc - 2 (Wp)_c + p'Wp, a function of the choice c
        wp = p @ sym
        pwp = (p * wp).sum(axis=1)
        q = np.diag(sym)[None, :] - 2 * wp + pwp[:, None]
        mean = (p * q).sum(axis=1)
        var = (p * q * q).sum(axis=1) - mean**2
        mx = np.einsum("nj,njk->nk", p, b.x)
        cross = np.einsum("nj,nj,njk->k", p, q, b.x) - mean @ mx
        bb = np.einsum("nj,njk,njl->kl", p, b.x, b.x) - mx.T @ mx
        return [(quad - mean).sum(), var.sum(), cross, bb]

    k, total = _spatial(model, graph, sums)
    score, var, cross, bb = total[0], total[1], total[2 : 2 + k], total[2 + k :].reshape(k, k)
    left = var - cross @ np.linalg.solve(bb, cross)
    return SpatialDiagnostic(float(score**2 / left) if left > 0 else math.nan, 1, "LM error")


def iia_test(model, subset: list) -> HausmanTest:
    """Refits the model on the observations that chose from a subset of alternatives, and compares by Hausman's test."""
    from .model import ChoiceModel

    full = model.result
    restricted = ChoiceModel(model.data.restrict(subset), model.formula, model.spec, weights=model.weights, availability=model.availability, solver=model.solver).fit()
    return hausman_test(full, restricted)
