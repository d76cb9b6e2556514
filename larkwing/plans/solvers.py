"""Optimisers on the driver: each evaluation of the objective is one Spark job, so few and well-chosen points matter."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np


@dataclass
class SolverResult:
    coefficients: np.ndarray
    log_likelihood: float
    n_iterations: int
    converged: bool
    message: str
    solver_name: str
    hessian: np.ndarray | None = None
    raw: dict = field(default_factory=dict)


class Solver(Protocol):
    def solve(self, objective, x0: np.ndarray, param_names: list[str], bounds: list[tuple[float, float]] | None, fixed_mask: np.ndarray | None) -> SolverResult: ...


def _prepare(x0, bounds, fixed_mask):
    low = np.array([b[0] for b in bounds] if bounds else [-np.inf] * len(x0))
    high = np.array([b[1] for b in bounds] if bounds else [np.inf] * len(x0))
    free = np.ones(len(x0), bool) if fixed_mask is None else ~np.asarray(fixed_mask)
    return np.clip(np.asarray(x0, float), low, high), low, high, free


def _active(x, g, low, high, free):
    """Free coordinates that do not push against a bound; g is the log likelihood's gradient."""
    return free & ~((x <= low) & (g < 0)) & ~((x >= high) & (g > 0))


class BFGS:
    """Projected BFGS, the first step tried with its gradient in one job, shorter ones together in another."""

    def __init__(self, maxiter: int = 1000, ftol: float = 1e-10, gtol: float = 1e-6, name: str = "lbfgs"):
        self.maxiter, self.ftol, self.gtol, self.name = maxiter, ftol, gtol, name

    def solve(self, objective, x0, param_names=None, bounds=None, fixed_mask=None) -> SolverResult:
        x, low, high, free = _prepare(x0, bounds, fixed_mask)
        f, g = objective.value_gradient(x)
        inverse, n = np.eye(len(x)) / max(1.0, np.abs(g).max()), 0
        for n in range(1, self.maxiter + 1):
            act = _active(x, g, low, high, free)
            if np.abs(g[act]).max(initial=0) < self.gtol * max(1.0, abs(f) / 1000):
                return SolverResult(x, f, n - 1, True, "gradient is small", self.name)
            step = np.zeros(len(x))
            step[act] = inverse[np.ix_(act, act)] @ g[act]
            if step @ g <= 0:
                inverse = np.eye(len(x)) / max(1.0, np.abs(g).max())
                step = np.where(act, inverse @ g, 0)
            new = np.clip(x + step, low, high)
            f_new, g_new = objective.value_gradient(new)
            if not (np.isfinite(f_new) and f_new >= f + 1e-4 * g @ (new - x)):
                shorter = [np.clip(x + step * s, low, high) for s in (0.5, 0.2, 0.05, 0.01, 1e-3, 1e-5)]
                values = [r["ll"] for r in objective.evaluate(shorter)]
                best = int(np.nanargmax(values))
                if not values[best] > f:
                    good = np.abs(g[act]).max(initial=0) < 1e-3 * max(1.0, abs(f) / 1000)
                    return SolverResult(x, f, n, bool(good), "no step improves the likelihood", self.name)
                new = shorter[best]
                f_new, g_new = objective.value_gradient(new)
            s, y = new - x, g - g_new
            if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                if n == 1:
                    inverse = np.eye(len(x)) * (s @ y) / (y @ y)
                rho = 1 / (s @ y)
                left = np.eye(len(x)) - rho * np.outer(s, y)
                inverse = left @ inverse @ left.T + rho * np.outer(s, s)
            small = abs(f_new - f) <= self.ftol * max(1.0, abs(f))
            x, f, g = new, f_new, g_new
            if small and np.abs(g[_active(x, g, low, high, free)]).max(initial=0) < 1e-4 * max(1.0, abs(f) / 1000):
                return SolverResult(x, f, n, True, "likelihood does not change", self.name)
        return SolverResult(x, f, n, False, "iteration limit", self.name)


class TrustNewton:
    """Newton steps in a trust region by the eigenvalues of the Hessian; bounds are not supported."""

    def __init__(self, maxiter: int = 200, gtol: float = 1e-6, name: str = "trust-ncg"):
        self.maxiter, self.gtol, self.name = maxiter, gtol, name

    def solve(self, objective, x0, param_names=None, bounds=None, fixed_mask=None) -> SolverResult:
        if bounds and any(b not in ((-np.inf, np.inf), (-1e6, 1e6), (None, None)) for b in map(tuple, bounds)):
            raise ValueError(f"{self.name} does not support bounds")
        x, *_, free = _prepare(x0, None, fixed_mask)
        radius, (f, g), h = 10.0, objective.value_gradient(x), None
        for n in range(1, self.maxiter + 1):
            if np.abs(g[free]).max(initial=0) < self.gtol * max(1.0, abs(f) / 1000):
                return SolverResult(x, f, n - 1, True, "gradient is small", self.name, h)
            h = objective.hessian(x) if h is None else h
            values, vectors = np.linalg.eigh(-h[np.ix_(free, free)])
            to = vectors.T @ g[free]
            shift = max(0.0, 1e-8 - values.min())
            step = vectors @ (to / (values + shift))
            while np.linalg.norm(step) > radius:
                shift = max(2 * shift, 1e-6 * max(1.0, abs(values).max()))
                step = vectors @ (to / (values + shift))
            move = np.zeros(len(x))
            move[free] = step
            f_new, g_new = objective.value_gradient(x + move)
            gain = f_new - f
            expected = g @ move + 0.5 * move @ h @ move
            if np.isfinite(f_new) and gain >= 1e-4 * expected:
                x, f, g, h = x + move, f_new, g_new, None
                radius *= 2
            elif abs(gain) <= 1e-12 * max(1.0, abs(f)):
                return SolverResult(x, f, n, True, "likelihood does not change", self.name, h)
            else:
                radius = 0.25 * np.linalg.norm(move)
        return SolverResult(x, f, self.maxiter, False, "iteration limit", self.name, h)


class FirstOrder:
    """adam, adamw, rmsprop and adabelief with bounds by projection; converged only if the gradient is small."""

    def __init__(self, kind: str = "adam", maxiter: int = 500, rate: float = 0.05, gtol: float = 1e-3, decay: float = 0.0):
        self.kind, self.maxiter, self.rate, self.gtol, self.decay, self.name = kind, maxiter, rate, gtol, decay, kind

    def solve(self, objective, x0, param_names=None, bounds=None, fixed_mask=None) -> SolverResult:
        x, low, high, free = _prepare(x0, bounds, fixed_mask)
        m, v, best = np.zeros(len(x)), np.zeros(len(x)), (-np.inf, x)
        for n in range(1, self.maxiter + 1):
            f, g = objective.value_gradient(x)
            if f > best[0]:
                best = (f, x)
            if np.abs(g[_active(x, g, low, high, free)]).max(initial=0) < self.gtol * max(1.0, abs(f) / 1000):
                return SolverResult(x, f, n, True, "gradient is small", self.name)
            scaled = g / max(1.0, abs(f))
            m = 0.9 * m + 0.1 * scaled
            square = (scaled - m) ** 2 + 1e-16 if self.kind == "adabelief" else scaled**2
            v = (0.9 if self.kind == "rmsprop" else 0.999) * v + (0.1 if self.kind == "rmsprop" else 0.001) * square
            up, scale = (scaled, v) if self.kind == "rmsprop" else (m / (1 - 0.9**n), v / (1 - 0.999**n))
            x = np.clip(x + np.where(free, self.rate * (up / (np.sqrt(scale) + 1e-8) - (self.decay * x if self.kind == "adamw" else 0)), 0), low, high)
        return SolverResult(best[1], best[0], self.maxiter, False, "iteration limit", self.name)


class MultiStart:
    """Random starting points around x0, ranked in one job; the best few are solved."""

    def __init__(self, inner: Solver | None = None, n_starts: int = 8, n_solved: int = 2, spread: float = 0.5, seed: int = 0):
        self.inner, self.n_starts, self.n_solved, self.spread, self.seed, self.name = inner or BFGS(), n_starts, n_solved, spread, seed, "multi-start"

    def solve(self, objective, x0, param_names=None, bounds=None, fixed_mask=None) -> SolverResult:
        x, low, high, free = _prepare(x0, bounds, fixed_mask)
        r = np.random.default_rng(self.seed)
        points = [x] + [np.clip(x + np.where(free, r.normal(0, self.spread, len(x)), 0), low, high) for _ in range(self.n_starts - 1)]
        ranked = sorted(zip([-v["ll"] for v in objective.evaluate(points)], range(len(points)), strict=True))
        found = [self.inner.solve(objective, points[i], param_names, bounds, fixed_mask) for _, i in ranked[: self.n_solved]]
        return max(found, key=lambda s: s.log_likelihood)


_SOLVERS = {
    "lbfgs": BFGS, "bfgs": lambda **k: BFGS(name="bfgs", **k), "optimistix": lambda **k: BFGS(name="optimistix", **k), "newton": lambda **k: TrustNewton(name="newton", **k), "trust-ncg": TrustNewton,
    "trust-krylov": lambda **k: TrustNewton(name="trust-krylov", **k), "adam": FirstOrder, "adamw": lambda **k: FirstOrder("adamw", **k), "rmsprop": lambda **k: FirstOrder("rmsprop", **k),
    "adabelief": lambda **k: FirstOrder("adabelief", **k), "multi-start": MultiStart,
}


def register_solver(name: str, make) -> None:
    _SOLVERS[name] = make


def list_solvers() -> list[str]:
    return sorted(_SOLVERS)


def get_solver(name, **options) -> Solver:
    if not isinstance(name, str):
        return name
    if name not in _SOLVERS:
        raise ValueError(f"unknown solver {name!r}; there are {', '.join(list_solvers())}")
    return _SOLVERS[name](**options)
