"""Estimates, their statistics and tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from ..functions.stats import norm_cdf


def stars(p: float) -> str:
    return "***" if p <= 0.01 else "**" if p <= 0.05 else "*" if p <= 0.1 else ""


@dataclass(frozen=True)
class FitResult:
    coefficients: pd.Series
    std_errors: pd.Series
    t_values: pd.Series
    p_values: pd.Series
    conf_int: pd.DataFrame
    log_likelihood: float
    log_likelihood_null: float
    n_observations: int
    n_parameters: int
    n_alts: int = 0
    aic: float = 0.0
    bic: float = 0.0
    rho_squared: float = 0.0
    rho_bar_squared: float = 0.0
    covariance_matrix: np.ndarray | None = None
    converged: bool = True
    n_iterations: int = 0
    message: str = ""
    spec: object = None
    model_type: str = "Multinomial Logit"
    solver_name: str = ""
    solver_result: dict = field(default_factory=dict)

    @classmethod
    def of(cls, names: list[str], estimates: np.ndarray, covariance: np.ndarray, ll: float, null: float, n: int, free: int, **more) -> FitResult:
        se = np.sqrt(np.where(np.diag(covariance) > 0, np.diag(covariance), np.nan))
        t = estimates / se
        series = lambda v: pd.Series(v, index=names, dtype=float)
        ci = pd.DataFrame({"lower": estimates - 1.959963984540054 * se, "upper": estimates + 1.959963984540054 * se}, index=names)
        return cls(
            series(estimates), series(se), series(t), series(2 * (1 - norm_cdf(np.abs(t)))), ci, ll, null, n, free, aic=2 * free - 2 * ll, bic=free * math.log(max(n, 1)) - 2 * ll,
            rho_squared=1 - ll / null if null else math.nan, rho_bar_squared=1 - (ll - free) / null if null else math.nan, covariance_matrix=covariance, **more,
        )

    def tidy(self) -> pd.DataFrame:
        return pd.DataFrame({"parameter": list(self.coefficients.index), "estimate": self.coefficients.values, "std_error": self.std_errors.values, "t_value": self.t_values.values, "p_value": self.p_values.values, "ci_lower": self.conf_int["lower"].values, "ci_upper": self.conf_int["upper"].values})

    def to_spark(self, spark):
        return spark.createDataFrame(self.tidy())

    def fit_statistics(self) -> pd.DataFrame:
        rows = [("Model", self.model_type), ("Observations", self.n_observations), ("Alternatives", self.n_alts), ("Parameters", self.n_parameters), ("Log-likelihood", self.log_likelihood), ("Null log-likelihood", self.log_likelihood_null), ("AIC", self.aic), ("BIC", self.bic), ("Rho-squared", self.rho_squared), ("Rho-bar-squared", self.rho_bar_squared), ("Converged", self.converged)]
        return pd.DataFrame(rows, columns=["statistic", "value"])

    def _parameter_covariance(self, *names: str) -> np.ndarray:
        at = [list(self.coefficients.index).index(n) for n in names]
        return self.covariance_matrix[np.ix_(at, at)]

    def wtp(self, numerator: str | list[str], denominator: str = "cost") -> pd.DataFrame:
        """-b_n / b_d with delta-method standard errors."""
        out = []
        for name in [numerator] if isinstance(numerator, str) else numerator:
            b, d = self.coefficients[name], self.coefficients[denominator]
            slope = np.array([-1 / d, b / d**2])
            se = math.sqrt(max(0.0, slope @ self._parameter_covariance(name, denominator) @ slope))
            value = -b / d
            out.append((name, denominator, value, se, value / se if se else math.nan, value - 1.959963984540054 * se, value + 1.959963984540054 * se))
        return pd.DataFrame(out, columns=["numerator", "denominator", "wtp", "std_error", "t_value", "ci_lower", "ci_upper"])

    vot = wtp

    def to_dict(self) -> dict:
        plain = lambda s: {k: float(v) for k, v in s.items()}
        return {"coefficients": plain(self.coefficients), "std_errors": plain(self.std_errors), "t_values": plain(self.t_values), "p_values": plain(self.p_values), "log_likelihood": self.log_likelihood, "log_likelihood_null": self.log_likelihood_null, "n_observations": self.n_observations, "n_parameters": self.n_parameters, "n_alts": self.n_alts, "aic": self.aic, "bic": self.bic, "rho_squared": self.rho_squared, "rho_bar_squared": self.rho_bar_squared, "converged": self.converged, "n_iterations": self.n_iterations, "message": self.message, "model_type": self.model_type, "solver_name": self.solver_name}

    def summary(self, format: str = "text") -> str:
        return format_coefficient_table(self, format) + ("\n\n" if format == "text" else "\n") + format_fit_statistics(self, format)

    def to_latex(self) -> str:
        return self.summary("latex")

    def to_html(self) -> str:
        return self.summary("html")


def _render(table: list[list[str]], format: str) -> str:
    if format == "text":
        widths = [max(len(r[i]) for r in table) for i in range(len(table[0]))]
        line = "-" * (sum(widths) + 2 * (len(widths) - 1))
        rows = ["  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, widths, strict=True))) for r in table]
        return "\n".join([rows[0], line, *rows[1:]])
    if format == "html":
        import html

        cells = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in r) + "</tr>"
        return "<table>" + cells(table[0], "th") + "".join(cells(r, "td") for r in table[1:]) + "</table>"
    if format == "latex":
        escape = lambda c: c.replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")
        body = [" & ".join(map(escape, r)) + r" \\" for r in table]
        return "\n".join([r"\begin{tabular}{l" + "r" * (len(table[0]) - 1) + "}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}"])
    raise ValueError(f"unknown format {format!r}; text, html or latex")


def format_coefficient_table(result: FitResult, format: str = "text") -> str:
    rows = [[n, f"{result.coefficients[n]:.4f}{stars(result.p_values[n])}", f"{result.std_errors[n]:.4f}", f"{result.t_values[n]:.3f}", f"{result.p_values[n]:.4f}"] for n in result.coefficients.index]
    return _render([["Parameter", "Estimate", "Std. error", "t", "p"], *rows], format)


def format_fit_statistics(result: FitResult, format: str = "text") -> str:
    return _render([["Statistic", "Value"], *([k, f"{v:.4f}" if isinstance(v, float) else str(v)] for k, v in result.fit_statistics().values.tolist())], format)


def format_side_by_side(results: list[FitResult], labels: list[str] | None = None, format: str = "text") -> str:
    """All parameters of all results in order of first appearance; one that a result lacks is a dash."""
    labels = labels or [f"({i + 1})" for i in range(len(results))]
    names = list(dict.fromkeys(n for r in results for n in r.coefficients.index))
    cell = lambda r, n: f"{r.coefficients[n]:.4f}{stars(r.p_values[n])} ({r.std_errors[n]:.4f})" if n in r.coefficients.index else "—"
    rows = [[n, *(cell(r, n) for r in results)] for n in names]
    rows += [["Log-likelihood", *(f"{r.log_likelihood:.3f}" for r in results)], ["Observations", *(str(r.n_observations) for r in results)], ["AIC", *(f"{r.aic:.2f}" for r in results)]]
    return _render([["", *labels], *rows], format)
