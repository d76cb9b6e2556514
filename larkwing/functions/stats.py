"""Scalar statistics and parameter transforms on numpy, without scipy; transforms also take complex numbers."""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(x):
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(np.asarray(x, float) / math.sqrt(2)))


def norm_pdf(x):
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def norm_ppf(p):
    """Inverse of the normal distribution function: a rational start, then Halley steps on the error function."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t**2) / (1 + 1.432788 * t + 0.189269 * t**2 + 0.001308 * t**3)
    x = np.where(p < 0.5, -x, x)
    erfc = np.vectorize(math.erfc, otypes=[float])
    for _ in range(3):  # on the nearer tail, so that small p keep their digits
        tail = np.where(x < 0, 0.5 * erfc(-x / math.sqrt(2)) - p, (1 - p) - 0.5 * erfc(x / math.sqrt(2)))
        step = tail / np.maximum(norm_pdf(x), 1e-300)
        x = x - step / (1 + 0.5 * x * step)
    return x


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    tiny = 1e-300
    b, c, d = x + 1 - a, 1 / tiny, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2) if df > 0 else math.nan


def chi2_ppf(p: float, df: int) -> float:
    low, high = 0.0, max(10.0, 10.0 * df)
    while chi2_sf(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_sf(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def softplus(x):
    """log(1 + e^x)"""
    if np.iscomplexobj(x):
        return np.log(1 + np.exp(x))
    return np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0)


def logit(p):
    p = np.clip(p, 1e-10, 1 - 1e-10)
    return np.log(p / (1 - p))


def inverse_softplus(y):
    y = np.maximum(np.asarray(y, float), 1e-12)
    return np.where(y > 30, y, np.log(np.expm1(np.minimum(y, 30))))


class Transform:
    """A map from the real line to a parameter's range: forward, inverse, derivative and log |derivative|."""

    def __init__(self, name: str, forward, inverse, slope):
        self.name, self.forward, self.inverse, self.slope = name, forward, inverse, slope

    constrain = property(lambda self: self.forward)

    def log_det_jac(self, x):
        return np.log(np.abs(self.slope(x)))


IDENTITY = Transform("identity", lambda x: x, lambda y: y, lambda x: np.ones_like(np.asarray(x, float)))
SIGMOID = Transform("sigmoid", sigmoid, logit, lambda x: sigmoid(x) * (1 - sigmoid(x)))
TANH = Transform("tanh", np.tanh, lambda y: np.arctanh(np.clip(y, -1 + 1e-12, 1 - 1e-12)), lambda x: 1 - np.tanh(x) ** 2)
SOFTPLUS = Transform("softplus", softplus, inverse_softplus, sigmoid)
EXP = Transform("exp", np.exp, np.log, np.exp)


def bounded(low: float, high: float) -> Transform:
    span = high - low
    return Transform("sigmoid", lambda x: low + span * sigmoid(x), lambda y: logit((y - low) / span), lambda x: span * SIGMOID.slope(x))


def above(low: float) -> Transform:
    return Transform("lower", lambda x: low + softplus(x), lambda y: inverse_softplus(y - low), sigmoid)


def below(high: float) -> Transform:
    return Transform("upper", lambda x: high - softplus(x), lambda y: inverse_softplus(high - y), lambda x: -sigmoid(x))


def safe_inverse(a: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a)


PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47)


def halton(n: int, base: int, first: int = 1) -> np.ndarray:
    """Radical inverses of first, first + 1, ... in a prime base."""
    i, out, scale = np.arange(first, first + n), np.zeros(n), 1.0 / base
    while i.any():
        out += scale * (i % base)
        i, scale = i // base, scale / base
    return out


def realise(kind: str, mean, spread, z):
    """A random coefficient from its location, spread and standard normal draws z."""
    if kind == "normal":
        return mean + spread * z
    if kind == "lognormal":
        x = mean + spread * z
        return np.exp(x if np.iscomplexobj(x) else np.clip(x, -50, 50))
    u = norm_cdf(np.real(z))
    if kind == "uniform":
        return mean + spread * (2 * u - 1)
    if kind == "triangular":
        return mean + spread * np.where(u < 0.5, np.sqrt(2 * u) - 1, 1 - np.sqrt(2 * (1 - u)))
    raise ValueError(f"unknown distribution {kind!r}")


naturalize_nest_params = sigmoid
