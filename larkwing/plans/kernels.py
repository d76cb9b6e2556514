"""Log choice probabilities of blocks of observations, on numpy.

A utility array has shape (..., J). All kernels stay in log space, mask unavailable alternatives, and take complex numbers, so
that derivatives come from complex steps, exact to machine precision.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

from ..functions.stats import halton, norm_ppf, realise, sigmoid, softplus
from .packing import Block

FAR = -1e30


@functools.cache
def _sequence(n: int, k: int) -> np.ndarray:
    return np.stack([halton(n, q, 11) for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47)[:k]], axis=1)


@functools.cache
def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    """The inverse distribution function, far below the simulation error; made once by each worker, not by each task."""
    grid = np.linspace(0, 1, 1 << 15)
    return grid, norm_ppf(np.clip(grid, 1 / (1 << 16), 1 - 1 / (1 << 16)))


def lse(v: np.ndarray, mask: np.ndarray | None = None, axis: int = -1) -> np.ndarray:
    """log sum exp over entries of the mask; FAR where there is none."""
    if mask is not None:
        v = np.where(mask, v, FAR)
    top = np.max(v.real, axis=axis, keepdims=True)
    total = np.exp(v - top)
    if mask is not None:
        total = np.where(mask, total, 0)
    total = total.sum(axis=axis)
    top = top.squeeze(axis)
    some = total != 0
    return np.where(some, top + np.log(np.where(some, total, 1)), FAR)


def mnl(v: np.ndarray, av: np.ndarray) -> np.ndarray:
    return np.where(av, v - lse(v, av)[..., None], FAR)


def nested(v: np.ndarray, av: np.ndarray, nest: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """nest: of each alternative, -1 for none; an alternative without a nest competes at the top by itself."""
    tops, out = [lse(v, av & (nest < 0))], np.where(av & (nest < 0), v, FAR)
    for m, scale in enumerate(lam):
        inside = av & (nest == m)
        iv = lse(v / scale, inside)
        tops.append(np.where(inside.any(axis=-1), scale * iv, FAR))
        out = np.where(inside, v / scale + (scale - 1) * iv[..., None], out)
    top = lse(np.stack(tops, axis=-1))
    return np.where(av, out - top[..., None], FAR)


@dataclass(frozen=True)
class Edges:
    """Pairs i < j of alternatives with their allocation shares; alternatives of `members` without a pair are isolated."""

    i: np.ndarray
    j: np.ndarray
    share_i: np.ndarray
    share_j: np.ndarray
    members: np.ndarray

    @classmethod
    def of(cls, weights: np.ndarray, members: np.ndarray | None = None) -> Edges:
        """From an adjacency matrix: the diagonal is dropped, rows are scaled to 1, a pair counts in either direction."""
        n = len(weights)
        members = np.arange(n) if members is None else np.asarray(members)
        w = np.zeros((n, n))
        w[np.ix_(members, members)] = np.asarray(weights, float)[np.ix_(members, members)]
        np.fill_diagonal(w, 0)
        rows = w.sum(axis=1, keepdims=True)
        share = np.divide(w, rows, out=np.zeros_like(w), where=rows > 0)
        i, j = np.nonzero(np.triu((share > 0) | (share.T > 0), 1))
        return cls(i, j, np.maximum(share[i, j], 1e-300), np.maximum(share[j, i], 1e-300), members)


def scl(v: np.ndarray, av: np.ndarray, edges: Edges, rho) -> tuple[np.ndarray, np.ndarray]:
    """Paired generalised extreme value logit: log probabilities and ln G; rho = 1 is the multinomial logit."""
    n = v.shape[-1]
    av = np.broadcast_to(av, v.shape)
    linked = np.zeros(n, bool)
    linked[edges.i] = linked[edges.j] = True
    alone = np.zeros(n, bool)
    alone[edges.members] = True
    alone &= ~linked
    masked = np.where(av, v, FAR)
    ti = (masked[..., edges.i] + np.log(edges.share_i)) / rho
    tj = (masked[..., edges.j] + np.log(edges.share_j)) / rho
    both = lse(np.stack([ti, tj], axis=-1))
    g = np.where(both.real < FAR / 1e3, FAR, rho * both)
    total = lse(np.concatenate([g, np.where(av & alone, v, FAR)], axis=-1))
    p = np.zeros(v.shape, v.dtype if np.iscomplexobj(v) or not np.iscomplexobj(rho) else complex)
    p = p.astype(np.result_type(p, total))
    for at, t in ((edges.i, ti), (edges.j, tj)):
        part = np.where(g.real > FAR / 1e3, np.exp(t - both + g - total[..., None]), 0)
        np.add.at(p, (..., at), part)
    p = np.where(av & alone, np.exp(np.where(av & alone, v, 0) - total[..., None]), p)
    return np.where(av & (p != 0), np.log(np.where(p != 0, p, 1)), FAR), total


def nested_scl(v: np.ndarray, av: np.ndarray, parts: list[Edges], rho: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """SCL inside each nest, a softmax of lambda ln G over nests; every alternative is in a nest."""
    out, tops = np.full(v.shape, FAR, np.result_type(v, rho, lam)), []
    within = []
    for m, edges in enumerate(parts):
        inside = np.zeros(v.shape[-1], bool)
        inside[edges.members] = True
        p, g = scl(v, av & inside, edges, rho[m])
        within.append((inside, p))
        tops.append(np.where(np.broadcast_to(av & inside, v.shape).any(axis=-1), lam[m] * g, FAR))
    tops = np.stack(tops, axis=-1)
    level = mnl(tops, tops.real > FAR / 1e3)
    for m, (inside, p) in enumerate(within):
        out = np.where(inside, p + level[..., m, None], out)
    return np.where(av, out, FAR)


def sar_filter(w: np.ndarray, rho, normalise: bool = True) -> np.ndarray:
    """(I - rho W)^-1, its rows divided by its diagonal if normalise."""
    t = np.linalg.inv(np.eye(len(w)) - rho * w)
    return t / np.diag(t)[:, None] if normalise else t


@dataclass
class Structure:
    """Everything about a model but its data; pickles, and is as small as its graph."""

    names: list[str]  # columns of the design
    fixed: dict[str, float] = field(default_factory=dict)
    random: dict[str, str] = field(default_factory=dict)  # column -> distribution
    correlated: bool = False
    nests: dict[str, list] = field(default_factory=dict)  # name -> alternative ids
    alts: list = field(default_factory=list)  # order of graphs
    graph: np.ndarray | None = None
    lag: bool = False
    normalise: bool = True
    n_draws: int = 0
    draw_type: str = "halton"
    seed: int = 42
    panel: bool = False
    lam_start: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.nest_of = {a: m for m, ids in enumerate(self.nests.values()) for a in ids}
        self.beta_names = [n for n in self.names if n not in self.random]
        self.random_names = [n for n in self.names if n in self.random]
        k = len(self.random_names)
        self.lower = [(a, b) for a in range(k) for b in range(a + 1)] if self.correlated else []
        spread = [f"chol_{self.random_names[a]}_{self.random_names[b]}" for a, b in self.lower] if self.correlated else [f"sd_{n}" for n in self.random_names]
        if self.graph is None:
            rho = []
        elif self.lag or not self.nests:
            rho = ["rho"]
        else:
            rho = [f"rho_{m}" for m in self.nests]
        self.rho_names = rho
        self.param_names = [*self.beta_names, *rho, *(f"lambda_{m}" for m in self.nests), *(f"mean_{n}" for n in self.random_names), *spread]
        self.kinds = ["identity"] * len(self.beta_names) + ["tanh" if self.lag else "sigmoid"] * len(rho) + ["sigmoid"] * len(self.nests) + ["identity"] * k + (["softplus" if a == b else "identity" for a, b in self.lower] if self.correlated else ["softplus"] * k)
        if self.graph is not None and not self.lag:
            g = np.asarray(self.graph, float)
            self.edges = [Edges.of(g, [self.alts.index(a) for a in ids]) for ids in self.nests.values()] if self.nests else [Edges.of(g)]
        self._filters: dict = {}

    def natural(self, raw: np.ndarray) -> np.ndarray:
        move = {"identity": lambda x: x, "sigmoid": sigmoid, "tanh": np.tanh, "softplus": softplus}
        return np.array([move[k](x) for k, x in zip(self.kinds, raw, strict=True)])

    def split(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        """A display-scale vector by part."""
        sizes = [len(self.beta_names), len(self.rho_names), len(self.nests), len(self.random_names)]
        cuts = np.cumsum(sizes)
        beta, rho, lam, mean, spread = np.split(np.asarray(theta), cuts)
        return {"beta": beta, "rho": rho, "lam": lam, "mean": mean, "spread": spread}

    def draws(self, persons: list) -> np.ndarray:
        """(persons, draws, random columns): one quasi-random sequence, shifted by a hash of seed and person."""
        import hashlib

        k, r = len(self.random_names), self.n_draws
        if self.draw_type == "random":
            return np.stack([np.random.default_rng(int.from_bytes(hashlib.md5(f"{self.seed}|{p}".encode()).digest()[:8], "little")).standard_normal((r, k)) for p in persons])
        base, grid, table = _sequence(r, k), *_normal_table()
        digest = [np.frombuffer(b"".join(hashlib.md5(f"{self.seed}|{p}|{q}".encode()).digest()[:8] for q in range(k)), "<u8") for p in persons]
        u = (base[None] + (np.stack(digest).astype(float) / 2.0**64)[:, None, :]) % 1.0
        return np.interp(u, grid, table)

    def coefficients(self, parts: dict, z: np.ndarray) -> np.ndarray:
        if self.correlated:
            l = np.zeros((len(self.random_names),) * 2, np.result_type(parts["spread"], float))
            for (a, b), v in zip(self.lower, parts["spread"], strict=True):
                l[a, b] = v
            z = z @ l.T
            return np.stack([realise(self.random[n], parts["mean"][q], 1.0, z[..., q]) for q, n in enumerate(self.random_names)], axis=-1)
        return np.stack([realise(self.random[n], parts["mean"][q], parts["spread"][q], z[..., q]) for q, n in enumerate(self.random_names)], axis=-1)

    def filter(self, rho) -> np.ndarray:
        key = complex(rho)
        if key not in self._filters:
            if len(self._filters) > 64:
                self._filters.clear()
            self._filters[key] = sar_filter(np.asarray(self.graph, float), rho, self.normalise)
        return self._filters[key]

    def nest_codes(self, block: Block) -> np.ndarray:
        j = block.av.shape[1]
        if all(a == block.alt[0] for a in block.alt):
            row = [self.nest_of.get(a, -1) for a in block.alt[0]] if block.alt else []
            return np.broadcast_to(np.array(row, int).reshape(1, -1), block.av.shape)
        return np.array([[self.nest_of.get(a, -1) for a in row] + [-1] * (j - len(row)) for row in block.alt])

    def check(self, block: Block) -> None:
        if self.graph is not None and any(list(a) != self.alts for a in block.alt):
            raise ValueError("a model with a graph needs every observation to list all alternatives in the graph's order")

    def structured(self, v: np.ndarray, av: np.ndarray, nest: np.ndarray | None, parts: dict) -> np.ndarray:
        if v.ndim == 3:
            av, nest = av[:, None, :], None if nest is None else nest[:, None, :]
        if self.graph is not None and not self.lag:
            if self.nests:
                return nested_scl(v, av, self.edges, parts["rho"], parts["lam"])
            return scl(v, av, self.edges[0], parts["rho"][0])[0]
        if self.lag:
            v = v @ self.filter(parts["rho"][0]).T
        return nested(v, av, nest, parts["lam"]) if self.nests else mnl(v, av)

    def log_probabilities(self, block: Block, theta: np.ndarray, chosen_only: bool = False, memory: int = 4_000_000) -> np.ndarray:
        """theta on the display scale. (n, J) log probabilities; chosen_only: (n,) of the choice, for mixed models (n, draws)."""
        parts = self.split(theta)
        at = [self.names.index(n) for n in self.beta_names]
        v = block.x[:, :, at] @ parts["beta"] if at else np.zeros(block.av.shape)
        v = v + block.lnpi
        nest = self.nest_codes(block) if self.nests else None
        rows = np.arange(len(v))
        if not self.random:
            out = self.structured(v, block.av, nest, parts)
            return out[rows, block.chosen] if chosen_only else out
        xr = block.x[:, :, [self.names.index(n) for n in self.random_names]]
        uniq, where = np.unique([str(p) for p in block.person], return_inverse=True)
        z = self.draws(list(uniq))
        step = max(1, memory // max(1, block.av.size))
        kept = []
        for r in range(0, self.n_draws, step):  # blocks of draws bound the memory
            b = self.coefficients(parts, z[:, r : r + step])[where]
            out = self.structured(v[:, None, :] + np.einsum("njk,nrk->nrj", xr, b), block.av, nest, parts)
            kept.append(out[rows, :, block.chosen] if chosen_only else lse(out, axis=1))
        if chosen_only:
            return np.concatenate(kept, axis=1)
        return lse(np.stack(kept, axis=1), axis=1) - np.log(self.n_draws)

    def contributions(self, block: Block, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood and weight of each unit: the observation, or the person of a panel."""
        out = self.log_probabilities(block, theta, chosen_only=True)
        w = block.w
        if self.random:
            if self.panel:
                _, where = np.unique([str(p) for p in block.person], return_inverse=True)
                total = np.zeros((where.max() + 1, out.shape[1]), out.dtype)
                np.add.at(total, where, out)
                weight = np.zeros(len(total))
                np.maximum.at(weight, where, w)
                out, w = total, weight
            out = lse(out, axis=1) - np.log(self.n_draws)
        return out, w


STEP = 1e-30


#: Utilities (observations x alternatives x draws) that are held at once: as many as the cache holds.
HELD = 1 << 18


def mixed_derivatives(structure: Structure, block: Block, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Log likelihood of each observation and its derivatives by the raw parameters, for mixed logits without panels, nests and
    graphs: the draws' derivatives of the choice, weighted by its probabilities, with those of the coefficients by complex
    steps. None for other models and where a choice is not available."""
    rows = np.arange(len(block.av))
    if not structure.random or structure.panel or structure.nests or structure.graph is not None or not len(rows) or not block.av[rows, block.chosen].all():
        return None
    s, at = structure, structure.names.index
    fixed, drawn = [at(n) for n in s.beta_names], [at(n) for n in s.random_names]
    parts = s.split(s.natural(raw))
    stepped = []
    for k in range(len(fixed), len(raw)):
        x = raw.astype(complex)
        x[k] += 1j * STEP
        stepped.append(s.split(s.natural(x)))
    base = np.where(block.av, block.x[:, :, fixed] @ parts["beta"] + block.lnpi, FAR)
    ll, out = np.empty(len(rows)), np.empty((len(rows), len(raw)))
    size = max(1, HELD // (base.shape[1] * s.n_draws))
    for a in range(0, len(rows), size):
        own = slice(a, a + size)
        x, n = block.x[own], rows[: len(block.x[own])]
        z, chosen = s.draws([str(p) for p in block.person[own]]), block.chosen[own]
        c = s.coefficients(parts, z).transpose(0, 2, 1)
        v = x[:, :, drawn] @ c if len(drawn) > 1 else x[:, :, drawn] * c
        v += base[own][:, :, None]
        of_choice = v[n, chosen]
        top = v.max(axis=1)
        v -= top[:, None]
        np.exp(v, out=v)
        total = v.sum(axis=1)
        log_p = of_choice - top - np.log(total)
        most = log_p.max(axis=1, keepdims=True)
        p = np.exp(log_p - most)
        ll[own] = most[:, 0] + np.log(p.mean(axis=1))
        p /= p.sum(axis=1, keepdims=True)
        # what the choice has of each column more than the mean over alternatives: (observations, columns, draws)
        more = x[n, chosen][:, :, None] - x.transpose(0, 2, 1) @ v / total[:, None]
        out[own, : len(fixed)] = np.einsum("nkr,nr->nk", more[:, fixed], p)
        for k, moved in enumerate(stepped, len(fixed)):
            slope = s.coefficients(moved, z).imag / STEP
            out[own, k] = np.einsum("nqr,nrq,nr->n", more[:, drawn], slope, p)
    slope = np.array([(s.natural(raw + 1j * STEP * (np.arange(len(raw)) == k))[k]).imag / STEP for k in range(len(fixed))])
    out[:, : len(fixed)] *= slope
    return ll, out


def scores(structure: Structure, block: Block, raw: np.ndarray) -> np.ndarray:
    """Of each unit: derivatives of its log likelihood with respect to the raw parameters, exact or by complex steps."""
    if (found := mixed_derivatives(structure, block, raw)) is not None:
        return found[1]
    return stepped_scores(structure, block, raw)


def stepped_scores(structure: Structure, block: Block, raw: np.ndarray) -> np.ndarray:
    out = []
    for k in range(len(raw)):
        x = raw.astype(complex)
        x[k] += 1j * STEP
        out.append(structure.contributions(block, structure.natural(x))[0].imag / STEP)
    return np.stack(out, axis=1) if out else np.zeros((len(block.w), 0))


def mnl_derivatives(structure: Structure, block: Block, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log likelihood, gradient and Hessian of the multinomial logit."""
    logp = mnl(block.x @ beta + block.lnpi, block.av)
    p = np.where(block.av, np.exp(logp), 0)
    mean = np.einsum("nj,njk->nk", p, block.x)
    rows = np.arange(len(p))
    g = ((block.x[rows, block.chosen] - mean) * block.w[:, None]).sum(axis=0)
    centred = block.x - mean[:, None, :]
    h = -np.einsum("nj,njk,njl->kl", p * block.w[:, None], centred, centred, optimize=True)
    return float((block.w * logp[rows, block.chosen]).sum()), g, h
