"""Gaussian mixtures: where fits start from (weighted expectation-maximisation on bounded samples), and transport between mixtures."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

REG = 1e-6


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    @property
    def k(self) -> int:
        return len(self.weights)

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Log-density of each point under each component, weights aside."""
        x = np.atleast_2d(np.asarray(x, float))
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            low = np.linalg.cholesky(self.covariances[j])
            z = np.linalg.solve(low, (x - self.means[j]).T)
            out[:, j] = -0.5 * (x.shape[1] * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(low)).sum()
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood of each point."""
        a = self.log_densities(x) + np.log(np.maximum(self.weights, 1e-300))
        top = a.max(axis=1, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]

    def posterior(self, x: np.ndarray) -> np.ndarray:
        a = self.log_densities(x) + np.log(np.maximum(self.weights, 1e-300))
        a = np.exp(a - a.max(axis=1, keepdims=True))
        return a / a.sum(axis=1, keepdims=True)

    def to_json(self) -> str:
        return json.dumps({n: getattr(self, n).tolist() for n in ("weights", "means", "covariances")})

    @staticmethod
    def from_json(text: str) -> Mixture:
        d = json.loads(text)
        return Mixture(*(np.array(d[n], float) for n in ("weights", "means", "covariances")))


def _start(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Means far from each other: each next one at random by weighted squared distance."""
    means = [x[rng.choice(len(x), p=w / w.sum())]]
    while len(means) < k:
        d = np.min([((x - m) ** 2).sum(axis=1) for m in means], axis=0) * w
        means.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(means)


def constrained(cov: np.ndarray, kind: str, weights: np.ndarray) -> np.ndarray:
    """Covariances of a kind, as full matrices: everything behind works on those."""
    d = cov.shape[1]
    if kind == "full":
        return cov
    if kind == "diag":
        return np.array([np.diag(np.diag(c)) for c in cov])
    if kind == "spherical":
        return np.array([np.eye(d) * np.trace(c) / d for c in cov])
    if kind == "tied":
        return np.repeat(np.einsum("k,kij->ij", weights, cov)[None], len(cov), axis=0)
    raise ValueError(f"unknown covariance type {kind!r}")


def fit(x: np.ndarray, k: int, sample_weight: np.ndarray | None = None, means: np.ndarray | None = None, start: Mixture | None = None, covariance: str = "full", n_init: int = 1, max_iter: int = 200, tol: float = 1e-3, reg: float = REG, seed: int | None = 0) -> Mixture:
    """A mixture of k normal distributions. Begins with given means, with a fitted mixture, or at random (best of n_init)."""
    x = np.asarray(x, float)
    x = x.reshape(len(x), -1) if len(x) else np.zeros((0, 1))
    w = np.ones(len(x)) if sample_weight is None else np.asarray(sample_weight, float)
    if len(x) == 0 or (w > 0).sum() < k:
        raise ValueError(f"{k} components need as many points")
    rng, best = np.random.default_rng(seed), None
    total, base = w.sum(), np.cov(x.T, aweights=w, bias=True).reshape(x.shape[1], -1)
    for _ in range(1 if means is not None or start is not None else n_init):
        if start is not None:
            m = Mixture(start.weights.copy(), start.means.copy(), start.covariances.copy())
        else:
            centre = np.asarray(means, float).reshape(k, -1) if means is not None else _start(x, w, k, rng)
            near = np.argmin(((x[:, None] - centre) ** 2).sum(axis=2) if len(x) * k < 2e7 else np.array([((x - c) ** 2).sum(axis=1) for c in centre]).T, axis=1)
            m = _estimate(x, w, np.eye(k)[near], base, covariance, reg)
            m.means = np.where(np.bincount(near, w, k)[:, None] > 0, m.means, centre)
        last = -np.inf
        for _ in range(max_iter):
            a = m.log_densities(x) + np.log(np.maximum(m.weights, 1e-300))
            top = a.max(axis=1, keepdims=True)
            norm = top[:, 0] + np.log(np.exp(a - top).sum(axis=1))
            mean = float((w * norm).sum() / total)
            m = _estimate(x, w, np.exp(a - norm[:, None]), base, covariance, reg)
            if abs(mean - last) < tol:
                break
            last = mean
        final = float((w * m.score(x)).sum() / total)
        if best is None or final > best[0]:
            best = (final, m)
    return best[1]


def _estimate(x: np.ndarray, w: np.ndarray, resp: np.ndarray, base: np.ndarray, kind: str, reg: float) -> Mixture:
    r = resp * w[:, None]
    n = r.sum(axis=0) + 1e-12
    means = (r.T @ x) / n[:, None]
    cov = np.empty((len(n), x.shape[1], x.shape[1]))
    for j in range(len(n)):
        d = x - means[j]
        cov[j] = (r[:, j, None] * d).T @ d / n[j] if n[j] > 1e-9 else base
    weights = n / n.sum()
    return Mixture(weights, means, constrained(cov, kind, weights) + reg * np.eye(x.shape[1]))


def root(a: np.ndarray) -> np.ndarray:
    """Square root of a covariance matrix; clearly negative eigenvalues are an error, small ones are rounding."""
    v, q = np.linalg.eigh(a)
    if (v < -1e-10).any():
        raise ValueError(f"not positive semi-definite: {v.min():.2e}")
    return (q * np.sqrt(np.maximum(v, 0))) @ q.T


def inverse_root(a: np.ndarray) -> np.ndarray:
    v, q = np.linalg.eigh(a)
    return (q / np.sqrt(np.maximum(v, 1e-10))) @ q.T


def gaussian_map(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The matrix that turns a centred normal distribution of covariance s into one of covariance t at least cost."""
    r, i = root(s), inverse_root(s)
    return i @ root((r @ t @ r + (r @ t @ r).T) / 2) @ i


def component_costs(source: Mixture, target: Mixture, cost: str = "wasserstein") -> np.ndarray:
    """Squared 2-Wasserstein distance between components. cost="added" adds the cross term instead of taking it off twice."""
    out = np.empty((source.k, target.k))
    for i in range(source.k):
        for j in range(target.k):
            v, u = source.covariances[i], target.covariances[j]
            r = root(u)
            cross = np.trace(root((r @ v @ r + (r @ v @ r).T) / 2))
            spread = np.trace(v + u) + (cross if cost == "added" else -2 * cross)
            out[i, j] = ((source.means[i] - target.means[j]) ** 2).sum() + spread
    return out


def transport_plan(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Exact optimal transport of weights a to weights b: successive shortest paths with potentials on the bipartite graph.

    Each round sends mass from one row along its shortest path to a column that still needs some (Dijkstra, dense; a step is a
    few operations on vectors). a and b must have equal sums.
    """
    a, b = np.asarray(a, float) / np.sum(a), np.asarray(b, float) / np.sum(b)
    n, m = cost.shape
    flow, left, need = np.zeros((n, m), order="F"), a.copy(), b.copy()
    # Potentials under which every row and every column begins with an edge that costs nothing.
    pj = cost.min(axis=0) if n else np.zeros(m)
    pi = -(cost - pj).min(axis=1) if m else np.zeros(n)
    eps = 1e-13
    for start in range(n):
        while left[start] > eps and need.max(initial=0) > eps:
            di, from_col = np.full(n, np.inf), np.full(n, -1)
            dj, from_row = np.full(m, np.inf), np.full(m, -1)
            open_j = np.full(m, np.inf)  # distances of columns that aren't settled
            di[start], fresh, end = 0.0, [start], -1
            while end < 0:
                for i in fresh:
                    new = cost[i] - pj
                    new += pi[i]
                    np.maximum(new, 0, out=new)
                    new += di[i]
                    better = np.flatnonzero(new < dj)  # never a settled column: distances don't fall
                    dj[better] = open_j[better] = new[better]
                    from_row[better] = i
                j = int(open_j.argmin())
                if open_j[j] == np.inf:
                    break
                if need[j] > eps:
                    end = j
                    break
                # Edges that carry mass cost nothing, so the rows behind a column are as far as it is.
                open_j[j] = np.inf
                back = np.flatnonzero((flow[:, j] > eps) & np.isinf(di))
                di[back], from_col[back] = dj[j], j
                fresh = back.tolist()
            if end < 0:
                break
            far = dj[end]
            pi += np.minimum(di, far)
            pj += np.minimum(dj, far)
            path, j, push = [], end, min(need[end], left[start])
            while (i := int(from_row[j])) != start:
                path.append((i, j, 1))
                j = int(from_col[i])
                path.append((i, j, -1))
                push = min(push, flow[i, j])
            path.append((start, j, 1))
            for i, j, sign in path:
                flow[i, j] += sign * push
            left[start] -= push
            need[end] -= push
    return np.maximum(flow, 0)


@dataclass
class Transport:
    """Maps between the components of two mixtures, and how much of each source component goes to each target component."""

    source: Mixture
    target: Mixture
    omega: np.ndarray
    maps: np.ndarray

    def to_json(self) -> str:
        return json.dumps({"source": self.source.to_json(), "target": self.target.to_json(), "omega": self.omega.tolist(), "maps": self.maps.tolist()})

    @staticmethod
    def from_json(text: str) -> Transport:
        d = json.loads(text)
        return Transport(Mixture.from_json(d["source"]), Mixture.from_json(d["target"]), np.array(d["omega"], float), np.array(d["maps"], float))

    def moved(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Points by the map of source component i to target component j, a pair for each point."""
        return np.einsum("nij,nj->ni", self.maps[i, j], x - self.source.means[i]) + self.target.means[j]

    def apply(self, x: np.ndarray, method: str = "rand", u: np.ndarray | None = None, threshold: float = 0.05, preserve_rare: bool = True, rare: float = 0.01) -> np.ndarray:
        """Points in their order, clipped to [0, 255].

        max: most probable source component, its greatest target. weight: densest source component (weights aside), mean of the
        maps to targets with at least `threshold`; points that no component is dense at go to one target. rand: a pair of
        components at random by its probability at the point. u: a number in [0, 1) for each point.
        """
        x = np.asarray(x, float)
        if not len(x):
            return x
        x = x.reshape(len(x), -1)
        u = np.zeros(len(x)) if u is None else u
        if method == "max":
            i = self.source.posterior(x).argmax(axis=1)
            out = self.moved(x, i, self.omega.argmax(axis=1)[i])
        elif method == "weight":
            density = self.source.log_densities(x)
            i = density.argmax(axis=1)
            share = np.where(self.omega >= threshold, self.omega, 0)
            none = share.sum(axis=1) == 0
            share[none, self.omega[none].argmax(axis=1)] = 1
            share /= share.sum(axis=1, keepdims=True)
            out = sum(share[i, j][:, None] * self.moved(x, i, np.full(len(x), j)) for j in range(self.target.k))
            if preserve_rare:
                at = np.flatnonzero(np.exp(density.max(axis=1)) < rare)
                if len(at):
                    j = np.minimum((np.cumsum(share[i[at]], axis=1) <= u[at, None]).sum(axis=1), self.target.k - 1)
                    out[at] = self.moved(x[at], i[at], j)
        elif method == "rand":
            post = self.source.posterior(x)
            p = (post / np.maximum(self.source.weights, 1e-300))[:, :, None] * self.omega
            p = p.reshape(len(x), -1)
            total = np.cumsum(p, axis=1)
            pick = np.minimum((total <= u[:, None] * total[:, -1:]).sum(axis=1), p.shape[1] - 1)
            out = self.moved(x, pick // self.target.k, pick % self.target.k)
        else:
            raise ValueError(f"unknown method {method!r}")
        return np.clip(out, 0, 255)


def transport_between(source: Mixture, target: Mixture, cost: str = "wasserstein") -> Transport:
    omega = transport_plan(source.weights, target.weights, component_costs(source, target, cost))
    d = source.means.shape[1]
    maps = np.zeros((source.k, target.k, d, d))
    for i, j in zip(*np.nonzero(omega > 0), strict=True):
        maps[i, j] = gaussian_map(source.covariances[i], target.covariances[j])
    return Transport(source, target, omega, maps)


def allocate(counts: dict[int, int], k: int, method: str = "equal") -> dict[int, int]:
    """Components for each population: equal, or by (the square root of) its size, two at least; the largest makes up the rest."""
    labels = sorted(counts)
    if method == "equal":
        out = {x: k // len(labels) + (i < k % len(labels)) for i, x in enumerate(labels)}
    elif method in ("sqrt", "proportional"):
        size = {x: counts[x] ** (0.5 if method == "sqrt" else 1.0) for x in labels}
        out = {x: max(2, int(k * size[x] / sum(size.values()))) for x in labels}
    else:
        raise ValueError(f"unknown method {method!r}")
    out[max(labels, key=lambda x: (counts[x], -labels.index(x)))] += k - sum(out.values())
    return out


def means_by_label(x: np.ndarray, labels: np.ndarray, k: int, method: str = "equal", seed: int = 0) -> np.ndarray:
    """First means spread over populations: points drawn from each by its allocation."""
    rng = np.random.default_rng(seed)
    counts = {int(v): int(n) for v, n in zip(*np.unique(labels, return_counts=True), strict=True)}
    picks = [rng.choice(np.flatnonzero(labels == v), n, replace=n > counts[v]) for v, n in allocate(counts, k, method).items() if n > 0]
    return x[rng.permutation(np.concatenate(picks))[:k]]
