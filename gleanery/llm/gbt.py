"""Gradient-boosted trees in numpy: histogram splits, monotone features, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """All trees in one set of arrays; a leaf is its own child, so scoring is ``depth`` gathers a tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] < self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: tuple[int, ...],
    cuts: dict[int, list[float]] | None = None,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    l2: float = 1.0,
    bins: int = 64,
    least: int = 5,
) -> FlatTrees:
    """Logistic boosting. monotone: per feature +1 (rising), -1 (falling) or 0. cuts: extra bin edges per feature.

    Monotonicity holds for the whole model: a split of a constrained feature is taken only if its child values
    are in order, and both subtrees are kept on their side of the values' midpoint.
    """
    n, k = x.shape
    edges = []
    for j in range(k):
        e = np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]) if n else [], (cuts or {}).get(j, [])]))
        edges.append(e)
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(k)], 1) if n else np.zeros((0, k), int)
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    F, T, L, R, V, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(F)
        F.append(0), T.append(np.inf), L.append(i), R.append(i), V.append(v)
        return i

    def weight(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + l2), lo, hi))

    def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        g, h = grad[rows], hess[rows]
        G, H = g.sum(), h.sum()
        best = (1e-9, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j in range(k):
                if not len(edges[j]):
                    continue
                b = binned[rows, j]
                m = len(edges[j]) + 1
                gl, hl, cl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g, h, np.ones(len(rows))))
                ok = (cl >= least) & (len(rows) - cl >= least)
                wl = np.clip(-gl / (hl + l2), lo, hi)
                wr = np.clip(-(G - gl) / (H - hl + l2), lo, hi)
                if monotone[j]:
                    ok &= (wr - wl) * monotone[j] >= 0
                loss = lambda w, a, c: a * w + 0.5 * (c + l2) * w * w
                w0 = weight(G, H, lo, hi)
                gain = np.where(ok, loss(w0, G, H) - loss(wl, gl, hl) - loss(wr, G - gl, H - hl), -1)
                t = int(gain.argmax())
                if gain[t] > best[0]:
                    best = (float(gain[t]), j, t, float(wl[t]), float(wr[t]))
        gain, j, t, wl, wr = best
        if j < 0:
            return leaf(rate * weight(G, H, lo, hi))
        i = leaf(0.0)
        F[i], T[i] = j, float(edges[j][t])
        mid = (wl + wr) / 2
        low, high = ((lo, mid), (mid, hi)) if monotone[j] > 0 else ((mid, hi), (lo, mid)) if monotone[j] < 0 else ((lo, hi), (lo, hi))
        goes = binned[rows, j] <= t
        L[i] = grow(rows[goes], level + 1, *low)
        R[i] = grow(rows[~goes], level + 1, *high)
        return i

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
        one = FlatTrees(*map(np.array, (F, T, L, R, V)), np.array(roots[-1:]), depth, 0.0)
        margin += one.margin(x)
    return FlatTrees(*(np.array(a) for a in (F or [0], T or [np.inf], L or [0], R or [0], V or [0.0])), np.array(roots, dtype=int), depth, base)
