"""Generalised additive model with pairwise interactions, as lookup tables.

Training cycles over the features; each turn fits a shallow tree (at most three leaves) on one feature's histogram of
logistic gradients and adds it, shrunken, to that feature's table. Then the pairs of features whose two-way tables
explain most of what is left are boosted the same way with four-leaf trees. A score is the sum of table entries looked
up by bin, so scoring is one vectorised addition for each table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        bins = self.bins(x)
        total = np.full(len(x), self.bias)
        for t, b in zip(self.tables, bins, strict=True):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _gain(g, h, lam):
    return g * g / (h + lam)


def _tree(g: np.ndarray, h: np.ndarray, lam: float, leaves: int = 3) -> np.ndarray:
    """Values by bin of the greedy tree on ordered bins with gradient and curvature sums ``g`` and ``h``."""
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = _gain(cg[:-1], ch[:-1], lam) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], lam) - _gain(cg[-1], ch[-1], lam)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """Best four-leaf table on a two-way histogram: one cut on each axis. Also its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    r_g, r_h, c_g, c_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    gain = _gain(a_g, a_h, lam) + _gain(r_g - a_g, r_h - a_h, lam) + _gain(c_g - a_g, c_h - a_h, lam) + _gain(tg - r_g - c_g + a_g, th - r_h - c_h + a_h, lam) - _gain(tg, th, lam)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + lam)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, lam: float = 2.0, max_bins: int = 48, max_pairs: int = 6, pair_rounds: int = 30) -> AdditiveModel:
    """Fit on rows ``x`` (finite floats) with labels ``y`` in {0, 1}; one class or no rows gives a constant model."""
    n, d = x.shape
    rate_of_ones = (y.sum() + 1.0) / (n + 2.0)
    bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if n == 0 or y.min() == y.max():
        return AdditiveModel([np.zeros(0)] * d, bias, [np.zeros(1)] * d, [np.zeros(1, np.int64)] * d)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(d)]
    model = AdditiveModel(edges, bias, [np.zeros(len(e) + 1) for e in edges])
    bins = model.bins(x)
    model.coarse = [np.arange(len(e) + 1) * 8 // (len(e) + 1) for e in edges]
    total = np.full(n, bias)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), lam)
            model.tables[j] += step
            total += step[bins[j]]
    two_way = {(i, j): model.coarse[i][bins[i]] * 8 + model.coarse[j][bins[j]] for i, j in combinations(range(d), 2)}
    hist = lambda key, w: np.bincount(two_way[key], w, 64).reshape(8, 8)
    g, h = slopes()
    ranked = sorted(two_way, key=lambda key: -_pair_tree(hist(key, g), hist(key, h), lam)[1])[:max_pairs]
    tables = {key: np.zeros((8, 8)) for key in ranked}
    for _ in range(pair_rounds):
        for key in ranked:
            g, h = slopes()
            step = rate * _pair_tree(hist(key, g), hist(key, h), lam)[0]
            tables[key] += step
            total += step.ravel()[two_way[key]]
    model.pairs = [(i, j, tables[i, j]) for i, j in ranked]
    return model
