"""Generalised additive models with pairwise interactions, boosted cyclically in numpy.

Each round visits the features in turn and adds a shallow tree on that feature's bins, so a feature's trees
add up to one lookup table; chosen pairs then get tables of their own. A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Additive:
    """Bin edges, lookup tables by feature and by pair, and the intercept of a fitted model."""

    edges: list
    tables: np.ndarray
    pairs: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)
    intercept: float = 0.0
    coarse: int = 8

    def bins(self, x):
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def logit(self, x):
        """Bin additions: one table entry for each feature and pair."""
        b = self.bins(x)
        out = self.intercept + self.tables[np.arange(b.shape[1]), b].sum(axis=1)
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _split(g, h, ridge, least):
    """The best cut of a row of bins by gradient and curvature: (gain, cut) with cut 0 for none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), _gain(gl, hl, ridge) + _gain(gr, hr, ridge), -np.inf)
    if not len(gain) or not np.isfinite(gain.max()):
        return 0.0, 0
    k = int(gain.argmax())
    return float(gain[k] - _gain(g.sum(), h.sum(), ridge)), k + 1


def _tree(g, h, ridge, least):
    """A tree of at most two levels on one feature's bins, as a value for each bin."""
    out = np.zeros(len(g))

    def leaf(lo, hi):
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + ridge)

    gain, cut = _split(g, h, ridge, least)
    if gain <= 0:
        leaf(0, len(g))
        return out
    for lo, hi in ((0, cut), (cut, len(g))):
        gain, inner = _split(g[lo:hi], h[lo:hi], ridge, least)
        if gain > 0:
            leaf(lo, lo + inner)
            leaf(lo + inner, hi)
        else:
            leaf(lo, hi)
    return out


def _pair_tree(g, h, ridge, least):
    """A cut of one feature, then a cut of the other on either side; the better of both orders, with its gain."""
    best = (-np.inf, None)
    for flip in (False, True):
        a, c = (g.T, h.T) if flip else (g, h)
        gain, cut = _split(a.sum(axis=1), c.sum(axis=1), ridge, least)
        cut = cut or len(a) // 2
        out, total = np.zeros_like(a), max(gain, 0.0)
        for rows in (slice(0, cut), slice(cut, len(a))):
            gg, hh = a[rows].sum(axis=0), c[rows].sum(axis=0)
            inner_gain, inner = _split(gg, hh, ridge, least)
            total += max(inner_gain, 0.0)
            for cols in (slice(0, inner), slice(inner, None)):
                if hh[cols].sum() > 0:
                    out[rows, cols] = -gg[cols].sum() / (hh[cols].sum() + ridge)
        if total > best[0]:
            best = (total, out.T if flip else out)
    return best


def fit_additive(x, y, bins: int = 32, rounds: int = 150, rate: float = 0.15, pairs: int = 5, pair_rounds: int = 60, ridge: float = 1.0, least: float = 2.0) -> Additive:
    """Fit on features x (n, d) and labels y (0 or 1) by logistic loss. Without both labels, the prior alone."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    model = Additive(edges, np.zeros((d, bins + 1)))
    rate_1 = (y.sum() + 0.5) / (n + 1)
    model.intercept = float(np.log(rate_1 / (1 - rate_1)))
    if not n or y.min() == y.max():
        return model
    b = model.bins(x)
    f = np.full(n, model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            k = len(edges[j]) + 1
            step = rate * np.clip(_tree(np.bincount(b[:, j], g, k), np.bincount(b[:, j], h, k), ridge, least), -4, 4)
            model.tables[j, :k] += step
            f += step[b[:, j]]
    g, h = slopes()
    size = bins + 1
    coarse = -(-size // model.coarse)

    def grids(i, j, w):
        fine = np.zeros((size, size))
        np.add.at(fine, (b[:, i], b[:, j]), w)
        return fine

    def gain(i, j):
        small = [np.bincount(b[:, i] // coarse * 64 + b[:, j] // coarse, w, 64 * 64).reshape(64, 64)[: model.coarse + 1, : model.coarse + 1] for w in (g, h)]
        return _pair_tree(*small, ridge, least)[0]

    ranked = sorted(((gain(i, j), i, j) for i in range(d) for j in range(i + 1, d)), reverse=True)
    model.pairs = [(i, j) for value, i, j in ranked[:pairs] if value > 0]
    model.pair_tables = [np.zeros((size, size)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            _, step = _pair_tree(grids(i, j, g), grids(i, j, h), ridge, least)
            step = rate * np.clip(step, -4, 4)
            table += step
            f += step[b[:, i], b[:, j]]
    return model
