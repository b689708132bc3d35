"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints.

Every tree is complete and stored flat: node i has children 2i+1 and 2i+2, and all rows
walk all trees by array indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): x <= cut goes left
    value: np.ndarray  # (trees, leaves)
    base: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def constant(p: float) -> Trees:
    """A model that scores every row p."""
    return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least_rows: int = 5) -> Trees:
    """Boosted trees for labels y in {0, 1}. monotone: feature -> +1 (score may only rise with it) or -1.

    No rows, or one class only: the smoothed share of ones as a constant.
    """
    n, width = x.shape if x.ndim == 2 else (0, 0)
    if n == 0 or y.min() == y.max():
        return constant((y.sum() + 1) / (n + 2) if n else 0.5)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    raw = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    sign = np.zeros(width, int)
    for j, s in (monotone or {}).items():
        sign[j] = s
    all_f, all_c, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = at - first
            best = np.full(many, 1e-6)
            pick = np.full((many, 2), -1)
            middle = np.zeros(many)
            for j, c in enumerate(cuts):
                b = len(c) + 1
                if b < 2:
                    continue
                key = local * b + coded[:, j]
                gs, hs, ns = (np.bincount(key, w, many * b).reshape(many, b).cumsum(1) for w in (g, h, None))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gr, hr, nr = gs[:, -1:] - gl, hs[:, -1:] - hl, ns[:, -1:] - nl
                lo, hi = low[first : first + many, None], high[first : first + many, None]
                wl, wr = np.clip(gl / (hl + ridge), lo, hi), np.clip(gr / (hr + ridge), lo, hi)
                w0 = np.clip(gs[:, -1:] / (hs[:, -1:] + ridge), lo, hi)
                of = lambda w, g_, h_: 2 * w * g_ - w * w * (h_ + ridge)
                gain = of(wl, gl, hl) + of(wr, gr, hr) - of(w0, gs[:, -1:], hs[:, -1:])
                gain[(nl < least_rows) | (nr < least_rows)] = 0
                if sign[j]:
                    gain[sign[j] * (wr - wl) < 0] = 0
                k = gain.argmax(1)
                top = gain[np.arange(many), k]
                won = top > best
                best[won], pick[won, 0], pick[won, 1] = top[won], j, k[won]
                middle[won] = (0.5 * (wl + wr))[np.arange(many), k][won]
            for i in range(many):
                node, (j, k) = first + i, pick[i]
                left, right = 2 * node + 1, 2 * node + 2
                low[left] = low[right] = low[node]
                high[left] = high[right] = high[node]
                if j >= 0:
                    feature[node], cut[node] = j, cuts[j][k]
                    if sign[j] > 0:
                        high[left] = low[right] = middle[i]
                    elif sign[j] < 0:
                        low[left] = high[right] = middle[i]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = rate * np.clip(gs / (hs + ridge), low[inner:], high[inner:])
        value[~np.isfinite(value)] = 0
        raw += value[leaf]
        all_f.append(feature), all_c.append(cut), all_v.append(value)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_v), base)
