"""Gradient-boosted regression trees with logistic loss over binned features, and isotonic calibration."""

from __future__ import annotations

import numpy as np

BINS = 64


class Boosted:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, least: int = 8, ridge: float = 1.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        binned = self._bin(x)
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.rate, self.trees = float(np.log(p / (1 - p))), rate, []
        raw = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            gradient, weight = y - p, p * (1 - p)
            nodes: list[list[float]] = []
            leaf = np.zeros(len(y))
            self._grow(nodes, binned, gradient, weight, np.arange(len(y)), depth, least, ridge, leaf)
            self.trees.append(np.array(nodes))
            raw += rate * leaf

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, nodes, binned, gradient, weight, rows, depth, least, ridge, leaf) -> int:
        """Appends (feature, bin, left, right, value); a leaf has feature -1. Returns its number."""
        at, g, h = len(nodes), gradient[rows].sum(), weight[rows].sum()
        value = g / (h + ridge)
        nodes.append([-1, 0, 0, 0, value])
        best = (1e-6, -1, 0)
        if depth and len(rows) >= 2 * least:
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                n, gs, hs = (np.cumsum(np.bincount(b, w, BINS + 1))[:-1] for w in (None, gradient[rows], weight[rows]))
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g * g / (h + ridge)
                gain[(n < least) | (len(rows) - n < least)] = -1
                if gain[k := int(gain.argmax())] > best[0]:
                    best = (gain[k], f, k)
        if best[1] < 0:
            leaf[rows] = value
            return at
        goes = binned[rows, best[1]] <= best[2]
        left = self._grow(nodes, binned, gradient, weight, rows[goes], depth - 1, least, ridge, leaf)
        right = self._grow(nodes, binned, gradient, weight, rows[~goes], depth - 1, least, ridge, leaf)
        nodes[at][:4] = [best[1], best[2], left, right]
        return at

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._bin(x), np.full(len(x), self.base)
        row = np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            feature, cut, left, right = (tree[:, i].astype(np.int64) for i in range(4))
            while (inner := feature[at] >= 0).any():
                goes = binned[row, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            out += self.rate * tree[at, 4]
        return out


class Isotonic:
    """Non-decreasing step means by pooling adjacent violators, read with linear interpolation. Each end is
    drawn in by a count of `prior` on either side, so that no probability is exactly 0 or 1."""

    def __init__(self, raw: np.ndarray, y: np.ndarray, prior: float = 1.0):
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for x, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1.0, x, x])
            while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
                v2, n2, _, hi = blocks.pop()
                v1, n1, lo, _ = blocks.pop()
                blocks.append([v1 + v2, n1 + n2, lo, hi])
        mean = len(y) and y.mean()
        value = np.maximum.accumulate([(v + prior * mean) / (n + prior) for v, n, _, _ in blocks]) if blocks else np.zeros(0)
        self.at = np.array([e for b in blocks for e in b[2:]])
        self.value = np.repeat(value, 2)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.value) if len(self.at) else 1 / (1 + np.exp(-raw))
