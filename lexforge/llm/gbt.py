"""Gradient-boosted trees in numpy: histogram fitting, flat node arrays, monotone constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """A forest flattened into node arrays; leaves point at themselves.

    node i sends a row to left[i] when row[feature[i]] <= cut[i], else to right[i]. monotone maps a
    feature to +1 (the margin never falls as it grows) or -1 (never rises): splits against the sign
    are refused and child values are held within the bounds set by earlier constrained splits.
    """

    rounds: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 48
    reg: float = 2.0
    least_rows: float = 8.0
    monotone: dict[int, int] = field(default_factory=dict)
    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values: every tree is walked by all rows at once, depth steps each."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        """Second-order boosting of the weighted logistic loss."""
        weight = np.ones(len(y)) if weight is None else weight
        p = float(np.clip((weight @ y + 0.5) / (weight.sum() + 1), 1e-4, 1 - 1e-4))
        self.base = float(np.log(p / (1 - p)))
        nodes: list[list] = []
        roots: list[int] = []
        if len(y) and y.min() != y.max():
            cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
            starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])]).astype(np.int64)
            codes = (np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) + starts[:-1]).astype(np.int32)
            margin = np.full(len(y), self.base)
            for _ in range(self.rounds):
                prob = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                g, h = weight * (prob - y), weight * np.maximum(prob * (1 - prob), 1e-6)
                roots.append(len(nodes))
                self._grow(nodes, codes, starts, cuts, g, h, np.arange(len(y)), 0, -np.inf, np.inf, margin)
        arrays = [np.array(a) for a in zip(*nodes, strict=True)] or [np.zeros(0)] * 5
        self.feature, self.cut = arrays[0].astype(np.int32), arrays[1].astype(float)
        self.left, self.right = arrays[2].astype(np.int32), arrays[3].astype(np.int32)
        self.value, self.roots = arrays[4].astype(float), np.array(roots, dtype=np.int32)
        return self

    def _grow(self, nodes, codes, starts, cuts, g, h, rows, level, low, high, margin) -> int:
        at = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + self.reg), low, high))
        nodes.append([0, np.inf, at, at, self.rate * value])
        best = self._best(codes, starts, cuts, g, h, rows, total_g, total_h, low, high) if level < self.depth and len(rows) >= 2 * self.least_rows else None
        if best is None:
            margin[rows] += self.rate * value
            return at
        j, k, lv, rv = best
        goes = codes[rows, j] <= starts[j] + k
        sign, mid = self.monotone.get(j, 0), (lv + rv) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[sign]
        a = self._grow(nodes, codes, starts, cuts, g, h, rows[goes], level + 1, *bounds[0], margin)
        b = self._grow(nodes, codes, starts, cuts, g, h, rows[~goes], level + 1, *bounds[1], margin)
        nodes[at] = [j, cuts[j][k], a, b, 0.0]
        return at

    def _best(self, codes, starts, cuts, g, h, rows, total_g, total_h, low, high):
        """Best (feature, bin, left value, right value) over all features at once; codes number the bins of all."""
        flat = codes[rows].ravel()
        width, size = codes.shape[1], int(starts[-1])
        n = np.bincount(flat, minlength=size).astype(float)
        lg = np.bincount(flat, np.repeat(g[rows], width), size)
        lh = np.bincount(flat, np.repeat(h[rows], width), size)

        def inside(x: np.ndarray) -> np.ndarray:
            """Running sums within each feature."""
            total = np.cumsum(x)
            ahead = np.concatenate([[0.0], total])[starts[:-1]]
            return total - np.repeat(ahead, np.diff(starts))

        n, lg, lh = inside(n), inside(lg), inside(lh)
        rg, rh = total_g - lg, total_h - lh
        lv, rv = np.clip(-lg / (lh + self.reg), low, high), np.clip(-rg / (rh + self.reg), low, high)
        gains = lg**2 / (lh + self.reg) + rg**2 / (rh + self.reg) - total_g**2 / (total_h + self.reg)
        ok = (n >= self.least_rows) & (len(rows) - n >= self.least_rows)
        feature = np.repeat(np.arange(width), np.diff(starts))
        ok[starts[1:] - 1] = False  # the last bin of a feature is no cut
        if self.monotone:
            sign = np.array([self.monotone.get(j, 0) for j in range(width)])[feature]
            ok &= sign * (rv - lv) >= 0
        gains = np.where(ok, gains, -np.inf)
        k = int(np.argmax(gains))
        return (int(feature[k]), k - int(starts[feature[k]]), float(lv[k]), float(rv[k])) if gains[k] > 1e-6 else None
