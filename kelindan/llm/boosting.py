"""Gradient-boosted trees for small feature tables, in numpy: logistic loss, histogram splits, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete binary tree: feature and threshold of inner nodes, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[node]
            node = 2 * node + 1 + (x[rows, f] > self.threshold[node])
        return self.value[node - (2**self.depth - 1)]


@dataclass
class Boosted:
    """Additive trees on the log odds, with a calibrated probability."""

    base: float = 0.0
    rate: float = 0.2
    trees: list[Tree] = field(default_factory=list)
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.margin(x))

    def calibrated(self, m: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return 1 / (1 + np.exp(-m))
        return self.levels[np.clip(np.searchsorted(self.steps, m, side="right") - 1, 0, len(self.levels) - 1)]

    def calibrate(self, m: np.ndarray, y: np.ndarray) -> None:
        """Isotonic fit (pool adjacent violators) of labels on held-out margins, with half a pseudo-case of each class a block."""
        order = np.argsort(m, kind="stable")
        blocks: list[list[float]] = []  # start, positives, size
        for i in order:
            if blocks and blocks[-1][0] == m[i]:
                blocks[-1][1] += y[i]
                blocks[-1][2] += 1
            else:
                blocks.append([m[i], float(y[i]), 1.0])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                last = blocks.pop()
                blocks[-1][1] += last[1]
                blocks[-1][2] += last[2]
        if blocks:
            self.steps = np.array([b[0] for b in blocks])
            self.levels = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: float = 4.0, ridge: float = 1.0) -> Boosted:
    """Boost ``trees`` trees of ``depth`` on 0/1 labels. Deterministic; ties between splits go to the first feature and threshold."""
    y = y.astype(float)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(share / (1 - share))), rate)
    n, width = x.shape
    cuts = [np.unique(x[:, f])[:-1] if len(np.unique(x[:, f])) <= 64 else np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 48))) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, width), int)
    margin = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for k in range(inner):
            here = node == k
            if here.sum() >= 2 * least:
                gs, hs = g[here].sum(), h[here].sum()
                best = gs * gs / (hs + ridge) + 1e-6
                for f in range(width):
                    if not len(cuts[f]):
                        continue
                    b, size = binned[here, f], len(cuts[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[here], h[here], None))
                    gain = gl * gl / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge)
                    gain[(nl < least) | (here.sum() - nl < least)] = -1
                    at = int(np.argmax(gain))
                    if gain[at] > best:
                        best, feature[k], threshold[k] = gain[at], f, cuts[f][at]
            node[here] = 2 * k + 1 + (x[here, feature[k]] > threshold[k])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        tree = Tree(feature, threshold, gs / (hs + ridge), depth)
        model.trees.append(tree)
        margin += rate * tree.value[leaf]
    return model
