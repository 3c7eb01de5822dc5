"""Small learners in numpy: gradient-boosted trees, logistic regression and isotonic calibration.

They fit bounded samples on the driver; the fitted models are a few kilobytes and score any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class BoostedTrees:
    """Logistic boosting of depth-limited trees over binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    leaf_weight: float = 1.0
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = sigmoid(score)
            tree: dict[int, tuple] = {}
            score = score + self.grow(tree, 1, binned, cuts, y - p, p * (1 - p), np.arange(len(y)), np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def grow(self, tree, node, binned, cuts, g, h, rows, out) -> np.ndarray:
        """Nodes are numbered as in a heap; a tree has (feature, cut) of inner nodes and (None, value) of leaves."""
        gs, hs = g[rows].sum(), h[rows].sum()
        best, at = 1e-6, None
        if node < 1 << self.depth and len(rows) >= 10:
            for f, q in enumerate(cuts):
                if not len(q):
                    continue
                b = binned[rows, f]
                gl, hl = (np.cumsum(np.bincount(b, v[rows], len(q) + 1))[:-1] for v in (g, h))
                gain = gl**2 / (hl + self.leaf_weight) + (gs - gl) ** 2 / (hs - hl + self.leaf_weight) - gs**2 / (hs + self.leaf_weight)
                if gain.max() > best:
                    best, at = gain.max(), (f, int(gain.argmax()))
        if at is None:
            tree[node] = (None, self.rate * gs / (hs + self.leaf_weight))
            out[rows] = tree[node][1]
            return out
        tree[node] = (at[0], float(cuts[at[0]][at[1]]))
        left = binned[rows, at[0]] <= at[1]
        self.grow(tree, 2 * node, binned, cuts, g, h, rows[left], out)
        return self.grow(tree, 2 * node + 1, binned, cuts, g, h, rows[~left], out)

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            todo = [(1, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                f, v = tree[node]
                if f is None:
                    score[rows] += v
                elif len(rows):
                    left = x[rows, f] <= v
                    todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
        return score

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps over standardised features."""

    ridge: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        self.w, reg = np.zeros(z.shape[1]), self.ridge * np.r_[1e-6, np.ones(x.shape[1])]
        for _ in range(25):
            p = sigmoid(z @ self.w)
            step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + np.diag(reg), z.T @ (y - p) - reg * self.w)
            self.w = self.w + step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.w[0] + np.clip((x - self.mean) / self.scale, -20, 20) @ self.w[1:]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


@dataclass
class Isotonic:
    """Pool-adjacent-violators calibration; between the pooled points it interpolates."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, rows, least and greatest score
        for s, t in zip(score[order], y[order], strict=True):
            if blocks and blocks[-1][3] == s:  # ties are one point
                blocks[-1][0] += t
                blocks[-1][1] += 1
            else:
                blocks.append([float(t), 1, s, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        self.y = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


def folds(n: int, k: int, seed: int = 0) -> np.ndarray:
    """A balanced fold number for each of n rows."""
    return np.random.default_rng(seed).permutation(n) % k
