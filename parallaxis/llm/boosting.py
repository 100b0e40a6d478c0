"""A small gradient-boosted tree classifier over numeric features (logistic loss, histogram splits)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, leaf: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.leaf, self.bins = rounds, depth, rate, leaf, bins
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, q * (1 - q)
            nodes = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1))  # feature (-1: leaf), threshold, value
            at = np.ones(len(y), dtype=np.int64)
            for node in range(1, 2 ** (self.depth + 1)):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes[node] = (-1, 0.0, -self.rate * gs / (hs + self.leaf))
                if node >= 2**self.depth:
                    continue
                best = (1e-6, -1, 0)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = codes[rows, j]
                    gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + self.leaf) + (gs - gl) ** 2 / (hs - hl + self.leaf) - gs**2 / (hs + self.leaf)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    _, j, k = best
                    nodes[node] = (j, float(edges[j][k]), nodes[node][2])
                    right = codes[rows, j] > k
                    at[rows] = 2 * node + right
            self.trees.append(nodes)
            f += self._tree(nodes, x)
        return self

    def _tree(self, nodes: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            j, threshold, value = nodes[node]
            if j < 0:
                out[rows] = value
                continue
            right = x[rows, j] > threshold
            todo += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for nodes in self.trees:
            f += self._tree(nodes, x)
        return 1 / (1 + np.exp(-f))
