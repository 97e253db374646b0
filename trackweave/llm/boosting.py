"""Gradient-boosted regression trees for a binary label, on binned features."""

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of fixed depth as arrays: node k has children 2k+1 and 2k+2; leaves hold log-odds steps."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.base)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(b), dtype=np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0, share: float = 1.0) -> BoostedTrees:
    """Second-order boosting of the logistic loss; splits by histograms of gradients over quantile bins, of a random ``share`` of the rows for each tree."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    inner = (1 << depth) - 1
    model = BoostedTrees(edges, np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), 255, dtype=np.int64), np.zeros((trees, inner + 1)), base)
    b = model.binned(x)
    columns = np.ascontiguousarray(b.T)
    draw = np.random.default_rng(1)
    odds = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        some = np.flatnonzero(draw.random(len(y)) < share)
        seen, gs, hs = columns[:, some].astype(np.int64), g[some], h[some]
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            local = (at[some] - first) * bins
            best = np.full(n, 1e-9)
            for f in range(x.shape[1]):
                key = local + seen[f]
                gl, hl = (np.bincount(key, v, n * bins).reshape(n, bins).cumsum(axis=1) for v in (gs, hs))
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = gl**2 / (hl + least) + gr**2 / (hr + least) - gl[:, -1:] ** 2 / (hl[:, -1:] + least)
                gain[(hl < 1e-3) | (hr < 1e-3)] = 0
                cut = gain.argmax(axis=1)
                better = gain[np.arange(n), cut] > best
                best[better] = gain[np.arange(n), cut][better]
                model.feature[t, first : first + n][better] = f
                model.cut[t, first : first + n][better] = cut[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), model.feature[t][at]] > model.cut[t][at])
        local = at - inner
        model.leaf[t] = rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + least)
        odds += model.leaf[t][local]
    return model
