"""Gradient-boosted regression trees for a yes-or-no target, over binned features; numpy only."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Additive trees of fixed depth, as arrays: at inner nodes a feature and a cut, at leaves a value."""

    def __init__(self, depth: int, offset: float) -> None:
        self.depth, self.offset = depth, offset
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.offset), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 2.0) -> Trees:
    """Trees for P(y = 1 | x) by second-order boosting of the log loss."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    mean = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(mean / (1 - mean))))
    raw = np.full(len(x), model.offset)
    inner = 2**depth - 1
    used = np.array([f for f, c in enumerate(cuts) if len(c)], dtype=np.int64)
    width = BINS + 1
    flat = bins[:, used] + np.arange(len(used)) * width
    ends = np.array([len(cuts[f]) for f in used])
    real = np.arange(width)[None, :] < ends[:, None]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(depth if len(used) else 0):
            first, nodes = 2**level - 1, 2**level
            cell = (flat + ((at - first) * len(used) * width)[:, None]).ravel()
            shape = (nodes, len(used), width)
            s, b = (np.cumsum(np.bincount(cell, np.repeat(v, len(used)), nodes * len(used) * width).reshape(shape), axis=2) for v in (slope, bend))
            total_s, total_b = s[:, :1, -1:], b[:, :1, -1:]
            gain = s**2 / (b + ridge) + (total_s - s) ** 2 / (total_b - b + ridge) - total_s**2 / (total_b + ridge)
            gain = np.where(real[None], gain, -1).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for node in np.flatnonzero(gain[np.arange(nodes), best] > 1e-6):
                f, k = divmod(int(best[node]), width)
                feature[first + node], cut[first + node] = used[f], cuts[used[f]][k]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        for _ in range(0 if len(used) else depth):
            at = 2 * at + 1
        leaf = at - inner
        value = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + ridge)
        raw += value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
    return model
